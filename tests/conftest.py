import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sievework.session import session

    s = session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__default__parallelism="4",
        spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "prepared_urls url_features url_scores raw_urls label_conflicts top_character_ngrams documents eval_items".split():
        con.sql(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con


def same_rows(spark_df, duck_rel):
    """Whether both hold the same rows, whatever their order."""
    cols = sorted(spark_df.columns)
    assert cols == sorted(duck_rel.columns)

    def plain(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v):.9g}"
        return str(v)

    a = sorted(tuple(plain(r[c]) for c in cols) for r in spark_df.collect())
    at = [duck_rel.columns.index(c) for c in cols]
    b = sorted(tuple(plain(r[i]) for i in at) for r in duck_rel.fetchall())
    assert a == b
