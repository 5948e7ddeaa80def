"""From raw labelled URLs to prepared records and label conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.suffix import TEST_RULES, registered_domain
from ..functions.urls import convert_target, dedupe_key, is_valid, split_group, stripped, with_parts
from .shared import distinct_counts, materialize
from .skew import spread_join


def find_column(df: DataFrame, name: str) -> str:
    """The column that is called ``name`` but for case and white space around it."""
    for c in df.columns:
        if c.strip().lower() == name.strip().lower():
            return c
    raise ValueError(f"no column {name!r} among {df.columns}")


def validate_raw(df: DataFrame, url: str = "url", label: str = "label") -> None:
    """Raise ValueError unless the table has rows, every row a URL and every label that is not null is 0 or 1. One pass.

    A null label is found later, when it is to be converted."""
    for c in (url, label):
        find_column(df, c)
    u, x = F.col(find_column(df, url)), F.col(find_column(df, label))
    n, no_url, odd = df.agg(F.count(F.lit(1)), F.count_if(u.isNull()), F.count_if(~x.isin(0, 1))).first()
    if not n:
        raise ValueError("the raw table is empty")
    if no_url:
        raise ValueError(f"{no_url} rows have no URL")
    if odd:
        raise ValueError(f"{odd} rows have a label other than 0 and 1")


def derived(df: DataFrame, url: str, label: str, order: str, rules=TEST_RULES, set_aside: bool = False) -> DataFrame:
    """The working columns of every row with a non-blank URL; ``order`` is kept as ``row_order``. A label that is neither 0 nor 1 is an error, or with
    ``set_aside`` leaves its row out."""
    slim = df.select(F.col(order).alias("row_order"), F.col(url).alias("url_original"), F.col(label).alias("source_label"))
    x = slim.withColumn("url_model_input", stripped(F.col("url_original"))).where("url_model_input <> ''")
    if set_aside:
        x = x.where(F.col("source_label").isin(0, 1))
    x = with_parts(x, "url_model_input").withColumn("url_dedupe_key", dedupe_key())
    domain: Column = registered_domain(df.sparkSession, F.col("parts.host"), rules)
    x = x.withColumns({"registered_domain": domain, "is_valid_url": is_valid(), "target": convert_target(F.col("source_label"))})
    x = x.withColumn("split_group", split_group(F.col("registered_domain"), F.col("url_dedupe_key")))
    return x.select("row_order", *PREPARED)


PREPARED = "url_original source_label url_model_input url_dedupe_key registered_domain is_valid_url target split_group".split()


def marked(df: DataFrame, url: str = "url", label: str = "label", order: str = "row_id", rules=TEST_RULES, set_aside: bool = False) -> DataFrame:
    """The working rows with ``conflicting`` (their key has both targets) and ``first`` (first row of key and target).

    Keys are judged by one map-side combined aggregate, whose result is joined back with heavy keys spread. Rows that
    tie in ``order`` count as one first row each.
    """
    x = materialize(derived(df, url, label, order, rules, set_aside))
    first = lambda t: F.min(F.when(F.col("target") == t, F.col("row_order")))
    keys = x.groupBy("url_dedupe_key").agg(first(0).alias("first_0"), first(1).alias("first_1"), F.count(F.lit(1)).alias("n"))
    y = spread_join(x, keys, "url_dedupe_key", weight="n", total=x.count())
    mine = F.when(F.col("target") == 0, F.col("first_0")).otherwise(F.col("first_1"))
    return y.select("row_order", *PREPARED, (F.col("first_0").isNotNull() & F.col("first_1").isNotNull()).alias("conflicting"), (F.col("row_order") == mine).alias("first"))


def prepare(df: DataFrame, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(prepared, conflicts, summary)``.

    Rows with a null or blank URL are dropped. All rows of a key that has both labels are conflicts; of the others the
    first row of each key is prepared. Sort by key and ``row_order`` where an order is wanted. An empty table gives
    empty tables and a summary of zeros. The summary has the nine counters as one row; with ``set_aside`` rows whose label is neither 0 nor 1 are no error but
    left out, and counted as ``bad_label_rows`` (those with a URL).
    """
    m = materialize(marked(df, **how))
    prepared = m.where("not conflicting and first").select("row_order", *PREPARED)
    conflicts = m.where("conflicting").select("row_order", *PREPARED)
    blank = stripped(F.col(how.get("url", "url"))) == ""
    bad = [F.count_if(~blank & ~F.coalesce(F.col(how.get("label", "label")).isin(0, 1), F.lit(False))).alias("bad_label_rows")] if how.get("set_aside") else []
    raw = df.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(blank).alias("empty_rows"), *bad)
    kept = ~F.col("conflicting") & F.col("first")
    rest = m.agg(
        F.count(F.lit(1)).alias("rows_after_empty"),
        F.count_if("conflicting").alias("conflicting_rows"),
        F.count_if(~F.col("conflicting") & ~F.col("first")).alias("duplicates_removed"),
        F.count_if(kept).alias("prepared_rows"),
        F.count_if(kept & ~F.col("is_valid_url")).alias("invalid_retained"),
    )
    (keys,), (groups,) = distinct_counts(conflicts, "url_dedupe_key"), distinct_counts(prepared, "split_group")
    whole = raw.crossJoin(F.broadcast(rest)).crossJoin(F.broadcast(keys)).crossJoin(F.broadcast(groups))
    whole = whole.withColumnsRenamed({"n_url_dedupe_key": "conflicting_keys", "n_split_group": "unique_groups"})
    counters = "rows_after_empty conflicting_keys conflicting_rows duplicates_removed prepared_rows invalid_retained unique_groups".split()
    return prepared, conflicts, whole.select(*raw.columns, *counters)
