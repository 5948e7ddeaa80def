"""Problem 4: results per group when a few groups hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_group_stats
from ..session import table


def _stats(spark: SparkSession, sf_dir: str, group: str) -> DataFrame:
    urls = table(spark, sf_dir, "prepared_urls")
    return salted_group_stats(urls, group, distinct="url_dedupe_key", classes="target", moment="first_seen")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of ``split_group`` with more than 2 % of the rows."""
    groups = _stats(spark, sf_dir, "split_group").where("split_group is not null")
    rows = table(spark, sf_dir, "prepared_urls").count()
    return groups.where(F.col("n_rows") * 50 > rows).select("split_group")


def _with_micros(df: DataFrame) -> DataFrame:
    """Moments as microseconds since 1970, which every engine compares alike."""
    return df.withColumns({c: F.unix_micros(c) for c in ("first_seen", "last_seen")})


def p4_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_micros(_stats(spark, sf_dir, "split_group"))


def p4_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_micros(_stats(spark, sf_dir, "registered_domain"))


def _sql(group: str) -> str:
    return f"""select {group}, count(*) as n_rows, count(*) filter (target = 0) as n_class_0, count(*) filter (target = 1) as n_class_1,
    count(distinct url_dedupe_key) as n_distinct, epoch_us(min(first_seen)) as first_seen, epoch_us(max(first_seen)) as last_seen from prepared_urls group by {group}"""


QUERIES = {"p4_found": p4_found, "p4_split_groups": p4_split_groups, "p4_domains": p4_domains}
ORACLE = {
    "p4_found": "select split_group from prepared_urls where split_group is not null group by 1 having count(*) > 0.02 * (select count(*) from prepared_urls)",
    "p4_split_groups": _sql("split_group"),
    "p4_domains": _sql("registered_domain"),
}
