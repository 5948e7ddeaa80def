"""Profiles of the prepared table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import class_label
from .shared import distinct_counts

MEASURES = ("url_length", "digit_count", "symbol_count")


def measured(df: DataFrame, url: str = "url_model_input") -> DataFrame:
    """``df`` with length, digits and symbols of its URLs; nulls stay null."""
    u = F.col(url)
    return df.withColumns({"url_length": F.length(u), "digit_count": F.regexp_count(u, F.lit(r"(?U)\d")), "symbol_count": F.regexp_count(u, F.lit("[^A-Za-z0-9]"))})


def class_summary(df: DataFrame) -> DataFrame:
    """Rows, different groups and share in percent (half to even, two places) of each target; a null target is a class of its own."""
    per = df.groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split_group").alias("n_groups"))
    share = F.bround(F.col("n_rows") * 100.0 / F.sum("n_rows").over(Window.partitionBy(F.lit(0))), 2)
    return per.select("target", class_label(F.col("target")).alias("class"), "n_rows", "n_groups", share.alias("percent"))


def class_counts(df: DataFrame) -> DataFrame:
    """Rows of target 0 and of target 1, zero where there are none."""
    one = df.agg(F.count_if(F.col("target") == 0).alias("a"), F.count_if(F.col("target") == 1).alias("b"))
    return one.select(F.explode(F.array(F.struct(F.lit(0).alias("target"), F.col("a").alias("n_rows")), F.struct(F.lit(1).alias("target"), F.col("b").alias("n_rows")))).alias("r")).select("r.*")


def domain_frequency(df: DataFrame) -> DataFrame:
    """Rows of each target and domain; null domains are kept."""
    return df.groupBy("target", "registered_domain").agg(F.count(F.lit(1)).alias("n_rows"))


def top_domains_by_class(df: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent domains of each target, ties by name, nulls first."""
    w = Window.partitionBy("target").orderBy(F.desc("n_rows"), F.asc_nulls_first("registered_domain"))
    return domain_frequency(df).withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def top_domains(df: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent domains, a missing one shown as ``<invalid>``, ties by name."""
    shown = F.coalesce("registered_domain", F.lit("<invalid>")).alias("domain")
    return df.groupBy(shown).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), "domain").limit(n)


def describe(df: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Count, mean, sample deviation, minimum, four exact quantiles and maximum of each measure, one row per statistic,
    half-even to two places. Quantiles interpolate linearly."""
    names = ["count", "mean", "std", "min", "50%", "90%", "95%", "99%", "max"]
    aggs = []
    for m in measures:
        q = F.percentile(m, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
        aggs.append(F.array(F.count(m).cast("double"), F.avg(m), F.stddev_samp(m), F.min(m).cast("double"), q[0], q[1], q[2], q[3], F.max(m).cast("double")).alias(m))
    one = df.agg(*aggs)
    rows = F.arrays_zip(F.array(*(F.lit(n) for n in names)).alias("statistic"), *measures)
    picked = one.select(F.explode(rows).alias("r"))
    return picked.select(F.col("r.statistic").alias("statistic"), *(F.bround(F.col(f"r.{m}"), 2).alias(m) for m in measures))


def overview(df: DataFrame) -> DataFrame:
    """Counters over the whole table; duplicates are rows beyond the first of their value."""
    counted = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("url_model_input").isNull()).alias("null_inputs"),
        F.count_if(~F.col("is_valid_url")).alias("invalid_rows"),
        F.count("url_model_input").alias("inputs"),
        F.count("url_dedupe_key").alias("keys"),
    )
    for one in distinct_counts(df, "split_group", "url_model_input", "url_dedupe_key"):
        counted = counted.crossJoin(F.broadcast(one))
    return counted.select(
        "n_rows", "null_inputs", "invalid_rows", F.col("n_split_group").alias("n_groups"),
        (F.col("inputs") - F.col("n_url_model_input")).alias("duplicate_inputs"), (F.col("keys") - F.col("n_url_dedupe_key")).alias("duplicate_keys"),
    )


def histogram(df: DataFrame, value: str, bins: int = 50, by: str | tuple[str, ...] = ()) -> DataFrame:
    """``(by, bin, n_rows, low, high)``: equal bins between the least and largest value (of each ``by``), the last closed; empty bins have no row.

    Nulls are left out; a single value falls into the middle of a range of width one around it.
    """
    keys = [by] if isinstance(by, str) else list(by)
    x = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v")).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    ends = x.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    same = F.col("lo") == F.col("hi")
    ends = ends.select(*keys, F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    both = x.join(F.broadcast(ends), keys) if keys else x.crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int").alias("bin")
    out = both.groupBy(*keys, at, "lo", "hi").agg(F.sum("n").alias("n_rows"))
    edge = lambda k: F.round(F.col("lo") + k * (F.col("hi") - F.col("lo")) / bins, 6)
    return out.select(*keys, "bin", "n_rows", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"))
