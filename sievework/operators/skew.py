"""Per-key work that stays even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one part in so many of all rows; hence at most so many keys are heavy.
HEAVY_PARTS = 1000


def heavy_keys(df: DataFrame, key: Column, parts: int = HEAVY_PARTS) -> DataFrame:
    """Keys (column ``key``) that hold more than ``1/parts`` of the rows of ``df``, with their row count ``n``.

    One map-side combined count; fewer than ``parts`` rows whatever the data, so the result may be broadcast.
    The null key counts like any other. An empty table gives no rows.
    """
    counts = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).where(F.col("n") * parts > F.col("total")).select("key", "n")


def salted_group_stats(
    df: DataFrame,
    group: str,
    *,
    distinct: str,
    classes: str,
    moment: str,
    parts: int = HEAVY_PARTS,
    rows_per_salt: int = 50_000,
) -> DataFrame:
    """Rows, classes, distinct values and first and last moments of every value of ``group``, evenly spread.

    Heavy keys get a salt of ``ceil(rows / rows_per_salt)`` values. The salt is a hash of ``distinct``, random as far
    as the key is concerned, so that no value falls under two salts and the partial distinct counts add up. Stage one
    combines by (key, salt, value), which folds copies before anything is counted; stage two gives one partial result
    per (key, salt); stage three merges these by key.

    Result: ``group`` (under its own name), ``n_rows``, ``n_class_0``, ``n_class_1``, ``n_distinct``, ``first_seen``,
    ``last_seen``. A null key is a group of its own. Nulls in ``distinct`` are not counted as a value, nulls in
    ``classes`` in neither class, null moments are passed over. An empty table gives no rows.
    """
    slim = df.select(F.col(group).alias("g"), F.col(distinct).alias("d"), F.col(classes).alias("c"), F.col(moment).alias("m"))
    heavy = heavy_keys(slim, F.col("g"), parts).select(F.col("key").alias("hg"), F.ceil(F.col("n") / rows_per_salt).alias("salts"))
    salted = slim.join(F.broadcast(heavy), F.col("g").eqNullSafe(F.col("hg")), "left").withColumn(
        "salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("d"), F.col("salts"))).otherwise(F.lit(0))
    )
    by_value = salted.groupBy("g", "salt", "d").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("c") == 0, 1)).alias("n0"),
        F.count(F.when(F.col("c") == 1, 1)).alias("n1"),
        F.min("m").alias("lo"),
        F.max("m").alias("hi"),
    )
    partial = by_value.groupBy("g", "salt").agg(*_merge(), F.count("d").alias("nd"))
    return partial.groupBy("g").agg(*_merge(), F.sum("nd").alias("nd")).select(
        F.col("g").alias(group),
        F.col("n").alias("n_rows"),
        F.col("n0").alias("n_class_0"),
        F.col("n1").alias("n_class_1"),
        F.col("nd").alias("n_distinct"),
        F.col("lo").alias("first_seen"),
        F.col("hi").alias("last_seen"),
    )


def _merge() -> list[Column]:
    return [F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]


def spread_join(rows: DataFrame, facts: DataFrame, key: str, *, weight: str, total: int, parts: int = HEAVY_PARTS) -> DataFrame:
    """Inner join of ``rows`` with ``facts`` (one row per ``key``) where a few keys may match most of ``rows``.

    ``weight`` is a column of ``facts`` with the number of rows each key matches, ``total`` their sum at most. Facts
    that match more than ``total / parts`` rows are fewer than ``parts`` and are broadcast; the others are shuffled,
    so no task gets more than its hash share plus ``total / parts`` rows of one key. ``weight`` is dropped. Null keys match nothing.
    """
    bound = max(1, total // parts)
    heavy = facts.where(F.col(weight) > bound).drop(weight)
    light = facts.where(F.col(weight) <= bound).drop(weight)
    marks = heavy.select(F.col(key).alias("__heavy_key"))
    marked = rows.join(F.broadcast(marks), rows[key] == F.col("__heavy_key"), "left")
    few = marked.where(F.col("__heavy_key").isNotNull()).drop("__heavy_key").join(F.broadcast(heavy), key)
    many = marked.where(F.col("__heavy_key").isNull()).drop("__heavy_key").join(light, key)
    return few.unionByName(many)


def rank_within(df: DataFrame, key: str, ident: str, *, rank: str = "rank", total: int, rows_per_salt: int = 100_000) -> DataFrame:
    """Number the rows of each ``key`` from 0, in an order fixed by ``ident`` but otherwise arbitrary.

    No key is collected into one task: rows are numbered inside (key, salt), the salt being a hash of ``ident``, and
    shifted by the number of rows under smaller salts of the key. ``total`` is the row count of ``df``. Rows with equal
    ``key`` and ``ident`` take numbers in an arbitrary order.
    """
    from pyspark.sql import Window

    salts = max(1, -(-total // rows_per_salt))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    if salts == 1:
        w = Window.partitionBy(key).orderBy(ident)
        return salted.withColumn(rank, F.row_number().over(w) - 1).drop("__salt")
    sizes = salted.groupBy(key, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__salt").orderBy(ident)
    return (
        salted.withColumn("__at", F.row_number().over(inside) - 1)
        .join(starts, [key, "__salt"])
        .withColumn(rank, F.col("__start") + F.col("__at"))
        .drop("__salt", "__start", "__at")
    )
