"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize
from .skew import spread_join


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Link every neighbour that ``keep`` admits to the least node of the neighbourhood of ``u``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("mv"), F.count(F.lit(1)).alias("w"))
    least = least.select("u", F.least("u", "mv").alias("m"), "w")
    linked = spread_join(pairs, least, "u", weight="w", total=pairs.count())
    return keep(linked)


def components(edges: DataFrame, a: str, b: str, *, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of the graph whose undirected edges are the columns ``a`` and ``b``.

    The component is its least node. Both columns need one orderable type. Self-loops give a node of its own; edges
    with a null end are passed over; repeated edges count once; an empty table gives an empty result. Hubs are spread
    (see ``spread_join``); every round is written to the shared folder, so lineage stays short, and
    the one before is deleted.
    """
    nodes_only = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = nodes_only.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    e = nodes_only.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).select("u", "v").distinct()
    e = materialize(e)

    def mark(d: DataFrame) -> tuple:
        return tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, lambda d: d.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()))

        def small(d: DataFrame) -> DataFrame:
            down = d.select(F.col("v").alias("u"), F.col("m").alias("v"))
            return down.union(d.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

        e, before = materialize(_star(large, small)), e
        discard(large, before)
        now = mark(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    inner = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node")).union(loops).distinct().join(inner.select("node"), "node", "left_anti")
    return inner.union(roots.select("node", F.col("node").alias("component")))
