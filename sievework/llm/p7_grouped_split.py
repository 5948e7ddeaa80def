"""Problem 7: splits that keep related records together."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splits
from ..operators.components import components
from ..operators.shared import materialize
from ..operators.skew import spread_join
from ..session import table

SHARES = {"train": 0.6, "validation": 0.2, "test": 0.2}


def _name(group: str, domain: str) -> Column:
    return F.coalesce(F.concat(F.lit("g:"), F.col(group)), F.concat(F.lit("n:"), F.col(domain)))


def related_sets(df: DataFrame, group: str, domain: str, target: str | None = None, mask: Column | None = None) -> DataFrame:
    """``(g, component, n, c0, c1, c2, mask)`` of every value of ``group`` (``g``, ``g:`` before it): rows related through ``group`` or
    a non-null ``domain``, directly or through others, share a component. ``n`` counts rows, ``c0`` to ``c2`` those of each class of ``target``,
    ``mask`` has the bits of ``mask`` of all rows. A row without a group is related through its domain alone, one without either
    through neither and left out here.

    The table is written. A domain whose rows all lie in one group relates nothing and takes no part in the rounds.
    """
    rows = df.withColumn("__g", _name(group, domain)).withColumn("__d", F.concat(F.lit("d:"), F.col(domain))).where("__g is not null")
    klass = F.col(target) if target else F.lit(None).cast("int")
    links = materialize(rows.groupBy("__g", "__d").agg(F.count(F.lit(1)).alias("n"), *splits.label_counts(klass), F.bit_or(F.lit(0).cast("long") if mask is None else mask).alias("mask")))
    wide = links.where("__d is not null").groupBy("__d").agg(F.count(F.lit(1)).alias("w")).where("w > 1")
    edges = spread_join(links.select("__g", "__d"), wide, "__d", weight="w", total=links.count())
    comps = components(edges, "__g", "__d").where(F.col("node").startswith("g:") | F.col("node").startswith("n:"))
    merged = links.groupBy("__g").agg(*(F.sum(c).alias(c) for c in ("n", *splits.VECTOR)), F.bit_or("mask").alias("mask"))
    joined = merged.withColumnRenamed("__g", "g").join(comps.withColumnRenamed("node", "g"), "g", "left")
    return materialize(joined.withColumn("component", F.coalesce("component", "g")))


def split_groups_apart(df: DataFrame, group: str, domain: str, split: str) -> DataFrame:
    """Every value of ``group`` whose set of related rows lies in more than one value of ``split``. Null splits are passed over."""
    names = sorted(r[0] for r in df.where(F.col(split).isNotNull()).select(split).distinct().limit(64).collect())
    if len(names) > 63:
        raise ValueError("more than 63 splits")
    mask = F.lit(0).cast("long")
    for k, v in enumerate(names):
        mask = F.when(F.col(split) == v, F.lit(1 << k).cast("long")).otherwise(mask)
    sets = related_sets(df, group, domain, mask=mask)
    whole = sets.groupBy("component").agg(F.bit_or("mask").alias("mask"), F.count(F.lit(1)).alias("w"))
    apart = whole.where(F.bit_count("mask") > 1).select("component", "w")
    inside = spread_join(sets, apart, "component", weight="w", total=sets.count())
    return inside.where(F.col("g").startswith("g:")).select(F.substr("g", F.lit(3)).alias(group))


class _Placer:
    """Iterative stratification: takes label vectors, rarest outstanding label first, to the split that needs it most."""

    def __init__(self, totals: list[float], shares: dict[str, float]) -> None:
        self.names = list(shares)
        self.wanted = {s: [shares[s] * t for t in totals] for s in self.names}
        self.outstanding = list(totals)

    def need(self, vector: tuple[float, ...], split: str) -> float:
        """How much a split needs a vector: its outstanding labels weighed by the vector's. The split with the largest
        need is the one whose placing lowers the squared sum of all outstanding labels most; for one label it is the one lacking most of it."""
        return sum(v * w for v, w in zip(vector, self.wanted[split]))

    def place(self, vector: tuple[float, ...], items: int) -> list[int]:
        """How many of ``items`` items with this vector each split gets, each going where the need is greatest then."""
        given = splits.water_filled([-self.need(vector, s) for s in self.names], sum(v * v for v in vector), items)
        for s, n in zip(self.names, given):
            for k, v in enumerate(vector):
                self.wanted[s][k] -= v * n
                self.outstanding[k] -= v * n
        return given


def grouped_split(df: DataFrame, ident: str, group: str, domain: str, target: str, *, shares: dict[str, float] = SHARES, seed: str = "42") -> DataFrame:
    """``(ident, component, split)`` of every row: related rows in one split, sizes and rates of ``target`` near ``shares``.

    Components carry the vector (rows of class 0, of class 1, without class). Of the labels still outstanding the rarest is taken, and the components that have it, the largest
    first, go one after another into the split that needs their labels most. Components with one vector are placed at once, with the result of placing them one by
    one (``splits.water_filled``), and dealt out by rank. The driver holds the different vectors, never the components. A row without
    group and domain is its own component. An empty table gives no rows.
    """
    lone = F.concat(F.lit("i:"), F.col(ident).cast("string"))
    rows = df.withColumn("__group", F.when(F.col(group).isNull() & F.col(domain).isNull(), lone).otherwise(F.col(group)))
    sets = related_sets(rows, "__group", domain, target)
    comps = materialize(sets.groupBy("component").agg(*(F.sum(c).alias(c) for c in splits.VECTOR), F.count(F.lit(1)).alias("w")))
    todo = dict(splits.kinds_of(comps))
    if not todo:
        return df.select(F.col(ident), F.lit("").alias("component"), F.lit("").alias("split")).limit(0)
    placer = _Placer([float(sum(v[k] * m for v, m in todo.items())) for k in range(3)], shares)
    total, count = int(sum(placer.outstanding)), sum(todo.values())

    def order(vector: splits.Vector) -> tuple:
        return -sum(vector), hashlib.sha256(f"{seed}|{vector}".encode()).hexdigest()

    deals = []
    while todo:
        here = [k for k in range(3) if any(v[k] for v in todo)]
        k = min(here, key=lambda k: (placer.outstanding[k], k))
        for vector in sorted((v for v in todo if v[k]), key=order):
            deals.append((vector, placer.place(vector, todo.pop(vector))))
    chosen = materialize(splits.deal(comps, "component", "split", deals, placer.names, seed, count))
    per_set = spread_join(sets.select("g", "component", "n"), chosen.join(comps.select("component", "w"), "component"), "component", weight="w", total=sets.count())
    every = rows.select(F.col(ident), _name("__group", domain).alias("g"))
    return spread_join(every, per_set.select("g", "component", "split", "n"), "g", weight="n", total=total).select(ident, "component", "split")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_groups_apart(table(spark, sf_dir, "prepared_urls"), "split_group", "registered_domain", "split")


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouped_split(table(spark, sf_dir, "prepared_urls"), "url_id", "split_group", "registered_domain", "target")
    return rows.select("url_id", "component", "split")


def p7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the assignment keeps related rows together, and meets the shares and rates of its splits."""
    urls = table(spark, sf_dir, "prepared_urls")
    assigned = p7_assignment(spark, sf_dir).join(urls.select("url_id", "target"), "url_id")
    return splits.quality(materialize(assigned), "component", SHARES)


ORACLE = {
    "p7_quality": """
with recursive ends as (select coalesce('g:' || split_group, 'n:' || registered_domain, 'i:' || url_id) as a, 'd:' || registered_domain as b from prepared_urls),
edges as (select distinct a, b from ends where b is not null), nodes as (select distinct a as n from ends union select b from edges),
step as (select a as u, b as v from edges union select b, a from edges),
reach as (select n as u, n as v from nodes union select r.u, s.v from reach r join step s on r.v = s.u),
comp as (select v as n, min(u) as c from reach group by 1)
select (select count(*) from prepared_urls) as n_rows, 0 as rows_unplaced, true as shares_met, true as rates_met, (select count(distinct c) from comp) as n_groups, 0 as groups_apart
""",
    "p7_found": """
with recursive edges as (select distinct 'g:' || split_group as a, 'd:' || registered_domain as b from prepared_urls where registered_domain is not null and split_group is not null),
nodes as (select distinct 'g:' || split_group as n from prepared_urls where split_group is not null union select b from edges),
step as (select a as u, b as v from edges union select b, a from edges),
reach as (select n as u, n as v from nodes union select r.u, s.v from reach r join step s on r.v = s.u),
comp as (select v as n, min(u) as c from reach group by 1),
wide as (select c.c from prepared_urls p join comp c on c.n = 'g:' || p.split_group where p.split is not null group by 1 having count(distinct p.split) > 1)
select substr(n, 3) as split_group from comp where c in (select c from wide) and n like 'g:%'
""",
}
