"""Stratified grouped folds, their summary and their integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .skew import rank_within, spread_join

FOLDS = 5
REQUIRED = ("url_dedupe_key", "url_model_input", "split_group", "target")
#: Rows of class 0, of class 1 and without either, of a group.
VECTOR = ("c0", "c1", "c2")
Vector = tuple[int, int, int]


def split_name(fold: Column) -> Column:
    return F.when(fold.isin(0, 1, 2), "train").when(fold == 3, "validation").otherwise("test")


def validate_input(df: DataFrame) -> None:
    """Raise ValueError unless the columns are there, there are rows, two classes and no null group."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    n, no_group, classes = df.agg(F.count(F.lit(1)), F.count_if(F.col("split_group").isNull()), F.count_distinct("target")).first()
    if not n:
        raise ValueError("there are no rows")
    if no_group:
        raise ValueError(f"{no_group} rows have no group")
    if classes != 2:
        raise ValueError("the split needs exactly two classes")


def label_counts(target: Column) -> list[Column]:
    """The columns of ``VECTOR``, as aggregates."""
    known = F.coalesce(target.isin(0, 1), F.lit(False))
    return [F.count_if(target == 0).alias("c0"), F.count_if(target == 1).alias("c1"), F.count_if(~known).alias("c2")]


def water_filled(levels: list[float], step: float, items: int) -> list[int]:
    """How many of ``items`` equal items each holder gets if every item goes to the one at the lowest level, the first on ties, and raises it by ``step``.

    The result of placing them one after another, without doing so: holders are filled up to one common level, and only the rest, fewer than there are holders, is placed singly.
    """
    order = sorted(levels)
    top = order[0]
    for k in range(1, len(order) + 1):
        top = (items * step + sum(order[:k])) / k
        if k == len(order) or top <= order[k]:
            break
    given = [min(items, max(0, int((top - x) / step + 1e-9))) for x in levels]
    while sum(given) > items:  # by rounding
        given[max(range(len(levels)), key=lambda i: (levels[i] + given[i] * step) if given[i] else -float("inf"))] -= 1
    for _ in range(items - sum(given)):
        given[min(range(len(levels)), key=lambda i: (levels[i] + given[i] * step, i))] += 1
    return given


def kinds_of(items: DataFrame) -> list[tuple[Vector, int]]:
    """The different vectors of ``items`` and how many items have each. The items stay where they are: vectors of n rows of all items
    together are of the order of n to the power 2/3 at most, and far fewer where sizes are small."""
    t = items.groupBy(*VECTOR).agg(F.count(F.lit(1)).alias("m")).toArrow()
    c0, c1, c2, m = (t.column(c).to_pylist() for c in (*VECTOR, "m"))
    return list(zip(zip(c0, c1, c2), m))


def deal(items: DataFrame, name: str, holder: str, deals: list[tuple[Vector, list[int]]], holders: list, seed: str, total: int) -> DataFrame:
    """``(name, holder)`` of every item: of the items with one vector, in an order set by ``seed``, the first go to the first holder and so on, as many as ``deals`` gives it."""
    import pyarrow as pa

    vectors, until = zip(*deals)
    ends = [[sum(g[: k + 1]) for k in range(len(g))] for g in until]
    facts = items.sparkSession.createDataFrame(pa.table({c: pa.array([v[k] for v in vectors], pa.int64()) for k, c in enumerate(VECTOR)} | {"ends": pa.array(ends, pa.list_(pa.int64())), "m": pa.array([e[-1] for e in ends], pa.int64())}))
    kind = F.concat_ws("/", *VECTOR)
    ranked = rank_within(items.select(name, kind.alias("kind"), F.xxhash64(F.lit(seed), name).alias("h")), "kind", "h", total=total)
    x = spread_join(ranked, facts.select(kind.alias("kind"), "ends", "m"), "kind", weight="m", total=total)
    at = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    return x.select(name, F.element_at(F.array(*(F.lit(h) for h in holders)), at + 1).alias(holder))


def assign_splits(df: DataFrame, *, group: str = "split_group", target: str = "target", seed: str = "42") -> DataFrame:
    """``df`` with ``fold`` (0 to 4) and ``split``; the rows of a group stay together, classes are balanced.

    Groups are placed in descending spread of their class counts, then size, each into the fold where it leaves the shares of the classes most even over the
    folds (least squares). Groups with the same counts are placed at once, with the result of placing them one by one (``water_filled``); which of them go
    where is told by a seeded hash. No row of the table and no list of groups goes to the driver, only their different counts. Rows with a
    null group are left out; an empty table stays empty.
    """
    groups = df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(*label_counts(F.col(target)), F.count(F.lit(1)).alias("__n"))
    groups = materialize(groups)
    kinds = kinds_of(groups)
    if not kinds:
        return df.limit(0).select("*", F.lit(0).cast("tinyint").alias("fold"), F.lit("").alias("split"))
    whole = [sum(v[k] * m for v, m in kinds) or 1 for k in range(3)]
    held = [[0, 0, 0] for _ in range(FOLDS)]
    deals = []
    for v, m in sorted(kinds, key=lambda x: (-abs(x[0][0] - x[0][1]), -sum(x[0]), x[0])):
        given = water_filled([sum(h[k] * v[k] / whole[k] ** 2 for k in range(3)) for h in held], sum((v[k] / whole[k]) ** 2 for k in range(3)), m)
        for h, g in zip(held, given):
            for k in range(3):
                h[k] += v[k] * g
        deals.append((v, given))
    rows, count = sum(sum(v) * m for v, m in kinds), sum(m for _, m in kinds)
    placed = deal(groups, "__g", "fold", deals, list(range(FOLDS)), seed, count)
    facts = materialize(placed.join(groups.select("__g", "__n"), "__g").select("__g", F.col("fold").cast("tinyint").alias("fold"), "__n"))
    x = spread_join(df.withColumn("__g", F.col(group)), facts, "__g", weight="__n", total=rows)
    return x.drop("__g").withColumn("split", split_name(F.col("fold")))


def quality(assigned: DataFrame, group: str, shares: dict[str, float], *, target: str = "target", split: str = "split", off: float = 0.005, rate_off: float = 0.01) -> DataFrame:
    """One row on an assignment: rows, rows without a split, groups, groups that lie in more than one, whether every split's share of the rows is within ``off`` of ``shares``
    and its rate of ``target`` within ``rate_off`` of that of all rows."""
    t = assigned.select(F.col(group).alias("g"), F.col(split).alias("s"), (F.col(target) == 1).cast("int").alias("t"))
    per = t.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).agg(F.count("g").alias("n_groups"), F.count_if(F.col("lo") != F.col("hi")).alias("groups_apart"))
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("s").isNull() | ~F.col("s").isin(list(shares))).alias("rows_unplaced")]
    near, even = F.lit(True), F.lit(True)
    for s, share in shares.items():
        mine = F.count_if(F.col("s") == s)
        near = near & (F.abs(mine / F.count(F.lit(1)) - share) <= off)
        even = even & (F.abs(F.avg(F.when(F.col("s") == s, F.col("t"))) - F.avg("t")) <= rate_off)
    return t.agg(*aggs, near.alias("shares_met"), even.alias("rates_met")).crossJoin(F.broadcast(per))


def hashed_splits(df: DataFrame, *, group: str = "split_group", target: str = "target", seed: str = "42") -> DataFrame:
    """``(g, fold, split)`` of every group: groups of one dominant class dealt out in order of size and seeded hash, in turn."""
    from pyspark.sql import Window

    g = df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("n1"))
    x = g.select("g", "n", (F.col("n1") * 2 > F.col("n")).cast("int").alias("cls"), F.sha2(F.concat(F.lit(seed), F.coalesce("g", F.lit(""))), 256).alias("h"))
    # Ranks in that order without a task per class: by (size, first digits of the hash), which sort like the whole order.
    x = x.withColumn("d", F.substring("h", 1, 3))
    sizes = x.groupBy("cls", "n", "d").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("cls").orderBy(F.desc("n"), "d").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("cls", "n", "d", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("cls", "n", "d").orderBy("h")
    ranked = x.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["cls", "n", "d"])
    return ranked.select("g", ((F.col("start") + F.col("at")) % FOLDS).cast("int").alias("fold")).select("g", "fold", split_name(F.col("fold")).alias("split"))


def split_summary(df: DataFrame) -> DataFrame:
    """Rows, share in percent, classes, rate and different groups of each split."""
    per = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("target") == 1).alias("phishing"), F.count_if(F.col("target") == 0).alias("legitimate"), F.count_distinct("split_group").alias("n_groups"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    x = per.crossJoin(F.broadcast(total))
    return x.select("split", "n_rows", F.bround(F.col("n_rows") * 100.0 / F.col("total"), 4).alias("percent"), "phishing", "legitimate", F.bround(F.col("phishing") / F.col("n_rows"), 6).alias("rate"), "n_groups")


def straddling(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` in more than one split, with the number of splits."""
    return df.groupBy(F.col(key).alias("value")).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


def integrity(df: DataFrame) -> DataFrame:
    """One row: different splits, rows without a known split, groups and keys that lie in more than one split."""
    a = df.agg(F.count_distinct("split").alias("n_splits"), F.count_if(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))).alias("unknown_rows"))
    b = straddling(df, "split_group").agg(F.count(F.lit(1)).alias("straddling_groups"))
    c = straddling(df, "url_dedupe_key").agg(F.count(F.lit(1)).alias("straddling_keys"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))


def validate_integrity(df: DataFrame) -> None:
    r = integrity(df).first()
    if r.n_splits != 3 or r.unknown_rows:
        raise ValueError("the splits must be exactly train, validation and test")
    if r.straddling_groups or r.straddling_keys:
        raise ValueError(f"{r.straddling_groups} groups and {r.straddling_keys} keys lie in more than one split")
