"""Ranking, calibration and cost metrics of scores, threshold sweeps and operating profiles.

Everything after validation works on the table of different scores (score, positives, negatives), never on raw rows; it is
written once. Running totals over it are split by score range (``running``), so no task gets more than its share of it.
``by`` names key columns, such as a model, for each value of which there is a result of its own; a key has one row in every
table of totals, which is broadcast: keys are names of models, of which there are few.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

By = tuple[str, ...]


@dataclass(frozen=True)
class Costs:
    false_negative: float = 25.0
    false_positive: float = 2.0
    true_positive: float = 0.0
    true_negative: float = 0.0


NAN = float("nan")
METRICS = (
    "threshold true_positive false_positive true_negative false_negative n_samples precision recall specificity false_positive_rate f1 accuracy "
    "predicted_positive_rate average_precision roc_auc brier_score expected_calibration_error simulated_cost simulated_cost_per_10000"
).split()


def validate(df: DataFrame, target: str = "target", score: str = "score") -> None:
    """Raise ValueError unless there are rows, targets are 0 or 1 and scores lie between 0 and 1. One pass."""
    t, s = F.col(target), F.col(score)
    n, odd, out = df.agg(F.count(F.lit(1)), F.count_if(t.isNull() | ~t.isin(0, 1)), F.count_if(s.isNull() | F.isnan(s) | (s < 0) | (s > 1))).first()
    if not n:
        raise ValueError("there are no rows")
    if odd:
        raise ValueError("targets must be 0 or 1")
    if out:
        raise ValueError("scores must be finite and between 0 and 1")


def _threshold(t: float) -> float:
    if not 0 <= t <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    return float(t)


def by_score(df: DataFrame, target: str = "target", score: str = "score", by: By = ()) -> DataFrame:
    """``(*by, score, p, n, r)``: positives and negatives of each different score; -0.0 counts as 0.0. ``r`` numbers ranges of
    like size, in order of ``by`` and descending score. The table is written."""
    t = df.groupBy(*by, (F.col(score) + F.lit(0.0)).alias("score")).agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n"))
    return materialize(t.repartitionByRange(*by, F.desc("score")).withColumn("r", F.spark_partition_id()))


def attach(df: DataFrame, facts: DataFrame, by: By) -> DataFrame:
    """``df`` with the one row of ``facts`` for its key."""
    return df.join(F.broadcast(facts), list(by)) if by else df.crossJoin(F.broadcast(facts))


def running(scores: DataFrame, by: By = ()) -> DataFrame:
    """``scores`` with ``tp`` and ``fp``: positives and negatives at that score or above.

    Totals are formed inside the score ranges and shifted by those of the ranges above.
    """
    above = Window.partitionBy(*by).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    per = scores.groupBy(*by, "r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    starts = per.select(*by, "r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("an"))
    inside = Window.partitionBy(*by, "r").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    y = scores.select("*", F.sum("p").over(inside).alias("ip"), F.sum("n").over(inside).alias("inn")).join(F.broadcast(starts), [*by, "r"])
    return y.select(*by, "score", "p", "n", (F.col("ap") + F.col("ip")).alias("tp"), (F.col("an") + F.col("inn")).alias("fp"))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where ``b`` is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ranking(scores: DataFrame, by: By = ()) -> DataFrame:
    """``average_precision`` (steps, not trapezoids) and ``roc_auc`` (ties count half); NaN with one class only."""
    total = scores.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    x = attach(running(scores, by), total, by)
    both = (F.max("all_p") > 0) & (F.max("all_n") > 0)
    ap = F.sum(F.when(F.col("all_p") > 0, F.col("p").cast("double") / F.col("all_p") * F.col("tp") / (F.col("tp") + F.col("fp"))))
    auc = F.sum(F.when((F.col("all_p") > 0) & (F.col("all_n") > 0), F.col("n") * (F.col("tp") - F.col("p") / 2) / F.col("all_p") / F.col("all_n")))
    return x.groupBy(*by).agg(F.when(both, ap).otherwise(NAN).alias("average_precision"), F.when(both, auc).otherwise(NAN).alias("roc_auc"))


def edges(n_bins: int) -> list[float]:
    """Inner edges of equal bins over 0..1, as a linear space computes them."""
    return [k * (1.0 / n_bins) for k in range(1, n_bins)]


def calibration_bins(scores: DataFrame, n_bins: int = 10, by: By = ()) -> DataFrame:
    """``(*by, bin, n_rows, mean_score, rate)`` of equal bins closed on the right."""
    if n_bins < 2:
        raise ValueError("n_bins must be 2 or more")
    at = F.lit(0)
    for e in edges(n_bins):
        at = at + F.when(F.col("score") > F.lit(e), 1).otherwise(0)
    return _binned(scores, at.alias("bin"), by)


def _binned(scores: DataFrame, at: Column, by: By) -> DataFrame:
    k = F.col("p") + F.col("n")
    return scores.groupBy(*by, at).agg(F.sum(k).alias("n_rows"), (F.sum(F.col("score") * k) / F.sum(k)).alias("mean_score"), (F.sum("p") / F.sum(k)).alias("rate"))


def expected_calibration_error(df: DataFrame, target: str = "target", score: str = "score", n_bins: int = 10, by: By = ()) -> DataFrame:
    return _ece(by_score(df, target, score, by), n_bins, by)


def _ece(scores: DataFrame, n_bins: int = 10, by: By = ()) -> DataFrame:
    b = calibration_bins(scores, n_bins, by)
    return b.groupBy(*by).agg((F.sum(F.col("n_rows") * F.abs(F.col("rate") - F.col("mean_score"))) / F.sum("n_rows")).alias("expected_calibration_error"))


def _scalars(scores: DataFrame, by: By = ()) -> DataFrame:
    k = F.col("p") + F.col("n")
    brier = scores.groupBy(*by).agg(((F.sum(F.col("p") * F.pow(1 - F.col("score"), F.lit(2)) + F.col("n") * F.pow("score", F.lit(2)))) / F.sum(k)).alias("brier_score"), F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return attach(attach(brier, ranking(scores, by), by), _ece(scores, by=by), by)


def _record(costs: Costs) -> list[Column]:
    """The metric columns of a row with threshold, tp, fp, all_p, all_n and the scalar metrics."""
    tp, fp, all_p, all_n = (F.col(c) for c in ("tp", "fp", "all_p", "all_n"))
    fn, tn, all_ = all_p - tp, all_n - fp, all_p + all_n
    cost = tp * costs.true_positive + fp * costs.false_positive + tn * costs.true_negative + fn * costs.false_negative
    precision, recall = ratio(tp, tp + fp), ratio(tp, all_p)
    out = dict(
        threshold=F.col("threshold"), true_positive=tp, false_positive=fp, true_negative=tn, false_negative=fn, n_samples=all_, precision=precision, recall=recall,
        specificity=ratio(tn, all_n), false_positive_rate=ratio(fp, all_n), f1=ratio(2 * tp, 2 * tp + fp + fn), accuracy=ratio(tp + tn, all_), predicted_positive_rate=ratio(tp + fp, all_),
        average_precision=F.col("average_precision"), roc_auc=F.col("roc_auc"), brier_score=F.col("brier_score"), expected_calibration_error=F.col("expected_calibration_error"),
        simulated_cost=cost, simulated_cost_per_10000=ratio(cost * 10000, all_),
    )
    return [v.alias(k) for k, v in out.items()]


def evaluate(df: DataFrame, target: str = "target", score: str = "score", *, threshold: float = 0.5, costs: Costs | None = None, by: By = ()) -> DataFrame:
    """One row (of each key) with all metrics at one threshold; predictions are ``score >= threshold``. No row for an empty table."""
    t = F.lit(_threshold(threshold))
    s = by_score(df, target, score, by)
    at = s.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("score") >= t, F.col("p"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(F.col("score") >= t, F.col("n"))), F.lit(0)).alias("fp"))
    one = attach(at, _scalars(s, by), by).where("all_p + all_n > 0").withColumn("threshold", t)
    return one.select(*by, *_record(costs or Costs()))


def threshold_table(df: DataFrame, target: str = "target", score: str = "score", *, costs: Costs | None = None, by: By = ()) -> DataFrame:
    """All metrics at every different score and at 0 and 1, one row per threshold (of each key); sort by it where an order is wanted."""
    s = by_score(df, target, score, by)
    scalars = materialize(_scalars(s, by))
    total = scalars.where("all_p + all_n > 0")
    ends = total.select(*by, F.explode(F.array(F.struct(F.lit(1.0).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp")), F.struct(F.lit(0.0).alias("threshold"), F.col("all_p").alias("tp"), F.col("all_n").alias("fp")))).alias("e")).select(*by, "e.*")
    seen = running(s, by).select(*by, F.col("score").alias("threshold"), "tp", "fp")
    # Where 0 or 1 was observed, its own row has the larger counts: at 1 those of scores of 1, at 0 everything either way.
    rows = seen.union(ends).groupBy(*by, "threshold").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    return attach(rows, scalars, by).select(*by, *_record(costs or Costs()))


def _best(table: DataFrame, order: list[Column], by: By) -> Column:
    """The row of ``table`` that comes first by ``order`` (ascending), as an aggregate; it is combined on the map side."""
    return F.min_by(F.struct(*(F.col(c) for c in table.columns if c not in by)), F.struct(*order))


def at_max_fpr(table: DataFrame, max_fpr: float, by: By = ()) -> DataFrame:
    """The row with the most recall at a false-positive rate of at most ``max_fpr``; one row (of each key), none for an empty table."""
    if not 0 <= max_fpr <= 1:
        raise ValueError("max_fpr must lie between 0 and 1")
    fits, some = F.col("false_positive_rate") <= F.lit(float(max_fpr)), F.col("predicted_positive_rate") > 0
    level = F.when(fits & some, 0).when(some, 1).otherwise(2)
    order = [level, -F.col("recall"), -F.col("precision"), F.col("false_positive_rate"), F.col("threshold")]
    return table.groupBy(*by).agg(_best(table, order, by).alias("x")).where("x is not null").select(*by, "x.*")


@dataclass(frozen=True)
class Profile:
    name: str
    description: str
    max_fpr: float
    min_precision: float
    min_recall: float
    order: tuple[str, ...]


#: Constraints and preferences of the three operating profiles; ``-`` is descending.
PROFILES = (
    Profile("high_security", "Most recall under the constraints.", 0.05, 0.70, 0.0, ("-recall", "false_positive_rate", "-precision", "threshold")),
    Profile("balanced", "Least cost under the constraints.", 0.05, 0.70, 0.50, ("simulated_cost", "-recall", "false_positive_rate", "-precision", "threshold")),
    Profile("conservative", "Most precision under the constraints.", 0.01, 0.0, 0.10, ("-precision", "-recall", "false_positive_rate", "-threshold")),
)


def _order(keys: tuple[str, ...]) -> list[Column]:
    return [-F.col(k[1:]) if k[0] == "-" else F.col(k) for k in keys]


def violation(p: Profile) -> Column:
    """By how much a row misses the constraints of a profile, summed."""
    f = lambda x: F.greatest(x, F.lit(0.0))
    return f(F.col("false_positive_rate") - p.max_fpr) + f(F.lit(p.min_precision) - F.col("precision")) + f(F.lit(p.min_recall) - F.col("recall"))


def _meets(p: Profile) -> Column:
    return (F.col("false_positive_rate") <= p.max_fpr) & (F.col("precision") >= p.min_precision) & (F.col("recall") >= p.min_recall)


def profiles(table: DataFrame, by: By = (), chosen: tuple[Profile, ...] = PROFILES) -> DataFrame:
    """``(*by, profile, ..., constraints_met)``: the row each profile chooses; where none meets the constraints, the one that misses them least.

    Thresholds that predict nothing positive are passed over unless there are no others. One pass for all profiles; no row for an empty table.
    """
    picks = []
    for p in chosen:
        met = _meets(p)
        order = [(F.col("predicted_positive_rate") <= 0).cast("int"), (~met).cast("int"), F.when(met, 0.0).otherwise(F.round(violation(p), 12)), *_order(p.order), F.col("threshold")]
        picks.append(_best(table, order, by).alias(p.name))
    one = table.groupBy(*by).agg(*picks)
    rows = one.select(*by, F.explode(F.array(*(F.struct(F.lit(p.name).alias("profile"), F.col(p.name).alias("x")) for p in chosen))).alias("r")).where("r.x is not null").select(*by, "r.profile", "r.x.*")
    constraints = F.lit(False)
    for p in chosen:
        constraints = F.when(F.col("profile") == p.name, _meets(p)).otherwise(constraints)
    return rows.withColumn("constraints_met", constraints)


def _with_end(points: DataFrame, table: DataFrame, by: By, **end: float) -> DataFrame:
    last = [F.lit(v).alias(k) for k, v in end.items()]
    rows = table.select(*by).distinct().select(*by, *last) if by else table.sparkSession.range(1).select(*last)
    return points.select(*by, *end).union(rows)


def pr_curve(table: DataFrame, by: By = ()) -> DataFrame:
    """Recall and precision at every observed threshold, and the end point (0, 1)."""
    return _with_end(table.where("predicted_positive_rate > 0"), table, by, recall=0.0, precision=1.0)


def roc_curve(table: DataFrame, by: By = ()) -> DataFrame:
    return _with_end(table.where("predicted_positive_rate > 0"), table, by, false_positive_rate=0.0, recall=0.0)


def tradeoff(table: DataFrame, by: By = ()) -> DataFrame:
    return table.select(*by, "threshold", "precision", "recall", "false_positive_rate")


def quantile_calibration(df: DataFrame, target: str = "target", score: str = "score", bins: int = 10, by: By = ()) -> DataFrame:
    """``(*by, bin, n_rows, mean_score, rate)`` of bins between score quantiles (closed on the right); empty bins have no row.

    Quantiles are exact, with linear interpolation, and read off the running counts: a quantile lies between the scores that stand at two ranks.
    """
    s = by_score(df, target, score, by)
    total = s.groupBy(*by).agg(F.sum(F.col("p") + F.col("n")).alias("all_"))
    x = attach(running(s, by), total, by)
    before = F.col("all_") - F.col("tp") - F.col("fp")
    after = before + F.col("p") + F.col("n")
    aggs = []
    for i in range(1, bins):
        at = (F.col("all_") - 1) * F.lit(i / bins)
        low, high = F.floor(at), F.ceil(at)
        aggs += [F.max(F.when((before <= k) & (k < after), F.col("score"))).alias(f"{name}{i}") for name, k in (("lo", low), ("hi", high))] + [F.max(at - low).alias(f"f{i}")]
    cut = x.groupBy(*by).agg(*aggs).select(*by, F.array(*(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}") for i in range(1, bins))).alias("q"))
    at = F.size(F.filter("q", lambda e: e < F.col("score"))).alias("bin")
    return _binned(attach(s, cut, by), at, by)
