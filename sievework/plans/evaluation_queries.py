"""Queries over scores: metrics, threshold sweeps, profiles and curves, of every model in the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import protocol_only_score
from ..operators import audit, metrics
from ..operators.shared import materialize
from ..session import table

_COSTS = metrics.Costs()


def _all_scores(spark, sf_dir) -> DataFrame:
    """Targets and scores of all models; rows without a score are left out."""
    x = table(spark, sf_dir, "url_scores").where("score is not null")
    return x.select("model", "url_id", F.col("target").cast("int").alias("target"), "score")


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_BY = ("model",)


def _table(scores: DataFrame) -> DataFrame:
    return metrics.threshold_table(scores, costs=_COSTS, by=_BY)


#: Reports of the scores, ``model`` in front.
_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "metrics_at_half": lambda x: metrics.evaluate(x, threshold=0.5, costs=_COSTS, by=_BY),
    "ranking_metrics": lambda x: metrics.ranking(metrics.by_score(x, by=_BY), _BY),
    "calibration_bins": lambda x: metrics.calibration_bins(metrics.by_score(x, by=_BY), by=_BY),
    "calibration_error": lambda x: metrics.expected_calibration_error(x, by=_BY),
    "calibration_quantile_bins": lambda x: metrics.quantile_calibration(x, by=_BY),
    "threshold_table": _table,
    "threshold_at_max_fpr": lambda x: metrics.at_max_fpr(_table(x), 0.0163, _BY),
    "profiles": lambda x: metrics.profiles(_table(x), _BY),
    "pr_curve": lambda x: metrics.pr_curve(materialize(_table(x)), _BY),
    "roc_curve": lambda x: metrics.roc_curve(materialize(_table(x)), _BY),
    "threshold_tradeoff": lambda x: metrics.tradeoff(_table(x), _BY),
    "score_histogram": lambda x: audit.histogram(x, "score", 20, by=("model", "target")).select("model", "target", "bin", "n_rows"),
}


def _report(report: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: _rounded(report(_all_scores(spark, sf_dir)))


def metrics_by_model(spark, sf_dir):
    """Scores, missing scores, Brier score and counts at 0.5 of every model."""
    t, s = F.col("target"), F.col("score")
    return _rounded(table(spark, sf_dir, "url_scores").groupBy("model").agg(
        F.count("score").alias("n_scores"), F.count_if(s.isNull()).alias("n_missing"), F.avg(F.pow(s - t, F.lit(2))).alias("brier_score"),
        F.count_if((s >= 0.5) & (t == 1)).alias("true_positive"), F.count_if((s >= 0.5) & (t == 0)).alias("false_positive"),
    ))


def protocol_only(spark, sf_dir):
    """The detector that looks at the scheme alone, over the validation rows."""
    x = table(spark, sf_dir, "prepared_urls").where("split = 'validation'").select(protocol_only_score(F.col("url_model_input")).alias("score"), F.col("target").cast("int").alias("target"))
    return _rounded(metrics.evaluate(x, threshold=0.5, costs=_COSTS))


QUERIES = {n: _report(f) for n, f in _REPORTS.items()}
QUERIES |= {"metrics_by_model": metrics_by_model, "protocol_only": protocol_only}

_PROTOCOL = r"rows_ as (select target, cast(starts_with(lower(url_model_input), 'http://') as double) as score from prepared_urls where split = 'validation')"
_EDGES = " + ".join(f"cast(score > {k * (1.0 / 10)!r}e0 as int)" for k in range(1, 10))
_BASE = f"""
g as (select score, count(*) filter (target = 1) as p, count(*) filter (target = 0) as n from rows_ group by 1),
tot as (select sum(p) as tp_all, sum(n) as tn_all from g),
r as (select score, p, n, sum(p) over w as tp, sum(n) over w as fp from g window w as (order by score desc rows unbounded preceding)),
rank_ as (select sum(p / tp_all * tp / (tp + fp)) as average_precision, sum(n * (tp - p / 2) / tp_all / tn_all) as roc_auc from (select cast(p as double) as p, cast(n as double) as n, tp, fp from r), tot),
bins as (select {_EDGES} as bin, count(*) as n_rows, avg(score) as mean_score, avg(target) as rate from rows_ group by 1),
ece as (select sum(n_rows * abs(rate - mean_score)) / sum(n_rows) as expected_calibration_error from bins),
brier as (select avg((score - target) * (score - target)) as brier_score from rows_),
cuts as (select score as threshold, tp, fp from r union all select 1.0e0, 0, 0 where not exists (select 1 from g where score = 1) union all select 0.0e0, tp_all, tn_all from tot where not exists (select 1 from g where score = 0)),
"""
_RECORD = """
full_ as (select threshold, cast(tp as bigint) as true_positive, cast(fp as bigint) as false_positive, cast(tn_all - fp as bigint) as true_negative, cast(tp_all - tp as bigint) as false_negative, cast(tp_all + tn_all as bigint) as n_samples,
  case when tp + fp > 0 then tp * 1.0e0 / (tp + fp) else 0 end as precision, case when tp_all > 0 then tp * 1.0e0 / tp_all else 0 end as recall, case when tn_all > 0 then (tn_all - fp) * 1.0e0 / tn_all else 0 end as specificity,
  case when tn_all > 0 then fp * 1.0e0 / tn_all else 0 end as false_positive_rate, case when tp + fp + tp_all > 0 then 2.0e0 * tp / (tp + fp + tp_all) else 0 end as f1, (tp + tn_all - fp) * 1.0e0 / (tp_all + tn_all) as accuracy,
  (tp + fp) * 1.0e0 / (tp_all + tn_all) as predicted_positive_rate, average_precision, roc_auc, brier_score, expected_calibration_error,
  25.0e0 * (tp_all - tp) + 2.0e0 * fp as simulated_cost, (25.0e0 * (tp_all - tp) + 2.0e0 * fp) * 10000 / (tp_all + tn_all) as simulated_cost_per_10000 from cuts, tot, rank_, ece, brier)
"""
_HALF = "cuts as (select 0.5e0 as threshold, sum(p) filter (score >= 0.5) as tp, sum(n) filter (score >= 0.5) as fp from g),"


def _one(source: str) -> str:
    base = _BASE[: _BASE.index("cuts as")] + _HALF
    return f"with {source}, {base}{_RECORD} select {_COLUMNS} from full_"


# Fixed values, written out for the SQL: name, constraints on false-positive rate, precision and recall, and order of preference.
_SQL_PROFILES = [
    ("high_security", 0.05, 0.70, 0.0, "recall desc, false_positive_rate, precision desc, threshold"),
    ("balanced", 0.05, 0.70, 0.50, "simulated_cost, recall desc, false_positive_rate, precision desc, threshold"),
    ("conservative", 0.01, 0.0, 0.10, "precision desc, recall desc, false_positive_rate, threshold desc"),
]
_SQL_COLUMNS = (
    "threshold", "true_positive", "false_positive", "true_negative", "false_negative", "n_samples", "precision", "recall", "specificity", "false_positive_rate", "f1", "accuracy",
    "predicted_positive_rate", "average_precision", "roc_auc", "brier_score", "expected_calibration_error", "simulated_cost", "simulated_cost_per_10000",
)
_COLUMNS = ", ".join(c if k in range(1, 6) else f"round(cast({c} as double), 6) as {c}" for k, c in enumerate(_SQL_COLUMNS))


def _profile_sql(name: str, fpr: float, precision: float, recall: float, order: str) -> str:
    met = f"(false_positive_rate <= {fpr} and precision >= {precision} and recall >= {recall})"
    miss = f"greatest(false_positive_rate - {fpr}, 0) + greatest({precision} - precision, 0) + greatest({recall} - recall, 0)"
    return f"(select model, '{name}' as profile, {_COLUMNS}, {met} as constraints_met from full_ qualify row_number() over (partition by model order by (predicted_positive_rate > 0) desc, {met} desc, case when {met} then 0 else round({miss}, 12) end, {order}) = 1)"


_Q = ", ".join(f"{i / 10}" for i in range(1, 10))
# The same with ``model`` as a key throughout.
_EACH_SOURCE = "rows_ as (select model, target, score from url_scores where score is not null)"
_EACH_BASE = f"""
g as (select model, score, count(*) filter (target = 1) as p, count(*) filter (target = 0) as n from rows_ group by 1, 2),
tot as (select model, sum(p) as tp_all, sum(n) as tn_all from g group by 1),
r as (select model, score, p, n, sum(p) over w as tp, sum(n) over w as fp from g window w as (partition by model order by score desc rows unbounded preceding)),
rank_ as (select model, sum(p / tp_all * tp / (tp + fp)) as average_precision, sum(n * (tp - p / 2) / tp_all / tn_all) as roc_auc from (select model, cast(p as double) as p, cast(n as double) as n, tp, fp from r) join tot using (model) group by 1),
bins as (select model, {_EDGES} as bin, count(*) as n_rows, avg(score) as mean_score, avg(target) as rate from rows_ group by 1, 2),
ece as (select model, sum(n_rows * abs(rate - mean_score)) / sum(n_rows) as expected_calibration_error from bins group by 1),
brier as (select model, avg((score - target) * (score - target)) as brier_score from rows_ group by 1),
"""
_EACH_CUTS = """cuts as (select model, score as threshold, tp, fp from r union all select model, 1.0e0, 0, 0 from tot where model not in (select model from g where score = 1)
  union all select model, 0.0e0, tp_all, tn_all from tot where model not in (select model from g where score = 0)),"""
_EACH_HALF = "cuts as (select model, 0.5e0 as threshold, coalesce(sum(p) filter (score >= 0.5), 0) as tp, coalesce(sum(n) filter (score >= 0.5), 0) as fp from g group by 1),"
_EACH_RECORD = _RECORD.replace("select threshold", "select model, threshold").replace("from cuts, tot, rank_, ece, brier", "from cuts join tot using (model) join rank_ using (model) join ece using (model) join brier using (model)")
_EACH = f"with {_EACH_SOURCE}, {_EACH_BASE}{_EACH_CUTS}{_EACH_RECORD}"


ORACLE = {
    "metrics_by_model": "select model, count(score) as n_scores, count(*) filter (score is null) as n_missing, round(avg((score - target) * (score - target)), 6) as brier_score, count(*) filter (score >= 0.5 and target = 1) as true_positive, count(*) filter (score >= 0.5 and target = 0) as false_positive from url_scores group by 1",
    "protocol_only": _one(_PROTOCOL),
    "metrics_at_half": f"with {_EACH_SOURCE}, {_EACH_BASE}{_EACH_HALF}{_EACH_RECORD} select model, {_COLUMNS} from full_",
    "ranking_metrics": f"{_EACH} select model, round(average_precision, 6) as average_precision, round(roc_auc, 6) as roc_auc from rank_",
    "calibration_bins": f"{_EACH} select model, bin, n_rows, round(mean_score, 6) as mean_score, round(rate, 6) as rate from bins",
    "calibration_error": f"{_EACH} select model, round(expected_calibration_error, 6) as expected_calibration_error from ece",
    "calibration_quantile_bins": f"with {_EACH_SOURCE}, q as (select model, quantile_cont(score, [{_Q}]) as q from rows_ group by 1) select model, cast(len(list_filter(q, lambda e: e < score)) as int) as bin, count(*) as n_rows, round(avg(score), 6) as mean_score, round(avg(target), 6) as rate from rows_ join q using (model) group by 1, 2",
    "threshold_table": f"{_EACH} select model, {_COLUMNS} from full_",
    "threshold_at_max_fpr": f"{_EACH} select model, {_COLUMNS} from full_ qualify row_number() over (partition by model order by (false_positive_rate <= 0.0163 and predicted_positive_rate > 0) desc, (predicted_positive_rate > 0) desc, recall desc, precision desc, false_positive_rate, threshold) = 1",
    "profiles": f"{_EACH} " + " union all ".join(_profile_sql(*p) for p in _SQL_PROFILES),
    "pr_curve": f"{_EACH} select model, round(recall, 6) as recall, round(precision, 6) as precision from full_ where predicted_positive_rate > 0 union all select model, 0.0e0, 1.0e0 from tot",
    "roc_curve": f"{_EACH} select model, round(false_positive_rate, 6) as false_positive_rate, round(recall, 6) as recall from full_ where predicted_positive_rate > 0 union all select model, 0.0e0, 0.0e0 from tot",
    "threshold_tradeoff": f"{_EACH} select model, round(threshold, 6) as threshold, round(precision, 6) as precision, round(recall, 6) as recall, round(false_positive_rate, 6) as false_positive_rate from full_",
    "score_histogram": f"with {_EACH_SOURCE}, ends as (select model, target, min(score) as lo, max(score) as hi from rows_ group by 1, 2) select model, target, cast(least(floor((score - lo) / ((hi - lo) / 20)), 19) as int) as bin, count(*) as n_rows from rows_ join ends using (model, target) group by 1, 2, 3",
}
