"""The pipeline's stages as jobs: ingest, prepare, audit, split, rules, train.

``python -m sievework.plans.jobs STAGE --data DIR --reports DIR``. Reports hold aggregates and registered domains only, never URLs.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.suffix import icann_rules, parsed_rules, registered_domain
from ..functions.urls import protocol_only_score, with_features, with_parts
from ..operators import audit, metrics, splits, textmodel
from ..operators.prepare import prepare
from ..operators.shared import materialize, widened
from ..session import session
from ..sources import raw

COSTS = metrics.Costs()


def rule_scored(df: DataFrame, url: str = "url_model_input", suffixes: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the features and the rule score of its URLs. ``suffixes`` are the public-suffix rules, ``icann_rules`` by default."""
    p = "__domain_parts"
    x = with_parts(widened(df), url, p).withColumn("__domain", registered_domain(df.sparkSession, F.col(f"{p}.host"), suffixes or icann_rules(df.sparkSession)))
    return with_features(x, url, F.col("__domain"), p).withColumn("score", rules.score()).drop("__domain")


def prepare_job(spark: SparkSession, data: str, reports: str, *, suffixes: Sequence[str] | None = None) -> dict:
    source = spark.read.parquet(raw.require(spark, f"{data}/raw.parquet", "ingest"))
    if "row_id" not in source.columns:
        source = source.withColumn("row_id", F.monotonically_increasing_id())
        source = materialize(source)
    prepared, conflicts, summary = prepare(source, rules=suffixes or icann_rules(spark))
    raw.write_parquet(prepared.orderBy("url_dedupe_key", "row_order"), f"{data}/prepared.parquet")
    raw.write_parquet(conflicts.orderBy("url_dedupe_key", "row_order"), f"{data}/conflicts.parquet")
    out = summary.first().asDict()
    raw.write_json(spark, out, f"{data}/preparation.json")
    return out


def audit_job(spark: SparkSession, data: str, reports: str) -> str:
    df = audit.measured(spark.read.parquet(raw.require(spark, f"{data}/prepared.parquet", "prepare"))).cache()
    conflicts = spark.read.parquet(raw.require(spark, f"{data}/conflicts.parquet", "prepare"))
    sections = [
        ("Overview", audit.overview(df)),
        ("Classes", audit.class_summary(df).orderBy("target")),
        ("Conflicting rows", conflicts.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("url_dedupe_key").alias("keys"))),
        ("Measures", audit.describe(df)),
        ("Most frequent domains by class", audit.top_domains_by_class(df).orderBy("target", "rank_no")),
        ("Most frequent domains", audit.top_domains(df)),
    ]
    text = "# Data audit\n" + "".join(f"\n## {title}\n\n{raw.markdown_table(d)}\n" for title, d in sections)
    raw.write_text(spark, text, f"{reports}/data_audit.md")
    raw.write_csv(audit.histogram(df, "url_length").orderBy("bin"), f"{reports}/figures/url_length", single=True)
    raw.write_csv(audit.class_counts(df), f"{reports}/figures/class_distribution", single=True)
    raw.write_csv(audit.top_domains(df), f"{reports}/figures/domain_frequency", single=True)
    df.unpersist()
    return text


def split_job(spark: SparkSession, data: str, reports: str) -> list[dict]:
    df = spark.read.parquet(raw.require(spark, f"{data}/prepared.parquet", "prepare"))
    splits.validate_input(df)
    out = materialize(splits.assign_splits(df))
    if out.where("fold is null").limit(1).count() or out.count() != df.count():
        raise ValueError("some rows got no fold")
    splits.validate_integrity(out)
    for name in ("train", "validation", "test"):
        raw.write_parquet(out.where(F.col("split") == name), f"{data}/{name}.parquet")
    summary = [r.asDict() for r in splits.split_summary(out).orderBy("split").collect()]
    raw.write_json(spark, summary, f"{data}/split_summary.json")
    return summary


def _validated(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(raw.require(spark, path, "split"))
    missing = {"url_model_input", "target"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    n, odd, none = df.agg(F.count(F.lit(1)), F.count_if(F.col("target").isNull() | ~F.col("target").isin(0, 1)), F.count_if(F.col("url_model_input").isNull())).first()
    if not n or odd or none:
        raise ValueError("the table must have rows, targets of 0 or 1, and no null URL")
    return df


def _tables(spark: SparkSession, scored: DataFrame, out: str, max_fpr: float | None = None) -> dict:
    t = materialize(metrics.threshold_table(scored, costs=COSTS))
    raw.write_csv(t.orderBy("threshold"), f"{out}/threshold_table.csv", single=True)
    raw.write_csv(metrics.pr_curve(t), f"{out}/figures/precision_recall", single=True)
    raw.write_csv(metrics.roc_curve(t), f"{out}/figures/roc", single=True)
    raw.write_csv(metrics.tradeoff(t).orderBy("threshold"), f"{out}/figures/tradeoff", single=True)
    raw.write_csv(metrics.quantile_calibration(scored).orderBy("bin"), f"{out}/figures/calibration", single=True)
    raw.write_csv(audit.histogram(scored, "score", 20, by="target").orderBy("target", "bin"), f"{out}/figures/score_distribution", single=True)
    got = {"profiles": {r.profile: r.asDict() for r in metrics.profiles(t).collect()}}
    if max_fpr is not None:
        got["matched_fpr"] = metrics.at_max_fpr(t, max_fpr).first().asDict()
    return got


def _report(title: str, facts: dict, profiles: dict, extra: str = "") -> str:
    lines = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items()), "", "| profile | threshold | precision | recall | false-positive rate | cost per 10,000 |", "| --- | --- | --- | --- | --- | --- |"]
    for name, r in profiles.items():
        lines.append(f"| {name} | {r['threshold']:.6f} | {raw.percentage(r['precision'])} | {raw.percentage(r['recall'])} | {raw.percentage(r['false_positive_rate'])} | {r['simulated_cost_per_10000']:,.2f} |")
    return "\n".join(lines) + "\n" + extra


def rules_job(spark: SparkSession, data: str, reports: str, *, suffixes: Sequence[str] | None = None) -> dict:
    df = _validated(spark, f"{data}/validation.parquet")
    out = f"{reports}/rules"
    began = time.perf_counter()
    scored = materialize(rule_scored(df, suffixes=suffixes))
    metrics.validate(scored)
    seconds = time.perf_counter() - began
    n = scored.count()
    timing = {"seconds": seconds, "ms_per_url": seconds / n * 1000, "urls_per_second": n / seconds if seconds else float("inf")}
    triggers = rules.trigger_counts(scored)
    raw.write_csv(triggers, f"{out}/rule_trigger_counts.csv", single=True)
    payload = {"made": datetime.now(timezone.utc).isoformat(), "rows": n, "locked_test_used": False, "timing": timing, "metrics": metrics.evaluate(scored, threshold=rules.DEFAULT_THRESHOLD, costs=COSTS).first().asDict()}
    payload |= _tables(spark, scored, out) | {"triggers": [r.asDict() for r in triggers.collect()]}
    raw.write_json(spark, payload, f"{out}/metrics.json")
    raw.write_text(spark, _report("Rule scores", {"rows": n} | timing, payload["profiles"], "\n" + raw.markdown_table(triggers) + "\n"), f"{out}/report.md")
    return payload


def train_job(spark: SparkSession, data: str, reports: str, *, specs: list[textmodel.Spec] | None = None, max_features: int | None = None) -> dict:
    train, validation = _validated(spark, f"{data}/train.parquet"), _validated(spark, f"{data}/validation.parquet")
    ident = "row_order"
    if ident not in train.columns:
        train, validation = (materialize(d.withColumn(ident, F.monotonically_increasing_id())) for d in (train, validation))
    out = f"{reports}/model"
    candidates = textmodel.limited(specs or textmodel.compact_candidates(), max_features)
    fpr, _ = raw.prior_fpr(spark, f"{reports}/rules/metrics.json")
    protocol = materialize(validation.select(protocol_only_score(F.col("url_model_input")).alias("score"), "target"))
    results = textmodel.search(train, validation, ident, "url_model_input", "target", candidates, max_fpr=fpr, costs=COSTS)
    chosen, benchmark = textmodel.select(results)
    raw.write_csv(spark.createDataFrame([{k: v for k, v in r.items() if v is not None} for r in results]), f"{out}/model_comparison.csv", single=True)
    began = time.perf_counter()
    model = textmodel.fit(train, "url_model_input", "target", textmodel.spec_of(chosen))
    fit_seconds = time.perf_counter() - began
    began = time.perf_counter()
    scored = materialize(model.score(validation, ident, "url_model_input").join(validation.select(F.col(ident).alias("id"), "target"), "id"))
    seconds = time.perf_counter() - began
    n = scored.count()
    payload = {"made": datetime.now(timezone.utc).isoformat(), "locked_test_used": False, "selected": chosen, "best_raw": benchmark, "reference_fpr": fpr, "fit_seconds": fit_seconds, "urls_per_second": n / seconds}
    payload |= {"protocol_only": metrics.evaluate(protocol, costs=COSTS).first().asDict(), "validation": metrics.evaluate(scored, costs=COSTS).first().asDict()}
    payload |= _tables(spark, scored, out, fpr)
    top = model.top_ngrams()
    raw.write_csv(top, f"{out}/top_character_ngrams.csv", single=True)
    model.save(f"{data}/model")
    raw.write_json(spark, payload, f"{out}/validation_metrics.json")
    raw.write_json(spark, {"spec": model.spec.to_dict(), "columns": {"url_model_input": "string"}}, f"{data}/model_metadata.json")
    shown = [(r.direction, r.rank_no, raw.unicode_escaped(r.ngram), round(r.coefficient, 6)) for r in top.where("rank_no <= 20").collect()]
    extra = "\n" + raw.markdown_table(spark.createDataFrame(shown, "direction string, rank_no int, ngram string, coefficient double")) + "\n"
    raw.write_text(spark, _report("Text model", {"candidate": chosen["name"], "rows": n, "fit seconds": round(fit_seconds, 3)}, payload["profiles"], extra), f"{out}/report.md")
    return payload


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("stage", choices=["ingest", "prepare", "audit", "split", "rules", "train"])
    p.add_argument("--data", required=True)
    p.add_argument("--reports", required=True)
    p.add_argument("--csv")
    p.add_argument("--parquet")
    p.add_argument("--full-grid", action="store_true")
    p.add_argument("--max-features", type=int)
    p.add_argument("--suffixes", help="public-suffix rules of the stages prepare and rules, one a line; else the ICANN rules")
    a = p.parse_args(args)
    spark = session(f"sievework-{a.stage}")
    for folder in (a.data, a.reports):
        raw.ensure_folder(spark, folder)
    if a.stage == "ingest":
        print(raw.ingest(spark, a.csv, a.parquet, f"{a.data}/raw.parquet"))
    elif a.stage == "train":
        train_job(spark, a.data, a.reports, specs=textmodel.full_candidates() if a.full_grid else None, max_features=a.max_features)
    elif a.stage in ("prepare", "rules"):
        suffixes = parsed_rules(raw.read_text(spark, a.suffixes)) if a.suffixes else None
        {"prepare": prepare_job, "rules": rules_job}[a.stage](spark, a.data, a.reports, suffixes=suffixes)
    else:
        {"audit": audit_job, "split": split_job}[a.stage](spark, a.data, a.reports)


if __name__ == "__main__":
    main()
