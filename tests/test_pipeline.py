import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import metrics, prepare, splits, textmodel
from sievework.operators.components import components
from sievework.operators.skew import heavy_keys, rank_within, salted_group_stats, spread_join
from sievework.plans import jobs
from sievework.sources import raw
from sievework.streaming.scoring import counts_by_hour


def raw_rows(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, url string, label int")


def test_conflicts_and_duplicates(spark):
    df = raw_rows(spark, ("http://Blog.Test/x?y#top", 1), ("http://blog.test/x?y", 0), ("http://blog.test/x?y#end", 1), ("ftp://files.test", 0), ("\u00a0\t", 0), (None, 1), ("no host:", 1), ("no host:#z", 1))
    prepared, conflicts, summary = prepare.prepare(df)
    assert sorted(r.row_order for r in prepared.collect()) == [3, 6] and sorted(r.row_order for r in conflicts.collect()) == [0, 1, 2]
    assert tuple(summary.first()) == (8, 2, 6, 1, 3, 1, 2, 1, 2)
    assert tuple(prepare.prepare(df.limit(0))[2].first()) == (0,) * 9
    odd = df.union(raw_rows(spark, ("http://more.test/", 5), ("http://more.test/", None), (None, 7)))
    got = prepare.prepare(odd, set_aside=True)[2].first()
    assert (got.raw_rows, got.empty_rows, got.bad_label_rows, got.rows_after_empty, got.prepared_rows) == (11, 3, 2, 6, 2)
    with pytest.raises(Exception, match="label"):
        prepare.prepare(odd)


def test_raw_validation(spark):
    with pytest.raises(ValueError, match="no URL"):
        prepare.validate_raw(raw_rows(spark, (None, 1)))
    with pytest.raises(ValueError, match="label"):
        prepare.validate_raw(raw_rows(spark, ("a", 3)))
    with pytest.raises(ValueError, match="empty"):
        prepare.validate_raw(raw_rows(spark, ("a", 1)).limit(0))
    prepare.validate_raw(raw_rows(spark, ("a", 1), ("b", None)))


def scores(spark, targets, values):
    return spark.createDataFrame(list(zip(targets, values)), "target int, score double")


def test_metrics(spark):
    r = metrics.evaluate(scores(spark, [1, 1, 0, 0, 0], [0.7, 0.3, 0.6, 0.1, 0.4])).first()
    assert (r.true_positive, r.false_positive, r.true_negative, r.false_negative) == (1, 1, 2, 1)
    assert r.precision == r.recall == 0.5 and abs(r.false_positive_rate - 1 / 3) < 1e-12 and r.simulated_cost == 27
    assert metrics.expected_calibration_error(scores(spark, [1, 0, 1], [1.0, 0.0, 1.0]), n_bins=4).first()[0] == 0
    with pytest.raises(ValueError, match="between 0 and 1"):
        metrics.validate(scores(spark, [1, 0], [-0.01, 0.3]))
    one = metrics.evaluate(scores(spark, [1, 1, 1], [0.9, 0.4, 0.2])).first()
    assert one.average_precision != one.average_precision and one.specificity == 0
    assert not metrics.evaluate(scores(spark, [0], [0.25]).limit(0)).count()
    tied = metrics.ranking(metrics.by_score(scores(spark, [1, 0, 0, 1, 0, 1], [0.3] * 6))).first()
    assert tied.roc_auc == 0.5 and tied.average_precision == 0.5


def brute(rows, cut):
    tp, fp = sum(t for t, s in rows if s >= cut), sum(1 - t for t, s in rows if s >= cut)
    return tp, fp


def test_thresholds_by_key(spark):
    """Every key is swept by itself, whatever the ranges the scores fall into."""
    import random

    import numpy as np

    rng = random.Random(1)
    keyed = {k: [(int(rng.random() < 0.4), round(rng.random() ** 3, digits)) for _ in range(400)] for k, digits in (("a", 6), ("b", 1))}
    keyed["c"] = [(1, 0.5)]
    df = spark.createDataFrame([(k, t, s) for k, rows in keyed.items() for t, s in rows], "k string, target int, score double")
    got = {(r.k, r.threshold): (r.true_positive, r.false_positive) for r in metrics.threshold_table(df, by=("k",)).collect()}
    assert got == {(k, cut): brute(rows, cut) if cut > 0 else (sum(t for t, _ in rows), sum(1 - t for t, _ in rows)) for k, rows in keyed.items() for cut in {0.0, 1.0, *(s for _, s in rows)}}
    bins = {(r.k, r.bin): r.n_rows for r in metrics.quantile_calibration(df, by=("k",)).collect()}
    for k, rows in keyed.items():
        values = np.array([s for _, s in rows])
        cuts = np.quantile(values, np.arange(1, 10) / 10)
        at, n = np.unique((cuts[None, :] < values[:, None]).sum(axis=1), return_counts=True)
        assert {b: m for (q, b), m in bins.items() if q == k} == dict(zip(at.tolist(), n.tolist()))
    table = metrics.threshold_table(df.where("k <> 'c'"), by=("k",))
    best = {r.k: r for r in metrics.at_max_fpr(table, 0.3, ("k",)).collect()}
    assert set(best) == {"a", "b"} and all(r.false_positive_rate <= 0.3 for r in best.values())
    for k, r in best.items():
        assert r.recall == max(x.recall for x in table.where(F.col("k") == k).collect() if x.false_positive_rate <= 0.3 and x.predicted_positive_rate > 0)
    assert sorted((r.k, r.profile) for r in metrics.profiles(table, ("k",)).collect()) == [(k, p.name) for k in "ab" for p in sorted(metrics.PROFILES, key=lambda p: p.name)]
    assert metrics.pr_curve(table, ("k",)).where("recall = 0 and precision = 1").select("k").distinct().count() == 2


def test_thresholds(spark):
    t = metrics.threshold_table(scores(spark, [1, 0, 1, 1, 0, 0, 1], [0.99, 0.33, 0.12, 0.57, 0.48, 0.05, 0.33]))
    rows = t.orderBy("threshold").collect()
    assert len(rows) == 8 and rows[0].true_positive == 4 and rows[-1].predicted_positive_rate == 0
    best = metrics.at_max_fpr(t, 1 / 3).first()
    assert best.false_positive_rate <= 1 / 3 and best.threshold == 0.57
    assert [r.profile for r in metrics.profiles(t).collect()] == ["high_security", "balanced", "conservative"]
    none = metrics.profiles(metrics.threshold_table(scores(spark, [1, 0, 0], [0.02, 0.6, 0.7]))).collect()
    assert len(none) == 3 and not any(r.constraints_met for r in none)
    assert not metrics.profiles(metrics.threshold_table(scores(spark, [1], [0.5]).limit(0))).count()


def sites(spark):
    """25 sites of 1 to 9 pages; two thirds of the sites are of one class only."""
    rows = [(f"http://s{g}.site{g}.test/p{r}", f"site{g}.test", (g // 3 + (r if g % 3 == 0 else 0)) % 2) for g in range(25) for r in range(g % 9 + 1)]
    return spark.createDataFrame([(i, u, u, d, d, t) for i, (u, d, t) in enumerate(rows)], "row_order long, url_model_input string, url_dedupe_key string, registered_domain string, split_group string, target int")


def test_split(spark):
    df = sites(spark)
    splits.validate_input(df)
    x = splits.assign_splits(df).cache()
    splits.validate_integrity(x)
    assert x.count() == df.count()
    got = {r.split: r for r in splits.split_summary(x).collect()}
    assert set(got) == {"train", "validation", "test"} and abs(got["train"].percent - 60) < 8
    again = splits.assign_splits(df)
    assert not x.select("row_order", "fold").exceptAll(again.select("row_order", "fold")).count()
    with pytest.raises(ValueError, match="classes"):
        splits.validate_input(df.where("target = 1"))
    with pytest.raises(ValueError, match="url_model_input"):
        splits.validate_input(df.drop("url_model_input"))
    with pytest.raises(ValueError, match="more than one split"):
        splits.validate_integrity(df.withColumn("split", F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))), (F.col("row_order") % 3 + 1).cast("int"))))


def test_equal_items_are_placed_as_one_by_one():
    import random

    rng = random.Random(2)
    for _ in range(500):
        levels, step, items = [rng.choice([rng.randrange(-50, 50), rng.random() * 10]) for _ in range(rng.randrange(1, 6))], rng.choice([1, 2, 0.37]), rng.randrange(0, 60)
        given = [0] * len(levels)
        for _ in range(items):
            given[min(range(len(levels)), key=lambda i: (levels[i] + given[i] * step, i))] += 1
        assert splits.water_filled(levels, step, items) == given
    assert splits.water_filled([0, 0, 5], 1, 10**12) == [333333333335, 333333333335, 333333333330]


def test_split_with_a_hot_group(spark):
    """A group with a third of the rows, and many of one row; shares and rates hold as far as groups allow."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i}", int(i % 3 == 0) if i % 7 else 1 - int(i % 3 == 0)) for i in range(6000)]
    df = spark.createDataFrame(rows, "url_id long, split_group string, target int").withColumns({"kind": F.lit(1), "ends": F.lit(2), "m": F.lit(3), "h": F.lit("x"), "rank": F.lit(0)})
    x = splits.assign_splits(df)
    zeros = [r["count"] for r in x.where("target = 0").groupBy("fold").count().collect()]
    assert x.count() == 6000 and len(zeros) == 5 and max(zeros) - min(zeros) <= 2
    assert x.where("target = 1 and split_group <> 'hot'").groupBy("fold").count().agg(F.max("count") - F.min("count")).first()[0] <= 2
    assert x.groupBy("split_group").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_spec():
    assert len(textmodel.compact_candidates()) == 7 and len(textmodel.full_candidates()) == 18
    for bad in (dict(min_n=3, max_n=2), dict(c=0), dict(class_weight="x"), dict(min_df=0)):
        with pytest.raises(ValueError):
            textmodel.Spec("x", **bad)


def test_candidates_spec_by_spec():
    """The fixed lists: name, range, C, class weight and whether scheme-neutral."""
    of = lambda specs: {(s.name, s.min_n, s.max_n, s.c, s.class_weight, s.scheme_neutral) for s in specs}
    assert of(textmodel.compact_candidates()) == {
        ("char35_c05", 3, 5, 0.5, None, False), ("char35_c10", 3, 5, 1.0, None, False), ("char35_c20_bal", 3, 5, 2.0, "balanced", False),
        ("char36_c10", 3, 6, 1.0, None, False), ("char46_c10", 4, 6, 1.0, None, False),
        ("char25_c10_bal_raw", 2, 5, 1.0, "balanced", False), ("char25_c10_bal_scheme_www_neutral", 2, 5, 1.0, "balanced", True),
    }
    assert of(textmodel.full_candidates()) == {
        (f"char{r}_c{c:g}_{w or 'none'}", int(r[0]), int(r[1]), c, w, False) for r in ("35", "36", "25") for c in (0.1, 1.0, 5.0) for w in (None, "balanced")
    }
    every = [*textmodel.compact_candidates(), *textmodel.full_candidates()]
    assert all((s.min_df, s.max_features, s.sublinear, s.max_iter) == (3, 250_000, True, 1000) for s in every)


def test_pipeline_end_to_end(spark, tmp_path):
    data, reports = f"file://{tmp_path}/data", f"file://{tmp_path}/reports"
    rows = [(f"http{'s' if g % 2 else ''}://{'shop' if g % 2 else 'login-verify'}{g}.test/{'items' if g % 2 else 'account'}/{r}", g % 2) for g in range(40) for r in range(3)]
    csv = spark.createDataFrame(rows, " URL string, Label int")
    csv.write.option("header", True).csv(f"{data}/in.csv")
    with pytest.raises(FileNotFoundError, match="ingest"):
        jobs.prepare_job(spark, data, reports)
    assert raw.ingest(spark, f"{data}/in.csv", None, f"{data}/raw.parquet")["rows"] == 120
    assert jobs.prepare_job(spark, data, reports)["prepared_rows"] == 120
    assert "## Classes" in jobs.audit_job(spark, data, reports)
    assert len(jobs.split_job(spark, data, reports)) == 3
    got = jobs.rules_job(spark, data, reports)
    assert not got["locked_test_used"] and set(got["profiles"]) == {"high_security", "balanced", "conservative"}
    spec = textmodel.Spec("tiny", 2, 4, min_df=1, max_features=2000)
    got = jobs.train_job(spark, data, reports, specs=[spec])
    assert got["validation"]["roc_auc"] > 0.9
    for name in ("rules/report.md", "rules/metrics.json", "rules/threshold_table.csv", "model/report.md", "model/model_comparison.csv", "model/top_character_ngrams.csv", "model/validation_metrics.json"):
        assert raw.exists(spark, f"{reports}/{name}")
    json.loads(raw.read_text(spark, f"{reports}/model/validation_metrics.json"))
    model = textmodel.Model.load(spark, f"{data}/model")
    s = model.score(spark.createDataFrame([(1, "http://login-verify99.test/account/1"), (2, ""), (3, None)], "row_order long, u string"), "row_order", "u")
    assert s.count() == 3 and s.where("score between 0 and 1").count() == 3
    top = model.top_ngrams(3)
    assert top.count() == 6 and {r.direction for r in top.collect()} == {"phishing", "legitimate"}


def test_jobs_know_real_suffixes(spark, tmp_path):
    """Hosts of one registered domain stay in one group, a shortener is one below www too; other suffixes can be given."""
    data = f"file://{tmp_path}/data"
    hosts = ["a.site.com", "b.site.com", "x.shop.co.uk", "y.shop.co.uk", "www.bit.ly", "a.b.xn--p1ai"]
    spark.createDataFrame([(i, f"https://{h}/p", i % 2) for i, h in enumerate(hosts)], "row_id long, url string, label int").write.parquet(f"{data}/raw.parquet")
    domains = lambda: [r.split_group for r in spark.read.parquet(f"{data}/prepared.parquet").orderBy("row_order").collect()]
    jobs.prepare_job(spark, data, "")
    assert domains() == ["site.com", "site.com", "shop.co.uk", "shop.co.uk", "bit.ly", "b.xn--p1ai"]
    prepared = spark.read.parquet(f"{data}/prepared.parquet")
    assert [r.uses_url_shortener for r in jobs.rule_scored(prepared).orderBy("row_order").collect()] == [False] * 4 + [True, False]
    (tmp_path / "list").write_text("// mine\nuk\nsite.com\n")
    jobs.main(["prepare", "--data", data, "--reports", f"file://{tmp_path}/reports", "--suffixes", f"file://{tmp_path}/list"])
    assert domains() == ["a.site.com", "b.site.com", "co.uk", "co.uk", "www.bit.ly", "a.b.xn--p1ai"]


def test_regression_is_at_its_minimum(spark):
    """The gradient of the stated objective vanishes, the intercept being part of the penalty."""
    import math

    df = spark.createDataFrame([(i, ("ab" * (i % 3 + 1)) + ("xy" if i % 2 else "zz"), (i % 2 if i else 1)) for i in range(12)], "id long, u string, target int")
    spec = textmodel.Spec("g", 2, 2, 2.0, min_df=1)
    model = textmodel.fit(df, "u", "target", spec)
    vocab = textmodel.numbered(model.vocab)
    w = textmodel.weights(df, "id", "u", vocab, spec).join(vocab, "i").collect()
    coef = {r.ngram: r.coefficient for r in model.coefficients.collect()}
    x: dict = {}
    for r in w:
        x.setdefault(r.id, {})[r.ngram] = r.weight
    grad, bias = dict(coef), model.intercept
    for r in df.collect():
        m = sum(coef[g] * v for g, v in x[r.id].items()) + model.intercept
        d = spec.c * (1 / (1 + math.exp(-m)) - r.target)
        bias += d
        for g, v in x[r.id].items():
            grad[g] += d * v
    assert max(abs(v) for v in [*grad.values(), bias]) < 1e-4


def test_stream_scores(spark, tmp_path):
    spark.createDataFrame([("http://192.168.1.10/login", "2026-01-01 00:10:00"), ("https://example.test/", "2026-01-01 00:20:00")], "url string, at string").select("url", F.col("at").cast("timestamp").alias("at")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("url string, at timestamp").parquet(f"{tmp_path}/in")
    q = counts_by_hour(stream, "at").writeStream.format("memory").queryName("scored").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    assert [(r.n_urls, r.n_alerts) for r in spark.table("scored").collect()] == [(2, 1)]


def test_sources(spark, tmp_path):
    assert raw.json_safe({1: {2.5}, "n": float("nan"), "o": object}) == {"1": [2.5], "n": None, "o": str(object)}
    df = spark.createDataFrame([("a|b", None)], "x string, y string")
    assert "a\\|b" in raw.markdown_table(df) and raw.markdown_table(df.limit(0)) == "_No rows._"
    assert raw.prior_fpr(spark, f"file://{tmp_path}/none.json") == (0.0163, None)
    assert raw.unicode_escaped("é\n") == "\\xe9\\n" and raw.percentage(0.12345) == "12.35%"
    with pytest.raises(ValueError):
        raw.concat_columns(df.withColumn("id", F.lit(1)), df.withColumn("id", F.lit(1)), "id")
    with pytest.raises(RuntimeError):
        raw.read_raw(spark, None, f"file://{tmp_path}/none")


def test_group_statistics_with_a_heavy_key(spark):
    rows = [("hot" if i % 3 else None if i % 6 else f"g{i}", f"k{i % 50}" if i % 7 else None, i % 2 if i % 5 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp string, key string, target int, at long").withColumns({"n": F.lit(1), "salt": F.lit(1), "first_seen": F.lit("x")})
    got = {r.grp: r for r in salted_group_stats(df, "grp", distinct="key", classes="target", moment="at", rows_per_salt=100).collect()}
    want: dict = {}
    for g, k, t, at in rows:
        want.setdefault(g, []).append((k, t, at))
    assert set(got) == set(want)
    for g, members in want.items():
        r = got[g]
        assert (r.n_rows, r.n_class_0, r.n_class_1) == (len(members), sum(t == 0 for _, t, _ in members), sum(t == 1 for _, t, _ in members))
        assert r.n_distinct == len({k for k, *_ in members if k is not None}) and (r.first_seen, r.last_seen) == (min(a for *_, a in members), max(a for *_, a in members))
    assert not salted_group_stats(df.limit(0), "grp", distinct="key", classes="target", moment="at").count()
    assert [r.key for r in heavy_keys(df, F.col("grp"), 3).collect()] == ["hot"]


def test_spread_join_and_ranks(spark):
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", i) for i in range(2000)] + [(None, -1)], "k string, v int")
    facts = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("v").alias("m"))
    out = spread_join(rows, facts, "k", weight="w", total=2000, parts=10)
    assert out.count() == 2000 and out.where("m < v").count() == 0 and set(out.columns) == {"k", "v", "m"}
    ranked = rank_within(rows.where("k is not null"), "k", "v", total=2000, rows_per_salt=100)
    r = ranked.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(x.n == x.d == x.m + 1 for x in r)


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame([*chain, *star, (5000, 5000), (7, None), (6, 7), (7, 6)], "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 5000: 5000}
    assert not components(df.limit(0), "a", "b").count()


def test_counters_are_passed_on():
    """A task never holds many more counters than it may, whatever the number of distinct terms."""
    import numpy as np

    from sievework.operators.counters import Counters

    c, seen = Counters(100), {}
    for s in range(50):
        c.add(np.repeat(np.arange(s * 60, s * 60 + 60, dtype=np.uint64), 2), np.tile([0, 1 + s % 2], 60).cumsum() // 2)
        assert c.held <= 160
        if c.full():
            k, o, _ = c.passed_on()
            seen |= dict(zip(k.tolist(), o.tolist()))
    k, o, _ = c.passed_on()
    seen |= dict(zip(k.tolist(), o.tolist()))
    assert len(seen) == 3000 and set(seen.values()) == {2}
    c = Counters(10)
    for _ in range(5):
        c.add(np.array([1, 1, 2, 3, 2, 9], np.uint64), np.array([0, 0, 0, 1, 1, 1]))
    k, o, r = c.merged()
    assert dict(zip(k.tolist(), o.tolist())) == {1: 10, 2: 10, 3: 5, 9: 5} and dict(zip(k.tolist(), r.tolist())) == {1: 5, 2: 10, 3: 5, 9: 5}


def test_most_frequent_grams(spark):
    """The cut by ranges, values and rank gives what sorting all would."""
    import random

    rng = random.Random(5)
    rows = [(f"g{i:04d}", rng.choice([3, 3, 3, 4, 5, 70, 71, 72, 1000, 10**7])) for i in range(2000)]
    df = spark.createDataFrame(rows, "ngram string, tf_total long")
    for most in (1, 100, 777, 1500, 2000, 5000):
        got = {r.ngram for r in textmodel.most_frequent(df, most).collect()}
        assert got == {g for g, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:most]}
