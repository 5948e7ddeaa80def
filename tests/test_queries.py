"""Every query of the core that has SQL beside it, on the smallest tables; the others must run."""

import pytest
from conftest import DATA, same_rows

from sievework.operators import textmodel
from sievework.plans import catalog, model_queries


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE)))
def test_same_as_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLE[name]))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_assignment_keeps_groups_together(spark):
    x = catalog.QUERIES["split_assignment"](spark, DATA)
    urls = spark.read.parquet(f"{DATA}/prepared_urls.parquet").select("url_id", "split_group")
    assert x.count() == urls.count()
    assert x.join(urls, "url_id").groupBy("split_group").agg({"fold": "min"}).count() == x.join(urls, "url_id").select("split_group", "split").distinct().count()


def test_model_queries_run_the_whole_job(spark):
    """All compact candidates are ranked, and the model is fitted on 3- to 5-grams without a smaller vocabulary."""
    ranked = catalog.QUERIES["candidate_search"](spark, DATA).collect()
    assert {r.name for r in ranked} == {s.name for s in textmodel.compact_candidates()} and [r.rank_no for r in ranked] == [*range(1, 8)]
    top = catalog.QUERIES["top_ngrams"](spark, DATA).collect()
    assert {len(r.ngram) for r in top} == {3, 4, 5}
    assert model_queries.FITTED in textmodel.compact_candidates() and model_queries.FITTED.max_features == 250_000
    wide = {r.n for r in catalog.QUERIES["ngram_vocabulary_wide"](spark, DATA).selectExpr("length(ngram) as n").distinct().collect()}
    assert wide == {3, 4, 5}


@pytest.mark.parametrize("name", ["ranking_metrics", "threshold_tradeoff", "score_histogram"])
def test_every_model_is_evaluated(spark, name):
    models = {r.model for r in spark.read.parquet(f"{DATA}/url_scores.parquet").where("score is not null").select("model").distinct().collect()}
    assert len(models) > 1 and {r.model for r in catalog.QUERIES[name](spark, DATA).select("model").distinct().collect()} == models


def test_one_scan_serves_all_profiles(spark):
    """The plan of the profiles reads the table of thresholds once, and the scores not at all any more."""
    plan = catalog.QUERIES["profiles"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "url_scores" not in plan and plan.count("Aggregate") < 8
