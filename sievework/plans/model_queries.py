"""Queries over splits and the text model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits, textmodel
from ..operators.shared import materialize
from ..session import table
from .url_queries import _strip

SPEC = textmodel.Spec("char34_c10_bal", 3, 4, 1.0, "balanced", scheme_neutral=True)
#: The counts over the range that the text model is fitted on.
WIDE = textmodel.Spec("char35_c10_bal", 3, 5, 1.0, "balanced", scheme_neutral=True)
#: The compact candidates, as the train job searches them, and the one that is fitted alone.
CANDIDATES = textmodel.compact_candidates()
FITTED = next(s for s in CANDIDATES if s.name == "char35_c10")


def _urls(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "prepared_urls")


def split_assignment(spark, sf_dir):
    return splits.assign_splits(_urls(spark, sf_dir).select("url_id", "split_group", "target")).select("url_id", F.col("fold").cast("int").alias("fold"), "split")


def split_quality(spark, sf_dir):
    """Whether the assignment keeps groups whole, and meets the shares and rates of its splits."""
    rows = _urls(spark, sf_dir).select("url_id", "split_group", "target")
    return splits.quality(materialize(splits.assign_splits(rows)), "split_group", {"train": 0.6, "validation": 0.2, "test": 0.2})


def split_hashed(spark, sf_dir):
    return splits.hashed_splits(_urls(spark, sf_dir))


def split_summary(spark, sf_dir):
    return splits.split_summary(_urls(spark, sf_dir))


def split_integrity(spark, sf_dir):
    return splits.integrity(_urls(spark, sf_dir))


def split_straddling_groups(spark, sf_dir):
    return splits.straddling(_urls(spark, sf_dir), "split_group")


def _vocabulary(spark, sf_dir, spec: textmodel.Spec) -> DataFrame:
    return textmodel.vocabulary(_urls(spark, sf_dir), "url_model_input", spec)


def _weights(spark, sf_dir, spec: textmodel.Spec) -> DataFrame:
    vocab = textmodel.numbered(_vocabulary(spark, sf_dir, spec))
    w = textmodel.weights(_urls(spark, sf_dir), "url_id", "url_model_input", vocab, spec)
    return w.groupBy(F.col("id").alias("url_id")).agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.sum("weight"), 5).alias("total"), F.round(F.max("weight"), 6).alias("largest"))


def ngram_vocabulary(spark, sf_dir):
    return _vocabulary(spark, sf_dir, SPEC).withColumn("idf", F.round("idf", 6))


def ngram_vocabulary_wide(spark, sf_dir):
    """``ngram_vocabulary`` with the 5-grams too."""
    return _vocabulary(spark, sf_dir, WIDE).withColumn("idf", F.round("idf", 6))


def tfidf_weights(spark, sf_dir):
    """Per record: number of weighted grams, their sum and the largest weight."""
    return _weights(spark, sf_dir, SPEC)


def tfidf_weights_wide(spark, sf_dir):
    """``tfidf_weights`` with the 5-grams too."""
    return _weights(spark, sf_dir, WIDE)


def _train(spark, sf_dir) -> DataFrame:
    return _urls(spark, sf_dir).where("split = 'train'").select("url_id", "url_model_input", F.col("target").cast("int").alias("target"))


def _validation(spark, sf_dir) -> DataFrame:
    return _urls(spark, sf_dir).where("split = 'validation'").select("url_id", "url_model_input", F.col("target").cast("int").alias("target"))


def logistic_scores(spark, sf_dir):
    model = textmodel.fit(_train(spark, sf_dir), "url_model_input", "target", FITTED)
    return model.score(_validation(spark, sf_dir), "url_id", "url_model_input").select(F.col("id").alias("url_id"), "score")


def logistic_settled(spark, sf_dir):
    """Rows and features the model is fitted on, and whether the gradient vanishes at its coefficients."""
    train = _train(spark, sf_dir)
    return textmodel.fit(train, "url_model_input", "target", FITTED).settled(train, "url_id", "url_model_input", "target")


def top_ngrams(spark, sf_dir):
    return textmodel.fit(_train(spark, sf_dir), "url_model_input", "target", FITTED).top_ngrams(50)


def candidate_search(spark, sf_dir):
    rows = textmodel.search(_train(spark, sf_dir), _validation(spark, sf_dir), "url_id", "url_model_input", "target", CANDIDATES)
    keep = "name c average_precision roc_auc expected_calibration_error matched_recall n_features".split()
    return spark.createDataFrame([(i + 1, *(r[k] for k in keep)) for i, r in enumerate(rows)], "rank_no int, name string, c double, average_precision double, roc_auc double, expected_calibration_error double, matched_recall double, n_features int")


_NAMES = "split_assignment split_quality split_hashed split_summary split_integrity split_straddling_groups ngram_vocabulary ngram_vocabulary_wide tfidf_weights tfidf_weights_wide logistic_scores logistic_settled top_ngrams candidate_search".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_GRAMS = rf"""
with t0 as (select url_id, regexp_replace(regexp_replace({_strip('url_model_input')}, '^(?i:https?://)', ''), '^(?i:www\.)', '') as t from prepared_urls),
t as (select url_id, regexp_replace(t, '[\s\p{{Z}}\x1c-\x1f\x{{85}}][\s\p{{Z}}\x1c-\x1f\x{{85}}]+', ' ', 'g') as t from t0),
tf as (select url_id as id, ngram, count(*) as tf from (
  select url_id, substr(t, i, k) as ngram from (select url_id, t, k, unnest(generate_series(1, length(t) - k + 1)) as i from t, (values (3), (4)) v(k))) group by 1, 2),
vocab as (select ngram, count(*) as df, cast(sum(tf) as bigint) as tf_total, ln((1.0e0 + (select count(*) from prepared_urls)) / (1.0e0 + count(*))) + 1 as idf from tf group by 1 having count(*) >= 3 order by 3 desc, 1 limit 250000)
"""
_WEIGHTS = "w as (select id, (1 + ln(tf)) * idf as raw from tf join vocab using (ngram)), n as (select id, sqrt(sum(raw * raw)) as norm from w group by 1) select id as url_id, count(*) as n_grams, round(sum(raw / norm), 5) as total, round(max(raw / norm), 6) as largest from w join n using (id) group by 1"
_WIDE = _GRAMS.replace("(values (3), (4))", "(values (3), (4), (5))")
_FITTED_GRAMS = r"""
with t as (select url_id, regexp_replace(coalesce(url_model_input, ''), '[\s\p{Z}\x1c-\x1f\x{85}][\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g') as t from prepared_urls where split = 'train'),
g as (select distinct url_id, substr(t, i, k) as ngram from (select url_id, t, k, unnest(generate_series(1, length(t) - k + 1)) as i from t, (values (3), (4), (5)) v(k))),
v as (select ngram from g group by 1 having count(*) >= 3)
"""
ORACLE = {
    "logistic_settled": f"{_FITTED_GRAMS} select (select count(*) from t) as n_rows, least((select count(*) from v), 250000) as n_features, true as settled",
    "split_quality": "select count(*) as n_rows, count(*) filter (split_group is null) as rows_unplaced, true as shares_met, true as rates_met, count(distinct split_group) as n_groups, 0 as groups_apart from prepared_urls",
    "split_hashed": "with g as (select split_group as g, count(*) as n, count(*) filter (target = 1) as n1 from prepared_urls group by 1), f as (select g, cast((row_number() over (partition by n1 * 2 > n order by n desc, sha256('42' || coalesce(g, ''))) - 1) % 5 as int) as fold from g) select g, fold, case when fold <= 2 then 'train' when fold = 3 then 'validation' else 'test' end as split from f",
    "split_summary": "select split, count(*) as n_rows, round_even(count(*) * 100.0e0 / (select count(*) from prepared_urls), 4) as percent, count(*) filter (target = 1) as phishing, count(*) filter (target = 0) as legitimate, round_even(count(*) filter (target = 1) * 1.0e0 / count(*), 6) as rate, count(distinct split_group) as n_groups from prepared_urls group by 1",
    "split_integrity": "select (select count(distinct split) from prepared_urls) as n_splits, (select count(*) from prepared_urls where split is null or split not in ('train', 'validation', 'test')) as unknown_rows, (select count(*) from (select 1 from prepared_urls group by split_group having count(distinct split) > 1)) as straddling_groups, (select count(*) from (select 1 from prepared_urls group by url_dedupe_key having count(distinct split) > 1)) as straddling_keys",
    "split_straddling_groups": "select split_group as value, count(distinct split) as n_splits from prepared_urls group by 1 having count(distinct split) > 1",
    "ngram_vocabulary": f"{_GRAMS} select ngram, df, tf_total, round(idf, 6) as idf from vocab",
    "ngram_vocabulary_wide": f"{_WIDE} select ngram, df, tf_total, round(idf, 6) as idf from vocab",
    "tfidf_weights": f"{_GRAMS}, {_WEIGHTS}",
    "tfidf_weights_wide": f"{_WIDE}, {_WEIGHTS}",
}
