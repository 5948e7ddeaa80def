"""The transparent additive scorer over URL features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name, condition over the feature columns, weight in hundredths, explanation.
RULES = [
    ("invalid_url", "not is_valid_url", 30, "No usable hostname."),
    ("non_http_scheme", "has_non_http_scheme", 30, "A scheme other than HTTP or HTTPS is written."),
    ("ip_hostname", "has_ip_hostname", 30, "The host is an IP address."),
    ("userinfo_or_at_symbol", "has_userinfo", 25, "User information precedes the host."),
    ("punycode_hostname", "has_punycode", 20, "The host has a punycode label."),
    ("multiple_suspicious_hostname_terms", "suspicious_hostname_keyword_count >= 2", 22, "Several suspicious terms in the host."),
    ("suspicious_hostname_term", "suspicious_hostname_keyword_count = 1", 12, "A suspicious term in the host."),
    ("url_shortener", "uses_url_shortener", 14, "The domain shortens URLs."),
    ("non_default_port", "has_non_default_port", 12, "The port is unusual or malformed."),
    ("very_long_url", "url_length >= 200", 16, "The URL has 200 characters or more."),
    ("long_url", "url_length between 120 and 199", 8, "The URL has 120 to 199 characters."),
    ("many_hostname_levels", "dot_count >= 5", 10, "The host has five dots or more."),
    ("deep_hostname", "dot_count = 4", 5, "The host has four dots."),
    ("many_hostname_hyphens", "hostname_hyphen_count >= 3", 8, "The host has three hyphens or more."),
    ("high_digit_ratio", "digit_ratio >= 0.30D", 10, "Three tenths digits or more."),
    ("moderate_digit_ratio", "digit_ratio >= 0.18D and digit_ratio < 0.30D", 5, "Digits between 0.18 and 0.30."),
    ("heavy_percent_encoding", "percent_encoded_count >= 3", 8, "Three percent escapes or more."),
    ("multiple_suspicious_path_terms", "suspicious_path_query_keyword_count >= 2", 8, "Several suspicious terms in path or query."),
    ("suspicious_path_term", "suspicious_path_query_keyword_count = 1", 3, "A suspicious term in path or query."),
    ("long_query", "query_length >= 120", 5, "The query has 120 characters or more."),
    ("many_special_characters", "special_character_count >= 20", 5, "Twenty special characters or more."),
    ("not_https", "is_valid_url and not uses_https", 2, "The scheme is not HTTPS."),
]
DEFAULT_THRESHOLD = 0.35


def contributions() -> Column:
    """The rules that fire, in their order, as an array of structs (idx, name, weight, explanation)."""
    fired = [
        F.when(F.expr(cond), F.struct(F.lit(i).alias("idx"), F.lit(name).alias("name"), F.lit(w / 100).alias("weight"), F.lit(text).alias("explanation")))
        for i, (name, cond, w, text) in enumerate(RULES)
    ]
    return F.filter(F.array(*fired), lambda r: r.isNotNull())


def score() -> Column:
    """The sum of the weights, at most 1, counted in whole hundredths. A null feature fires nothing."""
    total = F.lit(0)
    for _, cond, w, _ in RULES:
        total = total + F.when(F.expr(cond), w).otherwise(0)
    return F.least(total, F.lit(100)) / F.lit(100.0)


def predict(score_: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    return (score_ >= F.lit(float(threshold))).cast("tinyint")


def explain(limit: int = 5) -> Column:
    """The ``limit`` heaviest rules that fire, ties in the rules' order."""
    if limit < 1:
        raise ValueError("limit must be positive")
    ordered = F.array_sort(contributions(), lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(a["idx"] - b["idx"]))
    return F.slice(ordered, 1, limit)


def trigger_counts(df: DataFrame, top: int = 15) -> DataFrame:
    """``(rule, count)`` of the ``top`` rules that fire most often over the feature table, ties in the rules' order.

    One pass: a count per rule, unpivoted, so no row is multiplied.
    """
    one = df.agg(*(F.count_if(F.expr(cond)).alias(name) for name, cond, _, _ in RULES))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("count"), F.lit(i).alias("i")) for i, (name, *_) in enumerate(RULES)))
    rows = one.select(F.explode(pairs).alias("r")).select("r.*").where(F.col("count") > 0)
    return rows.orderBy(F.desc("count"), "i").limit(top).select("rule", "count")


def score_sql(features: str) -> str:
    """The score over the table or query ``features`` as ANSI SQL text, for comparison."""
    terms = " + ".join(f"case when {cond.replace('D', '') if 'digit_ratio' in cond else cond} then {w} else 0 end" for _, cond, w, _ in RULES)
    return f"select url_id, least({terms}, 100) / 100.0e0 as score from {features}"
