"""Queries over URLs: parts, canonical keys, features, rules, preparation and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, urls
from ..functions.suffix import TEST_RULES, registered_domain
from ..operators import audit, prepare
from ..session import table
from .jobs import rule_scored


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "prepared_urls")


def url_parse(spark, sf_dir):
    x = urls.with_parts(_urls(spark, sf_dir).select("url_id", "url_original"), "url_original")
    return x.select("url_id", *(f"parts.{c}" for c in "explicit parsed scheme netloc path query userinfo host port port_bad".split()))


def url_canonical_key(spark, sf_dir):
    x = urls.with_parts(_urls(spark, sf_dir).select("url_id", "url_original"), "url_original")
    return x.select("url_id", urls.dedupe_key().alias("url_dedupe_key"))


def url_groups(spark, sf_dir):
    x = urls.with_parts(_urls(spark, sf_dir).select("url_id", "url_original"), "url_original").withColumn("key", urls.dedupe_key())
    x = x.withColumn("registered_domain", registered_domain(spark, F.col("parts.host")))
    return x.select("url_id", "registered_domain", urls.is_valid().alias("is_valid_url"), urls.split_group(F.col("registered_domain"), F.col("key")).alias("split_group"))


def text_normaliser(spark, sf_dir):
    u = F.col("url_original")
    return _urls(spark, sf_dir).select("url_id", urls.text_model_input(u).alias("model_text"), urls.protocol_only_score(u).alias("protocol_score"))


def _featured(spark, sf_dir, *also: str) -> DataFrame:
    return rule_scored(_urls(spark, sf_dir).select("url_id", "url_original", *also), "url_original", TEST_RULES)


def url_features(spark, sf_dir):
    return _featured(spark, sf_dir).select("url_id", *(F.round("digit_ratio", 9).alias("digit_ratio") if c == "digit_ratio" else F.col(c) for c in urls.FEATURES))


def rule_scores(spark, sf_dir):
    return _featured(spark, sf_dir).select("url_id", F.round("score", 6).alias("score"), rules.predict(F.col("score")).cast("int").alias("predicted"))


def rule_trigger_counts(spark, sf_dir):
    return rules.trigger_counts(_featured(spark, sf_dir))


def rule_explanations(spark, sf_dir):
    """The five heaviest rules of each URL, as ``name=weight``."""
    shown = F.array_join(F.transform(rules.explain(5), lambda r: F.concat(r["name"], F.lit("="), F.format_string("%.2f", r["weight"]))), ";")
    return _featured(spark, sf_dir).select("url_id", shown.alias("explanation"))


def rule_class_summary(spark, sf_dir):
    """Rows, mean and largest rule score and alerts per class."""
    return _featured(spark, sf_dir, "target").groupBy("target").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("score"), 6).alias("mean_score"), F.max("score").alias("max_score"), F.count_if(F.col("score") >= rules.DEFAULT_THRESHOLD).alias("n_alerts"))


def _prepared(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All raw rows; those with a label other than 0 and 1 are set aside and counted."""
    return prepare.prepare(table(spark, sf_dir, "raw_urls"), set_aside=True)


def prepare_records(spark, sf_dir):
    return _prepared(spark, sf_dir)[0].withColumn("target", F.col("target").cast("int"))


def prepare_conflicts(spark, sf_dir):
    return _prepared(spark, sf_dir)[1].select("row_order", "url_dedupe_key", F.col("target").cast("int").alias("target"))


def prepare_summary(spark, sf_dir):
    return _prepared(spark, sf_dir)[2]


def raw_quality(spark, sf_dir):
    """What validation of the raw table counts, in one pass."""
    return table(spark, sf_dir, "raw_urls").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("url").isNull()).alias("null_urls"), F.count_if(urls.stripped(F.col("url")) == "").alias("blank_urls"), F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("odd_labels")
    )


def audit_overview(spark, sf_dir):
    return audit.overview(_urls(spark, sf_dir))


def audit_class_summary(spark, sf_dir):
    return audit.class_summary(_urls(spark, sf_dir)).withColumn("target", F.col("target").cast("int"))


def audit_class_counts(spark, sf_dir):
    return audit.class_counts(_urls(spark, sf_dir))


def audit_domain_frequency(spark, sf_dir):
    return audit.domain_frequency(_urls(spark, sf_dir)).withColumn("target", F.col("target").cast("int"))


def audit_top_domains_by_class(spark, sf_dir):
    return audit.top_domains_by_class(_urls(spark, sf_dir)).withColumn("target", F.col("target").cast("int"))


def audit_top_domains(spark, sf_dir):
    return audit.top_domains(_urls(spark, sf_dir))


def audit_describe(spark, sf_dir):
    return audit.describe(audit.measured(_urls(spark, sf_dir)))


def audit_length_histogram(spark, sf_dir):
    return audit.histogram(audit.measured(_urls(spark, sf_dir)), "url_length").select("bin", "n_rows")


_NAMES = (
    "url_parse url_canonical_key url_groups text_normaliser url_features rule_scores rule_trigger_counts rule_explanations rule_class_summary prepare_records prepare_conflicts "
    "prepare_summary raw_quality audit_overview audit_class_summary audit_class_counts audit_domain_frequency audit_top_domains_by_class audit_top_domains audit_describe audit_length_histogram"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

# Fixed values, written out for the SQL so that it does not share the code's.
_SQL_KEYWORDS = (
    "account", "auth", "banking", "confirm", "credential", "invoice", "login", "password", "payment", "recover", "secure", "session", "signin", "support",
    "unlock", "update", "verify", "wallet", "webscr",
)
_SQL_SHORTENERS = "'bit.ly', 'buff.ly', 'cutt.ly', 'goo.gl', 'is.gd', 'ow.ly', 'rebrand.ly', 'shorturl.at', 't.co', 'tiny.cc', 'tinyurl.com'"
_SQL_SUFFIX_1 = "'example', 'test', 'invalid'"
_SQL_SUFFIX_2 = "'co.example', 'org.test', 'ac.example', 'gov.test'"
_SQL_FEATURES = (
    "is_valid_url", "uses_https", "has_non_http_scheme", "has_ip_hostname", "has_userinfo", "has_punycode", "has_non_default_port", "uses_url_shortener", "url_length",
    "hostname_length", "path_length", "query_length", "dot_count", "hostname_hyphen_count", "path_depth", "digit_ratio", "special_character_count", "percent_encoded_count",
    "suspicious_hostname_keyword_count", "suspicious_path_query_keyword_count",
)
_SQL_RULES = [
    ("invalid_url", "not is_valid_url", 30),
    ("non_http_scheme", "has_non_http_scheme", 30),
    ("ip_hostname", "has_ip_hostname", 30),
    ("userinfo_or_at_symbol", "has_userinfo", 25),
    ("punycode_hostname", "has_punycode", 20),
    ("multiple_suspicious_hostname_terms", "suspicious_hostname_keyword_count >= 2", 22),
    ("suspicious_hostname_term", "suspicious_hostname_keyword_count = 1", 12),
    ("url_shortener", "uses_url_shortener", 14),
    ("non_default_port", "has_non_default_port", 12),
    ("very_long_url", "url_length >= 200", 16),
    ("long_url", "url_length between 120 and 199", 8),
    ("many_hostname_levels", "dot_count >= 5", 10),
    ("deep_hostname", "dot_count = 4", 5),
    ("many_hostname_hyphens", "hostname_hyphen_count >= 3", 8),
    ("high_digit_ratio", "digit_ratio >= 0.30", 10),
    ("moderate_digit_ratio", "digit_ratio >= 0.18 and digit_ratio < 0.30", 5),
    ("heavy_percent_encoding", "percent_encoded_count >= 3", 8),
    ("multiple_suspicious_path_terms", "suspicious_path_query_keyword_count >= 2", 8),
    ("suspicious_path_term", "suspicious_path_query_keyword_count = 1", 3),
    ("long_query", "query_length >= 120", 5),
    ("many_special_characters", "special_character_count >= 20", 5),
    ("not_https", "is_valid_url and not uses_https", 2),
]
_B = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def _strip(col: str) -> str:
    return rf"regexp_replace(coalesce({col}, ''), '^{_B}+|{_B}+$', '', 'g')"


def parts_sql(source: str, ident: str, url: str, also: str = "") -> str:
    """CTEs ending in ``parts``: the grammar written in SQL."""
    keep = f"{ident}{', ' + also if also else ''}"
    return rf"""
a as (select {keep}, {url} as u, {_strip(url)} as raw from {source}),
b as (select *, regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*://') as explicit from a),
c as (select *, translate(case when explicit then raw when raw like '//%' then 'http:' || raw else 'http://' || raw end, chr(9) || chr(10) || chr(13), '') as whole from b),
d as (select *, regexp_extract(whole, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) as s from c),
e as (select *, substr(whole, length(s) + 2) as rest from d),
f as (select *, regexp_extract(rest, '^//([^/?#]*)', 1) as loc from e),
g as (select *, split_part(substr(rest, length(loc) + 3), '#', 1) as nf, regexp_extract(loc, '([^@]*)$', 1) as info, regexp_extract(loc, '\[([^\]]*)', 1) as lit from f),
h as (select *, split_part(nf, '?', 1) as p,
  case when info like '%[%' then lit2 else split_part(info, ':', 1) end as hh,
  case when info like '%[%' then regexp_extract(info, '(?s)\[[^\]]*\][^:]*:(.*)$', 1) else substr(info, length(split_part(info, ':', 1)) + 2) end as pt,
  raw <> '' and not regexp_matches(loc, '{urls._UNSAFE}') and case when loc like '%[%' or loc like '%]%' then loc like '%[%' and loc like '%]%' and (regexp_matches(lit, '^(?:{urls.IPV6})$') or regexp_matches(lit, '(?s)^v[a-fA-F0-9]+\..+$')) else true end as ok
  from (select *, regexp_extract(info, '\[([^\]]*)', 1) as lit2 from g)),
i as (select *, length(split_part(hh, '%', 1)) as z, pt <> '' and (not regexp_matches(pt, '^[0-9]+$') or length(ltrim(pt, '0')) > 5 or coalesce(try_cast(nullif(ltrim(pt, '0'), '') as int), 0) > 65535) as badport from h),
parts as (select {keep}, u, raw, explicit and raw <> '' as explicit, ok as parsed, case when ok then lower(s) else '' end as scheme, case when ok then loc else '' end as netloc,
  case when ok then p else '' end as path, case when ok then substr(nf, length(p) + 2) else '' end as query,
  case when ok and loc like '%@%' then left(loc, length(loc) - length(info) - 1) end as userinfo,
  case when ok and hh <> '' then lower(left(hh, z)) || substr(hh, z + 1) end as host,
  case when ok and pt <> '' and not badport then cast(pt as int) end as port, ok and badport as port_bad from i)
"""


_DEFAULT = "((scheme = 'http' and port = 80) or (scheme = 'https' and port = 443))"
_KEYED = (
    "keyed as (select *, case when not parsed or host is null or port_bad or rtrim(host, '.') = '' then split_part(raw, '#', 1) else "
    "case when explicit then scheme || ':' else '' end || '//' || case when userinfo is null then '' else userinfo || '@' end || "
    "case when contains(host, ':') then '[' || lower(rtrim(host, '.')) || ']' else lower(rtrim(host, '.')) end || "
    f"case when port is null or {_DEFAULT} then '' else ':' || port end || path || case when query <> '' then '?' || query else '' end end as key from parts)"
)
_IP = f"regexp_matches(n, '^(?:{urls.IPV4})$') or regexp_matches(n, '^(?:{urls.IPV6})$')"
_DOMAIN = rf"""
named as (select *, nullif(rtrim(host, '.'), '') as n from keyed),
grouped as (select *, case when n is null or {_IP} then n
  when regexp_matches(n, '(^|\.)[^.]*\.[^.]*$') and regexp_extract(n, '([^.]*\.[^.]*)$', 1) in ({_SQL_SUFFIX_2}) then case when regexp_matches(n, '\..*\.') then regexp_extract(n, '([^.]*\.[^.]*\.[^.]*)$', 1) else n end
  when regexp_extract(n, '([^.]*)$', 1) in ({_SQL_SUFFIX_1}) and contains(n, '.') then regexp_extract(n, '([^.]*\.[^.]*)$', 1) else n end as domain,
  host is not null and not regexp_matches(host, '{_B}') as valid from named)
"""
_GROUP = "case when length(domain) > 0 then domain else 'invalid-' || left(sha256(key), 16) end"
_ALL = f"with {parts_sql('prepared_urls', 'url_id', 'url_original', 'target')}, {_KEYED}, {_DOMAIN}"


def _n(pattern: str, col: str) -> str:
    return f"cast(len(regexp_extract_all({col}, '{pattern}')) as int)"


def _keywords(expr: str) -> str:
    return "(" + " + ".join(f"cast(contains(lower({expr}), '{k}') as int)" for k in _SQL_KEYWORDS) + ")"


_FEATURES = rf"""
hosted as (select *, coalesce(rtrim(lower(host), '.'), '') as hn from grouped),
features as (select url_id, target, hn <> '' as is_valid_url, scheme = 'https' as uses_https, explicit and parsed and scheme not in ('http', 'https') as has_non_http_scheme,
  hn <> '' and (regexp_matches(hn, '^(?:{urls.IPV4})$') or regexp_matches(hn, '^(?:{urls.IPV6})$')) as has_ip_hostname, contains(netloc, '@') as has_userinfo, regexp_matches(hn, '(^|\.)xn--') as has_punycode,
  port_bad or (port is not null and not {_DEFAULT}) as has_non_default_port, coalesce(domain in ({_SQL_SHORTENERS}), false) as uses_url_shortener,
  cast(length(raw) as int) as url_length, cast(length(hn) as int) as hostname_length, cast(length(path) as int) as path_length, cast(length(query) as int) as query_length,
  cast(length(hn) - length(replace(hn, '.', '')) as int) as dot_count, cast(length(hn) - length(replace(hn, '-', '')) as int) as hostname_hyphen_count,
  cast(len(list_filter(string_split(path, '/'), lambda q: q <> '')) as int) as path_depth, case when raw = '' then 0 else {_n(urls.DIGIT, 'raw')} / length(raw) end as digit_ratio,
  {_n('[^A-Za-z0-9]', 'raw')} as special_character_count, {_n('%[0-9A-Fa-f]{2}', 'raw')} as percent_encoded_count,
  {_keywords('hn')} as suspicious_hostname_keyword_count, {_keywords("path || '?' || query")} as suspicious_path_query_keyword_count from hosted)
"""
_WITH_FEATURES = f"{_ALL}, {_FEATURES}"


_POINTS = " + ".join(f"case when {c} then {w} else 0 end" for _, c, w in _SQL_RULES)
_SCORED = f"{_WITH_FEATURES}, scored as (select url_id, target, least({_POINTS}, 100) / 100.0e0 as score from features)"
_TRIGGERS = " union all ".join(f"select {i} as i, '{n}' as rule, count(*) filter ({c}) as count from features" for i, (n, c, _) in enumerate(_SQL_RULES))
_FIRED = ", ".join(f"case when {c} then {{'w': {w}, 'i': {i}, 't': '{n}={w / 100:.2f}'}} end" for i, (n, c, w) in enumerate(_SQL_RULES))
_RAW = f"with {parts_sql('(select * from raw_urls where label in (0, 1))', 'row_id', 'url', 'label')}, {_KEYED}, {_DOMAIN}"
_MARKED = f"""{_RAW}, working as (select row_id as row_order, u as url_original, label as source_label, raw as url_model_input, key as url_dedupe_key, domain as registered_domain, valid as is_valid_url, cast(1 - label as int) as target, {_GROUP} as split_group from grouped where raw <> ''),
marked as (select *, min(target) over (partition by url_dedupe_key) <> max(target) over (partition by url_dedupe_key) as conflicting, row_number() over (partition by url_dedupe_key, target order by row_order) = 1 as first from working)
"""
_MEASURED = r"measured as (select length(url_model_input) as url_length, len(regexp_extract_all(url_model_input, '\p{Nd}')) as digit_count, len(regexp_extract_all(url_model_input, '[^A-Za-z0-9]')) as symbol_count from prepared_urls)"


def _describe_sql() -> str:
    stats = [("count", "count({0})"), ("mean", "avg({0})"), ("std", "stddev_samp({0})"), ("min", "min({0})")] + [(f"{q}%", f"quantile_cont({{0}}, 0.{q})") for q in (50, 90, 95, 99)] + [("max", "max({0})")]
    return f"with {_MEASURED} " + " union all ".join(f"select '{n}' as statistic, " + ", ".join(f"round_even(cast({e.format(m)} as double), 2) as {m}" for m in audit.MEASURES) + " from measured" for n, e in stats)


ORACLE = {
    "url_parse": f"{_ALL} select url_id, explicit, parsed, scheme, netloc, path, query, userinfo, host, port, port_bad from parts",
    "url_canonical_key": f"{_ALL} select url_id, key as url_dedupe_key from keyed",
    "url_groups": f"{_ALL} select url_id, domain as registered_domain, valid as is_valid_url, {_GROUP} as split_group from grouped",
    "text_normaliser": rf"select url_id, regexp_replace(regexp_replace({_strip('url_original')}, '^(?i:https?://)', ''), '^(?i:www\.)', '') as model_text, cast(starts_with(lower({_strip('url_original')}), 'http://') as double) as protocol_score from prepared_urls",
    "url_features": f"{_WITH_FEATURES} select url_id, {', '.join('round(digit_ratio, 9) as digit_ratio' if c == 'digit_ratio' else c for c in _SQL_FEATURES)} from features",
    "rule_scores": f"{_SCORED} select url_id, round(score, 6) as score, cast(score >= 0.35 as int) as predicted from scored",
    "rule_trigger_counts": f"{_WITH_FEATURES} select rule, count from ({_TRIGGERS}) where count > 0 order by count desc, i limit 15",
    "rule_explanations": f"{_WITH_FEATURES} select url_id, array_to_string(list_transform(list_slice(list_sort(list_filter([{_FIRED}], lambda x: x is not null)), 1, 5), lambda x: x.t), ';') as explanation from features".replace("{'w': ", "{'w': -"),
    "rule_class_summary": f"{_SCORED} select target, count(*) as n_rows, round(avg(score), 6) as mean_score, max(score) as max_score, count(*) filter (score >= 0.35) as n_alerts from scored group by 1",
    "prepare_records": f"{_MARKED} select row_order, {', '.join(prepare.PREPARED)} from marked where not conflicting and first",
    "prepare_conflicts": f"{_MARKED} select row_order, url_dedupe_key, target from marked where conflicting",
    "prepare_summary": f"""{_MARKED} select (select count(*) from raw_urls) as raw_rows, (select count(*) from raw_urls where {_strip('url')} = '') as empty_rows,
      (select count(*) from raw_urls where {_strip('url')} <> '' and (label is null or label not in (0, 1))) as bad_label_rows, count(*) as rows_after_empty,
      count(distinct case when conflicting then url_dedupe_key end) as conflicting_keys, count(*) filter (conflicting) as conflicting_rows, count(*) filter (not conflicting and not first) as duplicates_removed,
      count(*) filter (not conflicting and first) as prepared_rows, count(*) filter (not conflicting and first and not is_valid_url) as invalid_retained, count(distinct case when not conflicting and first then split_group end) as unique_groups from marked""",
    "raw_quality": f"select count(*) as n_rows, count(*) filter (url is null) as null_urls, count(*) filter ({_strip('url')} = '') as blank_urls, count(*) filter (label is null or label not in (0, 1)) as odd_labels from raw_urls",
    "audit_overview": "select count(*) as n_rows, count(*) filter (url_model_input is null) as null_inputs, count(*) filter (not is_valid_url) as invalid_rows, count(distinct split_group) as n_groups, count(url_model_input) - count(distinct url_model_input) as duplicate_inputs, count(url_dedupe_key) - count(distinct url_dedupe_key) as duplicate_keys from prepared_urls",
    "audit_class_summary": "select cast(target as int) as target, case target when 0 then 'legitimate' when 1 then 'phishing' end as class, count(*) as n_rows, count(distinct split_group) as n_groups, round_even(count(*) * 100.0e0 / (select count(*) from prepared_urls), 2) as percent from prepared_urls group by target",
    "audit_class_counts": "select t as target, (select count(*) from prepared_urls where target = t) as n_rows from (values (0), (1)) v(t)",
    "audit_domain_frequency": "select cast(target as int) as target, registered_domain, count(*) as n_rows from prepared_urls group by 1, 2",
    "audit_top_domains_by_class": "select * from (select cast(target as int) as target, registered_domain, count(*) as n_rows, cast(row_number() over (partition by target order by count(*) desc, registered_domain nulls first) as int) as rank_no from prepared_urls group by 1, 2, target) where rank_no <= 10",
    "audit_top_domains": "select coalesce(registered_domain, '<invalid>') as domain, count(*) as n_rows from prepared_urls group by 1 order by 2 desc, 1 limit 20",
    "audit_describe": _describe_sql(),
    "audit_length_histogram": f"with {_MEASURED}, ends as (select min(url_length) as lo, max(url_length) as hi from measured) select cast(least(floor((cast(url_length as double) - lo) / ((hi - lo) / 50.0e0)), 49) as int) as bin, count(*) as n_rows from measured, ends group by 1",
}
