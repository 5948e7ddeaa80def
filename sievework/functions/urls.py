"""URL strings taken apart, made canonical and measured, as column expressions. No URL is ever opened.

The grammar is that of CPython 3.13's ``urllib.parse.urlsplit``. Every function returns columns, so Catalyst keeps the
work in generated code; ``with_parts`` computes the parts once and everything else refers to them.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms that make a host or path suspicious, and domains that shorten URLs.
KEYWORDS = (
    "account", "auth", "banking", "confirm", "credential", "invoice", "login", "password", "payment", "recover", "secure", "session", "signin", "support",
    "unlock", "update", "verify", "wallet", "webscr",
)
SHORTENERS = ("bit.ly", "buff.ly", "cutt.ly", "goo.gl", "is.gd", "ow.ly", "rebrand.ly", "shorturl.at", "t.co", "tiny.cc", "tinyurl.com")

_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"
_H16 = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _ipv6() -> str:
    """Eight groups, or fewer around one ``::``; the last two may be written as an IPv4 address; a zone may follow."""
    tail = f"(?:{_H16}:{_H16}|{IPV4})"
    forms = [f"(?:{_H16}:){{6}}{tail}"]
    for after in range(6):  # groups between the gap and the last 32 bits
        before = 5 - after
        lead = f"(?:{_H16}(?::{_H16}){{0,{before - 1}}})?" if before else ""
        forms.append(f"{lead}::" + (f"(?:{_H16}:){{{after}}}" if after else "") + tail)
    forms.append(f"(?:{_H16}(?::{_H16}){{0,5}})?::{_H16}")
    forms.append(f"(?:{_H16}(?::{_H16}){{0,6}})?::")
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


IPV6 = _ipv6()


def _unsafe_class() -> str:
    """Characters whose compatibility form holds one of ``/?#@:``: a host with one of them is rejected. None lies beyond the basic plane."""
    mapped = (c for c in map(chr, range(0x80, 0x10000)) if unicodedata.decomposition(c).startswith("<"))
    bad = [c for c in mapped if set(unicodedata.normalize("NFKC", c)) & set("/?#@:")]
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in bad) + "]"


_UNSAFE = _unsafe_class()


def _digit_class() -> str:
    """Decimal digits, and the characters that are digits in writing only, such as superscripts. None of the latter lies beyond U+1F10A."""
    others = [c for c in range(0x80, 0x1F10B) if chr(c).isdigit() and not chr(c).isdecimal()]
    return r"[\p{Nd}" + "".join(f"\\x{{{c:x}}}" for c in others) + "]"


DIGIT = _digit_class()


def stripped(col: Column) -> Column:
    """Without Unicode white space at both ends; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), f"^{_BLANK}+|{_BLANK}+$", "")


def _after(col: Column, n: Column) -> Column:
    """The text after its first ``n`` characters."""
    return F.substr(col, n + 1)


def with_parts(df: DataFrame, url: str, name: str = "parts") -> DataFrame:
    """``df`` with the struct ``name`` of the parts of the text column ``url``.

    ``raw`` (stripped), ``explicit`` (scheme was written), ``parsed``, ``scheme``, ``netloc``, ``path``, ``query``, ``userinfo`` (null
    if none), ``host`` (lower case; null if none), ``bracketed``, ``port`` (null if none or bad), ``port_bad``. An empty
    or unparsable text has ``parsed`` false, empty text parts and no host. A column called ``name`` is replaced.
    """
    # Flat columns, one step at a time: fields of a struct under construction would be expanded into each other.
    def c(k: str) -> Column:
        return F.col(f"__p_{k}")

    def add(x: DataFrame, **cols: Column) -> DataFrame:
        return x.withColumns({f"__p_{k}": v for k, v in cols.items()})

    x = add(df, raw=stripped(F.col(url)))
    x = add(x, explicit=c("raw").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))
    whole = F.when(c("explicit"), c("raw")).when(c("raw").startswith("//"), F.concat(F.lit("http:"), c("raw"))).otherwise(F.concat(F.lit("http://"), c("raw")))
    x = add(x, whole=F.translate(whole, "\t\r\n", ""))
    x = add(x, s=F.regexp_extract(c("whole"), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    x = add(x, rest=_after(c("whole"), F.length(c("s")) + 1))
    x = add(x, loc=F.regexp_extract(c("rest"), r"^//([^/?#]*)", 1))
    x = add(x, nf=F.substring_index(_after(c("rest"), F.length(c("loc")) + 2), "#", 1), info=F.substring_index(c("loc"), "@", -1))
    opened, closed = c("loc").contains("["), c("loc").contains("]")
    inner = F.regexp_extract(c("loc"), r"\[([^\]]*)", 1)
    literal = inner.rlike(rf"^(?:{IPV6})$") | inner.rlike(r"(?s)^v[a-fA-F0-9]+\..+$")
    odd = c("loc").rlike(r"[^\x00-\x7F]")
    fine = (c("raw") != "") & F.when(odd, ~c("loc").rlike(_UNSAFE)).otherwise(True) & F.when(opened | closed, opened & closed & literal).otherwise(True)
    x = add(x, p=F.substring_index(c("nf"), "?", 1), br=c("info").contains("["), ok=fine)
    before = F.substring_index(c("info"), ":", 1)
    x = add(x, h=F.when(c("br"), F.regexp_extract(c("info"), r"\[([^\]]*)", 1)).otherwise(before))
    x = add(x, pt=F.when(c("br"), F.regexp_extract(c("info"), r"\[[^\]]*\][^:]*:(.*)$", 1)).otherwise(_after(c("info"), F.length(c("h")) + 1)))
    zone = F.length(F.substring_index(c("h"), "%", 1))
    host = F.when(c("h").contains("%"), F.concat(F.lower(F.left(c("h"), zone)), _after(c("h"), zone))).otherwise(F.lower(c("h")))
    number = F.expr("try_cast(regexp_replace(__p_pt, '^0+', '') as int)")
    bad = (c("pt") != "") & (~c("pt").rlike("^[0-9]+$") | (F.length(F.regexp_replace(c("pt"), "^0+", "")) > 5) | F.coalesce(number > 65535, F.lit(False)))
    x = add(x, pb=bad)
    empty = lambda v: F.when(c("ok"), v).otherwise(F.lit(""))
    out = {
        "raw": c("raw"),
        "explicit": c("explicit") & (c("raw") != ""),
        "parsed": c("ok"),
        "scheme": empty(F.lower(c("s"))),
        "netloc": empty(c("loc")),
        "path": empty(c("p")),
        "query": empty(_after(c("nf"), F.length(c("p")) + 1)),
        "userinfo": F.when(c("ok") & c("loc").contains("@"), F.left(c("loc"), F.length(c("loc")) - F.length(c("info")) - 1)),
        "host": F.when(c("ok") & (c("h") != ""), host),
        "bracketed": c("ok") & c("br"),
        "port": F.when(c("ok") & (c("pt") != "") & ~c("pb"), F.expr("try_cast(__p_pt as int)")),
        "port_bad": c("ok") & c("pb"),
    }
    x = add(x, **{f"o_{k}": v for k, v in out.items()})
    x = x.withColumn(name, F.struct(*(c(f"o_{k}").alias(k) for k in out)))
    return x.drop(*(k for k in x.columns if k.startswith("__p_")))


def is_valid(p: str = "parts") -> Column:
    """Has a host without white space."""
    return F.col(f"{p}.host").isNotNull() & ~F.col(f"{p}.host").rlike(_BLANK)


def dedupe_key(p: str = "parts") -> Column:
    """Canonical text: scheme and host in lower case, no fragment, no default port, path and query as written.

    Without a written scheme the key has none. Unparsable texts, and those without host or with a bad port, keep what
    precedes their first ``#``.
    """
    c = lambda k: F.col(f"{p}.{k}")
    host = F.lower(F.regexp_replace(c("host"), r"\.+$", ""))
    shown = F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    default = ((c("scheme") == "http") & (c("port") == 80)) | ((c("scheme") == "https") & (c("port") == 443))
    port = F.when(c("port").isNull() | default, "").otherwise(F.concat(F.lit(":"), c("port").cast("string")))
    # User information is shown as written, also if empty.
    user = F.when(c("userinfo").isNull(), "").otherwise(F.concat(c("userinfo"), F.lit("@")))
    scheme = F.when(c("explicit"), F.concat(c("scheme"), F.lit(":"))).otherwise("")
    query = F.when(c("query") != "", F.concat(F.lit("?"), c("query"))).otherwise("")
    whole = F.concat(scheme, F.lit("//"), user, shown, port, c("path"), query)
    return F.when(~c("parsed") | c("host").isNull() | c("port_bad") | (host == ""), F.substring_index(c("raw"), "#", 1)).otherwise(whole)


def is_ip(host: Column) -> Column:
    return F.coalesce(host.rlike(rf"^(?:{IPV4})$") | host.rlike(rf"^(?:{IPV6})$"), F.lit(False))


def keyword_count(text: Column) -> Column:
    """How many of the keywords occur in the text, in any case."""
    low = F.lower(text)
    total = F.lit(0)
    for k in KEYWORDS:
        total = total + low.contains(k).cast("int")
    return total


def _count(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def with_features(df: DataFrame, url: str, domain: Column | None = None, parts: str | None = None) -> DataFrame:
    """``df`` with the 20 features of the text column ``url``; ``domain`` is its registered domain, by default taken as its host. ``parts`` is the column
    with its parts where there is one already; it is dropped."""
    p = parts or "__feature_parts"
    x = df if parts else with_parts(df, url, p)
    c = lambda k: F.col(f"{p}.{k}")
    x = x.withColumn("__host", F.coalesce(F.regexp_replace(F.lower(c("host")), r"\.+$", ""), F.lit("")))
    host, raw = F.col("__host"), c("raw")
    n = F.length(raw)
    default = ((c("scheme") == "http") & (c("port") == 80)) | ((c("scheme") == "https") & (c("port") == 443))
    out = {
        "is_valid_url": host != "",
        "uses_https": c("scheme") == "https",
        "has_non_http_scheme": c("explicit") & c("parsed") & ~c("scheme").isin("http", "https"),
        "has_ip_hostname": (host != "") & is_ip(host),
        "has_userinfo": c("netloc").contains("@"),
        "has_punycode": host.rlike(r"(^|\.)xn--"),
        "has_non_default_port": c("port_bad") | F.coalesce(c("port").isNotNull() & ~default, F.lit(False)),
        "uses_url_shortener": F.coalesce((domain if domain is not None else host).isin(*SHORTENERS), F.lit(False)),
        "url_length": n,
        "hostname_length": F.length(host),
        "path_length": F.length(c("path")),
        "query_length": F.length(c("query")),
        "dot_count": _count(host, "."),
        "hostname_hyphen_count": _count(host, "-"),
        "path_depth": F.size(F.filter(F.split(c("path"), "/", -1), lambda s: s != "")),
        "digit_ratio": F.when(n > 0, F.regexp_count(raw, F.lit(DIGIT)) / n).otherwise(F.lit(0.0)),
        "special_character_count": F.regexp_count(raw, F.lit("[^A-Za-z0-9]")),
        "percent_encoded_count": F.regexp_count(raw, F.lit("%[0-9A-Fa-f]{2}")),
        "suspicious_hostname_keyword_count": keyword_count(host),
        "suspicious_path_query_keyword_count": keyword_count(F.concat(c("path"), F.lit("?"), c("query"))),
    }
    return x.withColumns(out).drop(p, "__host")


FEATURES = (
    "is_valid_url uses_https has_non_http_scheme has_ip_hostname has_userinfo has_punycode has_non_default_port uses_url_shortener url_length hostname_length path_length "
    "query_length dot_count hostname_hyphen_count path_depth digit_ratio special_character_count percent_encoded_count suspicious_hostname_keyword_count "
    "suspicious_path_query_keyword_count"
).split()


def text_model_input(url: Column) -> Column:
    """Stripped, without a leading http or https scheme and then ``www.`` in any case; the rest as written."""
    return F.regexp_replace(F.regexp_replace(stripped(url), "^(?i:https?://)", ""), r"^(?i:www\.)", "")


def protocol_only_score(url: Column) -> Column:
    """1.0 for a text that begins with ``http://`` in any case."""
    return F.lower(stripped(url)).startswith("http://").cast("double")


def convert_target(label: Column) -> Column:
    """Source label (1 legitimate, 0 phishing) to target (1 phishing); any other label, also null, is an error."""
    return F.when(label.isin(0, 1), (1 - label).cast("tinyint")).otherwise(F.raise_error(F.concat(F.lit("label is neither 0 nor 1: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("tinyint"))


def class_label(target: Column) -> Column:
    return F.when(target == 0, "legitimate").when(target == 1, "phishing")


def split_group(domain: Column, key: Column) -> Column:
    """The registered domain, or for texts without one ``invalid-`` and 16 hexadecimal digits of the key's SHA-256."""
    return F.when(F.length(domain) > 0, domain).otherwise(F.concat(F.lit("invalid-"), F.substring(F.sha2(key, 256), 1, 16)))
