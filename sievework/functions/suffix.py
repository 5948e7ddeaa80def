"""Registered domains by public-suffix rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .urls import is_ip

#: The public suffixes of the test tables.
TEST_RULES = ("example", "test", "invalid", "co.example", "org.test", "ac.example", "gov.test")
#: Up to so many rules the look-up is a column expression.
FEW = 64


def icann_rules(spark: SparkSession) -> list[str]:
    """The ICANN part of the public-suffix list that Spark's own HTTP client carries (no network); private suffixes are left out."""
    loader = spark._jvm.Thread.currentThread().getContextClassLoader()
    stream = loader.getResourceAsStream("mozilla/public-suffix-list.txt")
    if stream is None:
        raise RuntimeError("no public-suffix list on the class path")
    text = spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
    return parsed_rules(str(text))


def parsed_rules(text: str) -> list[str]:
    """The rules of a public-suffix list before its private part, one a line; those with non-ASCII letters in their ``xn--`` form too."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if "===BEGIN PRIVATE" in line:
            break
        if line and not line.startswith("//"):
            rule = line.split()[0].lower()
            out.append(rule)
            if not rule.isascii():
                out.append(".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in rule.split(".")))
    return out


def registered(host: str | None, rules: dict[str, str]) -> str | None:
    """One label more than the longest matching suffix; the host itself if no rule matches or nothing precedes the suffix.

    ``rules`` maps a suffix to ``=``, ``*`` (any label before it belongs to the suffix) or ``!`` (an exception to that).
    """
    if not host:
        return None
    labels = host.split(".")
    suffix = 0
    for n in range(1, len(labels) + 1):
        kind = rules.get(".".join(labels[-n:]), "")
        if "!" in kind:
            suffix = n - 1
            break
        if "=" in kind:
            suffix = max(suffix, n)
        if "*" in kind and n < len(labels):
            suffix = max(suffix, n + 1)
    return host if not suffix or suffix >= len(labels) else ".".join(labels[-suffix - 1 :])


def rule_table(rules: list[str] | tuple[str, ...]) -> dict[str, str]:
    out: dict[str, str] = {}
    for r in rules:
        kind = "*" if r.startswith("*.") else "!" if r.startswith("!") else "="
        name = r[2:] if kind == "*" else r.lstrip("!")
        out[name] = out.get(name, "") + kind
    return out


def registered_domain(spark: SparkSession, host: Column, rules: list[str] | tuple[str, ...] = TEST_RULES) -> Column:
    """The registered domain of ``host`` (trailing dots dropped); addresses stay as they are; null without a host.

    A few plain rules become an expression; a whole list is looked up per batch, once per different host.
    """
    name = F.regexp_replace(host, r"\.+$", "")
    some = F.when(name != "", name)
    if len(rules) <= FEW and not any(r[0] in "*!" for r in rules):
        depth = max(r.count(".") + 1 for r in rules)
        found = some
        for n in range(1, depth + 1):  # the longest rule is the last to be put around, so it is the first to be asked
            mine = [r for r in rules if r.count(".") + 1 == n]
            if mine:
                found = F.when(F.substring_index(name, ".", -n).isin(mine) & (F.size(F.split(name, r"\.")) > n), F.substring_index(name, ".", -n - 1)).when(
                    name.isin(mine), some
                ).otherwise(found)
        return F.when(is_ip(name), some).otherwise(found)
    shared = spark.sparkContext.broadcast(rule_table(rules))

    @F.pandas_udf("string")
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for hosts in batches:
            known = {h: registered(h, shared.value) for h in hosts.dropna().unique()}
            yield hosts.map(known)

    return F.when(is_ip(name), some).otherwise(look_up(some))
