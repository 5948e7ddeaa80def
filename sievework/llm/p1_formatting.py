"""Problem 1: records that differ in formatting only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize
from ..operators.skew import spread_join
from ..session import table
from .texts import fold_copies

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bare(piece: Column) -> Column:
    """Without the ASCII characters that are no letters or digits, ASCII letters in lower case."""
    return F.translate(F.regexp_replace(piece, r"[\x00-\x7F&&[^A-Za-z0-9]]+", ""), _UPPER, _LOWER)


def canonical_url(url: Column) -> Column:
    """One text per formatting class: the bare head (up to the first ``?``), then the bare non-empty parameters in order.

    The separators put in are ASCII punctuation, which no bare piece holds, so different pieces never run together.
    """
    head = F.substring_index(url, "?", 1)
    rest = F.substr(url, F.length(head) + 2)
    pieces = F.filter(F.transform(F.split(rest, "&", -1), _bare), lambda p: p != "")
    return F.concat(_bare(head), F.lit("?"), F.array_join(F.array_sort(pieces), "&"))


def formatting_copies(df: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, first_id, n_copies)`` of every row: the least ident among the records equal but for formatting, and their number.

    Byte-identical texts are folded first, with counts; only distinct ones are made canonical and grouped again on the
    full canonical text, the counts summed. A class of copies of any size is combined on the map side and spread when
    joined back. A null text or ident leaves the row out; an empty text is a text; repeated rows are copies of
    themselves under one ident; an empty table gives no rows.
    """
    members = fold_copies(df, ident, F.col(text))
    raw = members.where("text is not null").dropDuplicates(["rep"]).select("rep", F.col("n").alias("copies"), canonical_url(F.col("text")).alias("canon"))
    raw = materialize(raw)
    merged = raw.groupBy("canon").agg(F.min("rep").alias("first_id"), F.sum("copies").alias("n_copies"), F.count(F.lit(1)).alias("w"))
    classes = spread_join(raw, merged, "canon", weight="w", total=raw.count()).select("rep", "first_id", "n_copies", "copies")
    back = spread_join(members.select("rep", "ident"), classes, "rep", weight="copies", total=members.count())
    return back.select(F.col("ident").alias(ident), "first_id", "n_copies")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = formatting_copies(table(spark, sf_dir, "prepared_urls"), "url_id", "url_original")
    return rows.where("url_id <> first_id").select("first_id", F.col("url_id").alias("copy_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: the first of its copies and how many there are."""
    rows = formatting_copies(table(spark, sf_dir, "prepared_urls"), "url_id", "url_original")
    return rows.where("url_id = first_id").select(F.col("first_id").alias("url_id"), "n_copies")


def _bare_sql(piece: str) -> str:
    return rf"translate(regexp_replace({piece}, '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]', '', 'g'), '{_UPPER}', '{_LOWER}')"


_SQL = f"""
with canon as (
  select url_id, {_bare_sql("split_part(url_original, '?', 1)")} || '?' || array_to_string(list_sort(list_filter(list_transform(
      string_split(substr(url_original, length(split_part(url_original, '?', 1)) + 2), '&'), lambda p: {_bare_sql("p")}), lambda p: p <> '')), '&') as canon
  from prepared_urls where url_original is not null
), firsts as (select url_id, min(url_id) over (partition by canon) as first_id, count(*) over (partition by canon) as n from canon)
"""
ORACLE = {
    "p1_found": _SQL + "select first_id, url_id as copy_id from firsts where url_id <> first_id",
    "p1_records": _SQL + "select url_id, cast(n as bigint) as n_copies from firsts where url_id = first_id",
}
