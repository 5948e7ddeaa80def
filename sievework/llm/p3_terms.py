"""Problem 3: occurrences and record counts of every term, and marks for those too rare or too common."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counters import Counters
from ..operators.shared import widened
from ..session import table
from .grams import code_points, runs, windows
from .texts import model_text

#: Code points counted at once, and distinct terms a task holds before it passes its counters on.
_SLICE = 1_000_000
_HELD = 4_000_000
#: A list of named terms beyond this is counted in several passes, so that what is broadcast stays bounded.
TERMS = 20_000


def _slices(text: list[str]) -> Iterator[list[str]]:
    """Whole texts, about ``_SLICE`` code points together."""
    held, size = [], 0
    for t in text:
        held.append(t)
        size += len(t)
        if size >= _SLICE:
            yield held
            held, size = [], 0
    if held:
        yield held


def ngram_counts(texts: DataFrame, n: int) -> DataFrame:
    """``(ngram, occurrences, records)`` of all ``n``-character substrings of ``texts.text``, ``n`` from 1.

    A record's tokens never leave its task, which counts them in order of records (see ``Counters``) and passes the
    counters on when it holds too many; they are then hash-partitioned by term and summed. Up to three
    characters a term is a number; longer terms are told apart by 64 bits in the task and by their characters after it.
    Null texts count for nothing.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters(_HELD)

        def out() -> Iterator[pa.RecordBatch]:
            k, o, r, *letters = counters.passed_on()
            for s in range(0, len(k), 100_000):
                e = slice(s, s + 100_000)
                if n <= 3:
                    term = pa.array(k[e].view(np.int64))
                else:
                    whole = letters[0][e].tobytes().decode("utf-32-le", "surrogatepass")
                    term = pa.array([whole[i : i + n] for i in range(0, len(whole), n)], pa.string())
                yield pa.RecordBatch.from_arrays([term, pa.array(o[e]), pa.array(r[e])], ["k", "o", "r"])

        for batch in batches:
            for held in _slices([t for t in batch.column("text").to_pylist() if t is not None]):
                points, lengths = code_points(held)
                count = len(points) - n + 1
                if count < 1:
                    continue
                if n <= 3:
                    wide = points.astype(np.uint64)
                    key = wide[:count].copy()
                    for k in range(1, n):
                        key = (key << np.uint64(21)) | wide[k : k + count]
                    record = np.repeat(np.arange(len(held)), lengths)
                    inside = np.arange(count) + n <= np.cumsum(lengths)[record[:count]]
                    counters.add(key[inside], record[:count][inside])
                else:
                    key, record = windows(held, n)
                    inside = np.arange(count) + n <= np.cumsum(lengths)[np.repeat(np.arange(len(held)), lengths)[:count]]
                    counters.add(key, record, np.lib.stride_tricks.sliding_window_view(points, n)[inside])
                if counters.full():
                    yield from out()
        yield from out()

    kind = "long" if n <= 3 else "string"
    sums = texts.select("text").mapInArrow(run, f"k {kind}, o long, r long").groupBy("k").agg(F.sum("o").alias("occurrences"), F.sum("r").alias("records"))
    if n > 3:
        return sums.withColumnRenamed("k", "ngram")
    bits = [F.shiftright("k", 21 * (n - 1 - i)).bitwiseAND((1 << 21) - 1) for i in range(n)]
    # The mark in front is consumed; without it a leading U+FEFF would be.
    decoded = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), *(F.lpad(F.hex(b), 8, "0") for b in bits))), "UTF-32")
    ascii_only = F.lit(True)
    for b in bits:
        ascii_only = ascii_only & (b < 128) & (b > 0)
    plain = F.concat(*(F.chr(b) for b in bits))
    return sums.select(F.when(ascii_only, plain).otherwise(decoded).alias("ngram"), "occurrences", "records")


def term_counts(texts: DataFrame, names: DataFrame) -> DataFrame | None:
    """``(ngram, occurrences, records)`` of the terms in ``names.ngram``, of any length, overlaps counted; None without terms.

    Terms never met have no row. The list is a stated query set: it is held in blocks of about ``TERMS``, each with a
    pass over the texts.
    """
    spark = texts.sparkSession
    blocks = -(-names.count() // TERMS)
    out = None
    for k in range(blocks):
        wanted = sorted(r.ngram for r in names.where(F.pmod(F.xxhash64("ngram"), F.lit(blocks)) == k).collect())
        part = _some_terms(texts, spark.sparkContext.broadcast(wanted))
        out = part if out is None else out.unionByName(part)
    return out


def _some_terms(texts: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        tails: dict[str, list[tuple[int, np.ndarray]]] = {}
        for i, t in enumerate(wanted):
            tails.setdefault(t[0], []).append((i, code_points([t])[0]))
        occurrences, records = np.zeros((2, len(wanted)), np.int64)
        for batch in batches:
            for held in _slices([t for t in batch.column("text").to_pylist() if t is not None]):
                points, lengths = code_points(held)
                record = np.repeat(np.arange(len(held)), lengths)
                ends = np.cumsum(lengths)
                for first, same in tails.items():
                    starts = np.flatnonzero(points == ord(first))
                    for i, codes in same:
                        at = starts[starts + len(codes) <= ends[record[starts]]]
                        for k in range(1, len(codes)):
                            at = at[points[at + k] == codes[k]]
                        occurrences[i] += len(at)
                        records[i] += len(runs(record[at]))
        met = np.flatnonzero(occurrences)
        yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in met], pa.string()), pa.array(occurrences[met]), pa.array(records[met])], ["t", "o", "r"])

    sums = texts.select("text").mapInArrow(run, "t string, o long, r long")
    return sums.groupBy(F.col("t").alias("ngram")).agg(F.sum("o").alias("occurrences"), F.sum("r").alias("records"))


def marked_terms(df: DataFrame, text: str, named: DataFrame, term: str, *, n: int = 3, rare_below: int = 3, common_above: float = 0.3) -> DataFrame:
    """``(ngram, occurrences, records, mark)`` of every ``n``-character substring of the model texts and every ``named`` term.

    ``mark`` is ``rare`` under ``rare_below`` records (also none), ``common`` above the share ``common_above`` of all
    rows of ``df`` (a null text is a row without terms), else null. Null and repeated named terms count once or not at
    all; the empty term is passed over. With an empty ``df`` only the named terms remain, all rare.
    """
    texts = widened(df.select(text)).select(model_text(F.col(text)).alias("text"))
    names = named.select(F.col(term).alias("ngram")).where("ngram is not null and ngram <> ''").distinct()
    others = term_counts(texts, names.where(F.length("ngram") != n))
    counted = ngram_counts(texts, n) if others is None else ngram_counts(texts, n).unionByName(others)
    never = names.select("ngram", F.lit(0).cast("long").alias("occurrences"), F.lit(0).cast("long").alias("records"))
    every = counted.unionByName(never).groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    rows = df.count()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * rows, "common")
    return every.withColumn("mark", mark)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "prepared_urls"), "url_model_input", table(spark, sf_dir, "top_character_ngrams"), "ngram")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir).where("mark is not null").select("ngram", "mark")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir)


_STRIPPED = r"regexp_replace(url_model_input, '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g')"
_SQL = rf"""
with texts as (
  select url_id, regexp_replace(regexp_replace({_STRIPPED}, '^(?i:https?://)', ''), '^(?i:www\.)', '') as t from prepared_urls
), grams as (
  select url_id, substr(t, i, 3) as ngram from (select url_id, t, unnest(generate_series(1, length(t) - 2)) as i from texts)
), named as (
  select url_id, ngram from (select distinct ngram from top_character_ngrams where ngram <> '' and length(ngram) <> 3) n,
    (select url_id, t, unnest(generate_series(1, length(t))) as i from texts) x where substr(t, i, length(ngram)) = ngram
), counted as (
  select ngram, count(*) as occurrences, count(distinct url_id) as records from (select * from grams union all select * from named) group by 1
), every as (
  select ngram, occurrences, records from counted
  union all select distinct ngram, 0, 0 from top_character_ngrams where ngram <> '' and ngram not in (select ngram from counted)
), marked as (
  select ngram, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records,
    case when records < 3 then 'rare' when records > 0.3 * (select count(*) from prepared_urls) then 'common' end as mark from every
)
"""
ORACLE = {
    "p3_found": _SQL + "select ngram, mark from marked where mark is not null",
    "p3_counts": _SQL + "select * from marked",
}
