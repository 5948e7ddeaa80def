"""Problem 8: documents packed into containers of fixed capacity."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize
from ..operators.skew import rank_within
from ..session import table

CAPACITY = 8192


def byte_tokens(text: Column) -> Column:
    """Tokens of ByT5: one per UTF-8 byte and an end mark. A null text has none, the empty text one."""
    return (F.octet_length(text) + 1).cast("long")


Pattern = tuple[tuple[int, int], ...]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Packing patterns with their number; a pattern is ``((length, times), ...)`` in order of placing.

    Lengths are placed longest first, all their items at once: into the open patterns with the most space left, that is
    the shortest packs, splitting a pattern's count where only some of its packs receive the item. Where no pattern has
    space, new packs are opened once for the length: as many as hold all its items left, or as the volume still to
    come needs beyond the space that is open, whichever is more, so that shorter items find room beside them.

    A length opens packs once and splits one count at most, so there are no more patterns than twice the different lengths,
    however many items there are.
    """
    if any(not 0 < n <= capacity for n in histogram):
        raise ValueError("lengths must lie between 1 and the capacity")
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    spaces: list[int] = []  # heap of the keys of open_, negated
    volume, space_open = sum(n * m for n, m in histogram.items()), 0

    def put(space: int, pattern: Pattern, count: int) -> None:
        if space not in open_:
            heapq.heappush(spaces, -space)
        open_.setdefault(space, []).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = -spaces[0] if spaces else 0
            if space < length:
                need = -(-(volume - space_open) // capacity)
                fresh = min(left, max(-(-left // (capacity // length)), need))
                put(capacity, (), fresh)
                space_open += fresh * capacity
                continue
            stack = open_[space]
            pattern, count = stack.pop()
            if not stack:
                del open_[space]
                heapq.heappop(spaces)
            if count > left:
                put(space, pattern, count - left)
                count = left
            # As often as this stays the shortest pack.
            below = -spaces[0] if spaces else 0
            times = max(1, min((space - max(below, length - 1) - 1) // length + 1 if space > below else 1, space // length, left // count))
            more = pattern[-1][1] if pattern and pattern[-1][0] == length else 0
            put(space - times * length, (*(pattern[:-1] if more else pattern), (length, more + times)), count)
            left -= count * times
            volume -= count * times * length
            space_open -= count * times * length
    return [x for stack in open_.values() for x in stack]


def pieces(df: DataFrame, ident: str, tokens: Column, capacity: int) -> DataFrame:
    """``(ident, piece, start, length)``: whole documents, or those over the capacity cut into full pieces and a rest."""
    sized = df.select(F.col(ident).alias("ident"), tokens.alias("tokens")).where("tokens > 0 and ident is not null")
    last = F.floor((F.col("tokens") - 1) / capacity)
    cut = sized.select("ident", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * capacity
    return cut.select("ident", "piece", start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).cast("long").alias("length"))


def packed(df: DataFrame, ident: str, tokens: Column, *, capacity: int = CAPACITY) -> DataFrame:
    """``(ident, piece, start, length, container, offset)``: where each document, or piece of a large one, is put.

    Only documents above the capacity are split: into full containers and a rest, which is packed like a document. The
    length histogram (at most ``capacity`` rows) goes to the driver, where whole lengths are placed; its patterns come
    back as runs of ranks per length, and every piece finds its container by its rank within its length. A length that
    most pieces share is ranked in parts. Null texts and idents are left out, an empty table gives no rows; repeated
    rows are packed each.
    """
    spark = df.sparkSession
    cut = materialize(pieces(df, ident, tokens, capacity))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = shortest_pack_first(histogram, capacity)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = dict.fromkeys(histogram, 0)
    first = 0
    for pattern, count in patterns:
        offset = 0
        for length, times in pattern:
            runs.setdefault(length, []).append((ranks[length], first, offset, count))
            ranks[length] += count * times
            offset += length * times
        first += count
    flat = {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}
    shared = spark.sparkContext.broadcast(flat)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            container, offset = np.zeros((2, len(length)), np.int64)
            order = np.argsort(length, kind="stable")
            ends = np.append(np.flatnonzero(np.diff(length[order])) + 1, len(order))
            s = 0
            for e in ends:
                at = order[s:e]
                if len(at):
                    begin, box, place, count = shared.value[int(length[at[0]])]
                    k = np.searchsorted(begin, rank[at], side="right") - 1
                    layer, pack = np.divmod(rank[at] - begin[k], count[k])
                    container[at], offset[at] = box[k] + pack, place[k] + layer * length[at]
                s = e
            cols = [batch.column(c) for c in ("ident", "piece", "start", "length")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(container), pa.array(offset)], ["ident", "piece", "start", "length", "container", "offset"])

    numbered = cut.withColumn("key", F.struct("ident", "piece"))
    ranked = rank_within(numbered, "length", "key", total=sum(histogram.values())).select("ident", "piece", "start", "length", F.col("rank").cast("long"))
    kind = df.schema[ident].dataType.simpleString()
    out = ranked.mapInArrow(locate, f"ident {kind}, piece long, start long, length long, container long, offset long")
    return out.withColumnRenamed("ident", ident)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), "doc_id", byte_tokens(F.col("text")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were split: those with a second piece."""
    return _packed(spark, sf_dir).where("piece = 1").select("doc_id")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document with a text: its pieces, their tokens, whether they follow each other without a gap, whether none of
    its containers is overfull or holds two pieces at one place."""
    placed = materialize(_packed(spark, sf_dir))
    boxes = placed.groupBy("container").agg((F.sum("length") <= CAPACITY).alias("room"), (F.max(F.col("offset") + F.col("length")) == F.sum("length")).alias("tight"), F.min("offset").alias("low"), F.count(F.lit(1)).alias("n"), F.count_distinct("offset").alias("places"))
    fine = boxes.select("container", (F.col("room") & F.col("tight") & (F.col("low") == 0) & (F.col("n") == F.col("places"))).alias("fine"))
    return placed.join(fine, "container").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("length").alias("tokens"), (F.max(F.col("start") + F.col("length")) == F.sum("length")).alias("whole"), F.min("fine").alias("fits")
    )


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens, and the share of the space that stays unused."""
    boxes = _packed(spark, sf_dir).groupBy("container").agg(F.sum("length").alias("used"))
    n, used = F.count(F.lit(1)), F.sum("used")
    return boxes.agg(n.alias("containers"), used.alias("tokens"), F.max("used").alias("fullest"), (1 - used / (n * CAPACITY)).alias("unused"))


ORACLE = {
    "p8_found": "select doc_id from documents where strlen(text) + 1 > 8192",
    "p8_documents": "select doc_id, cast(floor(strlen(text) / 8192) + 1 as bigint) as pieces, strlen(text) + 1 as tokens, true as whole, true as fits from documents where text is not null",
}
