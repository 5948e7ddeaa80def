"""Problem 10: long stretches that stand verbatim in more than one document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize, widened
from ..operators.skew import spread_join
from ..session import table
from . import postings
from .grams import code_points, mix, runs
from .texts import digest, expand_pairs, named, pairs_within

LEAST = 400
#: Code points hashed at once. Places in a slice must fit 20 bits.
_SLICE = 400_000
_BLOCKS = np.dtype([("t", "<u8"), ("id", "<i8"), ("at", "<u4")])
_WINDOWS = np.dtype([("t", "<u8"), ("id", "<i8"), ("at", "<u4"), ("w", "<u8"), ("j", "<u2")])
_BASE = 0x9E3779B97F4A7C15
#: Places of a window relative to its block that stay together when a block is hot.
_NEAR = 16


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def block_hashes(points: np.ndarray, k: int, powers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of every window of ``k`` code points: sums of one scrambled power series, shifted back to its start."""
    up, down = powers
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(points) - k + 1]
    return mix(h)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For every window of ``w`` the place of its least hash, the first on ties (by the upper 44 bits of the hash)."""
    n = len(h)
    key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    square = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(square, axis=1).reshape(-1)
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (low & np.uint64((1 << 20) - 1)).astype(np.int64)


class Slice:
    """Some texts, or parts of long ones, hashed together; parts overlap so that every window lies in one of them.

    Of every window of ``least`` code points ``text`` is the number of its text, ``start`` where it begins there and ``place`` where its
    reference block does: the block of half that length with the least hash in the window, hence the same one wherever the window
    stands. ``block`` is the hash of that block, ``window()`` that of the window.
    """

    def __init__(self, held: list[tuple[int, int, str]], least: int, powers: tuple[np.ndarray, np.ndarray]) -> None:
        self.points, lengths = code_points([t for _, _, t in held])
        self.least, self.powers = least, powers
        h = block_hashes(self.points, least // 2, powers)
        low = window_minima(h, least - least // 2 + 1)
        ends = np.cumsum(lengths)
        part = np.repeat(np.arange(len(held)), lengths)[: len(low)]
        self.at = np.flatnonzero(np.arange(len(low)) + least <= ends[part])
        part, low = part[self.at], low[self.at]
        shift = np.array([o for _, o, _ in held]) - (ends - lengths)
        self.text = np.array([i for i, _, _ in held])[part]
        self.start, self.place, self.block = self.at + shift[part], low + shift[part], h[low]

    def window(self, some: np.ndarray) -> np.ndarray:
        return block_hashes(self.points, self.least, self.powers)[self.at[some]]


def slices(texts: list[str], least: int) -> Iterator[Slice]:
    powers = _powers(_SLICE + least)
    held: list[tuple[int, int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        if len(text) < least:
            continue
        for s in range(0, len(text) - least + 1, _SLICE - least):
            piece = text[s : s + _SLICE - 1]
            if size + len(piece) > _SLICE:
                yield Slice(held, least, powers)
                held, size = [], 0
            held.append((i, s, piece))
            size += len(piece)
    if held:
        yield Slice(held, least, powers)


def _met_blocks(docs: DataFrame, copies: DataFrame, rows: int, least: int) -> DataFrame:
    """``(ident, places)``: the blocks of every document, no later copy, that other documents have too."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ident").to_numpy()
            owner, blobs = [], []
            for x in slices(batch.column("text").to_pylist(), least):
                first = runs(x.text * (1 << 40) + x.place)
                a = np.zeros(len(first), _BLOCKS)
                a["t"], a["id"], a["at"] = x.block[first], ids[x.text[first]], x.place[first]
                cuts = runs(x.text[first])
                for s, e in zip(cuts, [*cuts[1:], len(first)]):
                    owner.append(int(a["id"][s]))
                    blobs.append(postings.pack(a[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(blobs, pa.binary())], ["ident", "blob"])

    later = copies.where("ident <> rep").select("ident")
    blocks = materialize(widened(docs).mapInArrow(index, "ident long, blob binary").join(later, "ident", "left_anti"))

    def make(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield np.concatenate([postings.unpack(b.as_py(), _BLOCKS) for b in batch.column("blob")])

    def once(batch: pa.RecordBatch) -> Iterator[np.ndarray]:  # a block that one document repeats is not hot
        for a in make(batch):
            yield a[np.unique(a[["t", "id"]], return_index=True)[1]]

    # A hot block is in several documents for certain: its postings need not meet and are dealt out by document.
    hot = postings.hot_tokens(blocks, once, rows=rows * 32)
    lists = postings.build(blocks, make, postings.parts(rows * 32), hot, by=lambda a, n: mix(a["id"].astype(np.uint64)) % n)

    def met(key: tuple, table: pa.Table) -> pa.Table:
        a = np.concatenate([postings.unpack(b.as_py(), _BLOCKS) for b in table.column("blob")])
        if key[1].as_py() < 0:
            a = a[np.lexsort((a["id"], a["t"]))]
            starts = runs(a["t"])
            ends = np.append(starts[1:], len(a))
            a = a[np.repeat(a["id"][starts] != a["id"][ends - 1], ends - starts)]
        a = a[np.argsort(a["id"], kind="stable")]
        cuts = runs(a["id"])
        blobs = [a["at"][s:e].tobytes() for s, e in zip(cuts, [*cuts[1:], len(a)])]
        return pa.table([pa.array(a["id"][cuts]), pa.array(blobs, pa.binary())], ["ident", "places"])

    parts_ = lists.groupBy("part", "sub").applyInArrow(met, "ident long, places binary")
    return parts_.groupBy("ident").agg(F.collect_list("places").alias("places"))


def _windows(docs: DataFrame, met: DataFrame, rows: int, least: int) -> DataFrame:
    """Lists of all windows around the blocks in ``met``, by block; those of a hot block are cut by where the window begins before the
    block, and by the window's hash, so that equal windows stay together."""
    some = materialize(named(docs, "ident", met).join(met, "ident"))

    def make(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        ids, texts = batch.column("ident").to_numpy(), batch.column("text").to_pylist()
        places = [np.unique(np.concatenate([np.frombuffer(b, "<u4") for b in row])).astype(np.int64) for row in batch.column("places").to_pylist()]
        wanted = np.concatenate([(i << 40) + p for i, p in enumerate(places)])  # ascends
        for x in slices(texts, least):
            key = (x.text << 40) + x.place
            m = np.flatnonzero(wanted[np.searchsorted(wanted, key).clip(max=len(wanted) - 1)] == key)
            out = np.zeros(len(m), _WINDOWS)
            out["t"], out["id"], out["at"], out["w"], out["j"] = x.block[m], ids[x.text[m]], x.start[m], x.window(m), x.place[m] - x.start[m]
            yield out

    near = -(-(least - least // 2 + 1) // _NEAR)

    def by(a: np.ndarray, n: np.ndarray) -> np.ndarray:
        deep = np.maximum(n // near, 1)
        return (a["j"] // _NEAR) * deep + (mix(a["w"]) % deep.astype(np.uint64)).astype(np.int64)

    size = rows * 8 * (least // 4)
    return postings.build(some, make, postings.parts(size), postings.hot_tokens(some, make, rows=size), by=by)


def window_classes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a`` sorted by block, window and document, where each class of equal windows begins, and which classes two documents share."""
    a = a[np.lexsort((a["at"], a["id"], a["w"], a["t"]))]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a["t"][1:] != a["t"][:-1]) | (a["w"][1:] != a["w"][:-1])
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(a))
    return a, starts, a["id"][starts] != a["id"][ends - 1]


def factored(a: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``(document, start, length, source, source start)``: every document factored greedily against the windows of all others.

    A window's source is its first occurrence (least document, then place) in another document. From a document's first shared window a
    factor goes on as long as the source does, then the next one begins.
    """
    a, starts, shared = window_classes(a)
    size = np.diff(np.append(starts, len(a)))
    first = np.repeat(starts, size)
    other = np.full(len(starts), -1)  # the first posting of a second document
    change = np.flatnonzero((a["id"][1:] != a["id"][:-1])) + 1
    k = np.searchsorted(change, starts + 1)
    other[shared] = change[k[shared]]
    source = np.where(a["id"] == a["id"][first], np.repeat(other, size), first)
    m = np.repeat(shared, size)
    ident, at, source = a["id"][m], a["at"][m].astype(np.int64), source[m]
    of, there = a["id"][source], a["at"][source].astype(np.int64)
    order = np.lexsort((at, ident))
    ident, at, of, there = ident[order], at[order], of[order], there[order]
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (ident[1:] == ident[:-1]) & (at[1:] == at[:-1] + 1) & (of[1:] == of[:-1]) & (there[1:] == there[:-1] + 1)
    begin = np.flatnonzero(~goes_on)
    length = np.diff(np.append(begin, len(at))) + least - 1
    return ident[begin], at[begin], length, of[begin], there[begin]


def sharing_sets(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(set, n, document)``: the sets of documents that have a window in common, each set once; a set is named by a hash of its documents."""
    a, starts, shared = window_classes(a)
    if not shared.any():
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(a))))
    m = shared[group]
    group, ident = group[m], a["id"][m]
    once = np.ones(len(ident), bool)
    once[1:] = (group[1:] != group[:-1]) | (ident[1:] != ident[:-1])
    group, ident = group[once], ident[once]
    starts = runs(group)
    size = np.diff(np.append(starts, len(group)))
    name = mix(np.add.reduceat(mix(ident.astype(np.uint64) ^ np.uint64(_BASE)), starts) ^ size.astype(np.uint64))
    _, kept = np.unique(name, return_index=True)
    chosen = np.zeros(len(starts), bool)
    chosen[kept] = True
    m = np.repeat(chosen, size)
    return np.repeat(name, size)[m].view(np.int64), np.repeat(size, size)[m], ident[m]


def _compared(df: DataFrame, ident: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """``(lists, copies)``: the lists of windows that may be shared, and ``(rep, ident, n)`` with the exact copies of every document."""
    docs = df.select(F.col(ident).cast("long").alias("ident"), F.col(text).alias("text")).where("ident is not null and text is not null")
    keyed = docs.select("ident", digest(F.col("text")).alias("h"))
    firsts = keyed.groupBy("h").agg(F.min("ident").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n"))
    rows = df.count()
    copies = materialize(spread_join(keyed, firsts, "h", weight="w", total=rows).select("rep", "ident", "n"))
    met = materialize(_met_blocks(docs, copies.where("n > 1"), rows, least))
    return _windows(docs, met, rows, least), copies


def _unpacked(table: pa.Table) -> np.ndarray:
    return np.concatenate([postings.unpack(b.as_py(), _WINDOWS) for b in table.column("blob")])


def shared_factors(df: DataFrame, ident: str, text: str, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(factors, copies)``: ``(ident, start, length, source, source_start)`` of the factors of at least ``least`` code points by which each
    different text is parsed against all others, and ``(rep, ident, n)`` with the exact copies of every document.

    Relative parsing: reference blocks, chosen by their content in all documents, are indexed; where a block is met in another document, every window of
    ``least`` code points around it is looked up among the windows of all documents with that block, and the document is factored greedily, each
    factor following one source as long as it goes. A window belongs to one block wherever it stands, so no shared window is missed, and one that
    crosses the boundary of two factors is looked up like any other. The work grows with the windows, not with pairs of documents. Windows are told
    apart by the 128 bits of their own and their block's hash.

    Copies are folded first; only documents with a block that is met elsewhere leave the map side. Null idents and texts are
    left out, texts shorter than ``least`` share nothing but copies; an empty table gives no rows.
    """
    lists, copies = _compared(df, ident, text, least)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table([pa.array(c) for c in factored(_unpacked(table), least)], ["ident", "start", "length", "source", "source_start"])

    return lists.groupBy("part", "sub").applyInArrow(run, "ident long, start long, length long, source long, source_start long"), copies


def sharing_documents(df: DataFrame, ident: str, text: str, *, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``(pairs, copies)``: ``(a, b)``, a < b, of different texts that share a window of ``least`` code points, and the copies, as in ``shared_factors``.

    The windows give sets of documents, of which equal ones are kept once; pairs are written from the sets' members, block by block.
    """
    lists, copies = _compared(df, ident, text, least)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table([pa.array(c) for c in sharing_sets(_unpacked(table))], ["rep", "n", "ident"])

    sets = materialize(lists.groupBy("part", "sub").applyInArrow(run, "rep long, n long, ident long").distinct())
    return pairs_within(sets).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), copies


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found, copies = sharing_documents(docs, "doc_id", "text")
    long = docs.where(F.length("text") >= LEAST).select("doc_id")
    repeated = copies.where("n > 1").join(long.withColumnRenamed("doc_id", "ident"), "ident", "left_semi")
    return expand_pairs(found, repeated, "doc_id_a", "doc_id_b")


def shared_spans(df: DataFrame, ident: str, text: str, *, least: int = LEAST) -> DataFrame:
    """``(doc_id, n_spans, shared_chars, n_chars, share)`` of every document with a text: how much of it stands elsewhere
    in stretches of at least ``least`` code points. Factors that overlap or touch are one span. A document with an exact copy of that length is shared whole."""
    found, copies = shared_factors(df, ident, text, least=least)
    ends = found.select(F.col("ident").alias("rep"), F.col("start").alias("s"), "length")
    spans = ends.groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("length")).alias("e")))).alias("spans"))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end")),
        lambda acc, x: F.struct(
            (acc["chars"] + F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))).alias("chars"),
            (acc["n"] + F.when(x["s"] > acc["end"], 1).otherwise(0)).alias("n"),
            F.greatest(acc["end"], x["e"]).alias("end"),
        ),
    )
    per = spans.select("rep", merged.alias("m"))
    sizes = df.select(F.col(ident).alias("ident"), F.length(text).cast("long").alias("n_chars")).where("ident is not null and n_chars is not null")
    every = copies.join(sizes, "ident").join(per, "rep", "left")
    whole = (F.col("n") > 1) & (F.col("n_chars") >= least)
    shared = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("m.chars", F.lit(0)))
    return every.select(
        F.col("ident").alias(ident),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("m.n", F.lit(0))).cast("long").alias("n_spans"),
        shared.alias("shared_chars"),
        "n_chars",
        F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(0.0).alias("share"),
    )


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


ORACLE = {
    "p10_found": f"""with stretches as (select distinct doc_id, hash(substr(text, i, {LEAST})) as h from (select doc_id, text, unnest(generate_series(1, length(text) - {LEAST - 1})) as i from documents where text is not null)),
    met as (select list(doc_id order by doc_id) as ids from stretches group by h having count(*) > 1), different as (select distinct ids from met)
    select distinct a as doc_id_a, b as doc_id_b from (select unnest(ids) as a, ids from different), unnest(ids) as t(b) where a < b""",
    "p10_shares": f"""with stretches as (select doc_id, i, hash(substr(text, i, {LEAST})) as h from (select doc_id, text, unnest(generate_series(1, length(text) - {LEAST - 1})) as i from documents where text is not null)),
    met as (select h from stretches group by h having min(doc_id) <> max(doc_id)),
    seen as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as step from stretches where h in (select h from met)),
    per as (select doc_id, count(*) filter (step is null or step > {LEAST}) as n_spans, sum(case when step is null or step > {LEAST} then {LEAST} else step end) as shared_chars from seen group by 1)
    select doc_id, coalesce(n_spans, 0) as n_spans, cast(coalesce(shared_chars, 0) as bigint) as shared_chars, length(text) as n_chars,
      case when length(text) > 0 then round(coalesce(shared_chars, 0) * 1.0e0 / length(text), 6) else 0 end as share from documents left join per using (doc_id) where text is not null""",
}
