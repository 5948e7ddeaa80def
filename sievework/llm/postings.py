"""Inverted lists as packed arrays: built where the records are, shuffled once, joined in whole-array steps.

A posting is a record of a numpy dtype whose first field ``t`` (uint64) is its token and whose field ``id`` (int64)
names the record. Map tasks pack postings into one binary value per target part, byte plane by byte plane, which
the shuffle compresses far better than rows; the part of a token is a hash of it. A reduce task joins one part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import mix, runs

#: Postings that one task is meant to hold, in so many parts that tasks come out alike.
TASK, DEALT = 200_000, 8
#: A list longer than two blocks of so many postings is joined block by block.
BLOCK = 4_000
#: Hot tokens that the layout knows of at most (2 MB to broadcast): the hottest; shorter lists stay in one piece.
HOT = 100_000
Hot = tuple[np.ndarray, np.ndarray]
NONE: Hot = (np.empty(0, np.uint64), np.empty(0, np.int64))
_BUFFER = 1_500_000


def parts(size: int) -> int:
    """Parts for about ``size`` postings: those of small tasks, up to 2,000 of them, of larger tasks beyond, as ever more of the same size would cost more to shuffle than they
    hold. It is a matter of layout only."""
    return DEALT * max(12, min(size // TASK, max(2_000, size // (25 * TASK))))


def pack(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def hot_tokens(df: DataFrame, make: Callable, *, rows: int, share: int = 64) -> Hot:
    """Tokens that seem to have over two ``BLOCK`` of postings, and pieces for each, told from one row in ``share``.

    It only steers how lists that need no pairing are cut, never what is found: a list missed here stays in one piece.
    At most ``HOT`` tokens are told, the hottest; tables too small for such a list are not read.
    """
    if rows <= 2 * BLOCK:
        return NONE
    least = max(2, 2 * BLOCK // share)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                t, n = np.unique(np.concatenate([p["t"] for p in make(batch)] or [np.empty(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], ["t", "n"])

    sample = df.where(F.pmod(F.xxhash64("ident"), F.lit(share)) == 0)
    counts = sample.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    hottest = counts.orderBy(F.desc("n"), "t").limit(HOT)
    found = sorted((r.t & 0xFFFFFFFFFFFFFFFF, -(-r.n * share // BLOCK)) for r in hottest.collect())
    return np.array([t for t, _ in found], np.uint64), np.array([max(2, n) for _, n in found], np.int64)


def build(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[np.ndarray]], parts: int, hot: Hot = NONE, by: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``(part, sub, blob)`` of the postings that ``make`` gives for each batch of ``df``.

    The postings of a ``hot`` token are dealt by ``by(postings, pieces)`` into pieces ``sub``, others have -1. No posting is sent twice.
    """
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tokens, pieces), held, size = shared.value, [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            a = np.concatenate(held)
            held.clear()
            part = (mix(a["t"]) % np.uint64(parts)).astype(np.int64)
            sub = np.full(len(a), -1)
            if len(tokens):
                at = np.searchsorted(tokens, a["t"]).clip(max=len(tokens) - 1)
                m = np.flatnonzero(tokens[at] == a["t"])
                sub[m] = by(a[m], pieces[at[m]]).astype(np.int64)
            order = np.lexsort((a["t"], sub, part))
            a, part, sub = a[order], part[order], sub[order]
            cuts = runs(part) if not len(tokens) else np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (sub[1:] != sub[:-1])))
            blobs = [pack(a[s:e]) for s, e in zip(cuts, [*cuts[1:], len(a)])]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(sub[cuts]), pa.array(blobs, pa.binary())], ["part", "sub", "blob"])

        for batch in batches:
            for piece in make(batch) if batch.num_rows else ():
                if len(piece):
                    held.append(piece)
                    size += len(piece)
                if size >= _BUFFER:
                    size = 0
                    yield from out()
        yield from out()

    return df.mapInArrow(run, "part long, sub long, blob binary").repartition(-(-parts // DEALT), "part", "sub")


class Pairs:
    """Pairs of postings ``(i, j)`` of one part, narrowed step by step; fields are read for the pairs still there."""

    def __init__(self, fields: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> None:
        self.fields, self.i, self.j = fields, i, j

    def get(self, f: str) -> tuple[np.ndarray, np.ndarray]:
        return self.fields[f][self.i], self.fields[f][self.j]

    def narrow(self, m: np.ndarray) -> None:
        self.i, self.j = self.i[m], self.j[m]


def _met(a: np.ndarray, ends: np.ndarray, keep: Callable[[Pairs], None], ratio: float, left: int | None = None) -> list[np.ndarray]:
    """``[smaller id, larger id]`` of the pairs within each list of ``a``, which is sorted by list and ``size`` and ends at ``ends``; with
    ``left``, of the pairs of one of the first so many postings and one of the others."""
    fields = {f: np.ascontiguousarray(a[f]) for f in a.dtype.names}
    n = len(a) if left is None else left
    i = np.arange(n)
    ahead = np.ones(n, np.int64) if left is None else left - i
    found: list[np.ndarray] = []
    while True:
        m = i + ahead < ends[i]
        i, ahead = i[m], ahead[m]
        m = fields["size"][i] >= ratio * fields["size"][i + ahead] - 1e-9  # sizes ascend, so what is too large now is so from here on
        i, ahead = i[m], ahead[m]
        if not len(i):
            break
        for s in range(0, len(i), 1 << 16):
            p = Pairs(fields, i[s : s + (1 << 16)], i[s : s + (1 << 16)] + ahead[s : s + (1 << 16)])
            keep(p)
            x, y = p.get("id")
            p.narrow(x != y)
            if len(p.i):
                x, y = p.get("id")
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
        ahead = ahead + 1
    return list(np.concatenate(found, axis=1)) if found else [np.empty(0, np.int64)] * 2


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_ROWS = "a long, b long, list long, i int, low long, high long, blob binary"


def join(lists: DataFrame, dtype: np.dtype, keep: Callable[[Pairs], None], ratio: float) -> DataFrame:
    """``(a, b)``, a < b, of the records that have a token in common, whose ``size`` has at least that ``ratio``, and that ``keep`` lets pass.

    Lists of up to two blocks are joined where they are. A longer one is sorted by size, cut into blocks and passed on; each two blocks whose
    sizes can meet are joined by a task of their own. Nothing is dropped, and how a list is cut follows from its own length.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a = np.concatenate([unpack(b.as_py(), dtype) for b in table.column("blob")])
        a = a[np.lexsort((a["size"], a["t"]))]
        starts = runs(a["t"])
        length = np.diff(np.append(starts, len(a)))
        long = np.flatnonzero(length > 2 * BLOCK)
        blocks = [(int(a["t"][s].view(np.int64)), k, a[b : min(b + BLOCK, s + n)]) for s, n in zip(starts[long], length[long]) for k, b in enumerate(range(s, s + n, BLOCK))]
        rest = np.repeat((length > 1) & (length <= 2 * BLOCK), length)
        a = a[rest]
        starts = runs(a["t"])
        length = np.diff(np.append(starts, len(a)))
        x, y = _met(a, np.repeat(starts + length, length), keep, ratio)
        none = [None] * len(x)
        cols = [
            [*x, *[None] * len(blocks)], [*y, *[None] * len(blocks)], [*none, *(t for t, _, _ in blocks)], [*none, *(k for _, k, _ in blocks)],
            [*none, *(int(b["size"][0]) for *_, b in blocks)], [*none, *(int(b["size"][-1]) for *_, b in blocks)], [*none, *(pack(b) for *_, b in blocks)],
        ] if blocks else [x, y, *[none] * 5]
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _ROWS.split(", ")])

    from ..operators.shared import materialize  # here, as workers are sent this module whole

    rows = materialize(lists.groupBy("part", "sub").applyInArrow(run, _ROWS))
    found = rows.where("blob is null").select("a", "b")
    blocks = rows.where("blob is not null")
    ours, theirs = blocks.select("list", "i", "high", F.col("blob").alias("x")), blocks.select("list", F.col("i").alias("j"), "low", F.col("blob").alias("y"))
    facts = blocks.select("list", "i", "high").join(blocks.select("list", F.col("i").alias("j"), "low"), "list").where((F.col("i") <= F.col("j")) & (F.col("high") >= ratio * F.col("low") - 1e-9))
    tasks = facts.count()
    if not tasks:
        return found.distinct()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                x = unpack(one.column("x")[0].as_py(), dtype)
                if one.column("i")[0].as_py() == one.column("j")[0].as_py():
                    cols = _met(x, np.full(len(x), len(x)), keep, ratio)
                else:
                    both = np.concatenate([x, unpack(one.column("y")[0].as_py(), dtype)])
                    cols = _met(both, np.full(len(both), len(both)), keep, ratio, len(x))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_PAIRS)

    facts = facts.repartition(min(tasks, 20_000), "list", "i", "j")
    pairs = facts.join(ours.drop("high"), ["list", "i"]).join(theirs.drop("low"), ["list", "j"]).repartition(min(tasks, 20_000), "list", "i", "j")
    return found.union(pairs.select("i", "j", "x", "y").mapInArrow(meet, "a long, b long")).distinct()


def parity(tokens: np.ndarray, record: np.ndarray, records: int, words: int) -> np.ndarray:
    """For each record ``32 * words`` bits, each the parity of the number of its tokens that fall on it.

    Two sets whose symmetric difference has ``h`` elements differ in at most ``h`` of the bits.
    """
    width = 32 * words
    odd = np.bincount(record * width + (tokens % np.uint64(width)).astype(np.int64), minlength=records * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(records, width), axis=1).view(np.uint32).reshape(records, words)


def within(pairs: Pairs, most: np.ndarray, fields: list[str]) -> None:
    """Narrow ``pairs`` to those whose parity words differ in at most ``most`` bits."""
    bits = np.zeros(len(pairs.i), np.uint8)
    for f in fields:
        x, y = pairs.get(f)
        bits += np.bitwise_count(x ^ y)
    pairs.narrow(bits <= most)


def least_overlap(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap of two sets whose sizes add up to ``sizes`` at Jaccard similarity ``threshold``, in whole numbers."""
    p, q = round(threshold * 10_000), 10_000
    return (p * sizes + (p + q - 1)) // (p + q)
