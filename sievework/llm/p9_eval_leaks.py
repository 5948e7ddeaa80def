"""Problem 9: documents that hold passages of held-out evaluation texts."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize, widened
from ..session import table
from .grams import runs
from .texts import named

#: Words of evaluation items that are searched for in one pass over the index; a larger query set takes several.
QUERY_WORDS = 2_000_000
#: Words of whole documents that are indexed together, and parts that the terms are dealt into.
SHARD_WORDS = 1_000_000
PARTS = 256
#: Lists that are intersected for each stretch of an item: those of its rarest words.
LISTS = 3
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    if text.isascii():
        return _WORD.findall(text.lower())
    found = _WORD.findall(text)
    return " ".join(found).lower().split(" ") if found else []  # word by word: a lower-case form may depend on what surrounds it


def term_hashes(terms: list[str]) -> np.ndarray:
    """The 64-bit name of each term in the index. Matches are confirmed on the words themselves."""
    raw = b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in terms)
    return np.frombuffer(raw, "<u8")


def _planes(a: np.ndarray) -> bytes:
    """Numbers below 2^32, byte plane by byte plane, which compresses well as the upper planes are mostly zero."""
    return a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], np.ndarray, list[str]]]:
    """``(document ids, where each begins, number of every word, terms by number)`` of whole documents, about ``SHARD_WORDS`` words together."""
    docs, starts, found, size = [], [], [], 0
    number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    for batch in batches:
        for ident, text in zip(batch.column("ident").to_pylist(), batch.column("text").to_pylist()):
            w = words(text)
            docs.append(ident)
            starts.append(size)
            found.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
            size += len(w)
            if size >= SHARD_WORDS:
                yield docs, starts, np.concatenate(found), list(number)
                docs, starts, found, size = [], [], [], 0
                number = defaultdict(itertools.count().__next__)
    if docs:
        yield docs, starts, np.concatenate(found), list(number)


class Index:
    """A positional inverted index of documents, stored in the shared folder and partitioned by term.

    ``lists`` has for every part of the terms and every shard of documents ``terms`` (names, ascending), ``counts`` (length of
    each list) and ``places`` (positions in the shard, each as its distance from the one before in its list). ``shards``
    has the documents of each shard (``ids``) and where they begin (``starts``).
    """

    def __init__(self, docs: DataFrame) -> None:
        """``docs`` has ``ident`` (long) and ``text``, neither null. Documents are tokenised once, whole."""

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = TaskContext.get().partitionId() << 32
            for k, (ids, starts, number, terms) in enumerate(_shards(batches)):
                names = term_hashes(terms)
                order = np.argsort(names, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                names, ranked = names[order], rank[number]
                place = np.argsort(ranked, kind="stable")
                counts = np.bincount(ranked, minlength=len(names))
                first = np.cumsum(counts) - counts
                steps = np.diff(place, prepend=0)
                steps[first] = place[first]
                part = ((names >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).astype(np.int64)
                cuts = runs(part)
                ends = np.append(cuts[1:], len(part))
                inside = np.append(first, len(place))
                rows = [(int(part[s]), names[s:e].tobytes(), _planes(counts[s:e]), _planes(steps[inside[s] : inside[e]])) for s, e in zip(cuts, ends)]
                rows.append((-1, np.array(ids, "<i8").tobytes(), None, _planes(np.array(starts))))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int32()), pa.array([task + k] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "shard", "terms", "counts", "places"]
                )

        # Parts are brought together; one of too many shards is cut, small ones are put into one file.
        rows = docs.mapInArrow(build, "part int, shard long, terms binary, counts binary, places binary").hint("rebalance", "part")
        self.rows = materialize(rows)
        self.lists = self.rows.where("part >= 0")
        self.shards = self.rows.where("part = -1").select("shard", F.col("terms").alias("ids"), F.col("places").alias("starts"))

    def occurrences(self, names: np.ndarray) -> np.ndarray:
        """How often each of the terms ``names`` (ascending) occurs, over all documents. Only they are summed."""
        shared = self.rows.sparkSession.sparkContext.broadcast(names)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value), np.int64)
            for batch in batches:
                for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                    have = np.frombuffer(terms.as_py(), "<u8")
                    at = np.searchsorted(shared.value, have).clip(max=len(total) - 1)
                    hit = shared.value[at] == have
                    total[at[hit]] += _numbers(counts.as_py())[hit]
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["t", "n"])

        parts = np.unique((names >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).tolist()
        sums = self.lists.where(F.col("part").isin(parts)).select("terms", "counts").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(len(names), np.int64)
        out[sums.column("t").to_numpy()] = sums.column("n").to_numpy()
        return out

    def of_terms(self, names: np.ndarray) -> DataFrame:
        """``(shard, keys)`` of the lists of the terms ``names`` (ascending): term number in the upper and position in the lower half."""
        shared = self.rows.sparkSession.sparkContext.broadcast(names)

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, blobs = [], []
                for which, terms, counts, places in zip(*(batch.column(c) for c in ("shard", "terms", "counts", "places"))):
                    have = np.frombuffer(terms.as_py(), "<u8")
                    at = np.searchsorted(shared.value, have).clip(max=len(shared.value) - 1)
                    hit = np.flatnonzero(shared.value[at] == have)
                    if not len(hit):
                        continue
                    n, steps = _numbers(counts.as_py()), _numbers(places.as_py())
                    first = np.cumsum(n) - n
                    mine = [(np.int64(at[k]) << 32) + np.cumsum(steps[first[k] : first[k] + n[k]]) for k in hit]
                    shard.append(which.as_py())
                    blobs.append(np.concatenate(mine).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(blobs, pa.binary())], ["shard", "keys"])

        parts = np.unique((names >> np.uint64(32)) * np.uint64(PARTS) >> np.uint64(32)).tolist()
        return self.lists.where(F.col("part").isin(parts)).select("shard", "terms", "counts", "places").mapInArrow(pick, "shard long, keys binary")


class Queries:
    """The items as word numbers, and the lists to be intersected for each of their stretches."""

    def __init__(self, items: list[tuple[int, str]], least: int) -> None:
        """A stretch has ``least`` words; an item with fewer is one stretch."""
        number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        self.ids, self.words, self.least = [], [], []
        for ident, text in items:
            w = words(text)
            if w:
                self.ids.append(ident)
                self.words.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                self.least.append(min(least, len(w)))
        self.vocabulary = dict(number)
        names = term_hashes(list(number))
        self.names, self.term = np.unique(names, return_inverse=True)  # of words with one name the lists are one

    def plan(self, occurrences: np.ndarray) -> None:
        """Sets ``wanted`` (terms whose lists are read), and for every stretch ``item``, ``lists`` (numbers in ``wanted``) and ``offsets``
        of its ``LISTS`` rarest words, the rarest first and the first on ties; stretches with the same ones are one.
        ``first`` says where the stretches begin whose rarest word is a term."""
        item, offsets, lists = [], [], []
        for i, (w, least) in enumerate(zip(self.words, self.least)):
            rarity = occurrences[self.term[w]]
            view = np.lib.stride_tricks.sliding_window_view(rarity, least)
            rarest = np.argsort(view, axis=1, kind="stable")[:, :LISTS] + np.arange(len(view))[:, None]
            rarest = np.unique(rarest, axis=0)
            if rarest.shape[1] < LISTS:
                rarest = np.concatenate([rarest, np.repeat(rarest[:, :1], LISTS - rarest.shape[1], axis=1)], axis=1)
            item.append(np.full(len(rarest), i))
            offsets.append(rarest)
            lists.append(self.term[w][rarest])
        terms = np.concatenate(lists)
        used, number = np.unique(terms, return_inverse=True)
        number = number.reshape(terms.shape)
        order = np.argsort(number[:, 0], kind="stable")
        self.wanted = self.names[used]
        self.item, self.offsets, self.lists = np.concatenate(item)[order], np.concatenate(offsets)[order], number[order]
        self.first = np.searchsorted(self.lists[:, 0], np.arange(len(used) + 1))


def intersected(q: Queries | SimpleNamespace, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, item, place)`` of a shard where the lists of a stretch's rarest words meet, each shifted by the word's offset in
    the item: the document by number, the place where the item would begin in it. ``keys`` ascends."""
    term, position = keys >> 32, keys & 0xFFFFFFFF
    n = q.first[term + 1] - q.first[term]
    which = np.repeat(q.first[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    begin = np.repeat(position, n) - q.offsets[which, 0]
    for k in range(1, LISTS):  # the next rarest, at the places still there
        there = begin + q.offsets[which, k]
        want = (q.lists[which, k].astype(np.int64) << 32) + there
        at = np.searchsorted(keys, want).clip(max=len(keys) - 1)
        met = (keys[at] == want) & (there >= 0)
        which, begin = which[met], begin[met]
    doc = np.searchsorted(starts, begin + q.offsets[which, 0], side="right") - 1
    found = np.unique(np.stack([doc, q.item[which], begin - starts[doc]]), axis=1)
    return found[0], found[1], found[2]


def stretches(here: np.ndarray, theirs: np.ndarray, place: int, least: int) -> list[tuple[int, int]]:
    """``(first word in the item, length)`` of the maximal equal stretches of ``least`` words or more if the item begins at ``place``."""
    low, high = max(0, -place), min(len(theirs), len(here) - place)
    if high - low < least:
        return []
    same = np.zeros(high - low + 2, np.int8)
    same[1:-1] = here[place + low : place + high] == theirs[low:high]
    edges = np.flatnonzero(np.diff(same))
    return [(int(s) + low, int(e - s)) for s, e in zip(edges[::2], edges[1::2]) if e - s >= least]


Found = dict[int, list[tuple[int, int, int]]]


def exact_rows(q: SimpleNamespace, found: Found) -> Iterator[tuple]:
    """``(item, longest, passages, covered, item_words)`` of a document: longest shared stretch in words, shared stretches, and
    words of the item that lie in one."""
    for i, mine in found.items():
        covered = np.zeros(len(q.words[i]), bool)
        for _, first, n in mine:
            covered[first : first + n] = True
        yield q.ids[i], max(n for *_, n in mine), len(mine), int(covered.sum()), len(covered)


def near_rows(q: SimpleNamespace, found: Found, least: int, gap: int) -> Iterator[tuple]:
    """``(item, words, span, exact)`` of a document: shared stretches, in the item's order and with at most ``gap`` words between
    two of them on either side, that hold ``least`` words together (or the whole of a shorter item); the most words, the words of the document they
    lie in (the fewest on ties), and whether one stretch alone has as many."""
    for i, mine in found.items():
        enough = min(least, len(q.words[i]))
        mine.sort()
        widest = max(n for *_, n in mine)
        chains: list[tuple[int, int]] = []  # words, and the place of its first, of the best chain that ends in each stretch
        for k, (place, first, n) in enumerate(mine):
            best = n, place
            for j in range(k - 1, -1, -1):
                p, f, m = mine[j]
                if place - p > widest + gap:
                    break
                over = max(0, p + m - place, f + m - first)  # words that both would count
                if over < n and f < first and place + over - p - m <= gap and first + over - f - m <= gap:
                    best = max(best, (chains[j][0] + n - over, chains[j][1]))
            chains.append(best)
        most, short = max((w, s - p - n) for (w, s), (p, _, n) in zip(chains, mine))
        if most >= enough:
            yield q.ids[i], most, -short, widest >= enough


def _meeting(shared) -> Callable:
    """The candidates of one shard, from its lists and its documents."""

    def run(lists: pa.Table, shard: pa.Table) -> pa.Table:
        doc, i, place = np.empty((3, 0), np.int64)
        if lists.num_rows and shard.num_rows:
            keys = np.sort(np.concatenate([np.frombuffer(k.as_py(), "<i8") for k in lists.column("keys")]))
            doc, i, place = intersected(SimpleNamespace(**shared.value), keys, _numbers(shard.column("starts")[0].as_py()))
            doc = np.frombuffer(shard.column("ids")[0].as_py(), "<i8")[doc]
        return pa.table([pa.array(doc, pa.int64()), pa.array(i, pa.int64()), pa.array(place, pa.int64())], ["doc_id", "i", "place"])

    return run


def _confirming(shared, rows_of: Callable, kinds: list[pa.DataType], names: list[str]) -> Callable:
    """The rows of documents, from their texts and candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = SimpleNamespace(**shared.value)
        get = here.vocabulary.get
        for batch in batches:
            rows = []
            for ident, text, met in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "met"))):
                w = words(text)
                number = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
                found: Found = {}
                for m in met:
                    i, place = m["i"], m["place"]
                    for first, n in stretches(number, here.words[i], place, here.least[i]):
                        found.setdefault(i, []).append((place + first, first, n))
                rows += [(ident, *r) for r in rows_of(here, found)]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return run


def _searched(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, passage: str, least: int, schema: str, rows_of: Callable) -> DataFrame:
    """What ``rows_of`` gives for every document that shares a stretch of ``least`` words with an item, for each block of the
    query set; ``doc_id`` and the columns of ``schema``."""
    spark = docs.sparkSession
    slim = docs.select(F.col(ident).cast("long").alias("ident"), F.col(text).alias("text")).where("ident is not null and text is not null")
    stated = items.select(F.col(item).cast("long").alias("i"), F.col(passage).alias("t")).where("i is not null and t is not null")
    blocks = max(1, -(-(stated.agg(F.sum(F.length("t"))).first()[0] or 0) // (QUERY_WORDS * 4)))
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
    kinds = [pa.int64(), *({"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", "))]
    index, out = None, None
    for b in range(blocks):
        q = Queries([(r.i, r.t) for r in stated.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()], least)
        if not q.ids:
            continue
        index = index or Index(widened(slim))
        q.plan(index.occurrences(q.names))
        shared = spark.sparkContext.broadcast(vars(q))  # plain data: workers need not know the class

        met = index.of_terms(q.wanted).groupBy("shard").cogroup(index.shards.groupBy("shard")).applyInArrow(_meeting(shared), "doc_id long, i long, place long")
        met = materialize(met.groupBy("doc_id").agg(F.collect_set(F.struct("i", "place")).alias("met")))
        some = named(slim, "ident", met.select(F.col("doc_id").alias("ident"))).withColumnRenamed("ident", "doc_id").join(met.hint("merge"), "doc_id")

        part = some.select("doc_id", "text", "met").mapInArrow(_confirming(shared, rows_of, kinds, names), f"doc_id long, {schema}")
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"doc_id long, {schema}") if out is None else out


def leaked_passages(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, passage: str, *, least: int = 12) -> DataFrame:
    """``(doc_id, item_id, longest, passages, covered, item_words)`` of every document that holds ``least`` or more consecutive words of an item.

    A positional inverted index of the documents (``Index``) is stored, partitioned by term. Of every stretch of an item the lists of its
    rarest words, told by their occurrences in the index, are read and intersected, each shifted by the word's offset; where they
    meet, the stretch is confirmed on the document's words and extended to its ends. The query set is stated,
    held by the driver and sent in blocks of at most ``QUERY_WORDS`` words; the index is built once.

    An item with fewer words than ``least`` is searched as a whole; one without words matches nothing, nor do null texts and
    idents on either side. Documents are read whole. Repeated rows of a document or item count once in the result, with the largest values. Empty
    tables give no rows.
    """
    out = _searched(docs, ident, text, items, item, passage, least, "item_id long, longest int, passages int, covered int, item_words int", exact_rows)
    return out.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("longest", "passages", "covered", "item_words")))


def near_passages(docs: DataFrame, ident: str, text: str, items: DataFrame, item: str, passage: str, *, least: int = 12, part: int = 6, gap: int = 4) -> DataFrame:
    """``(doc_id, item_id, words, span, exact)``: exact phrase and proximity matches, see ``near_rows``. Stretches have ``part`` words or more,
    so a passage is found though words are changed, put in or left out, as long as ``part`` words in a row are left between such places
    and each takes ``gap`` words at most. Otherwise as ``leaked_passages``; with ``exact`` the pair is among its rows too."""

    def rows_of(q: SimpleNamespace, found: Found) -> Iterator[tuple]:
        return near_rows(q, found, least, gap)

    out = _searched(docs, ident, text, items, item, passage, part, "item_id long, words int, span int, exact boolean", rows_of)
    best = F.max(F.struct("words", (-F.col("span")).alias("short"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best, F.max("exact").alias("exact")).select("doc_id", "item_id", "best.words", (-F.col("best.short")).alias("span"), "exact")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("longest >= 12").select("doc_id", "item_id")


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches."""
    return near_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked: in how many documents, and the largest share of their words found in one."""
    share = (F.col("covered") / F.col("item_words")).alias("share")
    return _leaks(spark, sf_dir).select("item_id", share).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.round(F.max("share"), 6).alias("largest_share"))


_WORDS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda w: lower(w))"
_WINDOWS = "select id, w[i : i + 11] as g from (select id, w, unnest(generate_series(1, len(w) - 11)) as i from {0})"
_BOTH = f"with d as (select doc_id as id, {_WORDS} as w from documents where text is not null), e as (select item_id as id, {_WORDS} as w from eval_items where text is not null)"
#: All shared stretches by gaps and islands: windows of 12 words, or of a shorter item's, that meet under one shift in a row.
_PASSAGES = f"""{_BOTH}, sizes as (select distinct least(12, len(w)) as k from e where len(w) > 0),
x as (select id, k, i, w[i : i + k - 1] as g from (select id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from d, sizes)),
y as (select id, k, i, w[i : i + k - 1] as g from (select id, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from e, sizes where k = least(12, len(w)))),
met as (select x.id as doc_id, y.id as item_id, x.i - y.i as shift, y.i as pos, k from x join y using (k, g)),
islands as (select *, pos - row_number() over (partition by doc_id, item_id, shift order by pos) as island from met),
stretches as (select doc_id, item_id, min(pos) as first, count(*) + any_value(k) - 1 as n from islands group by doc_id, item_id, shift, island),
covered as (select doc_id, item_id, count(distinct pos) as covered from (select doc_id, item_id, unnest(generate_series(first, first + n - 1)) as pos from stretches) group by 1, 2),
passages as (select s.doc_id, s.item_id, cast(max(n) as int) as longest, cast(count(*) as int) as passages, cast(any_value(c.covered) as int) as covered, cast(any_value(len(e.w)) as int) as item_words
  from stretches s join covered c using (doc_id, item_id) join e on e.id = s.item_id group by 1, 2)
"""
ORACLE = {
    "p9_found": f"{_BOTH}, x as ({_WINDOWS.format('d')}), y as ({_WINDOWS.format('e')}) select distinct x.id as doc_id, y.id as item_id from x join y using (g)",
    "p9_passages": f"{_PASSAGES} select * from passages",
    "p9_leaked_items": f"{_PASSAGES} select item_id, count(*) as documents, round(max(covered * 1.0e0 / item_words), 6) as largest_share from passages group by 1",
}
