"""Several candidates of the text model fitted side by side: grams counted once for all, records kept as blocks of gram columns, and one pass over the blocks for a step of every fit.

A gram is one integer: its characters' places in the alphabet of the training texts, in order of code points, left-aligned, so that integers order as texts do. Code points that
occur less often than the smallest ``min_df`` are in no vocabulary and have no place in the alphabet.
"""

from __future__ import annotations

import itertools
import pickle
import warnings
from collections.abc import Generator, Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit
from urllib.request import url2pathname

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import widened

#: Records counted at once, and records of a block.
_COUNTED, _BLOCK = 1 << 13, 1 << 12
#: Parts of the counters for each part of a shuffle: a part is merged at once, in Python.
_FINER = 4
#: Models fitted at once, and places of a sum that are sent in one row.
_MODELS, _SLICE = 8, 1 << 15
#: Settings of a step: its shuffle files, the sums of the tasks, are removed when it ends, as they would pile up otherwise; blocks come one at a time, being some MB each.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
#: Steps that a solver remembers, steps over which its value must fall, and steps after which it asks for the curvature anew.
_MEMORY, _FLAT, _CURVATURE = 7, 20, (0, 2, 5, 10, 20, 40, 80, 160, 320, 640)


@dataclass(frozen=True)
class Alphabet:
    """Places of code points, from 1; ``bits`` for a place, ``top`` places in a key."""

    points: np.ndarray
    bits: int
    top: int

    @property
    def records(self) -> int:
        """How many records can be told apart beside a key in 64 bits."""
        return 1 << min(62 - self.bits * self.top, 15) if self.bits * self.top <= 54 else 0

    def table(self) -> np.ndarray:
        out = np.zeros(0x110000, np.uint64)
        out[self.points] = np.arange(1, len(self.points) + 1)
        return out


def _strings(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def alphabet(texts: DataFrame, least: int, top: int) -> Alphabet:
    """The code points that occur ``least`` times or more in the columns of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for column in batch.columns:
                n = np.bincount(np.frombuffer("".join(_strings(column)).encode("utf-32-le", "surrogatepass"), np.uint32))
                total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["point", "n"])

    rows = texts.mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    points = np.sort(rows.column("point").to_numpy())
    return Alphabet(points, max(1, len(points).bit_length()), top)


def _grams(texts: list[str], table: np.ndarray, bits: int, top: int, lo: int, hi: int) -> Iterator[tuple]:
    """For each n ``(n, keys, pairs per key, record and occurrences of each pair)`` of the grams within one text, sorted by key and record."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.zeros(len(points) + len(texts), np.uint64)  # a zero follows every text
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(lengths + 1) - 1] = False
    codes[inside] = table[points]
    record = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths + 1)
    zeros = np.cumsum(codes == 0)
    before = np.append(0, zeros[:-1])
    width, shift = np.uint64(max(1, (len(texts) - 1).bit_length())), np.uint64(bits)
    key = codes
    for n in range(1, hi + 1):
        if n > 1:
            key = (key[:-1] << shift) | codes[n - 1 :]
        if n < lo:
            continue
        good = np.flatnonzero(zeros[n - 1 :] == before[: len(key)])
        if not len(good):
            return
        packed = (key[good] << width) | record[good]
        packed.sort()
        at = np.flatnonzero(np.append(True, packed[1:] != packed[:-1]))
        times = np.diff(np.append(at, len(packed)))
        pair = packed[at]
        grams = pair >> width
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        yield n, grams[first] << np.uint64(bits * (top - n)), np.diff(np.append(first, len(grams))), pair & ((np.uint64(1) << width) - np.uint64(1)), times


def _planes(x: np.ndarray) -> bytes:
    """The bytes of ``x``, all first ones first: they compress well where many are zero."""
    return b"".join((x >> x.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(x.itemsize))


def _from_planes(b: bytes, kind: type, bytes_each: int) -> np.ndarray:
    first, *planes = np.frombuffer(b, np.uint8).reshape(bytes_each, -1)
    out = first.astype(kind)
    for k, plane in enumerate(planes):
        if plane.any():
            out |= plane.astype(kind) << kind(8 * k + 8)
    return out


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of ``most`` rows; only the last is smaller."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, most - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def counted(texts: DataFrame, letters: Alphabet, ranges: list[tuple[int, int]], least: int) -> DataFrame:
    """``(kind, n, ngram, df, tf_total)`` of the grams in ``least`` records or more; column ``t<kind>`` of ``texts`` with the lengths of ``ranges[kind]``.

    A task's counters are sorted arrays, cut by a hash of the key into ``_FINER`` times as many parts as a shuffle has; each part is merged by one task.
    """
    parts = _FINER * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, top, points, most = letters.bits, letters.top, letters, min(_COUNTED, letters.records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = points.table()
        for rows in _gathered(batches, most):
            for kind, (lo, hi) in enumerate(ranges):
                found = [[], [], []]
                for _, keys, pairs, _, times in _grams(_strings(rows.column(f"t{kind}")), table, bits, top, lo, hi):
                    ends = np.cumsum(pairs)
                    for held, x in zip(found, (keys, pairs, np.add.reduceat(times, ends - pairs))):
                        held.append(x)
                if not found[0]:
                    continue
                keys, df, tf = map(np.concatenate, found)
                part = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
                order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint64), kind="stable")  # keys ascend for each n; from one n to the next the step wraps around
                ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
                keys, df, tf = keys[order], df[order], tf[order]
                out = [[], [], [], [], []]
                for p, (s, e) in enumerate(zip(np.append(0, ends[:-1]).tolist(), ends.tolist())):
                    if s < e:
                        step = np.diff(keys[s:e], prepend=np.uint64(0))
                        for held, x in zip(out, (kind, p, _planes(step), _planes(df[s:e].astype(np.uint32)), _planes((tf[s:e] - df[s:e]).astype(np.uint32)))):
                            held.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.binary()) for x in out[2:])], ["kind", "part", "keys", "df", "more"])

    def merge(at: tuple, rows: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_from_planes(b, np.uint64, 8)) for b in rows.column("keys").to_pylist()]).astype(np.uint64)
        df = np.concatenate([_from_planes(b, np.int64, 4) for b in rows.column("df").to_pylist()])
        tf = np.concatenate([_from_planes(b, np.int64, 4) for b in rows.column("more").to_pylist()]) + df
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        df, tf = np.add.reduceat(df[order], first), np.add.reduceat(tf[order], first)
        enough = np.flatnonzero(df >= least)
        keys = keys[first][enough]
        n = np.full(len(keys), top, np.int32)
        for k in range(1, top):
            n[(keys & np.uint64((1 << bits * k) - 1)) == 0] = top - k
        return pa.table({"kind": pa.array(np.full(len(keys), at[0].as_py(), np.int32)), "n": n, "ngram": keys.astype(np.int64), "df": df[enough], "tf_total": tf[enough]})

    sent = texts.mapInArrow(run, "kind int, part int, keys binary, df binary, more binary")
    return sent.groupBy("kind", "part").applyInArrow(merge, "kind int, n int, ngram long, df long, tf_total long")


class Stored:
    """The table of blocks, for one pass after another. From a folder that is mounted, tasks read their row groups themselves, so that no block goes through the JVM; any other is read by Spark."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.tasks, self.groups = rows, rows.sparkSession.sparkContext.defaultParallelism, None
        files = rows.inputFiles()
        if files and all(f.startswith("file:") for f in files):
            paths, loads = [url2pathname(urlsplit(f).path) for f in files], [0] * self.tasks
            self.groups = [[] for _ in loads]
            sizes = []
            for path in paths:
                meta = pq.read_metadata(path)
                sizes += [(meta.row_group(k).total_byte_size, path, k) for k in range(meta.num_row_groups)]
            for n, path, k in sorted(sizes, key=lambda x: -x[0]):
                least = loads.index(min(loads))
                loads[least] += n
                self.groups[least].append((path, k))

    def source(self) -> DataFrame:
        return self.rows.coalesce(self.tasks) if self.groups is None else self.rows.sparkSession.range(0, self.tasks, 1, self.tasks)

    def reader(self):
        """A function that gives the blocks of a task from the batches of ``source``."""
        groups = self.groups

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Scalar]:
            for batch in batches:
                if groups is None:
                    yield from batch.column("block")
                    continue
                for task in batch.column("id").to_pylist():
                    for path, own in itertools.groupby(sorted(groups[task]), lambda x: x[0]):
                        with pq.ParquetFile(path) as file:
                            for _, k in own:
                                for part in file.iter_batches(1, [k], ["block"], use_threads=False):
                                    yield from part.column("block")

        return read


@dataclass
class Features:
    """The grams of one kind of text that any vocabulary has, by n and key, and which of them are ``members`` of each vectoriser's. Broadcast as ``arrays``."""

    keys: dict[int, np.ndarray]
    starts: dict[int, int]
    idf: np.ndarray
    size: int
    members: dict[int, np.ndarray]

    def arrays(self) -> tuple:
        return self.keys, self.starts, self.idf, self.size, self.members


def features(tops: dict[int, pa.Table], rows: int) -> Features:
    """``tops``: per vectoriser its vocabulary (n, ngram, df)."""
    n, keys, df = (np.concatenate([t.column(c).to_numpy() for t in tops.values()]) for c in ("n", "ngram", "df"))
    keys, first = np.unique(keys, return_index=True)
    n, df = n[first], df[first]
    order = np.argsort(n, kind="stable")  # by n, then key
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    members = {v: np.sort(place[np.searchsorted(keys, t.column("ngram").to_numpy())]) for v, t in tops.items()}
    n, keys, df = n[order], keys[order].astype(np.uint64), df[order]
    of = {int(k): np.flatnonzero(n == k) for k in np.unique(n)}
    return Features({k: keys[x] for k, x in of.items()}, {k: int(x[0]) for k, x in of.items()}, np.log((1.0 + rows) / (1.0 + df)) + 1.0, len(keys), members)


def _times(tf: np.ndarray, sublinear: bool) -> np.ndarray:
    return 1 + np.log(tf) if sublinear else tf.astype(float)


def _widths(records: int) -> np.ndarray:
    """The widths of columns in a block: every one to 16, then each larger by a fifth or so, to at least ``records``."""
    out = list(range(1, 17))
    while out[-1] < records:
        out.append(out[-1] + max(4, out[-1] // 5))
    return np.array(out)


def _columns(texts: list[str], table: np.ndarray, letters: tuple[int, int], f: Features, lo: int, hi: int, vectorisers: dict[int, tuple]) -> tuple[dict, dict]:
    """The columns of ``texts`` as ``Level`` takes them, by n, and the norms of the records by vectoriser."""
    out, square = {}, {v: np.zeros(len(texts)) for v in vectorisers}
    own, widths = {}, _widths(len(texts))
    for v in vectorisers:
        own[v] = np.zeros(f.size)
        own[v][f.members[v]] = f.idf[f.members[v]]
    for n, keys, pairs, record, times in _grams(texts, table, *letters, lo, hi):
        if n not in f.keys:
            continue
        at = np.searchsorted(f.keys[n], keys).clip(max=len(f.keys[n]) - 1)
        hit = f.keys[n][at] == keys
        keep = np.repeat(hit, pairs)
        feature, pairs, record, times = at[hit], pairs[hit], record[keep].astype(np.uint16), times[keep]
        if not len(feature):
            continue
        more = np.flatnonzero(times > 1)
        for v, (a, b, sublinear) in vectorisers.items():
            if a <= n <= b:
                w = np.repeat(own[v][feature + f.starts[n]], pairs)
                w[more] *= _times(times[more], sublinear)
                square[v] += np.bincount(record, w * w, len(texts))
        starts, width = np.cumsum(pairs) - pairs, np.searchsorted(widths, pairs)
        order = np.argsort(width, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        shape, records, first = [], [], 0
        for k, count in enumerate(np.bincount(width).tolist()):
            if count:
                columns, slot = order[first : first + count, None], np.arange(widths[k])
                filled = slot < pairs[columns]
                records.append(np.where(filled, record[np.where(filled, starts[columns] + slot, 0)], len(texts)).astype(np.uint16).ravel())
                shape.append((int(widths[k]), count))
                first += count
        column = place[np.searchsorted(starts, more, side="right") - 1]
        sort = np.argsort(column, kind="stable")
        column, more = column[sort], more[sort]
        out[n] = feature[order].astype(np.int32), shape, _planes(np.concatenate(records)), column, record[more], times[more].astype(np.int32)
    return out, {v: np.where(x > 0, np.sqrt(x), 1.0) for v, x in square.items()}


class Level:
    """The columns of one n in a block, ready for products with several models at once. They are in order of width, and stored as features (counted from the first of this n), ``(width, columns)``
    of each width, records in two planes; then column, record and number of what occurs more than once in a record. A column is filled up to its width with the record after the last."""

    def __init__(self, stored: tuple, records: int) -> None:
        self.feature, self.shape, packed, self.column, self.row, self.times = stored
        self.records, flat = records, _from_planes(packed, np.uint16, 2)
        self.record = np.empty(len(flat), np.intp)
        for s, e, width, n, _ in self._each():
            self.record[s:e].reshape(width, n)[:] = flat[s:e].reshape(n, width).T
        self.first = np.flatnonzero(np.diff(self.column, prepend=-1))

    def _each(self) -> Iterator[tuple]:
        """Of each width the stretch of its records, the width, its columns and the first of them."""
        s = first = 0
        for width, n in self.shape:
            yield s, s + width * n, width, n, first
            s, first = s + width * n, first + n

    def margins(self, z: np.ndarray, sublinear: list[bool]) -> Iterator[np.ndarray]:
        """Of each model the sums per record; ``z`` has a row for each feature and a column for each model."""
        w, each = np.empty(len(self.record)), [*self._each()]
        for x, how in zip(np.ascontiguousarray(np.take(z, self.feature, axis=0).T), sublinear):
            for s, e, width, n, first in each:
                w[s:e].reshape(width, n)[:] = x[first : first + n]
            yield np.bincount(self.record, w, self.records + 1)[:-1] + np.bincount(self.row, x[self.column] * (_times(self.times, how) - 1), self.records)

    def add(self, total: np.ndarray, r: np.ndarray, sublinear: list[bool], power: int = 1) -> None:
        """Add to each feature the sums of ``r`` over its records, times its occurrences to ``power``; ``total`` and ``r`` have a column for each model."""
        out, padded = np.empty((len(self.feature), len(sublinear))), np.vstack([r, np.zeros((1, len(sublinear)))])
        for s, e, width, n, first in self._each():
            rows = np.take(padded, self.record[s:e].reshape(width, n), axis=0)
            out[first : first + n] = rows[0] if width == 1 else rows.sum(axis=0)
        if len(self.first):
            more = np.stack([_times(self.times, how) ** power - 1 for how in sublinear], axis=1)
            out[self.column[self.first]] += np.add.reduceat(r[self.row] * more, self.first, axis=0)
        total[self.feature] += out


class Side:
    """Models of one kind of text side by side: their coefficients by n, and sums of the same shape."""

    def __init__(self, f: Features, vectorisers: list[tuple], members: list[np.ndarray], coefficients: list[np.ndarray]) -> None:
        self.f, self.members, self.sublinear = f, members, [x[2] for x in vectorisers]
        self.within = {n: [j for j, (lo, hi, _) in enumerate(vectorisers) if lo <= n <= hi] for n in f.keys}
        self.intercepts = np.array([x[-1] for x in coefficients])
        self.z = self.zeros()
        for j, (at, x) in enumerate(zip(members, coefficients)):
            weighted = np.zeros(f.size)
            weighted[at] = x[:-1] * f.idf[at]
            for n, own in self.within.items():
                if j in own:
                    self.z[n][:, own.index(j)] = weighted[f.starts[n] : f.starts[n] + len(f.keys[n])]

    def zeros(self, asked: list[int] | None = None) -> dict[int, np.ndarray]:
        return {n: np.zeros((len(self.f.keys[n]), sum(asked is None or j in asked for j in own))) for n, own in self.within.items()}

    def margins(self, levels: dict[int, Level], norm: np.ndarray) -> np.ndarray:
        """``(record, model)``, the intercepts included."""
        out = np.zeros(norm.shape)
        for n, level in levels.items():
            own = self.within[n]
            for j, x in zip(own, level.margins(self.z[n], [self.sublinear[j] for j in own])):
                out[:, j] += x
        return out / norm + self.intercepts

    def add(self, total: dict[int, np.ndarray], levels: dict[int, Level], r: np.ndarray, asked: list[int], power: int = 1) -> None:
        """``total`` is of the models ``asked``, as is ``r``."""
        for n, level in levels.items():
            own = [j for j in self.within[n] if j in asked]
            if own:
                level.add(total[n], r[:, [asked.index(j) for j in own]], [self.sublinear[j] for j in own], power)

    def of(self, total: dict[int, np.ndarray], j: int, asked: list[int]) -> np.ndarray:
        """The sums of model ``j`` at its own features, in their order."""
        out = np.zeros(self.f.size)
        for n, own in self.within.items():
            if j in own:
                out[self.f.starts[n] : self.f.starts[n] + len(self.f.keys[n])] = total[n][:, [i for i in own if i in asked].index(j)]
        return out[self.members[j]]


def _loss(m: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, m) - y * m


class Candidates:
    """Candidates on one training table: ``kinds`` of text, vectorisers ``(kind, lo, hi, sublinear)`` and models."""

    def __init__(self, specs: list, kind_of, text_of) -> None:
        self.specs = specs
        self.kinds = list(dict.fromkeys(map(kind_of, specs)))
        self.texts = [text_of(next(s for s in specs if kind_of(s) == k)) for k in self.kinds]
        self.keys = list(dict.fromkeys(s.vectorizer_key for s in specs))
        first = [next(s for s in specs if s.vectorizer_key == k) for k in self.keys]
        self.first = first
        self.vectorisers = {v: (s.min_n, s.max_n, s.sublinear) for v, s in enumerate(first)}
        self.kind = {v: self.kinds.index(kind_of(s)) for v, s in enumerate(first)}
        self.of = [self.keys.index(s.vectorizer_key) for s in specs]
        self.ranges = [(min(self.vectorisers[v][0] for v, k in self.kind.items() if k == i), max(self.vectorisers[v][1] for v, k in self.kind.items() if k == i)) for i in range(len(self.kinds))]
        self.top, self.least = max(hi for _, hi in self.ranges), min(s.min_df for s in specs)

    def columns(self, df: DataFrame, text: str, label: str) -> DataFrame:
        """``(t0, t1, ..., y)``: the kinds of text and the label."""
        rows = widened(df.select(F.col(text).alias("t"), F.col(label).cast("double").alias("y")))
        return rows.select(*(t(F.col("t")).alias(f"t{k}") for k, t in enumerate(self.texts)), "y")

    def vocabularies(self, counts: DataFrame, rows: int, most_frequent) -> list[Features]:
        tops: list[dict] = [{} for _ in self.kinds]
        for v, s in enumerate(self.first):
            own = counts.where((F.col("kind") == self.kind[v]) & F.col("n").between(s.min_n, s.max_n) & (F.col("df") >= s.min_df))
            tops[self.kind[v]][v] = most_frequent(own, s.max_features).select("n", "ngram", "df").toArrow()
            if not tops[self.kind[v]][v].num_rows:
                raise ValueError("no gram occurs in enough records")
        return [features(t, rows) for t in tops]

    def block_of(self, letters: Alphabet):
        """A function that makes ``[(columns, norms) of each kind]`` of rows."""
        per_kind = [{v: x for v, x in self.vectorisers.items() if self.kind[v] == k} for k in range(len(self.kinds))]
        ranges, shape = self.ranges, (letters.bits, letters.top)

        def make(rows: pa.Table, table: np.ndarray, features: list[Features]) -> list[tuple]:
            return [_columns(_strings(rows.column(f"t{k}")), table, shape, features[k], *ranges[k], own) for k, own in enumerate(per_kind)]

        return make

    def blocks(self, rows: DataFrame, letters: Alphabet, shared) -> DataFrame:
        """``(block)``: the records of the training table, ``_BLOCK`` at a time."""
        make, most = self.block_of(letters), min(_BLOCK, letters.records)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, found = letters.table(), [Features(*x) for x in shared.value]
            for part in _gathered(batches, most):
                block = part.column("y").to_numpy().astype(np.int8), make(part, table, found)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])

        return rows.mapInArrow(run, "block binary")

    def evaluated(self, blocks: Stored, shared, asked: dict[int, tuple]) -> dict[int, tuple]:
        """Per model of ``asked`` (coefficients, whether the curvature is wanted, C of both classes) ``(loss, gradient, diagonal of the Hessian or None)`` without the penalty, the intercept last. One pass; the tasks' sums are added up by executors, slice by slice."""
        spark = blocks.rows.sparkSession
        sent = spark.sparkContext.broadcast(asked)
        vectorisers, kind, of, read = self.vectorisers, self.kind, self.of, blocks.reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, wanted = [Features(*x) for x in shared.value], sent.value
            sides = {}
            for k, f in enumerate(found):
                if own := [i for i in wanted if kind[of[i]] == k]:
                    side = Side(f, [vectorisers[of[i]] for i in own], [f.members[of[i]] for i in own], [wanted[i][0] for i in own])
                    curved = [j for j, i in enumerate(own) if wanted[i][1]]
                    sides[k] = own, side, curved, side.zeros(), side.zeros(curved), *np.zeros((3, len(own)))
            for packed in read(batches):
                y, parts = pickle.loads(packed.as_buffer())
                for k, (own, side, curved, g, h, loss, g0, h0) in sides.items():
                    by_n, norms = parts[k]
                    levels, norm = {n: Level(x, len(y)) for n, x in by_n.items()}, np.stack([norms[of[i]] for i in own], axis=1)
                    c = np.stack([np.where(y == 1, c1, c0) for _, _, (c0, c1) in (wanted[i] for i in own)], axis=1)
                    m = side.margins(levels, norm)
                    p = 1 / (1 + np.exp(-m))
                    r = c * (p - y[:, None])
                    loss += (c * _loss(m, y[:, None])).sum(axis=0)
                    g0 += r.sum(axis=0)
                    side.add(g, levels, r / norm, [*range(len(own))])
                    if curved:
                        r = (c * p * (1 - p))[:, curved]
                        h0[curved] += r.sum(axis=0)
                        side.add(h, levels, r / norm[:, curved] ** 2, curved, 2)
            for k, j, i in ((k, j, i) for k, x in sides.items() for j, i in enumerate(x[0])):
                own, side, curved, g, h, loss, g0, h0 = sides[k]
                idf = side.f.idf[side.members[j]]
                total, first = np.append(side.of(g, j, [*range(len(own))]) * idf, g0[j]), loss[j]
                curve = np.append(side.of(h, j, curved) * idf**2, h0[j]).astype(np.float32) if j in curved else np.empty(0, np.float32)
                for s in range(0, len(total), _SLICE):
                    row = [i], [s], [0.0 if s else first], [total[s : s + _SLICE].tobytes()], [curve[s : s + _SLICE].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary()))], ["model", "start", "loss", "g", "h"])

        def summed(rows: pa.Table) -> pa.Table:
            g, h = (sum(np.frombuffer(b.as_buffer(), kind) for b in rows.column(c)).tobytes() for c, kind in (("g", np.float64), ("h", np.float32)))
            return pa.table({"model": rows.column("model").slice(0, 1), "start": rows.column("start").slice(0, 1), "loss": [sum(rows.column("loss").to_pylist())], "g": pa.array([g], pa.binary()), "h": pa.array([h], pa.binary())})

        schema, conf = "model int, start int, loss double, g binary, h binary", spark.conf
        before = {k: conf.get(k, None) for k in _STEP}
        for k, v in _STEP.items():
            conf.set(k, v)
        try:
            rows = blocks.source().mapInArrow(run, schema).groupBy("model", "start").applyInArrow(summed, schema).toArrow()
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        sent.destroy()
        slices: dict[int, list] = {}
        for i, *part in sorted(zip(*(rows.column(c).to_pylist() for c in ("model", "start", "loss", "g", "h")))):
            slices.setdefault(i, []).append(part)
        out = {}
        for i, own in slices.items():
            g, h = (np.frombuffer(b"".join(part[k] for part in own), kind) for k, kind in ((2, np.float64), (3, np.float32)))
            out[i] = sum(part[1] for part in own), g, h if len(h) else None
        return out

    def scored(self, validation: DataFrame, text: str, target: str, letters: Alphabet, shared, fits: dict[int, np.ndarray]) -> DataFrame:
        """``(model, score, target)`` of every row and model. One pass without a shuffle."""
        sent = validation.sparkSession.sparkContext.broadcast(fits)
        make, most = self.block_of(letters), min(_BLOCK, letters.records)
        vectorisers, kind, of = self.vectorisers, self.kind, self.of

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, table = [Features(*x) for x in shared.value], letters.table()
            for part in _gathered(batches, most):
                y = part.column("y").combine_chunks()
                for k, (by_n, norms) in enumerate(make(part, table, found)):
                    if own := [i for i in sent.value if kind[of[i]] == k]:
                        side = Side(found[k], [vectorisers[of[i]] for i in own], [found[k].members[of[i]] for i in own], [sent.value[i] for i in own])
                        m = side.margins({n: Level(x, part.num_rows) for n, x in by_n.items()}, np.stack([norms[of[i]] for i in own], axis=1))
                        for i, x in zip(own, m.T):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i, np.int32)), pa.array(1 / (1 + np.exp(-x))), y], ["model", "score", "target"])

        return self.columns(validation, text, target).mapInArrow(run, "model int, score double, target double")


Ask = tuple[np.ndarray, bool]


def solver(size: int, tolerance: float, max_iter: int) -> Generator[Ask, tuple, tuple[np.ndarray, bool]]:
    """Limited-memory BFGS for the loss that the caller gives plus half the squared norm. Yields points and whether the curvature is wanted there, gets loss, gradient and the
    diagonal of the Hessian; returns the minimum and whether it settled. As the solver of single fits it stops when the gradient's norm is at most ``tolerance`` of the value, or when
    in ``_FLAT`` steps the value fell by no more than ``tolerance`` of the first."""
    x = np.zeros(size)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []

    def at(point: np.ndarray, answer: tuple) -> tuple[float, np.ndarray]:
        return answer[0] + 0.5 * float(point @ point), answer[1] + point

    answer = yield x, True
    f, g = at(x, answer)
    diagonal, values = 1 + answer[2], [f]

    def over() -> bool:
        return bool(np.linalg.norm(g) <= tolerance * f) or len(values) > _FLAT and values[-1 - _FLAT] - f <= tolerance * values[0]

    for step in range(1, max_iter + 1):
        if over():
            return x, True
        d, kept = -g, []
        for s, y, rho in reversed(pairs):
            a = rho * float(s @ d)
            kept.append(a)
            d = d - a * y
        if pairs:
            s, y, rho = pairs[-1]
            d = d / diagonal * (1 / (rho * float(y @ (y / diagonal))))
        else:
            d = d / diagonal
        for (s, y, rho), a in zip(pairs, reversed(kept)):
            d = d + (a - rho * float(y @ d)) * s
        slope = float(g @ d)
        if slope >= 0:
            d, pairs = -g / diagonal, []
            slope = float(g @ d)
        t = 1.0 if pairs else 0.1  # many grams share a record, so the first step by the diagonal alone would go far too far
        while True:
            there = x + t * d
            curved = step in _CURVATURE
            answer = yield there, curved
            f1, g1 = at(there, answer)
            if f1 <= f + 1e-4 * t * slope or abs(f1 - f) <= 1e-12 * abs(f) and np.linalg.norm(g1) < np.linalg.norm(g):
                break
            slope1 = float(g1 @ d)
            t *= min(0.6, max(0.05, slope / (slope - slope1))) if np.isfinite(slope1) and slope1 > slope else 0.1
            if t < 1e-12:
                return x, False
        s, y = (there - x).astype(np.float32), (g1 - g).astype(np.float32)
        inner = float(s @ y)
        if inner > 0:
            pairs = [*pairs[-_MEMORY + 1 :], (s, y, 1 / inner)]
        x, f, g = there, f1, g1
        values.append(f)
        if answer[2] is not None:
            diagonal = 1 + answer[2]
    return x, over()


def fitted(c: Candidates, blocks: DataFrame, shared, found: list[Features], counts: tuple[int, int], tolerance: float, told=lambda i: None) -> dict[int, np.ndarray]:
    """Per candidate its coefficients, the intercept last. All candidates take their steps together; ``told`` hears of each that is done."""
    n0, n1 = counts
    if not n0 or not n1:
        raise ValueError("both classes are needed")
    stored, out = Stored(blocks), {}
    for s in range(0, len(c.specs), _MODELS):
        running, asked = {}, {}
        for i in range(s, min(s + _MODELS, len(c.specs))):
            spec = c.specs[i]
            w0, w1 = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if spec.class_weight == "balanced" else (1.0, 1.0)
            running[i] = solver(len(found[c.kind[c.of[i]]].members[c.of[i]]) + 1, tolerance, spec.max_iter), (spec.c * w0, spec.c * w1)
            asked[i] = *next(running[i][0]), running[i][1]
        while asked:
            answers = c.evaluated(stored, shared, asked)
            for i in list(asked):
                try:
                    asked[i] = *running[i][0].send(answers.pop(i)), running[i][1]
                except StopIteration as end:
                    out[i], settled = end.value
                    if not settled:
                        warnings.warn(f"{c.specs[i].name} has not settled after {c.specs[i].max_iter} steps", RuntimeWarning, stacklevel=2)
                    del asked[i], running[i]
                    told(i)
    return out
