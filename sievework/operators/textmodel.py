"""Character n-gram TF-IDF and a regularised logistic regression over it."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import text_model_input
from . import lockstep
from .counters import Counters
from .metrics import Costs, at_max_fpr, evaluate, threshold_table
from .shared import discard, materialize, widened


@dataclass(frozen=True)
class Spec:
    """Hyper-parameters of one candidate."""

    name: str
    min_n: int = 3
    max_n: int = 5
    c: float = 1.0
    class_weight: str | None = None
    min_df: int = 3
    max_features: int = 250_000
    scheme_neutral: bool = False
    sublinear: bool = True
    max_iter: int = 1000
    lowercase: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.min_n <= self.max_n:
            raise ValueError("the n-gram range must be ascending from 1")
        if self.c <= 0:
            raise ValueError("c must be positive")
        if self.class_weight not in (None, "balanced"):
            raise ValueError("class_weight must be None or 'balanced'")
        if self.min_df < 1 or self.max_features < 1:
            raise ValueError("min_df and max_features must be positive")

    @property
    def vectorizer_key(self) -> tuple:
        return self.min_n, self.max_n, self.min_df, self.max_features, self.scheme_neutral, self.sublinear, self.lowercase

    def to_dict(self) -> dict:
        return asdict(self)


def compact_candidates() -> list[Spec]:
    """Seven candidates; the last two differ in ``scheme_neutral`` alone."""
    return [
        Spec("char35_c05", 3, 5, 0.5),
        Spec("char35_c10", 3, 5, 1.0),
        Spec("char35_c20_bal", 3, 5, 2.0, "balanced"),
        Spec("char36_c10", 3, 6, 1.0),
        Spec("char46_c10", 4, 6, 1.0),
        Spec("char25_c10_bal_raw", 2, 5, 1.0, "balanced"),
        Spec("char25_c10_bal_scheme_www_neutral", 2, 5, 1.0, "balanced", scheme_neutral=True),
    ]


def full_candidates() -> list[Spec]:
    """The grid of three ranges, three strengths and two class weights, none scheme-neutral."""
    ranges, cs, weights = ((3, 5), (3, 6), (2, 5)), (0.1, 1.0, 5.0), (None, "balanced")
    return [Spec(f"char{a}{b}_c{c:g}_{w or 'none'}", a, b, c, w) for a, b in ranges for c in cs for w in weights]


def model_input(text: Column, spec: Spec) -> Column:
    """The text that grams are taken from: scheme-neutral and in lower case if asked for, runs of two or more blanks become one."""
    t = text_model_input(text) if spec.scheme_neutral else F.coalesce(text, F.lit(""))
    t = F.lower(t) if spec.lowercase else t
    return F.regexp_replace(t, r"(?U)\s\s+", " ")


#: Counters a task holds before it passes them on, and texts worked on at once.
_HELD, _RECORDS = 2_000_000, 4096


def gram_counts(df: DataFrame, text: str, spec: Spec) -> DataFrame:
    """``(ngram, df, tf_total)`` of all character n-grams of the model inputs, case kept: in how many records they occur, and how often. Short texts give what fits.

    A record's grams are counted in its task; what is shuffled are the tasks' counters, a row for each different gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {n: Counters(_HELD) for n in range(spec.min_n, spec.max_n + 1)}

        def out(n: int) -> Iterator[pa.RecordBatch]:
            k, tf, records, *letters = counters[n].passed_on()
            for s in range(0, len(k), 100_000):
                e = slice(s, s + 100_000)
                whole = letters[0][e].tobytes().decode("utf-32-le", "surrogatepass")
                yield pa.RecordBatch.from_arrays([pa.array([whole[i : i + n] for i in range(0, len(whole), n)], pa.string()), pa.array(records[e]), pa.array(tf[e])], ["ngram", "df", "tf"])

        for batch in batches:
            texts = batch.column("t").to_pylist()
            for s in range(0, len(texts), _RECORDS):
                for n, c in counters.items():
                    h, record, at, points = _gram_hashes(texts[s : s + _RECORDS], n)
                    if len(h):
                        c.add(h, record, np.lib.stride_tricks.sliding_window_view(points, n)[at])
                    if c.full():
                        yield from out(n)
        for n in counters:
            yield from out(n)

    rows = widened(df.select(F.col(text).alias("t"))).select(model_input(F.col("t"), spec).alias("t"))
    return rows.mapInArrow(run, "ngram string, df long, tf long").groupBy("ngram").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf_total"))


def most_frequent(per: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of ``per`` with the largest ``tf_total``, ties by gram. The frequency at which to cut is found from counts per frequency, first of ranges, then
    of the values in one range; only rows at that frequency are ranked."""
    return _most_frequent(materialize(per), most)


def _most_frequent(per: DataFrame, most: int) -> DataFrame:
    """``most_frequent`` of a table that is read again and again."""
    bucket = F.floor(F.log2("tf_total") * 64).cast("int")
    left, cut = most, None
    for r in sorted(per.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.b):
        if r.n > left:
            cut = r.b
            break
        left -= r.n
    if cut is None:
        return per
    for r in sorted(per.where(bucket == cut).groupBy("tf_total").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r.tf_total):
        if r.n > left:
            tied = per.where(F.col("tf_total") == r.tf_total).orderBy("ngram").limit(left)
            return per.where(F.col("tf_total") > r.tf_total).unionByName(tied)
        left -= r.n
    return per


def vocabulary(df: DataFrame, text: str, spec: Spec) -> DataFrame:
    """``(ngram, df, tf_total, idf)``: grams in at least ``min_df`` records, the ``max_features`` most frequent of them, ties by gram."""
    rows = df.count()
    top = most_frequent(gram_counts(df, text, spec).where(F.col("df") >= spec.min_df), spec.max_features)
    return top.withColumn("idf", F.log((1.0 + rows) / (1.0 + F.col("df"))) + 1.0)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(64-bit hash, record, place, code points)`` of all windows of ``n`` code points that lie within one text; the places are in all code points in a row."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    count = len(points) - n + 1
    if count < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), points
    wide = points.astype(np.uint64)
    h = np.full(count, n, np.uint64)
    for k in range(n):
        h = _scrambled(h ^ (wide[k : k + count] + np.uint64(1)))
    record = np.repeat(np.arange(len(texts)), lengths)[:count]
    at = np.flatnonzero(np.arange(count) + n <= np.cumsum(lengths)[record])
    return h[at], record[at], at, points


class Table:
    """A vocabulary as arrays: per n the sorted hashes of its grams with their index, and the idf by index."""

    def __init__(self, rows: pa.Table, spec: Spec) -> None:
        """``rows`` with ngram, idf and i, i counting from 0."""
        self.spec = spec
        i, grams = rows.column("i").to_numpy(), rows.column("ngram").to_pylist()
        self.idf = np.zeros(len(i))
        self.idf[i] = rows.column("idf").to_numpy()
        length = np.fromiter(map(len, grams), np.int64, len(grams))
        self.lookup = {}
        for n in np.unique(length).tolist():
            same = np.flatnonzero(length == n)
            h = _gram_hashes([grams[k] for k in same], n)[0]
            order = np.argsort(h)
            self.lookup[n] = h[order], i[same][order]

    def arrays(self) -> tuple:
        return self.lookup, self.idf, self.spec.sublinear


def _weigh(texts: list[str], table: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(record, index, weight)`` of unit length per record, sorted by record and index."""
    lookup, idf, sublinear = table
    keys = []
    for n, (hashes, index) in lookup.items():
        h, record, _, _ = _gram_hashes(texts, n)
        at = np.searchsorted(hashes, h).clip(max=len(hashes) - 1)
        hit = hashes[at] == h
        keys.append(record[hit] * len(idf) + index[at[hit]])
    key, tf = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
    record, i = key // max(len(idf), 1), key % max(len(idf), 1)
    w = (1 + np.log(tf) if sublinear else tf.astype(float)) * idf[i]
    norm = np.sqrt(np.bincount(record, w * w, minlength=len(texts)))
    return record, i, w / norm[record]


def _mapped(df: DataFrame, ident: str, text: str, vocab: DataFrame, spec: Spec, schema, make) -> DataFrame:
    """One pass over ``df`` in Arrow batches: ``make(ids, texts, table)`` gives a record batch, ``ids`` being the values of the column ``ident``. The vocabulary, bounded by
    ``max_features``, is broadcast as arrays; nothing is shuffled."""
    index = vocab if "i" in vocab.columns else numbered(vocab)
    shared = df.sparkSession.sparkContext.broadcast(Table(index.select("ngram", "idf", "i").toArrow(), spec).arrays())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, _RECORDS):
                part = batch.slice(s, _RECORDS)
                yield make(part.column("id"), part.column("t").to_pylist(), shared.value)

    rows = widened(df.select(F.col(ident).alias("id"), F.col(text).alias("t"))).select("id", model_input(F.col("t"), spec).alias("t"))
    return rows.mapInArrow(run, schema)


def numbered(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``i`` from 0 in order of grams; it is bounded by ``max_features``, so one task may number it."""
    from pyspark.sql import Window

    return vocab.withColumn("i", F.row_number().over(Window.orderBy("ngram")) - 1)


def weights(df: DataFrame, ident: str, text: str, vocab: DataFrame, spec: Spec) -> DataFrame:
    """``(id, i, weight)`` of every record's grams in the vocabulary (which has ``i``), of unit length per record."""

    def make(ids: pa.Array, texts: list[str], table: tuple) -> pa.RecordBatch:
        record, i, w = _weigh(texts, table)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(record)), pa.array(i), pa.array(w)], ["id", "i", "weight"])

    kind = df.schema[ident].dataType.simpleString()
    return _mapped(df, ident, text, vocab, spec, f"id {kind}, i long, weight double", make)


class Model:
    """A fitted vocabulary and linear scorer; tables only, kept in the shared folder."""

    def __init__(self, spec: Spec, vocab: DataFrame, coefficients: DataFrame, intercept: float) -> None:
        self.spec, self.vocab, self.coefficients, self.intercept = spec, vocab, coefficients, intercept

    def score(self, df: DataFrame, ident: str, text: str) -> DataFrame:
        """``(id, score)``: probability of phishing. Rows without a known gram get that of the intercept. One pass without a shuffle."""
        index = materialize(numbered(self.vocab).join(F.broadcast(self.coefficients), "ngram"))
        both = index.select("i", "coefficient").toArrow()
        coefficients = np.zeros(both.num_rows)
        coefficients[both.column("i").to_numpy()] = both.column("coefficient").to_numpy()
        shared, intercept = df.sparkSession.sparkContext.broadcast(coefficients), self.intercept

        def make(ids: pa.Array, texts: list[str], table: tuple) -> pa.RecordBatch:
            record, i, w = _weigh(texts, table)
            m = np.bincount(record, w * shared.value[i], minlength=len(texts)) + intercept
            return pa.RecordBatch.from_arrays([ids, pa.array(1 / (1 + np.exp(-m)))], ["id", "score"])

        kind = df.schema[ident].dataType.simpleString()
        return _mapped(df, ident, text, index, self.spec, f"id {kind}, score double", make)

    def top_ngrams(self, n: int = 50) -> DataFrame:
        """``(direction, rank_no, ngram, coefficient)``: the ``n`` largest and the ``n`` smallest coefficients, ties by gram."""
        if n < 1:
            raise ValueError("top_n must be positive")
        out = None
        for name, order in (("phishing", F.desc("coefficient")), ("legitimate", F.asc("coefficient"))):
            top = self.coefficients.orderBy(order, "ngram").limit(n).agg(F.collect_list(F.struct("ngram", "coefficient")).alias("x"))
            part = top.select(F.lit(name).alias("direction"), F.posexplode("x").alias("i", "x"))
            part = part.select("direction", (F.col("i") + 1).alias("rank_no"), F.col("x.ngram").alias("ngram"), F.col("x.coefficient").alias("coefficient"))
            out = part if out is None else out.unionByName(part)
        return out

    def settled(self, df: DataFrame, ident: str, text: str, target: str, *, within: float = 1e-3) -> DataFrame:
        """One row: rows, features, and whether the gradient of the objective (see ``fit``, without class weights) over ``df`` has at most the part ``within`` of the norm it has where all coefficients are zero."""
        index = materialize(numbered(self.vocab).join(self.coefficients, "ngram"))
        rows = df.select(F.col(ident).alias("id"), F.col(text).alias("t"), F.col(target).cast("double").alias("y"))
        w = materialize(weights(rows, "id", "t", index.select("ngram", "idf", "i"), self.spec).join(index.select("i", "coefficient"), "i"))
        margin = w.groupBy("id").agg(F.sum(F.col("weight") * F.col("coefficient")).alias("m"))
        p = 1 / (1 + F.exp(-(F.coalesce("m", F.lit(0.0)) + self.intercept)))
        off = materialize(rows.select("id", "y").join(margin, "id", "left").select("id", (self.spec.c * (p - F.col("y"))).alias("r"), (self.spec.c * (0.5 - F.col("y"))).alias("r0")))
        per = w.join(off, "id").groupBy("i").agg(F.max("coefficient").alias("c"), F.sum(F.col("weight") * F.col("r")).alias("g"), F.sum(F.col("weight") * F.col("r0")).alias("g0"))
        square = lambda c: F.pow(c, F.lit(2))
        norms = per.agg(F.count(F.lit(1)).alias("n_features"), F.sum(square(F.col("c") + F.col("g"))).alias("a"), F.sum(square(F.col("g0"))).alias("a0"))
        bias = off.agg(F.count(F.lit(1)).alias("n_rows"), square(F.sum("r") + self.intercept).alias("b"), square(F.sum("r0")).alias("b0"))
        return norms.crossJoin(bias).select("n_rows", "n_features", (F.sqrt(F.col("a") + F.col("b")) <= within * F.sqrt(F.col("a0") + F.col("b0"))).alias("settled"))

    def save(self, path: str) -> None:
        import json

        self.vocab.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")
        meta = json.dumps({"spec": self.spec.to_dict(), "intercept": self.intercept})
        self.vocab.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark, path: str) -> Model:
        import json

        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        return Model(Spec(**meta["spec"]), spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/coefficients"), meta["intercept"])


def vectors(df: DataFrame, target: str, text: str, vocab: DataFrame, spec: Spec, size: int) -> DataFrame:
    """``(label, features)``: the label and the sparse vector of ``size`` weights and a constant one in the last place, of every row."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    def make(labels: pa.Array, texts: list[str], table: tuple) -> pa.RecordBatch:
        record, i, w = _weigh(texts, table)
        n = len(texts)
        at = np.append(np.searchsorted(record, np.arange(n)), len(record))[1:]  # the constant follows each record's weights
        offsets = pa.array(np.append(0, at + np.arange(1, n + 1)), pa.int32())
        indices = pa.ListArray.from_arrays(offsets, pa.array(np.insert(i, at, size), pa.int32()))
        values = pa.ListArray.from_arrays(offsets, pa.array(np.insert(w, at, 1.0)))
        kind, width = pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size + 1, np.int32))
        vector = pa.StructArray.from_arrays([kind, width, indices, values], ["type", "size", "indices", "values"])
        return pa.RecordBatch.from_arrays([labels, vector], ["label", "features"])

    schema = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    return _mapped(df.withColumn(target, F.col(target).cast("double")), target, text, vocab, spec, schema, make)


def fit(df: DataFrame, text: str, target: str, spec: Spec) -> Model:
    """Fit on all rows. The objective is half the squared norm (intercept included) plus C times the weighted log loss.

    An all-zero row gives the constant column a variance, without which the solver would fix its coefficient at zero; it adds nothing to the gradient.
    A fit that has not settled after ``max_iter`` steps raises a warning.
    """
    vec, index, size = _vectorised(df, text, target, spec)
    return _fit(vec, spec, index, size)


def _vectorised(df: DataFrame, text: str, target: str, spec: Spec) -> tuple[DataFrame, DataFrame, int]:
    index = materialize(numbered(vocabulary(df, text, spec)))
    size = index.count()
    if not size:
        raise ValueError("no gram occurs in enough records")
    return materialize(vectors(df, target, text, index, spec, size)), index, size


#: The solver stops when the gradient's norm is this part of the mean loss.
TOLERANCE = 1e-5


def _fit(vec: DataFrame, spec: Spec, index: DataFrame, size: int) -> Model:
    import warnings

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector

    n0, n1 = vec.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    if not n0 or not n1:
        raise ValueError("both classes are needed")
    w0, w1 = ((n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)) if spec.class_weight == "balanced" else (1.0, 1.0)
    rows = vec.select("features", "label", F.when(F.col("label") == 1, w1).otherwise(w0).alias("w"))
    dummy = vec.sparkSession.createDataFrame([(SparseVector(size + 1, {}), 0.0, 1.0)], rows.schema)
    total = n0 * w0 + n1 * w1 + 1.0
    lr = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="w", fitIntercept=False, standardization=False, regParam=1.0 / (spec.c * total), elasticNetParam=0.0, family="binomial", maxIter=spec.max_iter, tol=TOLERANCE
    )
    fitted = lr.fit(rows.union(dummy))
    if fitted.summary.totalIterations >= spec.max_iter:
        warnings.warn(f"{spec.name} has not settled after {spec.max_iter} steps", RuntimeWarning, stacklevel=2)
    coefficients = fitted.coefficients.toArray()
    values = vec.sparkSession.createDataFrame(pa.table({"i": pa.array(np.arange(size), pa.int32()), "coefficient": pa.array(coefficients[:size])}))
    return Model(spec, index.drop("i"), materialize(index.select("ngram", "i").join(values, "i").select("ngram", "coefficient")), float(coefficients[size]))


def search(train: DataFrame, validation: DataFrame, ident: str, text: str, target: str, specs: list[Spec], *, max_fpr: float = 0.0163, costs: Costs | None = None) -> list[dict]:
    """A result per candidate, best first: average precision, recall at ``max_fpr``, ROC AUC, calibration error. The lists are as long as ``specs``.

    All candidates are fitted side by side (``lockstep``), to the objective of ``fit``; so the seconds of a fit run from the common start, and those of vectorising and scoring are of all.
    With an alphabet too large for grams to be integers they are fitted one after the other.
    """
    by_key: dict[tuple, list[Spec]] = {}
    for s in specs:
        by_key.setdefault(s.vectorizer_key, []).append(s)
    specs = [s for same in by_key.values() for s in same]
    began = time.perf_counter()
    c = lockstep.Candidates(specs, lambda s: (s.scheme_neutral, s.lowercase), lambda s: lambda t: model_input(t, s))
    texts = c.columns(train, text, target)
    letters = lockstep.alphabet(texts.drop("y"), c.least, c.top)
    if not letters.records:
        return _ranked(_searched_singly(train, validation, ident, text, target, by_key, max_fpr, costs))
    rows, n0, n1 = train.agg(F.count(F.lit(1)), F.count_if(F.col(target) == 0), F.count_if(F.col(target) == 1)).first()
    if n0 + n1 < rows:
        raise ValueError("targets must be 0 or 1")
    counts = materialize(lockstep.counted(texts.drop("y"), letters, c.ranges, c.least))
    found = c.vocabularies(counts, rows, _most_frequent)
    discard(counts)
    shared = train.sparkSession.sparkContext.broadcast([f.arrays() for f in found])
    blocks = materialize(c.blocks(texts, letters, shared), large_rows=True)
    took = time.perf_counter() - began
    began, seconds = time.perf_counter(), {}
    fits = lockstep.fitted(c, blocks, shared, found, (n0, n1), TOLERANCE, lambda i: seconds.setdefault(i, time.perf_counter() - began))
    discard(blocks)
    began = time.perf_counter()
    scored = materialize(c.scored(validation, text, target, letters, shared, fits))
    scoring = time.perf_counter() - began
    at_half = {r.model: r.asDict() for r in evaluate(scored, costs=costs, by=("model",)).collect()}
    matched = {r.model: r.asDict() for r in at_max_fpr(threshold_table(scored, costs=costs, by=("model",)), max_fpr, by=("model",)).collect()}
    discard(scored)
    shared.destroy()
    out = []
    for i, s in enumerate(specs):
        half = {k: v for k, v in at_half[i].items() if k != "model"}
        out.append(_result(s, half, matched[i], took, seconds[i], scoring, len(fits[i]) - 1))
    return _ranked(out)


def _result(spec: Spec, at_half: dict, matched: dict, vectorize: float, fit: float, score: float, n_features: int) -> dict:
    at_fpr = {f"matched_{k}": matched[k] for k in ("threshold", "recall", "precision", "false_positive_rate")}
    return spec.to_dict() | at_half | at_fpr | {"vectorize_seconds": vectorize, "fit_seconds": fit, "score_seconds": score, "n_features": n_features}


def _ranked(results: list[dict]) -> list[dict]:
    return sorted(results, key=lambda r: (-r["average_precision"], -r["matched_recall"], -r["roc_auc"], r["expected_calibration_error"]))


def _searched_singly(train: DataFrame, validation: DataFrame, ident: str, text: str, target: str, by_key: dict[tuple, list[Spec]], max_fpr: float, costs: Costs | None) -> list[dict]:
    """A result per candidate, each fitted for itself. Candidates with one vectoriser share its tables."""
    out = []
    labels = validation.select(F.col(ident).alias("id"), F.col(target).alias("target"))
    for same in by_key.values():
        began = time.perf_counter()
        vec, index, size = _vectorised(train, text, target, same[0])
        took = time.perf_counter() - began
        for s in same:
            began = time.perf_counter()
            model = _fit(vec, s, index, size)
            fitted = time.perf_counter() - began
            began = time.perf_counter()
            scored = materialize(model.score(validation, ident, text).join(labels, "id"))
            seconds = time.perf_counter() - began
            at_half = evaluate(scored, costs=costs).first().asDict()
            matched = at_max_fpr(threshold_table(scored, costs=costs), max_fpr).first().asDict()
            out.append(_result(s, at_half, matched, took, fitted, seconds, size))
            discard(scored)
        discard(vec)
    return out


def select(results: list[dict]) -> tuple[dict, dict | None]:
    """The best scheme-neutral candidate if there is one, else the best; and the best of the others, kept for comparison."""
    neutral = [r for r in results if r["scheme_neutral"]]
    raw = [r for r in results if not r["scheme_neutral"]]
    return (neutral or results)[0], (raw[0] if raw else None)


def spec_of(row: dict) -> Spec:
    return Spec(**{k: row[k] for k in Spec.__dataclass_fields__})


def limited(specs: list[Spec], max_features: int | None) -> list[Spec]:
    return specs if max_features is None else [replace(s, max_features=max_features) for s in specs]
