"""The search over candidates: all fitted side by side, with the results of single fits."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from sievework.operators import lockstep, textmodel

SPECS = [
    textmodel.Spec("a", 2, 3, 1.0, min_df=2, max_features=300),
    textmodel.Spec("b", 2, 3, 0.3, "balanced", min_df=2, max_features=300),
    textmodel.Spec("c", 2, 3, 2.0, min_df=2, max_features=300),
    textmodel.Spec("d", 1, 4, 1.0, min_df=3, max_features=500, scheme_neutral=True, sublinear=False),
    textmodel.Spec("e", 1, 4, 1.0, min_df=3, max_features=500, lowercase=True),
]


def _rows(spark, n, seed, letters="abcAB/.é  \U0001f600"):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = rng.random() < 0.4
        text = rng.choice(["http://", "https://www.", "", " HTTPS://"]) + "".join(rng.choice(letters) for _ in range(rng.randrange(0, 25))) + ("log" if rng.random() < (0.7 if y else 0.2) else "")
        rows.append((i, None if i == 3 else text, int(y)))
    return spark.createDataFrame(rows, "id long, u string, target int")


def _jobs(spark, group, specs, train, validation):
    spark.sparkContext.setJobGroup(group, group)
    out = textmodel.search(train, validation, "id", "u", "target", specs)
    spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def _singly(train, validation, specs):
    by_key = {}
    for s in specs:
        by_key.setdefault(s.vectorizer_key, []).append(s)
    return textmodel._ranked(textmodel._searched_singly(train, validation, "id", "u", "target", by_key, 0.0163, None))


def test_candidates_share_their_passes(spark):
    """Three fits take the passes of the longest, not of all; each result is that of a fit of its own."""
    train, validation = _rows(spark, 400, 1).cache(), _rows(spark, 150, 2).cache()
    one, _ = _jobs(spark, "one", SPECS[:1], train, validation)
    three, _ = _jobs(spark, "three", SPECS[:3], train, validation)
    assert three < 1.8 * one
    _, got = _jobs(spark, "all", SPECS, train, validation)
    want = {r["name"]: r for r in _singly(train, validation, SPECS)}
    assert {r["name"] for r in got} == set(want)
    for r in got:
        w = want[r["name"]]
        assert r["n_features"] == w["n_features"] and r["n_samples"] == w["n_samples"] == 150
        for k in ("average_precision", "roc_auc", "brier_score", "expected_calibration_error"):
            assert r[k] == pytest.approx(w[k], abs=2e-3)


def test_grams_as_integers():
    """Keys stand for the grams within one text, in the order of texts; code points that have no place break a text."""
    texts = ["abca", "", "a", "zab ", "bbbb", "\U0001f600ab"]
    letters = lockstep.Alphabet(np.array(sorted(map(ord, "abc \U0001f600"))), 3, 4)
    name = {i + 1: chr(p) for i, p in enumerate(letters.points.tolist())}
    seen = {}
    for n, keys, pairs, record, times in lockstep._grams(texts, letters.table(), 3, 4, 1, 4):
        spelled = ["".join(name[k >> 3 * (3 - j) & 7] for j in range(n)) for k in keys.tolist()]
        assert spelled == sorted(spelled)
        for gram, r, t in zip(np.repeat(spelled, pairs).tolist(), record.tolist(), times.tolist()):
            seen[gram, r] = t
    want = Counter((t[i : i + n], r) for r, t in enumerate(texts) for n in range(1, 5) for i in range(len(t) - n + 1) if "z" not in t[i : i + n])
    assert seen == want


def test_counts_of_grams(spark):
    df = _rows(spark, 500, 3)
    c = lockstep.Candidates(SPECS, lambda s: (s.scheme_neutral, s.lowercase), lambda s: lambda t: textmodel.model_input(t, s))
    texts = c.columns(df, "u", "target").drop("y")
    letters = lockstep.alphabet(texts, 2, c.top)
    got = {(r.kind, r.n, r.ngram): (r.df, r.tf_total) for r in lockstep.counted(texts, letters, c.ranges, 2).collect()}
    place = {chr(p): i + 1 for i, p in enumerate(letters.points.tolist())}
    want = {}
    for kind, (lo, hi) in enumerate(c.ranges):
        tf, seen = Counter(), Counter()
        for r in texts.collect():
            t = r[f"t{kind}"] or ""
            own = Counter(t[i : i + n] for n in range(lo, hi + 1) for i in range(len(t) - n + 1))
            tf.update(own)
            seen.update(own.keys())
        for g, k in seen.items():
            if k >= 2:
                want[kind, len(g), sum(place[x] << letters.bits * (c.top - 1 - j) for j, x in enumerate(g))] = k, tf[g]
    assert got == want


def test_large_alphabets_are_searched_too(spark):
    """Where a gram fits no integer, the candidates are fitted singly."""
    letters = "".join(map(chr, itertools.chain(range(97, 123), range(0x4E00, 0x4E00 + 40_000, 20))))
    specs = [textmodel.Spec("wide", 1, 6, min_df=1, max_features=400)]
    train, validation = _rows(spark, 200, 4, letters), _rows(spark, 60, 5, letters)
    assert [r["name"] for r in textmodel.search(train, validation, "id", "u", "target", specs)] == ["wide"]


def test_solver_settles_at_the_minimum():
    rng = np.random.default_rng(0)
    x, y = np.hstack([rng.normal(size=(300, 8)) * 10.0 ** np.arange(-3, 5) / 100, np.ones((300, 1))]), rng.integers(0, 2, 300)

    def answer(w):
        m = x @ w
        p = 1 / (1 + np.exp(-m))
        return float(lockstep._loss(m, y).sum()), x.T @ (p - y), (x**2).T @ (p * (1 - p))

    run = lockstep.solver(9, 1e-8, 500)
    point, _ = next(run)
    while True:
        try:
            point, _ = run.send(answer(point))
        except StopIteration as end:
            w, settled = end.value
            break
    assert settled and np.linalg.norm(answer(w)[1] + w) <= 1e-3 * np.linalg.norm(answer(np.zeros(9))[1])


def test_rows_of_megabytes_come_in_small_row_groups(spark):
    """What a reader holds at once is a row group; its size is looked at before the hundredth row too."""
    import os

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from sievework.operators.shared import discard, materialize

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _ in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([os.urandom(3 << 20)], pa.binary())], ["block"])

    rows = materialize(spark.range(0, 24, 1, 1).mapInArrow(run, "block binary"), large_rows=True)
    metas = [pq.read_metadata(f.removeprefix("file:").replace("//", "")) for f in rows.inputFiles()]
    groups = [m.row_group(k) for m in metas for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24 == rows.where(F.length("block") == 3 << 20).count()
    assert max(g.total_byte_size for g in groups) <= 7 << 20
    discard(rows)


def test_blocks_reach_tasks_past_the_jvm(spark, monkeypatch):
    """From a mounted folder each block is read by one task, by itself; the sums are those of blocks that Spark reads, and come in slices."""
    from sievework.operators.shared import discard, materialize

    monkeypatch.setattr(lockstep, "_BLOCK", 32)
    monkeypatch.setattr(lockstep, "_SLICE", 100)
    df = _rows(spark, 700, 6).repartition(3)
    c = lockstep.Candidates(SPECS, lambda s: (s.scheme_neutral, s.lowercase), lambda s: lambda t: textmodel.model_input(t, s))
    texts = c.columns(df, "u", "target")
    letters = lockstep.alphabet(texts.drop("y"), c.least, c.top)
    found = c.vocabularies(materialize(lockstep.counted(texts.drop("y"), letters, c.ranges, c.least)), 700, textmodel._most_frequent)
    shared = spark.sparkContext.broadcast([f.arrays() for f in found])
    blocks = materialize(c.blocks(texts, letters, shared), large_rows=True)
    own, by_spark = lockstep.Stored(blocks), lockstep.Stored(blocks)
    by_spark.groups = None
    assert not any(f.endswith(".parquet") for f in own.source().inputFiles()) and by_spark.source().inputFiles()
    rng = np.random.default_rng(1)
    asked = {}
    for i, s in enumerate(SPECS):
        asked[i] = rng.normal(size=len(found[c.kind[c.of[i]]].members[c.of[i]]) + 1), i % 2 == 0, (s.c, 2 * s.c)
    a, b = (c.evaluated(x, shared, asked) for x in (own, by_spark))
    for i in asked:
        assert a[i][0] == pytest.approx(b[i][0]) and np.allclose(a[i][1], b[i][1]) and len(a[i][1]) == len(asked[i][0])
        assert (a[i][2] is None) == (b[i][2] is None) == (i % 2 == 1)
        assert a[i][2] is None or np.allclose(a[i][2], b[i][2], rtol=1e-4)
    discard(blocks)


def test_sums_of_several_models_at_once():
    """Margins and sums over columns of all widths are those of the dense matrix, for each model by its own grams and weights."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("aaab c"), rng.integers(0, 30))) for _ in range(150)]
    points = np.array(sorted(map(ord, "abc ")))
    grams = Counter((n, t[i : i + n]) for t in texts for n in range(1, 4) for i in range(len(t) - n + 1))
    key = lambda g: sum((int(np.searchsorted(points, ord(x))) + 1) << 3 * (2 - j) for j, x in enumerate(g))
    vectorisers = {0: (1, 3, True), 1: (2, 3, False), 2: (1, 1, True)}
    tops = {}
    for v, (lo, hi, _) in vectorisers.items():
        own = [(n, key(g), c) for (n, g), c in grams.items() if lo <= n <= hi and (v or rng.random() < 0.8)]
        tops[v] = lockstep.pa.table(dict(zip(("n", "ngram", "df"), map(np.array, zip(*own)))))
    f = lockstep.features(tops, 150)
    stored, norms = lockstep._columns(texts, lockstep.Alphabet(points, 3, 3).table(), (3, 3), f, 1, 3, vectorisers)
    levels = {n: lockstep.Level(x, 150) for n, x in stored.items()}
    index = {int(k): f.starts[n] + i for n, keys in f.keys.items() for i, k in enumerate(keys)}
    tf = np.zeros((150, f.size))
    for r, t in enumerate(texts):
        for n in range(1, 4):
            for i in range(len(t) - n + 1):
                if key(t[i : i + n]) in index:
                    tf[r, index[key(t[i : i + n])]] += 1
    models = [0, 1, 2, 0]
    members, x = [f.members[v] for v in models], [rng.normal(size=len(f.members[v]) + 1) for v in models]
    side = lockstep.Side(f, [vectorisers[v] for v in models], members, x)
    times = {v: np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) if how else tf for v, (_, _, how) in vectorisers.items()}
    weight = {v: times[v][:, f.members[v]] * f.idf[f.members[v]] for v in vectorisers}
    for v, w in weight.items():
        assert np.allclose(norms[v], np.where((w != 0).any(axis=1), np.linalg.norm(w, axis=1), 1))
    norm = np.stack([norms[v] for v in models], axis=1)
    m = side.margins(levels, norm)
    assert np.allclose(m, np.stack([weight[v] @ c[:-1] / norms[v] + c[-1] for v, c in zip(models, x)], axis=1))
    for asked, power in ((range(4), 1), ([1, 3], 2), ([2], 1)):
        total = side.zeros([*asked])
        side.add(total, levels, m[:, [*asked]], [*asked], power)
        for j in asked:
            assert np.allclose(side.of(total, j, [*asked]), (times[models[j]] ** power).T[members[j]] @ m[:, j])
