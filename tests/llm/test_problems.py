"""Each operator against a brute-force version on small fixtures: nulls, empty and long texts, ties, repeated rows, empty
tables, columns with clashing names, and a key that holds a third of all rows."""

import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import DATA, same_rows  # noqa: E402

from sievework.llm import (  # noqa: E402
    catalog,
    p1_formatting,
    p2_lookalikes,
    p3_terms,
    p5_near_duplicates,
    p6_split_leaks,
    p7_grouped_split,
    p8_packing,
    p9_eval_leaks,
    p10_shared_spans,
    postings,
)
from sievework.llm import texts as texts_module  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, duck, name):
    same_rows(catalog.QUERIES[name](spark, DATA), duck.sql(catalog.ORACLE[name]))


def frame(spark, texts, clash="rep n ident text h w a b component"):
    """Texts with ids, and columns that have the names operators use inside."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "url_id long, body string")
    return df.withColumns({c: F.lit(7) for c in clash.split()})


def hot(texts, share=3):
    """``texts`` with the first one copied until it holds about one in ``share`` of all."""
    return texts + [texts[0]] * (len(texts) // (share - 1))


def pairs(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


# 1


def formatting_class(u):
    bare = lambda s: "".join(c.lower() if c.isascii() else c for c in s if not c.isascii() or c.isalnum())
    head, _, rest = u.partition("?")
    return bare(head), tuple(sorted(filter(None, map(bare, rest.split("&")))))


def test_formatting_copies(spark):
    texts = hot(["http://A.b/c?x=1&y=2", "http://a.b/c?Y=2&&x=1", "HTTP://A.B/C?x=1&y=2&y=2", "É?", "é?", "", None, "?", "a" * 70_000, "A" * 70_000 + "?&-", "x?a?b", "x?ab", " x ? a b "])
    got = {r.url_id: (r.first_id, r.n_copies) for r in p1_formatting.formatting_copies(frame(spark, texts), "url_id", "body").collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        if t is not None:
            groups[formatting_class(t)].append(i)
    assert got == {i: (g[0], len(g)) for g in groups.values() for i in g}
    assert not p1_formatting.formatting_copies(frame(spark, ["x"]).limit(0), "url_id", "body").count()


# 2


def test_lookalikes(spark):
    same = ["http://café.test/a b", "http://café.test/a b", "http://саfé.test/​a　b", "http://xn--caf-dma.test/a b", "ｈttp://café.test/a b"]
    texts = [*same, same[0], "http://cafe.test/a b", "http://café.test/l", "http://café.test/1", "xn--é", "", None, "A", "А", "а", "xn--zzzzzzzz--", "é" * 20_000]
    df = frame(spark, texts, "form s t x y")
    got = pairs(p2_lookalikes.lookalike_pairs(df, "url_id", "body"))
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if texts[i] != texts[j]} | {(12, 13)}
    assert got == want
    assert not p2_lookalikes.lookalike_pairs(df.limit(0), "url_id", "body").count()
    forms = {r.body: r.f for r in p2_lookalikes.with_plain_form(df, "body", "f").select("body", "f").collect()}
    assert len(forms) == len(set(texts)) and forms["A"] == "A" and forms[""] == "" and forms[None] is None


def test_ascii_reads_only_like_itself():
    table = p2_lookalikes.rewrites({chr(c): 1 for c in range(0x80, 0x3000)})
    a = p2_lookalikes.automaton(table)
    ascii_ = "".join(map(chr, range(128)))
    assert p2_lookalikes.rewrite(ascii_, a) == ascii_
    assert len({p2_lookalikes.rewrite(c, a) for c in "aàáâãäåāăą"}) == 10
    for plain, others in p2_lookalikes.LOOKALIKES.items():
        assert {p2_lookalikes.rewrite(o, a) for o in others} == {plain}


# 3


def test_terms(spark):
    texts = ["http://aaaa", "www.aab", " HTTPS://WWW.aab ", "", None, "﻿a\U0001f600b", "x" * 5000, "aaa"]
    df = frame(spark, texts, "text ngram k o r occurrences")
    named = spark.createDataFrame([("aa",), ("aaaa",), ("zz",), ("aab",), (None,), ("",), ("aa",), ("b",)], "ngram string")
    got = {r.ngram: (r.occurrences, r.records, r.mark) for r in p3_terms.marked_terms(df, "body", named, "ngram").collect()}
    plain = ["aaaa", "aab", "aab", "", "﻿a\U0001f600b", "x" * 5000, "aaa"]
    terms = {t[i : i + 3] for t in plain for i in range(len(t) - 2)} | {"aa", "aaaa", "zz", "aab", "b"}
    for g in terms:
        occ = sum(sum(t.startswith(g, i) for i in range(len(t))) for t in plain)
        rec = sum(g in t for t in plain)
        assert got.pop(g) == (occ, rec, "rare" if rec < 3 else "common" if rec > 0.3 * len(texts) else None), g
    assert not got
    assert {r.mark for r in p3_terms.marked_terms(df.limit(0), "body", named, "ngram").collect()} == {"rare"}


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_longer_terms(spark, monkeypatch, held):
    monkeypatch.setattr(p3_terms, "_HELD", held)
    texts = ["abcdeabcde", "abcde\x00", "\ufeffab😀cd", None, "", "abcd", "x" * 3000, "abcdeabcde"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (4, 5, 7):
        plain = [t for t in texts if t]
        terms = {t[i : i + n] for t in plain for i in range(len(t) - n + 1)}
        got = {r.ngram: (r.occurrences, r.records) for r in p3_terms.ngram_counts(df, n).collect()}
        assert got == {g: (sum(sum(t.startswith(g, i) for i in range(len(t))) for t in plain), sum(g in t for t in plain)) for g in terms}


def test_terms_in_slices(spark, monkeypatch):
    """Whatever is counted at once and held, the sums are the same."""
    df = spark.createDataFrame([(t,) for t in ["abcabc", "bca", None, "abc" * 40, "xyz"] * 7], "text string")
    whole = pairs(p3_terms.ngram_counts(df, 3))
    monkeypatch.setattr(p3_terms, "_HELD", 5)
    monkeypatch.setattr(p3_terms, "_SLICE", 8)
    assert pairs(p3_terms.ngram_counts(df, 3)) == whole and ("abc", 7 * 42, 14) in whole


# 5 and 6


def url_like(n, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abcdefghij0123456789") for _ in range(k))
    texts = []
    while len(texts) < n:
        base = f"http://host.test/{word(12)}/{word(20)}?{word(6)}={word(10)}&{word(5)}={word(8)}"
        texts.append(base)
        for _ in range(rng.randrange(3)):
            t = list(base)
            for _ in range(rng.randrange(1, 6)):
                p = rng.randrange(8, len(t))
                t[p : p + rng.randrange(2)] = rng.choice(["", "Z", "q"])
            texts.append("".join(t))
    return texts[:n]


def gram_pairs(texts, t=0.7, q=4):
    plain = {i: re.sub(r"(?i)^www\.", "", re.sub(r"(?i)^https?://", "", x.strip())).lower() for i, x in enumerate(texts) if x is not None}
    sets = {i: {x[k : k + q] for k in range(len(x) - q + 1)} for i, x in plain.items()}
    out = set()
    ids = sorted(plain)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if plain[i] == plain[j] or both and 10 * both >= 7 * (len(sets[i]) + len(sets[j]) - both):
                out.add((i, j))
    return out


@pytest.fixture(scope="module")
def messy():
    return hot(url_like(150, 1)) + [None, "", "", "abc", "ABC", "www.abc", "abcd", "é" * 9, "x" * 30_000, "x" * 30_001 + "y", "  http://WWW.host.test/abcdefgh ", "host.test/abcdefgh"]


@pytest.mark.parametrize("block", [5_000, 10])
def test_near_duplicates(spark, messy, monkeypatch, block):
    monkeypatch.setattr(texts_module, "BLOCK", block)
    df = frame(spark, messy)
    want = gram_pairs(messy)
    found, members = p5_near_duplicates.near_duplicates(df, "url_id", "body")
    assert pairs(p5_near_duplicates.expand_pairs(found, members, "x", "y")) == want
    groups = {r.url_id: r.group_id for r in p5_near_duplicates.near_duplicate_groups(df, "url_id", "body").collect()}
    root = {i: i for i, t in enumerate(messy) if t is not None}
    for _ in root:
        changed = False
        for i, j in want:
            m = min(root[i], root[j])
            changed |= root[i] != m or root[j] != m
            root[i] = root[j] = m
        if not changed:
            break
    assert groups == root
    assert not p5_near_duplicates.near_duplicates(df.limit(0), "url_id", "body")[0].count()


@pytest.mark.parametrize("frequent, long, block", [(20_000, 200, 7), (3, 200, 4_000), (3, 60, 7), (0, 10**6, 4_000)])
def test_hot_lists_lose_nothing(spark, messy, monkeypatch, frequent, long, block):
    """Long lists cut into blocks, and frequent grams indexed in pairs, give the same pairs."""
    texts = messy[:110] + messy[-12:-5] + ["x" * 300, "x" * 301 + "y"] + [f"abcdefghijklmnopqrstuvwxyz0123456789{i:03d}" + "q" * (i % 12) for i in range(60)]
    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(p5_near_duplicates, "FREQUENT", frequent)
    monkeypatch.setattr(p5_near_duplicates, "LONG", long)
    found, members = p5_near_duplicates.near_duplicates(frame(spark, texts), "url_id", "body")
    assert pairs(p5_near_duplicates.expand_pairs(found, members, "x", "y")) == gram_pairs(texts)


def test_blocks_of_a_list_meet_once():
    """Postings of one list, joined whole or block by block, give the same pairs of different records, and only sizes that can meet are compared."""
    rng = np.random.default_rng(3)
    a = np.zeros(60, np.dtype([("t", "<u8"), ("id", "<i8"), ("size", "<u4")]))
    a["id"], a["size"] = rng.integers(0, 50, 60), np.sort(rng.integers(5, 40, 60))
    keep = lambda p: None
    whole = set(zip(*(c.tolist() for c in postings._met(a, np.full(60, 60), keep, 0.7))))
    assert whole == {(min(x["id"], y["id"]), max(x["id"], y["id"])) for i, x in enumerate(a) for y in a[i + 1 :] if x["id"] != y["id"] and x["size"] >= 0.7 * y["size"] - 1e-9}
    cut = set()
    for i in range(0, 60, 20):
        for j in range(i, 60, 20):
            both = a[i : i + 20] if i == j else np.concatenate([a[i : i + 20], a[j : j + 20]])
            cut |= set(zip(*(c.tolist() for c in postings._met(both, np.full(len(both), len(both)), keep, 0.7, None if i == j else 20))))
    assert cut == whole


@pytest.mark.parametrize("block", [5_000, 10])
def test_split_leaks(spark, messy, monkeypatch, block):
    monkeypatch.setattr(texts_module, "BLOCK", block)
    monkeypatch.setattr(p6_split_leaks, "BLOCK", block)
    n = len(messy)
    split = [("train", "validation", "test", None)[i * 7 % 4] for i in range(n)]
    key = [f"k{i % 40}" if i % 9 else None for i in range(n)]
    df = spark.createDataFrame([(i, messy[i], key[i], split[i]) for i in range(n)], "url_id long, body string, k2 string, split string").withColumns({c: F.lit(7) for c in "rep n side k at ident".split()})
    want = gram_pairs(messy) | {(i, j) for i in range(n) for j in range(i + 1, n) if key[i] is not None and key[i] == key[j]}
    want = {(i, j) for i, j in want if (split[i] == "train") != (split[j] == "train")}
    leaks = p6_split_leaks.split_leaks(df, "url_id", "k2", "body", "split")
    rows = leaks.collect()
    assert {(min(r.train_id, r.other_id), max(r.train_id, r.other_id)) for r in rows} == want and len(rows) == len(want)
    assert all(r.exact == (key[r.train_id] is not None and key[r.train_id] == key[r.other_id]) for r in rows)
    assert not p6_split_leaks.split_leaks(df.limit(0), "url_id", "k2", "body", "split").count()


# 7


def related(rows):
    parent: dict = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (g, d, *_) in enumerate(rows):
        ends = [("i", i)] + ([("g", g)] if g is not None else []) + ([("d", d)] if d is not None else [])
        for e in ends[1:]:
            parent[find(e)] = find(ends[0])
    return [find(("i", i)) for i in range(len(rows))]


def test_grouped_split(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(900)}" if rng.random() < 0.9 else None
        d = "hot.test" if i % 3 == 0 else f"d{rng.randrange(1200)}" if rng.random() < 0.5 and i % 5 == 1 else None
        rows.append((g, d, rng.choice([0, 1, 1, None]) if i % 50 == 0 else int(rng.random() < 0.4), rng.choice(["train", "validation", "test", None])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "url_id long, grp string, dom string, target int, split string").withColumns({"n": F.lit(1), "g": F.lit("x"), "w": F.lit(2), "mask": F.lit(1)})
    comp = related(rows)
    wide = defaultdict(set)
    for c, r in zip(comp, rows):
        if r[3] is not None:
            wide[c].add(r[3])
    want = {r[0] for c, r in zip(comp, rows) if r[0] is not None and len(wide[c]) > 1}
    assert {r.grp for r in p7_grouped_split.split_groups_apart(df, "grp", "dom", "split").collect()} == want
    out = {r.url_id: r for r in p7_grouped_split.grouped_split(df, "url_id", "grp", "dom", "target").collect()}
    assert len(out) == len(rows)
    by = defaultdict(set)
    for i, c in enumerate(comp):
        by[c].add(out[i].split)
    assert all(len(s) == 1 for s in by.values())
    assert not p7_grouped_split.grouped_split(df.limit(0), "url_id", "grp", "dom", "target").count()


def test_grouped_split_proportions(spark):
    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(2500)}", None, int(rng.random() < 0.3)) for i in range(5000)]
    out = p7_grouped_split.grouped_split(spark.createDataFrame(rows, "url_id long, grp string, dom string, target int"), "url_id", "grp", "dom", "target").collect()
    target = {i: t for i, _, _, t in rows}
    n, rate = Counter(r.split for r in out), Counter()
    for r in out:
        rate[r.split] += target[r.url_id]
    whole = sum(target.values()) / 5000
    for s, share in p7_grouped_split.SHARES.items():
        assert abs(n[s] / 5000 - share) < 0.02 and abs(rate[s] / n[s] - whole) < 0.02


# 8


def test_packing(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(0, 60) for _ in range(800)] + [100, 99, 101, 200, 201, 350] + [37] * 400 + [None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, size long").withColumns({"length": F.lit(1), "rank": F.lit(1), "piece": F.lit(0)})
    rows = p8_packing.packed(df, "doc_id", F.col("size"), capacity=100).collect()
    assert sorted((r.doc_id, r.piece) for r in rows) == sorted((i, k) for i, n in enumerate(sizes) if n for k in range(-(-n // 100)))
    boxes = defaultdict(list)
    for r in rows:
        boxes[r.container].append((r.offset, r.length))
        assert r.start == r.piece * 100 and r.start + r.length <= sizes[r.doc_id]
    for b in boxes.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 100
    assert len(boxes) <= math.ceil(sum(n or 0 for n in sizes) / 100 * 1.03)
    assert sorted(boxes) == list(range(len(boxes)))
    assert not p8_packing.packed(df.limit(0), "doc_id", F.col("size")).count()
    toks = spark.createDataFrame([("é",), ("",), (None,)], "t string").select(p8_packing.byte_tokens(F.col("t"))).collect()
    assert [r[0] for r in toks] == [3, 1, None]


def test_patterns_are_bounded_by_lengths():
    """The work depends on the different lengths, not on the items; every item is placed once and no pack is overfull."""
    assert len(p8_packing.shortest_pack_first({5000: 10**9}, 8192)) == 1
    assert p8_packing.shortest_pack_first({37: 400}, 100) == [(((37, 2),), 200)]
    rng = random.Random(8)
    for capacity in (7, 60, 1000, 1000, 8192):
        histogram = {rng.randrange(1, capacity + 1): rng.randrange(1, 10 ** rng.randrange(1, 9)) for _ in range(300)}
        patterns = p8_packing.shortest_pack_first(histogram, capacity)
        placed = Counter()
        for pattern, count in patterns:
            assert count > 0 and sum(n * times for n, times in pattern) <= capacity
            placed.update({n: times * count for n, times in pattern})
        assert placed == histogram and len(patterns) <= 2 * len(histogram) + 1


# 9


def test_eval_leaks(spark, monkeypatch):
    monkeypatch.setattr(p9_eval_leaks, "SHARD_WORDS", 300)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["Élan", "ÀB", "3x"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(8, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "same " * 30), (93, "just three words")]
    docs = []
    for i in range(120):
        w = text(rng.randrange(0, 200))
        if i % 3 == 0:
            src = items[rng.randrange(20)][1].split()
            k = rng.randrange(5, 30)
            p = rng.randrange(0, max(1, len(src) - k))
            w[rng.randrange(0, len(w) + 1) : 0] = src[p : p + k]
        docs.append((i, rng.choice([" ", "  ", "-\n", "_"]).join(w).upper() if i % 2 else ", ".join(w)))
    docs += [(500, None), (501, ""), (502, "same " * 11), (503, "same " * 5000), (3, docs[3][1])]
    docs.append((504, "x " + dict(items)[93] + " y"))
    word = re.compile(r"[^\W_]+")
    split = lambda t: [x.lower() for x in word.findall(t or "")]
    want = {}
    for d, t in docs:
        a = split(t)
        for i, p in items:
            b = split(p)
            size = min(12, len(b))
            here = {tuple(a[k : k + size]) for k in range(len(a) - size + 1)}
            hits = [k for k in range(len(b) - size + 1) if size and tuple(b[k : k + size]) in here]
            if hits:
                want[d, i] = len({k + j for k in hits for j in range(size)})
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"ident": F.lit(1), "item_id": F.lit(2)})
    got = p9_eval_leaks.leaked_passages(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, t string"), "item_id", "t").collect()
    assert {(r.doc_id, r.item_id): r.covered for r in got} == want and len(got) == len(want)
    assert all(r.longest >= min(12, r.item_words) and r.covered <= r.item_words for r in got)
    none = spark.createDataFrame([], "item_id long, t string")
    assert not p9_eval_leaks.leaked_passages(df, "doc_id", "text", none, "item_id", "t").count()
    assert not p9_eval_leaks.leaked_passages(df.limit(0), "doc_id", "text", spark.createDataFrame(items, "item_id long, t string"), "item_id", "t").count()


def test_chapter_long_items(spark):
    """An item of 10,000 words in several documents takes no array of documents times words; the blocks of a large query set give the same."""
    import tracemalloc
    from types import SimpleNamespace

    w = [f"w{i % 977}x{i % 13}" for i in range(10_000)]
    q = p9_eval_leaks.Queries([(1, " ".join(w))], 12)
    q.plan(np.bincount(q.term[q.words[0]], minlength=len(q.names)))
    number = np.tile(q.words[0], 20)
    starts = np.arange(20) * 10_000
    lists = np.searchsorted(q.wanted, q.names)
    wanted = np.isin(q.names, q.wanted)
    keys = np.sort(np.concatenate([(np.int64(lists[t]) << 32) + np.flatnonzero(q.term[number] == t) for t in np.flatnonzero(wanted)]))
    tracemalloc.start()
    doc, i, place = p9_eval_leaks.intersected(SimpleNamespace(**vars(q)), keys, starts)
    for d, p in zip(doc, place):
        p9_eval_leaks.stretches(number[d * 10_000 : d * 10_000 + 10_000], q.words[0], int(p), 12)
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()
    assert {(d, 0) for d in range(20)} <= set(zip(doc.tolist(), place.tolist()))


def test_blocks_of_queries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 5 + k) % 90}" for k in range(20))) for i in range(20)], "item_id long, t string")
    whole = pairs(p9_eval_leaks.leaked_passages(docs, "doc_id", "text", items, "item_id", "t"))
    monkeypatch.setattr(p9_eval_leaks, "QUERY_WORDS", 300)
    assert whole and pairs(p9_eval_leaks.leaked_passages(docs, "doc_id", "text", items, "item_id", "t")) == whole


# 10


def common_pairs(texts, least):
    where = defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t or "") - least + 1):
            where[t[k : k + least]].add(i)
    return {(i, j) for s in where.values() for i in s for j in s if i < j}


@pytest.mark.parametrize("slice_, block", [(400_000, 4_000), (700, 4_000), (400_000, 3)])
def test_shared_spans(spark, monkeypatch, slice_, block):
    monkeypatch.setattr(p10_shared_spans, "_SLICE", slice_)
    monkeypatch.setattr(postings, "BLOCK", block)  # also of hot blocks
    monkeypatch.setattr(postings, "hot_tokens", lambda df, make, rows, share=64, real=postings.hot_tokens: real(df, make, rows=rows, share=1))
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz \né😀") for _ in range(n))
    passages = [text(n) for n in (39, 40, 41, 80, 120)]
    texts = [text(rng.randrange(0, 300)) for _ in range(60)]
    for i in range(0, 60, 2):
        p = rng.choice(passages)
        at = rng.randrange(0, len(texts[i]) + 1)
        texts[i] = texts[i][:at] + p + texts[i][at:]
    texts += [texts[0]] * 20 + [None, "", "z" * 500, "z" * 41 + "y", "z" * 39, "z" * 39, text(40), texts[2] * 6]
    df = frame(spark, texts, "ident text rep a b n h seeds")
    found, copies = p10_shared_spans.sharing_documents(df, "url_id", "body", least=40)
    long = copies.join(df.where(F.length("body") >= 40).select(F.col("url_id").alias("ident")), "ident", "left_semi")
    got = pairs(p10_shared_spans.expand_pairs(found, long.where("n > 1"), "x", "y"))
    assert got == common_pairs(texts, 40)
    where = defaultdict(set)
    for i, t in enumerate(texts):
        for k in range(len(t or "") - 39):
            where[t[k : k + 40]].add(i)
    different = {c.ident: c.rep for c in copies.collect()}
    starts = defaultdict(set)
    for r in p10_shared_spans.shared_factors(df, "url_id", "body", least=40)[0].collect():
        assert r.length >= 40 and r.ident != r.source and texts[r.ident][r.start : r.start + r.length] == texts[r.source][r.source_start : r.source_start + r.length]
        starts[r.ident] |= set(range(r.start, r.start + r.length - 39))
    for i in set(different.values()):
        assert starts[i] == {k for k in range(len(texts[i]) - 39) if len({different[j] for j in where[texts[i][k : k + 40]]}) > 1}
    shares = {r.url_id: r for r in p10_shared_spans.shared_spans(df, "url_id", "body", least=40).collect()}
    assert set(shares) == {i for i, t in enumerate(texts) if t is not None}
    for i, r in shares.items():
        covered = [False] * len(texts[i])
        for k in range(len(texts[i]) - 39):
            if len(where[texts[i][k : k + 40]]) > 1:
                covered[k : k + 40] = [True] * 40
        assert r.shared_chars == sum(covered), i
    assert not p10_shared_spans.shared_factors(df.limit(0), "url_id", "body", least=40)[0].count()


def test_a_common_block_is_linear():
    """A passage in very many documents: factoring sends one row for each of them, and its set of documents comes once."""
    n = 100_000
    a = np.zeros(n * 3, p10_shared_spans._WINDOWS)
    a["id"], a["at"] = np.repeat(np.arange(n), 3), np.tile(np.arange(3), n) + np.repeat(np.arange(n) % 50, 3)
    a["t"], a["w"] = 5, np.tile([7, 8, 9], n)
    ident, start, length, source, there = p10_shared_spans.factored(a, 400)
    assert len(ident) == n and set(length.tolist()) == {402} and (source != ident).all() and (start == ident % 50).all()
    name, size, members = p10_shared_spans.sharing_sets(a)
    assert len(members) == n and len(set(name.tolist())) == 1 and set(size.tolist()) == {n}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_proximity_matches(spark):
    """A passage with a word changed or put in after every 11 is no exact match, but a near one; scattered stretches are neither."""
    w = [f"w{i}" for i in range(40)]
    changed = ["XX" if i % 12 == 11 else x for i, x in enumerate(w)]
    inserted = [y for i, x in enumerate(w) for y in ([x, "YY"] if i % 11 == 10 else [x])]
    far = w[:8] + ["ZZ"] * 30 + w[8:16]
    swapped = w[20:28] + w[:8]
    texts = [" ".join(["before", *x, "after"]) for x in (w, changed, inserted, far, swapped, w[:11])]
    df = spark.createDataFrame([*enumerate(texts), (6, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(w)), (2, "too short"), (3, None)], "item_id long, t string")
    exact = p9_eval_leaks.leaked_passages(df, "doc_id", "text", items, "item_id", "t").collect()
    assert [r.doc_id for r in exact] == [0]
    near = {(r.doc_id, r.item_id): (r.words, r.span, r.exact) for r in p9_eval_leaks.near_passages(df, "doc_id", "text", items, "item_id", "t").collect()}
    assert near == {(0, 1): (40, 40, True), (1, 1): (33, 35, False), (2, 1): (40, 43, False)}
    assert "p9_near" in catalog.QUERIES


@pytest.mark.parametrize("block", [5_000, 3])
def test_hot_forms(spark, monkeypatch, block):
    """Forms with many texts, and texts with many rows, come out whole."""
    monkeypatch.setattr(texts_module, "BLOCK", block)
    texts = ["ao"] * 12 + ["\u0430o"] * 9 + ["a\u043e", "\u0430\u043e", "a\u200bo", "\uff41o", "b"]
    df = spark.createDataFrame([*enumerate(texts)], "i long, u string")
    got = pairs(p2_lookalikes.lookalike_pairs(df, "i", "u"))
    n = len(texts) - 1
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if texts[i] != texts[j]}


def test_lookalikes_of_more_scripts(spark):
    """Cyrillic and Coptic r, Greek sigma, Cherokee R, Lisu B and others read like the ASCII letter; every letter has one reading."""
    texts = ["http://roRB.test/", "http://\u0433\u03c3\u13a1\ua4d0.test/", "http://\u2c85\u2c9f\ua4e3B.test/", "http://ro\u13d2\ua4d0.test/", "http://toRB.test/"]
    df = spark.createDataFrame([*enumerate(texts)], "i long, u string")
    got = {(r.a, r.b) for r in p2_lookalikes.lookalike_pairs(df, "i", "u").collect()}
    assert got == {(i, j) for i in range(4) for j in range(i + 1, 4)}
    # Accents on look-alike letters, invisible characters between letter and accent, and a hidden label before a port.
    texts = ["no\u00ebl", "no\u0451l", "no\u0435\u0308l", "noe\u200b\u0308l", "xn--caf-dma.test:80/", "caf\u00e9.test:80/", "xn--caf-dma.test:80", "no\u0435l"]
    df = spark.createDataFrame([*enumerate(texts)], "i long, u string")
    got = {(r.a, r.b) for r in p2_lookalikes.lookalike_pairs(df, "i", "u").collect()}
    assert got == {(i, j) for i in range(4) for j in range(i + 1, 4)} | {(4, 5)}
    every = [c for others in p2_lookalikes.LOOKALIKES.values() for c in others]
    assert len(every) == len(set(every))
