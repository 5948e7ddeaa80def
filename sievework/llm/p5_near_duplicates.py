"""Problem 5: records that share most of their text, whatever the size of the collection.

An inverted index of byte positions whose lists are tallied per pair assumes that equal texts keep their bytes in
place; an inserted character or a moved parameter shifts all later ones, so no number of equal positional bytes is
guaranteed at a given set similarity. The index here therefore holds substrings (grams) with the position they take
in one global order, rarest first. There a minimum is guaranteed: two sets of sizes m and n whose Jaccard similarity
is t share at least ceil(t / (1 + t) * (m + n)) grams, hence one of the first m - ceil(t m) + 1 of either. Only these
are indexed. Positions bound how many matches can still follow; a parity word bounds how many grams are not shared;
pairs that cannot reach the minimum are dropped where the lists are joined, the others are verified on their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.shared import materialize, widened
from ..session import table
from . import postings
from .grams import RECORDS, mix, runs, similar, windows
from .texts import expand_pairs, fold_copies, model_text

#: log2 of the number of counters for gram frequencies; it bounds what is broadcast (1 MB) and does not grow with the data.
COUNTER_BITS = 18
#: Occurrences beyond which a gram is indexed in pairs, and set size up to which it is; both steer the index, not what is found.
FREQUENT, LONG = 20_000, 200
WORDS = 3
_SKETCH = [f"s{k}" for k in range(WORDS)]
_DTYPE = np.dtype([("t", "<u8"), ("id", "<i8"), ("size", "<u4"), ("rank", "<u2"), *((s, "<u4") for s in _SKETCH)])


def gram_frequencies(texts: DataFrame, q: int) -> np.ndarray:
    """Occurrences per counter of all grams of ``texts.text``; a counter is a range of gram hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            text = batch.column("text").to_pylist()
            for s in range(0, len(text), RECORDS):
                g, _ = windows(text[s : s + RECORDS], q)
                total += np.bincount((g >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["c", "n"])

    sums = texts.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNTER_BITS, np.int64)
    out[sums.column("c").to_numpy()] = sums.column("n").to_numpy()
    return out


def ordered_sets(text: list[str], q: int, level: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first record, token, record)`` per slice of texts: distinct grams of each record, rarest first.

    A token has the level of its gram's frequency in its upper 16 and the gram's hash in its next 35 bits.
    """
    for s in range(0, len(text), RECORDS):
        g, r = windows(text[s : s + RECORDS], q)
        c = (g >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
        token = (level[c] << np.uint64(35)) | (mix(g) >> np.uint64(29))
        both = np.sort((r.astype(np.uint64) << np.uint64(51)) | token)
        both = both[runs(both)]
        yield s, both & np.uint64((1 << 51) - 1), (both >> np.uint64(51)).astype(np.int64)


def paired(token: np.ndarray, record: np.ndarray, rank: np.ndarray, last: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(key, which)``: for each of the tokens numbered ``hot`` a key with every token that follows it in its record before rank ``last[record]``;
    ``which`` is the number of the latter. A record's only token has a key of its own."""
    n = np.maximum(last[record[hot]] - rank[hot] - 1, 0)
    first = np.repeat(hot, n)
    after = first + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    alone = hot[n == 0]
    key = mix(token[first]) ^ (mix(token[after]) >> np.uint64(1))
    return np.concatenate([key, mix(token[alone]) ^ np.uint64(1)]), np.concatenate([after, alone])


def near_pairs(classes: DataFrame, q: int, threshold: float) -> DataFrame:
    """``(a, b)``, a < b, of all ``classes`` (``rep``, ``text``) whose sets of ``q``-grams have at least that similarity.

    A gram that occurs more than ``FREQUENT`` times is no token by itself: sets that share none rarer share two grams at least of the first m - ceil(t m) + 2, so it is
    indexed together with each that follows. Lists thus stay short where all grams are frequent, as in a very large collection. Sets of more than
    ``LONG`` grams, of which all pairs would be many, keep the single gram, and so do, besides, those that can be similar to such a set.
    """
    rows = classes.count()
    frequency = gram_frequencies(classes, q)
    level = np.minimum(65535, np.log2(1 + frequency) * 2048).astype(np.uint64)
    shared = classes.sparkSession.sparkContext.broadcast((level, int(np.log2(1 + FREQUENT) * 2048)))

    def make(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        ids, text = batch.column("rep").to_numpy(), batch.column("text").to_pylist()
        level, frequent = shared.value
        for s, token, record in ordered_sets(text, q, level):
            here = min(RECORDS, len(text) - s)
            size = np.bincount(record, minlength=here)
            sketch = postings.parity(mix(token), record, here, WORDS)
            rank = np.arange(len(token)) - (np.cumsum(size) - size)[record]
            prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            inside = rank < prefix[record]
            hot = inside & ((token >> np.uint64(35)) > frequent)
            single = np.flatnonzero(inside & (~hot | (size[record] > threshold * LONG)))
            key, after = paired(token, record, rank, np.minimum(prefix + 1, size), np.flatnonzero(hot & (size[record] <= LONG)))
            which = np.concatenate([single, after])
            r = record[which]
            out = np.zeros(len(r), _DTYPE)
            out["t"], out["id"], out["size"] = np.concatenate([token[single], key]), ids[s : s + here][r], size[r]
            # In a pair of grams the second has the rank of the first that may still be followed by others.
            out["rank"] = np.minimum(np.maximum(np.concatenate([rank[single], rank[after] - 1]), 0), 65535)
            for k, f in enumerate(_SKETCH):
                out[f] = sketch[r, k]
            yield out

    def keep(p: postings.Pairs) -> None:
        m, n = p.get("size")
        x, y = p.get("rank")
        need = postings.least_overlap(m.astype(np.int64) + n, threshold)
        p.narrow(np.minimum(m - x, n - y) >= need)  # as many can match if this is the first gram they share
        m, n = p.get("size")
        both = m.astype(np.int64) + n
        postings.within(p, both - 2 * postings.least_overlap(both, threshold), _SKETCH)

    lists = postings.build(widened(classes.select("rep", "text")), make, postings.parts(rows * 16))
    found = postings.join(lists, _DTYPE, keep, threshold)
    return verified(materialize(found), classes, q, threshold)


def verified(pairs: DataFrame, classes: DataFrame, q: int, threshold: float) -> DataFrame:
    """The ``pairs`` (a, b) whose texts have at least that similarity, exactly."""
    text = classes.select("rep", "text")

    @F.pandas_udf("boolean")
    def passes(x, y):
        import pandas as pd

        return pd.Series(similar(x.tolist(), y.tolist(), q, threshold))

    left = pairs.join(text.select(F.col("rep").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(text.select(F.col("rep").alias("b"), F.col("text").alias("y")), "b")
    return both.where(passes("x", "y")).select("a", "b")


def near_duplicates(df: DataFrame, ident: str, text: str, *, q: int = 4, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``: pairs (a, b) of exact-copy classes with Jaccard similarity ``threshold`` or more of their
    sets of ``q``-character substrings (lower-cased model text), and the class (``rep``) of every row (``ident``).

    Rows with a null text or ident are left out. Texts shorter than ``q`` match only their copies. Repeated rows are
    copies. An empty table gives empty results. Texts are taken whole.
    """
    members = fold_copies(df, ident, F.lower(model_text(F.col(text))))
    return near_pairs(members.where("text is not null"), q, threshold), members


def near_duplicate_groups(df: DataFrame, ident: str, text: str, **how) -> DataFrame:
    """``(ident, group_id, n_links)`` of every row with a text: connected records share a group, named by its least
    ident; ``n_links`` counts the different texts the row's own text is linked to."""
    pairs, members = near_duplicates(df, ident, text, **how)
    pairs = materialize(pairs)
    links = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    group = components(pairs, "a", "b").select(F.col("node").alias("rep"), "component")
    facts = group.join(links, "rep")
    return members.join(facts, "rep", "left").select(
        F.col("ident").alias(ident), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = near_duplicates(table(spark, sf_dir, "prepared_urls"), "url_id", "url_model_input")
    return expand_pairs(pairs, members, "url_id_a", "url_id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "prepared_urls"), "url_id", "url_model_input")


#: CTEs ending in ``near``: the same pairs by prefix filtering in SQL.
NEAR_SQL = r"""
texts as (select url_id, lower(regexp_replace(regexp_replace(regexp_replace(url_model_input, '^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$', '', 'g'), '^(?i:https?://)', ''), '^(?i:www\.)', '')) as t from prepared_urls where url_model_input is not null),
grams as (select distinct url_id, substr(t, i, 4) as g from (select url_id, t, unnest(generate_series(1, length(t) - 3)) as i from texts)),
seen as (select g, count(*) as df from grams group by 1),
ranked as (select url_id, g, row_number() over (partition by url_id order by df, g) as rk, count(*) over (partition by url_id) as n from grams join seen using (g)),
prefix as (select * from ranked where rk <= n - ceil(0.7 * n - 1e-9) + 1),
candidates as (select distinct x.url_id as a, y.url_id as b from prefix x join prefix y on x.g = y.g and x.url_id < y.url_id where least(x.n, y.n) >= 0.7 * greatest(x.n, y.n) - 1e-9),
sets as (select url_id, list(g) as s from grams group by 1),
measured as (select a, b, len(list_intersect(x.s, y.s)) as common, len(x.s) + len(y.s) as sizes from candidates join sets x on x.url_id = a join sets y on y.url_id = b),
near as (select a, b from measured where 10 * common >= 7 * (sizes - common) union select x.url_id, y.url_id from texts x join texts y on x.t = y.t and x.url_id < y.url_id)
"""
ORACLE = {
    "p5_found": f"with {NEAR_SQL} select a as url_id_a, b as url_id_b from near",
    "p5_groups": f"""with recursive {NEAR_SQL}, classes as (select url_id, min(url_id) over (partition by t) as rep from texts),
links as (select distinct x.rep as u, y.rep as v from (select a, b from near union all select b, a from near) join classes x on x.url_id = a join classes y on y.url_id = b where x.rep <> y.rep),
reach as (select distinct rep as u, rep as v from classes union select r.u, l.v from reach r join links l on l.u = r.v),
groups as (select u as rep, min(v) as group_id from reach group by 1), counts as (select u as rep, count(*) as n_links from links group by 1)
select url_id, group_id, coalesce(n_links, 0) as n_links from classes join groups using (rep) left join counts using (rep)""",
}
