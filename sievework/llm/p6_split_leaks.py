"""Problem 6: validation and test records that train holds too, exactly or almost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import materialize, widened
from ..operators.skew import heavy_keys
from ..session import table
from . import postings
from .grams import RECORDS, mix, runs, windows
from .p5_near_duplicates import NEAR_SQL, verified
from .texts import BLOCK, dealt, every_block, fold_copies, meet, model_text

#: Minwise hashes per band, and bands: a pair at similarity 0.7 shares no band with probability 5.7e-6, one at 0.8 with 1e-10.
BAND_ROWS, BANDS = 4, 44
WORDS = 2
_SKETCH = [f"s{k}" for k in range(WORDS)]
_DTYPE = np.dtype([("t", "<u8"), ("id", "<i8"), ("size", "<u4"), ("side", "u1"), *((s, "<u4") for s in _SKETCH)])
TRAIN, OTHER = 1, 2


def band_postings(batch: pa.RecordBatch, q: int, bands: int, rows: int) -> Iterator[np.ndarray]:
    """A posting per band of every record: token (band and its minwise hashes, 40 bits), record, set size, sides, parity words."""
    rng = np.random.default_rng(7)
    factors, shifts = rng.integers(0, 1 << 32, (2, bands * rows), dtype=np.uint32)
    factors |= np.uint32(1)
    ids, text, side = batch.column("rep").to_numpy(), batch.column("text").to_pylist(), batch.column("side").to_numpy()
    for s in range(0, len(text), RECORDS):
        here = min(RECORDS, len(text) - s)
        g, r = windows(text[s : s + here], q)
        both = np.sort((r.astype(np.uint64) << np.uint64(51)) | (g >> np.uint64(13)))
        both = both[runs(both)]
        record, gram = (both >> np.uint64(51)).astype(np.int64), mix(both & np.uint64((1 << 51) - 1))
        starts = runs(record)
        if not len(starts):
            continue
        owner = record[starts]
        size = np.diff(np.append(starts, len(record)))
        sketch = postings.parity(gram, record, here, WORDS)
        short = (gram >> np.uint64(32)).astype(np.uint32)
        for band in range(bands):
            token = np.full(len(owner), band, np.uint64)
            for k in range(band * rows, band * rows + rows):
                token = mix(token ^ np.minimum.reduceat((short ^ shifts[k]) * factors[k], starts).astype(np.uint64))
            out = np.zeros(len(owner), _DTYPE)
            out["t"], out["id"], out["size"], out["side"] = token >> np.uint64(24), ids[s : s + here][owner], size, side[s : s + here][owner]
            for k, f in enumerate(_SKETCH):
                out[f] = sketch[owner, k]
            yield out


def cross_split_pairs(classes: DataFrame, q: int, threshold: float) -> DataFrame:
    """``(a, b)`` of different ``classes`` (``rep``, ``text``, ``side``), similar and with a train record facing another's."""
    rows = classes.count()
    slim = widened(classes.select("rep", "text", "side"))

    def make(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return band_postings(batch, q, BANDS, BAND_ROWS)

    def keep(p: postings.Pairs) -> None:
        x, y = p.get("side")
        p.narrow((x | y) == TRAIN | OTHER)  # one has a train record, one another
        m, n = p.get("size")
        both = m.astype(np.int64) + n
        postings.within(p, both - 2 * postings.least_overlap(both, threshold), _SKETCH)

    lists = postings.build(slim, make, postings.parts(rows * BANDS))
    found = postings.join(lists, _DTYPE, keep, threshold)
    return verified(materialize(found), classes, q, threshold)


def split_leaks(df: DataFrame, ident: str, key: str, text: str, split: str, *, train: str = "train", q: int = 4, threshold: float = 0.7) -> DataFrame:
    """``(train_id, other_id, exact)``: every record outside ``train`` with each record of train that has the same ``key``
    (``exact``) or a text of at least that similarity. Near cases come from minwise bands and are verified exactly.

    A null split is no train. Rows with a null ident are left out; a null key or text matches nothing through that
    column. Pairs of records are written out in full, since each is a case; the tables before are classes of copies. An
    empty table gives no rows.
    """
    side = F.when(F.col(split).eqNullSafe(train), TRAIN).otherwise(OTHER)
    rows = df.where(F.col(ident).isNotNull())
    sides = rows.select(F.col(ident).alias("ident"), F.col(key).alias("k"), side.alias("side")).where("k is not null")
    # Heavy keys, of which there are few, are paired block by block.
    heavy = heavy_keys(sides, F.col("k")).select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    sides = sides.join(F.broadcast(heavy), "k", "left")
    t = every_block(sides.where(F.col("side") == TRAIN)).select("k", "block", F.col("ident").alias("train_id"))
    block = F.pmod(F.xxhash64("ident"), F.coalesce("blocks", F.lit(1))).alias("block")
    o = sides.where(F.col("side") == OTHER).select("k", block, F.col("ident").alias("other_id"))
    exact = t.join(o, ["k", "block"]).select("train_id", "other_id", F.lit(True).alias("exact"))

    members = fold_copies(rows, ident, F.lower(model_text(F.col(text))), side.alias("at"), facts={"side": F.bit_or("at")})
    classes = members.where("text is not null").select("rep", "text", F.col("side").cast("tinyint").alias("side"))
    pairs = materialize(cross_split_pairs(classes, q, threshold))
    both = members.where(F.col("side") == TRAIN | OTHER).select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    links = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(both)
    parts = dealt(members.select("rep", "n", "ident", "at"))
    near = meet(meet(links, "a", parts.where(F.col("at") == TRAIN), "train_id"), "b", parts.where(F.col("at") == OTHER), "other_id")
    near = near.select("train_id", "other_id", F.lit(False).alias("exact"))
    return exact.union(near).groupBy("train_id", "other_id").agg(F.max("exact").alias("exact"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = split_leaks(table(spark, sf_dir, "prepared_urls"), "url_id", "url_dedupe_key", "url_model_input", "split")
    return leaks.select(F.least("train_id", "other_id").alias("url_id_a"), F.greatest("train_id", "other_id").alias("url_id_b"))


def p6_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records outside train found in it, per split and feed: with the same key, and only almost the same."""
    urls = table(spark, sf_dir, "prepared_urls")
    leaks = split_leaks(urls, "url_id", "url_dedupe_key", "url_model_input", "split")
    per = leaks.groupBy(F.col("other_id").alias("url_id")).agg(F.max("exact").alias("exact"), F.count(F.lit(1)).alias("pairs"))
    return urls.select("url_id", "split", "feed").join(per, "url_id").groupBy("split", "feed").agg(
        F.count_if("exact").alias("exact_records"), F.count_if(~F.col("exact")).alias("near_records"), F.sum("pairs").alias("pairs")
    )


_SQL = f"""with {NEAR_SQL}, same as (select x.url_id as a, y.url_id as b from prepared_urls x join prepared_urls y on x.url_dedupe_key = y.url_dedupe_key and x.url_id < y.url_id),
met as (select a, b, max(exact) as exact from (select a, b, 1 as exact from same union all select a, b, 0 from near) group by 1, 2),
leaks as (select a, b, exact, case when coalesce(x.split, '') = 'train' then b else a end as other_id from met join prepared_urls x on x.url_id = a join prepared_urls y on y.url_id = b
  where (coalesce(x.split, '') = 'train') <> (coalesce(y.split, '') = 'train'))
"""
ORACLE = {
    "p6_found": _SQL + "select a as url_id_a, b as url_id_b from leaks",
    "p6_overlaps": _SQL + ", per as (select other_id, max(exact) as exact, count(*) as pairs from leaks group by 1) select split, feed, count(*) filter (exact = 1) as exact_records, count(*) filter (exact = 0) as near_records, cast(sum(pairs) as bigint) as pairs from per join prepared_urls on url_id = other_id group by 1, 2",
}
