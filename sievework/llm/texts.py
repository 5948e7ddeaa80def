"""Column expressions and exact-copy classes shared by the operators on texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import materialize
from ..operators.skew import spread_join

#: What stripping removes: Unicode white space and the four ASCII separators.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]+"


def model_text(col: Column) -> Column:
    """The text stripped, without a leading ``http://`` or ``https://`` and then a leading ``www.`` (any case)."""
    bare = F.regexp_replace(col, f"^{_BLANK}|{_BLANK}$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^(?i:https?://)", ""), r"^(?i:www\.)", "")


def digest(text: Column) -> Column:
    """160 bits of SHA-256, by which exact copies meet: no two different texts with one digest can be made."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 20)


def fold_copies(df: DataFrame, ident: str, text: Column, *carry: Column, facts: dict[str, Column] | None = None) -> DataFrame:
    """Every row with the class of its exact copies: ``rep`` (least ``ident`` of the class), ``n`` (rows of the class),
    ``ident``, ``text`` (only where ``ident`` is ``rep``, else null), the columns ``carry`` and the aggregates ``facts``
    of the class (over carried columns); written to the shared folder.

    Texts meet by their ``digest``. The count is combined on the map side and the join back spreads large
    classes, so a text that stands in a third of all rows makes no heavy task. Rows with a null text or ident are left out.
    """
    rows = df.select(F.col(ident).alias("ident"), text.alias("text"), *carry).where("ident is not null and text is not null")
    rows = rows.withColumn("h", digest(F.col("text")))
    facts = facts or {}
    firsts = rows.groupBy("h").agg(F.min("ident").alias("rep"), F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in facts.items()))
    firsts = firsts.withColumn("w", F.col("n"))
    joined = spread_join(rows, firsts, "h", weight="w", total=df.count())
    kept = [c for c in rows.columns if c not in ("ident", "text", "h")]
    return materialize(joined.select("rep", "n", "ident", F.when(F.col("ident") == F.col("rep"), F.col("text")).alias("text"), *kept, *facts))


#: Bits of the map of idents that are looked for: 512 KB to broadcast, however many there are.
MAP_BITS = 22


def named(df: DataFrame, ident: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` (``ident`` and ``text``) that may have an ident in ``wanted``, told by a bit map of fixed size, so that the texts of
    others are not shuffled for a join with it. Chance companions pass; the more idents are wanted, the more."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS)).alias("s")
    bits = np.zeros(1 << MAP_BITS, bool)
    bits[wanted.select(slot(ident)).distinct().toArrow().column("s").to_numpy()] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(marks[batch.column("s").to_numpy()])).select([ident, "text"])

    kind = df.schema[ident].dataType.simpleString()
    return df.select(ident, "text", slot(ident)).mapInArrow(run, f"{ident} {kind}, text string")


#: Members of a class that one task pairs with all it meets; larger classes are dealt into blocks.
BLOCK = 5_000


def dealt(members: DataFrame) -> DataFrame:
    """``members`` (``rep``, ``n``, ``ident``, ...) with ``blocks`` of their class and the ``block`` each belongs to."""
    x = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    return x.withColumn("block", F.pmod(F.xxhash64("ident"), F.col("blocks")))


def every_block(df: DataFrame) -> DataFrame:
    """``df`` once for each of its ``blocks``, with ``block``; a null ``blocks`` counts as one."""
    return df.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)).cast("long") - 1)))


def meet(links: DataFrame, side: str, members: DataFrame, name: str, *, singles: bool = False) -> DataFrame:
    """``links`` with the class in ``side`` replaced by each of its ``members`` (dealt), as ``name``.

    A class of many members meets its links in as many tasks as it has blocks. With ``singles``, a class without
    members listed stands for itself.
    """
    sizes = members.select(F.col("rep").alias(side), "blocks").distinct()
    spread = every_block(links.join(sizes, side, "left" if singles else "inner"))
    to = members.select(F.col("rep").alias(side), "block", F.col("ident").alias(name))
    out = spread.join(to, [side, "block"], "left" if singles else "inner")
    if singles:
        out = out.where(F.col("blocks").isNull() | F.col(name).isNotNull()).withColumn(name, F.coalesce(name, side))
    return out.drop("blocks", "block", side)


def pairs_within(members: DataFrame) -> DataFrame:
    """``(x, y)``, x < y, of the different idents of every class in ``members`` (``rep``, ``n``, ``ident``), block by block."""
    repeated = dealt(members.where("n > 1").select("rep", "n", "ident"))
    left = repeated.select("rep", "block", F.col("ident").alias("x"))
    right = every_block(repeated.select("rep", "blocks", F.col("ident").alias("y"))).drop("blocks")
    return left.join(right, ["rep", "block"]).where("x < y").select("x", "y")


def expand_pairs(pairs: DataFrame, members: DataFrame, a: str, b: str) -> DataFrame:
    """All pairs of rows ``(a, b)``, smaller ident first, behind ``pairs`` ``(a, b)`` of classes and inside each class.

    Written out in full, as a report of cases needs it; the classes themselves are the compact form.
    """
    repeated = dealt(members.where("n > 1").select("rep", "n", "ident"))
    inside = pairs_within(members)
    across = meet(meet(pairs.select(F.col("a").alias("p"), F.col("b").alias("q")), "p", repeated, "x", singles=True), "q", repeated, "y", singles=True)
    across = across.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return inside.union(across).select(F.col("x").alias(a), F.col("y").alias(b))
