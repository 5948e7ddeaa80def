"""Intermediate results that outlive an executor, and small helpers shared by operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group before compression.
_ROW_GROUP, _LARGE_ROW = 16 << 20, 1 << 20
_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent (tests, one machine) it is a temporary folder of this machine, but only under a
    ``local[...]`` master: on a cluster it would be unreadable elsewhere.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sievework-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return "file://" + _own[0]


def materialize(df: DataFrame, *, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and no executor owns a part.

    Row groups are small, so that what few tasks wrote is read by many. With ``large_rows`` their size is looked at from row to row, otherwise from the hundredth on:
    a row of a MB or more is a row group of its own, in a format that is read fast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sievework-{uuid.uuid4().hex}"
    checks = {f"parquet.{x}.size.row.check.min": 1 for x in ("block", "page")} if large_rows else {}
    df.write.options(**checks).option("compression", "lz4_raw" if large_rows else "zstd").option("parquet.block.size", _LARGE_ROW if large_rows else _ROW_GROUP).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind ``frames`` that ``materialize`` returned; nothing may be read from them any more."""
    for df in frames:
        path = getattr(df, "written_to", None)
        if path:
            _delete(df.sparkSession, path)
            _written.remove((df.sparkSession, path))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass


def discard_materialized() -> None:
    """Delete all that ``materialize`` wrote and nothing deleted yet; for when no result is read any more. Runs by itself when the driver ends."""
    while _written:
        _delete(*_written.pop())


atexit.register(discard_materialized)


def distinct_counts(df: DataFrame, *columns: str) -> list[DataFrame]:
    """``(n_<column>)``, one row for each column: how many different texts, not null, it has. One aggregate a column, so that no row is
    multiplied, on 160 bits of SHA-256, so that no text is shuffled."""
    name = lambda c: F.substring(F.unhex(F.sha2(F.col(c).cast("binary"), 256)), 1, 20).alias("h")
    return [df.where(F.col(c).isNotNull()).select(name(c)).distinct().agg(F.count(F.lit(1)).alias(f"n_{c}")) for c in columns]


def widened(df: DataFrame) -> DataFrame:
    """``df`` with at least as many partitions as there are cores, for work that costs far more than moving its rows.

    A small table in one file is one task otherwise. Tables with enough partitions, as any large one, are left alone.
    Meant for scans: the number of partitions behind a shuffle is known only by running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.isStreaming or df.rdd.getNumPartitions() >= cores else df.repartition(cores)
