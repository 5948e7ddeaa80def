"""Reading raw labelled URL tables, and writing results as Parquet, CSV, JSON and Markdown."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.prepare import find_column, validate_raw


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def require(spark: SparkSession, path: str, stage: str) -> str:
    """``path``, or FileNotFoundError that names the stage which makes it."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; run the stage {stage!r} first")
    return path


def read_csv(spark: SparkSession, path: str, url: str = "url", label: str = "label") -> DataFrame:
    """A CSV with header, its URL and label columns found whatever their case and given these names; types are inferred."""
    df = spark.read.option("header", True).option("inferSchema", True).option("mode", "FAILFAST").csv(path)
    return df.withColumnRenamed(find_column(df, url), url).withColumnRenamed(find_column(df, label), label)


def concat_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """The columns of two tables side by side, rows meeting by ``row_id``; both must have the same rows and no other column in common."""
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {row_id.lower()}
    if shared:
        raise ValueError(f"columns in both tables: {sorted(shared)}")
    return left.join(right, row_id)


def read_raw(spark: SparkSession, local_csv: str | None, parquet: str | None, url: str = "url", label: str = "label") -> DataFrame:
    """The raw table: the CSV if it is there, else the Parquet table. Nothing is fetched over a network."""
    if local_csv and exists(spark, local_csv):
        return read_csv(spark, local_csv, url, label)
    if parquet and exists(spark, parquet):
        return spark.read.parquet(parquet)
    raise RuntimeError(f"neither {local_csv} nor {parquet} is there; put the table in one of these places")


def ingest(spark: SparkSession, local_csv: str | None, parquet: str | None, out: str, url: str = "url", label: str = "label") -> dict:
    """Read, validate and store the raw table; its metadata is returned and stored beside it."""
    df = read_raw(spark, local_csv, parquet, url, label)
    validate_raw(df, url, label)
    df.write.mode("overwrite").parquet(out)
    kept = spark.read.parquet(out)
    meta = {"rows": kept.count(), "columns": kept.columns, "labels": {str(r[0]): r[1] for r in kept.groupBy(label).count().collect()}}
    write_json(spark, meta, out.rstrip("/") + "_metadata.json")
    return meta


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """A folder of CSV part files with headers; ``single`` asks for one file and is meant for small reports."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def json_safe(value):
    """``value`` with everything JSON cannot hold turned into dicts, lists, numbers or text."""
    if isinstance(value, float) and value != value:
        return None
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    if isinstance(value, Mapping):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [json_safe(v) for v in value]
    for method in ("to_dict", "asDict", "tolist"):
        if hasattr(value, method):
            return json_safe(getattr(value, method)())
    return str(value)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    p, fs = _path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_json(spark: SparkSession, value, path: str) -> None:
    write_text(spark, json.dumps(json_safe(value), indent=2, ensure_ascii=False) + "\n", path)


def prior_fpr(spark: SparkSession, path: str, default: float = 0.0163) -> tuple[float, dict | None]:
    """The false-positive rate of the balanced profile of an earlier rule evaluation, or ``default`` without one."""
    if not exists(spark, path):
        return default, None
    payload = json.loads(read_text(spark, path))
    try:
        return float(payload["profiles"]["balanced"]["false_positive_rate"]), payload
    except (KeyError, TypeError, ValueError):
        return default, payload


def markdown_table(df: DataFrame, limit: int = 100) -> str:
    """The first rows of a small result as a Markdown table; ``_No rows._`` without any. It is a report, not a data sink."""
    rows = df.limit(limit).collect()
    if not rows:
        return "_No rows._"
    show = lambda v: ("" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(show, df.columns)) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def unicode_escaped(text: str) -> str:
    return text.encode("unicode_escape").decode("ascii")


def percentage(value: float) -> str:
    return f"{value * 100:.2f}%"


def ensure_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.mkdirs(p)
