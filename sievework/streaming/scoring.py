"""Scoring URLs as they arrive, with the column expressions of the batch jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.jobs import rule_scored


def scored_stream(stream: DataFrame, url: str = "url", suffixes: Sequence[str] | None = None) -> DataFrame:
    """``stream`` with features and rule score; stateless, so late or repeated rows need no care."""
    return rule_scored(stream, url, suffixes)


def counts_by_hour(stream: DataFrame, time_column: str, *, late: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Scored URLs and alerts per window of event time; rows later than ``late`` are dropped with the closed windows."""
    scored = scored_stream(stream).withWatermark(time_column, late)
    return scored.groupBy(F.window(time_column, window)).agg(F.count(F.lit(1)).alias("n_urls"), F.count_if(F.col("score") >= 0.35).alias("n_alerts"))
