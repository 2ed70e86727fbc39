"""Triage of a run log with columns ``timestamp`` and ``message``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import log_severity, zoneless


def recent(log: DataFrame, asof: datetime, minutes: int = 15) -> DataFrame:
    """Lines of the last ``minutes`` before ``asof``, the window's first instant included."""
    start = F.timestamp_add("MINUTE", F.lit(-minutes), zoneless(asof))
    return log.where(F.col("timestamp") >= start)


def with_severity(log: DataFrame) -> DataFrame:
    return log.withColumn("severity", log_severity(F.col("message")))


def containing(log: DataFrame, pattern: str) -> DataFrame:
    """Lines that contain a word, e.g. ``ERROR``, ``Athena`` or ``bucket``."""
    return log.where(F.col("message").contains(pattern))


def error_count(log: DataFrame) -> DataFrame:
    return containing(log, "ERROR").agg(F.count(F.lit(1)).alias("error_count"))
