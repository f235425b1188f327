"""Scan lines over a stream of rays: sessions that end when time jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_sessions(rays: DataFrame, time: str, strip: str, gap: str, late: str) -> DataFrame:
    """Per strip the sessions of rays less than ``gap`` apart (start, end, count); rows later than ``late`` are dropped by the watermark."""
    return rays.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), strip).agg(F.count("*").alias("n")).select(strip, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
