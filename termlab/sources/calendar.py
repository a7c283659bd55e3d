"""Expiry calendar: one text line per contract month, such as ``18 January 2006``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_expiry_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(exp_year, exp_month, expiry), the last line of a month winning.

    The result has one row per calendar month, which bounds it (1,200 rows a
    century) and makes it safe to broadcast.  An unreadable line fails the job.
    """
    text = F.trim("value")
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("line"), text.alias("text")
    )
    dates = lines.filter("text <> ''").select("line", F.to_date("text", "d MMMM yyyy").alias("expiry"))
    return (
        dates.groupBy(F.year("expiry").alias("exp_year"), F.month("expiry").alias("exp_month"))
        .agg(F.max_by("expiry", "line").alias("expiry"))
    )
