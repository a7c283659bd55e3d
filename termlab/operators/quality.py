"""One-pass data-quality counts.  Rows that other operators drop are counted here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.schema import DAY, SYMBOL, TENORS, px
from termlab.sources.bars import symbol_from_path


def bar_quality(bars: DataFrame, keys: Sequence[str] = (), root: str = "VI") -> DataFrame:
    """Counts over parsed bars: unreadable times and days, no symbol, no close.

    A bar of a file without any symbol has one if the file's name does.  Bars are counted by file first, where each
    task reduces its own.
    """
    by_file = bars.groupBy(*dict.fromkeys([*keys, "file_path"])).agg(
        F.count("*").alias("n_bars"),
        F.count_if(F.col("timestamp").isNull()).alias("n_bad_time"),
        F.count_if(F.col(DAY).isNull()).alias("n_bad_day"),
        F.count_if(F.col(SYMBOL).isNull()).alias("_without"),
        F.count_if(F.col("close").isNull()).alias("n_no_close"),
        F.count_if(F.col("close") <= 0).alias("n_nonpositive_close"),
    )
    named = symbol_from_path(F.col("file_path"), root).isNotNull() & (F.col("_without") == F.col("n_bars"))
    by_file = by_file.withColumn("n_no_symbol", F.when(named, 0).otherwise(F.col("_without")))
    counts = ("n_bars", "n_bad_time", "n_bad_day", "n_no_symbol", "n_no_close", "n_nonpositive_close")
    return by_file.groupBy(*keys).agg(*[F.sum(c).cast("bigint").alias(c) for c in counts])


def term_quality(term: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over the term structure: expired rows, rows with no maturity or close."""
    return term.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("ttm_days").isNull()).alias("n_no_maturity"),
        F.count_if(F.col("ttm_days") <= 0).alias("n_expired"),
        F.count_if(F.col("close").isNull()).alias("n_no_close"),
    )


def price_quality(
    prices: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """Days, and per tenor the NULL prices and the prices no log return can use."""
    counts = [F.count("*").alias("n_days")]
    for c in px(tenors):
        counts.append(F.expr(f"count_if({c} IS NULL) AS null_{c}"))
        counts.append(F.expr(f"count_if({c} <= 0) AS nonpositive_{c}"))
    return prices.groupBy(*keys).agg(*counts)


def leg_quality(positions: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over positions before those without a return are dropped.

    Legs that stay, positions with a missing or non-positive close or next close, positions
    without a return for that or any other reason, and positions held after expiry.
    """
    good = (F.col("close") > 0) & (F.col("close_next") > 0)
    return positions.groupBy(*keys).agg(
        F.count("r_next").alias("n_legs"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("n_bad_rows"),
        F.count_if(F.col("r_next").isNull()).alias("n_no_return"),
        F.count_if(F.col(DAY) > F.col("expiry")).alias("n_after_expiry"),
    )


def legs_per_day(legs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest, median and largest number of legs on one day."""
    daily = legs.groupBy(*keys, DAY).agg(F.count("*").alias("n"))
    return daily.groupBy(*keys).agg(
        F.min("n").alias("min_legs"), F.median("n").alias("median_legs"), F.max("n").alias("max_legs")
    )


def empty_buckets(bucketed: DataFrame, bucket: str, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """How many of ``n`` quantile buckets equal breakpoints left empty."""
    return bucketed.groupBy(*keys).agg((F.lit(n) - F.count_distinct(bucket)).alias("n_empty"))
