"""Equity, drawdown episodes and loss concentration.  All tables are day grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlab.functions.columns import ratio, running, whole
from termlab.schema import DAY, TENORS, px


def log_equity(pnl: DataFrame, keys: Sequence[str] = (), column: str = "strategy_ret") -> DataFrame:
    """Day rows plus cum_log, equity = exp(cum_log), peak_equity and drawdown (<= 0)."""
    out = pnl.withColumn("cum_log", F.sum(column).over(running(keys)))
    out = out.withColumn("equity", F.exp("cum_log"))
    return with_drawdown(out, keys, "equity", "peak_equity")


def with_drawdown(df: DataFrame, keys: Sequence[str], equity: str, peak: str) -> DataFrame:
    out = df.withColumn(peak, F.max(equity).over(running(keys)))
    return out.withColumn("drawdown", ratio(F.col(equity), F.col(peak)) - 1.0)


def drawdown_summary(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return curve.groupBy(*keys).agg(
        F.min("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown")
    )


def worst_episode(curve: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The day rows from the last peak before the deepest drawdown to that trough.

    Adds peak_day and trough_day.  The earliest of equally deep troughs counts.
    Windows over one curve find both days, so nothing is joined back.
    """
    everything = whole(keys)
    trough = F.min(F.struct("drawdown", DAY, F.col("peak_equity").alias("top"))).over(everything)
    marked = curve.withColumn("_t", trough)
    at_peak = (F.col(DAY) <= F.col(f"_t.{DAY}")) & (F.col("equity") == F.col("_t.top"))
    marked = marked.withColumn("peak_day", F.max(F.when(at_peak, F.col(DAY))).over(everything))
    return (
        marked.withColumn("trough_day", F.col(f"_t.{DAY}"))
        .filter(F.col(DAY).between(F.col("peak_day"), F.col("trough_day")))
        .drop("_t")
    )


def episode_summary(episode: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return episode.groupBy(*keys).agg(
        F.min(DAY).alias("peak_day"),
        F.max(DAY).alias("trough_day"),
        F.min("drawdown").alias("max_dd_in_window"),
        F.count("*").alias("n_days_in_window"),
    )


def losses_by_size(
    episode: DataFrame, keys: Sequence[str] = (), column: str = "strategy_ret"
) -> DataFrame:
    """Losing days of an episode: loss_mag, its running total, share and the total loss.

    Largest loss first; equal losses in day order.
    """
    losing = episode.filter(F.col(column) < 0).withColumn("loss_mag", -F.col(column))
    order = Window.partitionBy(*keys).orderBy(F.desc("loss_mag"), DAY)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return losing.withColumns(
        {
            "cum_loss": F.sum("loss_mag").over(upto),
            "total_loss": F.sum("loss_mag").over(whole(keys)),
        }
    ).withColumn("pct_of_loss", ratio(F.col("cum_loss"), F.col("total_loss")))


def concentrated_losses(losses: DataFrame, limit: float = 0.80) -> DataFrame:
    """The largest losses that together make up at most ``limit`` of the total."""
    return losses.filter(F.col("pct_of_loss") <= limit)


def loss_concentration(losses: DataFrame, keys: Sequence[str] = (), limit: float = 0.80) -> DataFrame:
    """Days and loss within ``limit``, the total and the share.  One row per curve with a loss."""
    within = F.col("pct_of_loss") <= limit
    captured = F.coalesce(F.sum(F.when(within, F.col("loss_mag"))), F.lit(0.0))
    return losses.groupBy(*keys).agg(
        F.count_if(within).alias("n_days"),
        captured.alias("loss_captured"),
        F.max("total_loss").alias("total_loss"),
        ratio(captured, F.max("total_loss")).alias("pct_captured"),
    )


def regime_source(
    prices: DataFrame, spot: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, day, spot, slope): the spot index and the back slope of the curve."""
    names = px(tenors)
    slope = prices.select(*keys, DAY, (F.col(names[-1]) - F.col(names[0])).alias("slope"))
    return slope.join(spot.select(*keys, DAY, "spot"), [*keys, DAY], "left")


def with_regime(days: DataFrame, regime: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return days.join(regime, [*keys, DAY], "left")


def regime_stats(days: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median and range of the spot, and mean and median of the slope."""
    return days.groupBy(*keys).agg(
        F.avg("spot").alias("avg_spot"),
        F.median("spot").alias("med_spot"),
        F.min("spot").alias("min_spot"),
        F.max("spot").alias("max_spot"),
        F.avg("slope").alias("avg_slope"),
        F.median("slope").alias("med_slope"),
    )


def loss_regime(
    bad_days: DataFrame, pnl: DataFrame, regime: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """:func:`regime_stats` of the loss days and of all days, told apart by ``sample``.

    All profit days are labelled with the regime once; the loss days are a flag on
    them, so one aggregate serves both samples.
    """
    flagged = pnl.select(*keys, DAY).join(
        bad_days.select(*keys, DAY, F.lit(True).alias("_bad")), [*keys, DAY], "left"
    )
    known = regime.withColumn("_known", F.lit(True))
    joined = with_regime(flagged, known, keys)
    samples = F.explode(
        F.filter(
            F.array(
                F.when(F.col("_bad"), F.lit("loss_days")), F.when(F.col("_known"), F.lit("all_days"))
            ),
            lambda s: s.isNotNull(),
        )
    )
    return regime_stats(joined.select(*keys, samples.alias("sample"), "spot", "slope"), [*keys, "sample"])
