"""Performance tables of a sized strategy.  All inputs are day grain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.functions.columns import ratio, running, share, sharpe, whole
from termlab.functions.quantiles import adjusted_kurtosis, adjusted_skewness
from termlab.operators.drawdown import with_drawdown
from termlab.schema import DAY, TRADING_DAYS

# The states profit is attributed to.
REPORTED_STATES = ("pca_rotation_state", "pc1_var_state", "std_r_state", "spot_state")


def compounded_equity(
    strategy: DataFrame, keys: Sequence[str] = (), column: str = "sized_ret"
) -> DataFrame:
    """(keys, day, return, equity, peak, drawdown) with equity the product of 1 + return."""
    grown = F.product(F.lit(1.0) + F.col(column)).over(running(keys))
    days = strategy.select(*keys, DAY, column).withColumn("equity", grown)
    return with_drawdown(days, keys, "equity", "peak")


def annual_stats(strategy: DataFrame, keys: Sequence[str] = (), column: str = "sized_ret") -> DataFrame:
    """Mean, deviation, days and Sharpe per year, with the curve's mean annual Sharpe."""
    x = F.col(column)
    yearly = strategy.groupBy(*keys, F.year(DAY).alias("year")).agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.count(x).alias("count"),
        sharpe(F.avg(x), F.stddev_samp(x), TRADING_DAYS).alias("sharpe"),
    )
    return yearly.withColumn("mean_sharpe", F.avg("sharpe").over(whole(keys)))


def summary_wide(equity: DataFrame, keys: Sequence[str] = (), column: str = "sized_ret") -> DataFrame:
    """Performance measures of :func:`compounded_equity` rows, one row per curve."""
    x = F.col(column)
    win, loss = F.when(x > 0, x), F.when(x < 0, x)
    mean, std, downside = F.avg(x), F.stddev_samp(x), F.stddev_samp(loss)
    root = F.sqrt(F.lit(float(TRADING_DAYS)))
    return equity.groupBy(*keys).agg(
        (mean * TRADING_DAYS).alias("mean_annualized_return"),
        (std * root).alias("annualized_volatility"),
        sharpe(mean, std, TRADING_DAYS).alias("sharpe_ratio"),
        share(x > 0).alias("win_rate"),
        F.avg(win).alias("average_win"),
        F.avg(loss).alias("average_loss"),
        (share(x > 0) * 100).alias("pct_win"),
        adjusted_skewness(x).alias("skewness"),
        adjusted_kurtosis(x).alias("kurtosis"),
        F.min("drawdown").alias("max_drawdown"),
        (downside * root).alias("downside_vol_ann"),
        sharpe(mean, downside, TRADING_DAYS).alias("sortino_ratio"),
    )


def summary(equity: DataFrame, keys: Sequence[str] = (), column: str = "sized_ret") -> DataFrame:
    """:func:`summary_wide` as (keys, measure, value)."""
    wide = summary_wide(equity, keys, column)
    measures = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), measures, "measure", "value")


def scaled_against_unscaled(strategy: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Compounded equity of the plain and of the sized return, side by side."""
    days = running(keys)
    return strategy.select(
        *keys,
        DAY,
        "forward_ret",
        "sized_ret",
        F.product(F.lit(1.0) + F.col("forward_ret")).over(days).alias("equity_unscaled"),
        F.product(F.lit(1.0) + F.col("sized_ret")).over(days).alias("equity_scaled"),
    )


def annual_sharpe_comparison(strategy: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Annual Sharpe of the plain and of the sized return: one aggregate, no join."""
    columns = {"unscaled": F.col("forward_ret"), "state_scaled": F.col("sized_ret")}
    return strategy.groupBy(*keys, F.year(DAY).alias("year")).agg(
        *[sharpe(F.avg(x), F.stddev_samp(x), TRADING_DAYS).alias(n) for n, x in columns.items()]
    )


def pnl_by_state(
    strategy: DataFrame,
    keys: Sequence[str] = (),
    states: Sequence[str] = REPORTED_STATES,
    column: str = "sized_ret",
) -> DataFrame:
    """Return statistics per state of every state column, with the share of the total.

    (keys, signal, state, n_days, mean_daily, vol_daily, total_pnl, sharpe,
    pct_total_pnl); all columns are unpivoted and aggregated at once.
    """
    x = F.col(column)
    tall = strategy.unpivot([*keys, column], list(states), "signal", "state").filter(F.col("state").isNotNull())
    stats = tall.groupBy(*keys, "signal", "state").agg(
        F.count(x).alias("n_days"),
        F.avg(x).alias("mean_daily"),
        F.stddev_samp(x).alias("vol_daily"),
        F.sum(x).alias("total_pnl"),
        sharpe(F.avg(x), F.stddev_samp(x), TRADING_DAYS).alias("sharpe"),
    )
    everything = F.sum("total_pnl").over(whole([*keys, "signal"]))
    return stats.withColumn("pct_total_pnl", ratio(F.col("total_pnl"), everything))
