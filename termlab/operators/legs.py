"""Contract weights, next-day returns, legs and their profit and loss."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlab.functions.columns import dot, log_ratio, ratio, share
from termlab.functions.joins import salted_join
from termlab.functions.quantiles import nearest_quantile, nearest_quantiles
from termlab.schema import DAY, SYMBOL, TENORS, hedges, weights

# Periods per year of each horizon, and the anchor of two-week windows.
HORIZONS = {"1d": 252, "1w": 52, "2w": 26, "1mo": 12}
FORTNIGHT_ANCHOR = datetime.date(1970, 1, 5)


def _exposure(tenors: Sequence[int]) -> Column:
    """Hedge mapped through the tenor weights of a row."""
    return dot(hedges(tenors), weights(tenors)).alias("w_contract")


def contract_weights(
    weighted: DataFrame,
    hedge: DataFrame,
    tenors: Sequence[int] = TENORS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Contract rows plus ``w_contract``, the hedge mapped through the tenor weights.

    ``hedge`` has one row per (keys, day); days without one are dropped.  All
    contracts of a day meet that row, so the join is salted by symbol.
    """
    day = hedge.select(*keys, DAY, *hedges(tenors)).dropna(subset=hedges(tenors))
    rest = [c for c in weighted.columns if not c.startswith("weight_")]
    joined = salted_join(weighted, day, [*keys, DAY], F.col(SYMBOL))
    return joined.select(*rest, _exposure(tenors)).dropna(subset=["w_contract"])


def _next(column: str, keys: Sequence[str]) -> Column:
    return F.lead(column).over(Window.partitionBy(*keys, SYMBOL).orderBy(DAY))


def next_returns(term: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The next *observed* close of each contract and the log return to it.

    (keys, day, symbol, close, close_next, r_next, nextDay); the last row of a
    contract has no next one and is dropped.
    """
    out = term.select(
        *keys, DAY, SYMBOL, "close", _next("close", keys).alias("close_next"), _next(DAY, keys).alias("nextDay")
    ).dropna(subset=["close_next"])
    return out.select(
        *keys, DAY, SYMBOL, "close", "close_next",
        log_ratio(F.col("close_next"), F.col("close")).alias("r_next"), "nextDay",
    )


LEG_COLUMNS = (
    DAY, SYMBOL, "expiry", "ttm_days", "close", "close_next", "nextDay", "w_contract", "r_next", "pnl_leg",
)


def legs(contracts: DataFrame, following: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positions with a non-zero weight joined to their next-day return, those without one dropped."""
    held = contracts.filter(F.col("w_contract") != 0)
    joined = held.join(following.drop("close"), [*keys, DAY, SYMBOL])
    profit = joined.withColumn("pnl_leg", F.col("w_contract") * F.col("r_next"))
    return with_return(profit).select(*keys, *LEG_COLUMNS)


def with_return(positions: DataFrame) -> DataFrame:
    """Drop positions whose close or next close has no logarithm.

    Their profit is unknown, not 0; :func:`termlab.operators.quality.leg_quality` counts
    them on the positions.
    """
    return positions.filter(F.col("r_next").isNotNull())


def legs_in_one_pass(
    weighted: DataFrame, hedge: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """:func:`legs` of contract weights and next returns of the same table, no self-join."""
    return with_return(positions_in_one_pass(weighted, hedge, tenors, keys))


def positions_in_one_pass(
    weighted: DataFrame, hedge: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """All positions with a next close, those without a return (``r_next`` NULL) included.

    The next close is looked up on the contract rows, which are shuffled once by
    contract.  Only contracts with some tenor weight, two per tenor and day at most,
    then meet the day's hedge.
    """
    looked_up = weighted.withColumn("close_next", _next("close", keys)).withColumn("nextDay", _next(DAY, keys))
    used = " OR ".join(f"{w} <> 0" for w in weights(tenors))
    candidates = looked_up.filter(f"close_next IS NOT NULL AND ({used})")
    day = hedge.select(*keys, DAY, *hedges(tenors))
    return (
        candidates.join(day, [*keys, DAY])
        .select(*[c for c in looked_up.columns if not c.startswith("weight_")], _exposure(tenors))
        .filter(F.col("w_contract") != 0)
        .withColumn("r_next", log_ratio(F.col("close_next"), F.col("close")))
        .withColumn("pnl_leg", F.col("w_contract") * F.col("r_next"))
        .select(*keys, *LEG_COLUMNS)
    )


def return_quantiles(leg_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Exact 99.9th percentile and maximum of the absolute leg return."""
    sized = leg_rows.withColumn("_abs", F.abs("r_next"))
    return nearest_quantiles(sized, "_abs", {"p999": 0.999, "max": 1.0}, keys)


def leg_days(leg_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-section and profit of each day in one aggregate over the legs.

    (keys, day, n_legs, mean_r, std_r, min_r, max_r, max_abs_r, strategy_ret)
    """
    r = F.col("r_next")
    return leg_rows.groupBy(*keys, DAY).agg(
        F.count("*").alias("n_legs"),
        F.avg(r).alias("mean_r"),
        F.stddev_samp(r).alias("std_r"),
        F.min(r).alias("min_r"),
        F.max(r).alias("max_r"),
        F.max(F.abs(r)).alias("max_abs_r"),
        F.sum("pnl_leg").alias("strategy_ret"),
    )


def daily_cross_section(leg_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Leg count and spread of next-day returns per day."""
    return leg_days(leg_rows, keys).drop("strategy_ret")


def cross_section_quantiles(daily_xs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return daily_xs.groupBy(*keys).agg(
        nearest_quantile(F.col("std_r"), 0.99).alias("std_r_p99"),
        nearest_quantile(F.col("max_abs_r"), 0.99).alias("max_abs_r_p99"),
        F.max("max_abs_r").alias("max_abs_r_max"),
    )


def shock_days(daily_xs: DataFrame, max_move: float = 0.5, max_spread: float = 0.2) -> DataFrame:
    """Days with a single move or a spread of moves above the thresholds."""
    return daily_xs.filter((F.col("max_abs_r") > max_move) | (F.col("std_r") > max_spread))


def symbol_extremes(following: DataFrame, keys: Sequence[str] = (), top: int | None = 10) -> DataFrame:
    """Contracts by their largest absolute return; ``top`` of them, or all if None."""
    stats = following.groupBy(*keys, SYMBOL).agg(
        F.count("*").alias("n"), F.max(F.abs("r_next")).alias("max_abs_r")
    )
    if top is None:
        return stats
    return stats.orderBy(F.desc("max_abs_r"), *keys, SYMBOL).limit(top)


def exposure(leg_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Gross and net contract weight per day."""
    return leg_rows.groupBy(*keys, DAY).agg(
        F.sum(F.abs("w_contract")).alias("gross_w"),
        F.sum("w_contract").alias("net_w"),
        F.count("*").alias("n_legs"),
    )


def exposure_summary(exposures: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return exposures.groupBy(*keys).agg(
        nearest_quantile(F.col("gross_w"), 0.01).alias("gross_p01"),
        F.median("gross_w").alias("gross_med"),
        nearest_quantile(F.col("gross_w"), 0.99).alias("gross_p99"),
        F.max("gross_w").alias("gross_max"),
        F.max(F.abs("net_w")).alias("net_abs_max"),
        F.avg("net_w").alias("net_mean"),
        F.stddev_samp("net_w").alias("net_std"),
    )


def extreme_legs(
    leg_rows: DataFrame, by: str = "r_next", k: int = 5, worst: bool = True, keys: Sequence[str] = ()
) -> DataFrame:
    """The ``k`` smallest (or largest) legs over all curves: a top-k, not a full sort."""
    order = F.col(by).asc_nulls_last() if worst else F.col(by).desc_nulls_last()
    return leg_rows.orderBy(order, *keys, DAY, SYMBOL).limit(k)


def daily_pnl(leg_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``strategy_ret``: the sum of leg profits per day."""
    return leg_days(leg_rows, keys).select(*keys, DAY, "strategy_ret")


def period_start(every: str) -> Column:
    """First day of the calendar period of a row: 1d, 1w (Monday), 2w or 1mo."""
    day = F.col(DAY)
    if every == "1d":
        return day
    if every == "1w":
        return F.trunc(day, "week")
    if every == "1mo":
        return F.trunc(day, "month")
    if every == "2w":
        anchor = F.lit(FORTNIGHT_ANCHOR)
        return F.date_add(anchor, (F.floor(F.datediff(day, anchor) / 14) * 14).cast("int"))
    raise ValueError(f"every must be one of {sorted(HORIZONS)}, not {every!r}")


def resample(
    pnl: DataFrame, every: str, keys: Sequence[str] = (), column: str = "strategy_ret"
) -> DataFrame:
    """Sum per calendar period, labelled by its first day; empty periods are absent."""
    return pnl.groupBy(*keys, period_start(every).alias("period")).agg(F.sum(column).alias("ret"))


def pnl_moments(pnl: DataFrame, keys: Sequence[str] = (), column: str = "strategy_ret") -> DataFrame:
    x = F.col(column)
    return pnl.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt")
    )


def horizon_stats(pnl: DataFrame, keys: Sequence[str] = (), column: str = "strategy_ret") -> DataFrame:
    """Statistics of daily, weekly, two-weekly and monthly sums, one row per horizon.

    Every day row is labelled with its period at all four horizons at once, so the
    profit table is read and shuffled once.
    """
    periods = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon"), F.lit(float(n)).alias("_n"), period_start(h).alias("period")
                )
                for h, n in HORIZONS.items()
            ]
        )
    )
    summed = (
        pnl.select(*keys, F.col(column).alias("_x"), periods.alias("_p"))
        .groupBy(*keys, "_p.horizon", "_p._n", "_p.period")
        .agg(F.sum("_x").alias("ret"))
    )
    x = F.col("ret")
    return summed.groupBy(*keys, "horizon").agg(
        F.count("*").alias("n_periods"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        (ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.max("_n"))).alias("sharpe"),
        F.skewness(x).alias("skew"),
        F.kurtosis(x).alias("kurtosis"),
        share(x > 0).alias("hit_rate"),
    )
