"""Signal studies: a signal's decile today against the strategy's return tomorrow.

All twelve signals go through one operator.  The profit of a day is already the
return to the next observation; the forward return moves one day further, and is
kept that way.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlab.functions.columns import by_day, change, ratio, rolling_std, sharpe
from termlab.functions.days import fold_days
from termlab.functions.quantiles import bucket_labels, nearest_quantile, with_bucket, with_buckets
from termlab.schema import DAY, TENORS, TRADING_DAYS, px

CARRY_VOL_ROWS = 21  # fixed value


@dataclass(frozen=True)
class Signal:
    """Columns a signal reads from its source, and its value on the joined day rows."""

    source: str  # attribution, prices, spot, diagnostics or cross_section
    columns: tuple[str, ...]
    value: Callable[[Sequence[str]], Column]


def signal_definitions(tenors: Sequence[int] = TENORS) -> dict[str, Signal]:
    """The twelve signals, by name."""
    p = px(tenors)
    front, second, third, back = p[0], p[1], p[2], p[-1]

    def plain(source: str, column: str) -> Signal:
        return Signal(source, (column,), lambda keys: F.col(column))

    def changing(source: str, column: str) -> Signal:
        return Signal(source, (column,), lambda keys: change(F.col(column), keys))

    return {
        "carry": plain("attribution", "port_carry"),
        "d_carry": changing("attribution", "port_carry"),
        "carry_vol": Signal(
            "attribution",
            ("port_carry",),
            lambda keys: rolling_std(
                F.col("port_carry"), keys, 1 - CARRY_VOL_ROWS, 0, minimum=CARRY_VOL_ROWS
            ),
        ),
        "front_slope": Signal("prices", (front, second), lambda keys: F.col(second) - F.col(front)),
        "back_slope": Signal("prices", (front, back), lambda keys: F.col(back) - F.col(front)),
        "curvature": Signal(
            "prices", (front, third, back), lambda keys: F.col(front) - 2.0 * F.col(third) + F.col(back)
        ),
        "spot": plain("spot", "spot"),
        "d_spot": changing("spot", "spot"),
        "rotation": plain("diagnostics", "rotation"),
        "pc1_var": plain("diagnostics", "pc1_var"),
        "std_r": plain("cross_section", "std_r"),
        "max_abs_r": plain("cross_section", "max_abs_r"),
    }


def forward_return(pnl: DataFrame, keys: Sequence[str] = (), column: str = "strategy_ret") -> DataFrame:
    """Add ``forward_ret``, the next day row's return; NULL on a curve's last day."""
    return pnl.withColumn("forward_ret", F.lead(column).over(by_day(keys)))


def signal_table(
    pnl: DataFrame, source: DataFrame, signal: Signal, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, day, signal, forward_ret, the source columns), rows with a NULL of the first two dropped.

    Differences and rolling values run over the profit days, after the join.
    """
    wanted = source.select(*keys, DAY, *signal.columns)
    joined = forward_return(pnl.select(*keys, DAY, "strategy_ret").join(wanted, [*keys, DAY], "left"), keys)
    return joined.select(
        *keys, DAY, signal.value(keys).alias("signal"), "forward_ret", *signal.columns
    ).dropna(subset=["signal", "forward_ret"])


def forward_stats(bucketed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Forward-return table per bucket: n, mean, deviation, left tail, Sharpe, annual mean."""
    r = F.col("forward_ret")
    return bucketed.groupBy(*keys, "bucket", "label").agg(
        F.count("*").alias("n_days"),
        F.avg(r).alias("mean_daily"),
        F.stddev_samp(r).alias("std_daily"),
        nearest_quantile(r, 0.05).alias("p05"),
        nearest_quantile(r, 0.01).alias("p01"),
        sharpe(F.avg(r), F.stddev_samp(r), TRADING_DAYS).alias("sharpe_ann"),
        (F.avg(r) * TRADING_DAYS).alias("mean_ann"),
    )


def signal_study(
    pnl: DataFrame, source: DataFrame, signal: Signal, keys: Sequence[str] = (), n: int = 10
) -> DataFrame:
    """Join, forward return, quantile bucket, table."""
    table = signal_table(pnl, source, signal, keys)
    bucketed = with_bucket(table, "signal", bucket_labels(n), keys, "label", bucket="bucket")
    return forward_stats(bucketed, keys)


def signal_studies(
    pnl: DataFrame, sources: Mapping[str, DataFrame], signals: Mapping[str, Signal], keys: Sequence[str] = (), n: int = 10
) -> DataFrame:
    """:func:`signal_study` of all ``signals`` at once, told apart by ``signal``; ``sources`` by the names signals use.

    The sources are folded into one frame of profit days, where forward returns, signals and the breakpoints of all
    of them are windows by curve; only the labelled days move again, to be summed up by signal and bucket.
    """
    wanted: dict[str, list[str]] = {}
    for signal in signals.values():
        mine = wanted.setdefault(signal.source, [])
        mine += [c for c in signal.columns if c not in mine]
    tables = {name: (sources[name], columns) for name, columns in wanted.items()}
    days = fold_days({"pnl": (pnl, ("strategy_ret",)), **tables}, keys).filter("_in_pnl")
    days = forward_return(days, keys)
    values = [signal.value(keys).alias(f"_s_{name}") for name, signal in signals.items()]
    days = days.select(*keys, DAY, "forward_ret", *values).filter("forward_ret IS NOT NULL")
    labels = bucket_labels(n)
    bucketed = with_buckets(
        days, {f"_l_{s}": (f"_s_{s}", labels) for s in signals}, keys, {f"_l_{s}": f"_b_{s}" for s in signals}
    )
    each = [
        F.struct(F.lit(s).alias("signal"), F.col(f"_b_{s}").alias("bucket"), F.col(f"_l_{s}").alias("label")) for s in signals
    ]
    tall = bucketed.select(*keys, "forward_ret", F.explode(F.array(*each)).alias("_e")).select(*keys, "forward_ret", "_e.*")
    return forward_stats(tall.filter("bucket IS NOT NULL"), [*keys, "signal"])


# Fixed values of the volatility target.
TARGET_VOL, VOL_ROWS, VOL_MINIMUM = 0.16, 20, 10


def volatility_target(
    pnl: DataFrame,
    keys: Sequence[str] = (),
    target: float = TARGET_VOL,
    rows: int = VOL_ROWS,
    minimum: int = VOL_MINIMUM,
) -> DataFrame:
    """Add rv_daily (through yesterday), scale and strategy_ret_vt.

    Scale is 0 while the volatility is undefined or zero.
    """
    daily = F.lit(target) / F.sqrt(F.lit(float(TRADING_DAYS)))
    rv = rolling_std(F.col("strategy_ret"), keys, -rows, -1, minimum)
    out = pnl.withColumn("rv_daily", rv)
    out = out.withColumn("scale", F.coalesce(ratio(daily, F.col("rv_daily")), F.lit(0.0)))
    return out.withColumn("strategy_ret_vt", F.col("strategy_ret") * F.col("scale"))


def volatility_target_summary(targeted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    root = F.sqrt(F.lit(float(TRADING_DAYS)))
    return targeted.groupBy(*keys).agg(
        (F.stddev_samp("strategy_ret_vt") * root).alias("realized_vol_ann_vt"),
        (F.avg("strategy_ret_vt") * TRADING_DAYS).alias("annualized_mean_ret_vt"),
        (F.stddev_samp("strategy_ret") * root).alias("realized_vol_ann"),
        (F.avg("strategy_ret") * TRADING_DAYS).alias("annualized_mean_ret"),
        F.avg("scale").alias("avg_scale"),
        F.max("scale").alias("max_scale"),
    )
