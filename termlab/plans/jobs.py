"""The pipeline from bar files to performance tables, one job per stage.

    spark-submit termlab/plans/jobs.py prices   BARS_DIR EXPIRIES_TXT OUT_DIR [curves]
    spark-submit termlab/plans/jobs.py strategy OUT_DIR SPOT_PARQUET [curves]

With ``curves`` the folder of a bar file names its curve, and every table has ``curve_id``.

Each job reads the Parquet stages before it and writes its own, so a rerun can
start at any stage.  Contract-grain stages are partitioned by month of trading day,
which prunes files for a date range; day-grain stages are single tables.
"""

from __future__ import annotations

import datetime
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlab.functions.quantiles import bucket_labels, with_bucket
from termlab.operators import (
    contracts,
    drawdown,
    legs,
    maturity,
    quality,
    report,
    returns,
    rolling_pca,
    signals,
    sizing,
)
from termlab.schema import DAY, SYMBOL, TENORS, px
from termlab.schema import returns as return_names
from termlab.session import build_session
from termlab.sources.bars import read_bars
from termlab.sources.calendar import read_expiry_calendar
from termlab.sources.tables import clear_scratch, read_table, write_table

MONTH = "month"


def _write_contracts(df: DataFrame, path: str) -> None:
    by_month = df.withColumn(MONTH, F.date_format(DAY, "yyyy-MM"))
    write_table(by_month, path, [MONTH], [DAY, "ttm_days", SYMBOL])


def _read_contracts(spark: SparkSession, path: str, after: datetime.date | None = None) -> DataFrame:
    """A contract-grain stage; ``after`` prunes the months before it as well as the days."""
    rows = spark.read.parquet(path)
    if after is not None:
        rows = rows.filter((F.col(MONTH) >= f"{after:%Y-%m}") & (F.col(DAY) > F.lit(after)))
    return rows.drop(MONTH)


def with_curve(bars: DataFrame) -> DataFrame:
    """``curve_id``, the name of the folder that holds the bar's file."""
    return bars.withColumn("curve_id", F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1))


def build_term_structure(
    spark: SparkSession,
    bars_dir: str,
    expiries: str,
    out_dir: str,
    root: str = "VI",
    strict: bool = False,
    unique_times: bool = False,
    keys: Sequence[str] = (),
) -> None:
    """Bars and calendar to ``term_structure``; ``keys`` is empty or ``curve_id``."""
    bars = read_bars(spark, bars_dir)
    bars = with_curve(bars) if keys else bars
    term = contracts.term_structure(bars, read_expiry_calendar(spark, expiries), root, strict, unique_times, keys)
    _write_contracts(term, f"{out_dir}/term_structure")


def add_weights(
    spark: SparkSession, out_dir: str, tenors: Sequence[int] = TENORS, keys: Sequence[str] = (), clamp: bool = True
) -> None:
    """``term_structure`` to ``term_with_weights``."""
    term = _read_contracts(spark, f"{out_dir}/term_structure")
    _write_contracts(maturity.add_weights(term, tenors, keys, clamp), f"{out_dir}/term_with_weights")


def build_prices(spark: SparkSession, out_dir: str, keys: Sequence[str] = ()) -> None:
    """``term_with_weights`` to ``synthetic_prices``."""
    weighted = _read_contracts(spark, f"{out_dir}/term_with_weights")
    write_table(maturity.prices_from_weights(weighted, keys), f"{out_dir}/synthetic_prices", sort_by=[*keys, DAY])


def run_prices(
    spark: SparkSession,
    bars_dir: str,
    expiries: str,
    out_dir: str,
    tenors: Sequence[int] = TENORS,
    root: str = "VI",
    strict: bool = False,
    unique_times: bool = False,
    keys: Sequence[str] = (),
    clamp: bool = True,
) -> None:
    """The three jobs above in order."""
    build_term_structure(spark, bars_dir, expiries, out_dir, root, strict, unique_times, keys)
    add_weights(spark, out_dir, tenors, keys, clamp)
    build_prices(spark, out_dir, keys)


def run_strategy(
    spark: SparkSession,
    out_dir: str,
    spot: DataFrame,
    tenors: Sequence[int] = TENORS,
    keys: Sequence[str] = (),
    window: int = rolling_pca.WINDOW,
    every: int = rolling_pca.EVERY,
    days: float = 30.0,
    carry_space: str = "standardised",
    cap: float = 2.0,
    boost: float = 1.0,
) -> None:
    """Prices to sized strategy and report tables.

    ``spot`` is (keys, day, spot).  Profit is earned by the tradable-space hedge;
    ``carry_space`` chooses the hedge whose carry is the signal.
    """

    def stage(name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{out_dir}/{name}", sort_by=[c for c in (*keys, DAY) if c in df.columns])
        return read_table(spark, f"{out_dir}/{name}")

    prices = returns.daily_rows(read_table(spark, f"{out_dir}/synthetic_prices"), keys)
    ret = stage("returns", returns.add_carry(returns.log_returns(prices, tenors, keys), tenors, days))

    names, p = return_names(tenors), px(tenors)
    near, far = 0, min(2, len(tenors) - 1)
    residuals = returns.add_residual(ret, names[near], names[far], keys).withColumn("slope", F.col(p[far]) - F.col(p[near]))
    residuals = stage("pair_residuals", residuals)
    stage("pair_beta", returns.pair_regression(ret, names[near], names[far], keys))
    stage("residual_stats", returns.residual_stats(residuals, names[near], keys))
    priced = residuals.join(spot.select(*keys, DAY, "spot"), [*keys, DAY], "left")
    for level in ("slope", "spot"):
        by_level = with_bucket(priced, level, bucket_labels(5, "Q"), keys, "label")
        stage(f"residual_by_{level}", returns.residual_by_bucket(by_level, "label", keys))

    moments = rolling_pca.rolling_moments(ret, tenors, keys, window, every)
    components = stage("components", rolling_pca.principal_components(moments, tenors))
    diagnostics = stage("diagnostics", rolling_pca.diagnostics(components, tenors, keys))

    def hedged(space: str) -> DataFrame:
        hedge = rolling_pca.hedge_weights(components, tenors, keys, space)
        return rolling_pca.attach_weights(ret, hedge, tenors, keys, window, every)

    attribution = stage("attribution", rolling_pca.attribution(hedged(carry_space), tenors))
    hedge_days = stage("hedge_days", hedged("tradable"))

    weighted = _read_contracts(spark, f"{out_dir}/term_with_weights", returns.FIRST_DAY)
    _write_contracts(legs.positions_in_one_pass(weighted, hedge_days, tenors, keys), f"{out_dir}/positions")
    positions = _read_contracts(spark, f"{out_dir}/positions")
    stage("leg_quality", quality.leg_quality(positions, keys))
    leg_rows = legs.with_return(positions)
    _write_contracts(leg_rows, f"{out_dir}/legs")
    leg_days = stage("leg_days", legs.leg_days(_read_contracts(spark, f"{out_dir}/legs"), keys))
    pnl = leg_days.select(*keys, DAY, "strategy_ret")

    sources = {
        "attribution": attribution, "prices": ret, "spot": spot, "diagnostics": diagnostics, "cross_section": leg_days,
    }
    definitions = signals.signal_definitions(tenors)
    studies = stage("signals", signals.signal_studies(pnl, sources, definitions, keys))
    for name in definitions:
        stage(f"signal_{name}", studies.filter(F.col("signal") == name).drop("signal"))

    labelled = stage("labelled_days", sizing.labelled_days(pnl, diagnostics, leg_days, attribution, spot, keys))
    matrix = sizing.matrix_rows(labelled, keys)
    sized = stage("sized_states", sizing.state_sizing(matrix, boost=boost, cap=cap))
    strategy = stage("strategy", sizing.strategy_days(labelled, keys, cap, boost))

    stage("boost", sizing.global_boost(matrix, keys))
    stage("scaled_vs_unscaled", report.scaled_against_unscaled(strategy, keys))
    stage("annual_sharpe_comparison", report.annual_sharpe_comparison(strategy, keys))

    exposures = stage("exposure", legs.exposure(_read_contracts(spark, f"{out_dir}/legs"), keys))
    stage("exposure_summary", legs.exposure_summary(exposures, keys))
    stage("shock_days", legs.shock_days(leg_days))
    stage("symbol_extremes", legs.symbol_extremes(legs.next_returns(weighted, keys), keys))
    stage("state_counts", sizing.state_counts(matrix, keys))
    stage("scale_summary", sizing.scale_summary(sized, keys))

    log_curve = drawdown.log_equity(pnl, keys)
    stage("drawdown", log_curve)
    losses = stage("loss_days", drawdown.losses_by_size(drawdown.worst_episode(log_curve, keys), keys))
    regime = drawdown.regime_source(prices, spot, tenors, keys)
    stage("loss_regime", drawdown.loss_regime(drawdown.concentrated_losses(losses), pnl, regime, keys))
    targeted = stage("vol_target", signals.volatility_target(pnl, keys))
    stage("vol_target_summary", signals.volatility_target_summary(targeted, keys))
    stage("horizons", legs.horizon_stats(pnl, keys))
    equity = report.compounded_equity(strategy, keys)
    stage("equity", equity)
    stage("annual", report.annual_stats(strategy, keys))
    stage("summary", report.summary(equity, keys))
    stage("pnl_by_state", report.pnl_by_state(strategy, keys))


def main(arguments: Sequence[str]) -> None:
    command, *rest = arguments
    spark = build_session(f"termlab {command}")
    if command == "prices":
        bars_dir, expiries, out_dir, *curves = rest
        run_prices(spark, bars_dir, expiries, out_dir, keys=["curve_id"] if curves else [])
    elif command == "strategy":
        out_dir, spot, *curves = rest
        keys = ["curve_id"] if curves else []
        run_strategy(spark, out_dir, read_table(spark, spot, [*keys, DAY, "spot"]), keys=keys)
    else:
        raise SystemExit(__doc__)
    clear_scratch(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
