"""The whole pipeline on a made futures curve, with no key columns."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from termlab.plans import jobs
from termlab.schema import DAY, MONTH_CODES


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    """Two hundred weekdays of nine monthly contracts."""
    rng = random.Random(11)
    days = [d for d in (dt.date(2015, 12, 28) + dt.timedelta(i) for i in range(290)) if d.weekday() < 5]
    expiries = [dt.date(2016 + m // 12, m % 12 + 1, 17) for m in range(22)]
    noise = {e: 0.0 for e in expiries}
    rows, level = [], 0.0
    for d in days:
        level = 0.97 * level + rng.gauss(0, 0.04)
        for e in [e for e in expiries if e > d][:9]:
            ttm = (e - d).days
            noise[e] = 0.9 * noise[e] + rng.gauss(0, 0.004)
            close = 18 + 4 * (1 - math.exp(-ttm / 90))
            close *= math.exp(level * math.exp(-ttm / 150) + noise[e])
            rows.append((f"VI{MONTH_CODES[e.month - 1]}{e.year % 100:02d}", d, close, e, ttm))
    path = str(tmp_path_factory.mktemp("job") / "out")
    term = spark.createDataFrame(rows, f"symbol string, {DAY} date, close double, expiry date, ttm_days int")
    jobs._write_contracts(term, f"{path}/term_structure")
    jobs.add_weights(spark, path)
    jobs.build_prices(spark, path)
    spot = spark.createDataFrame([(d, 15 + 5 * math.sin(i / 9)) for i, d in enumerate(days)], f"{DAY} date, spot double")
    jobs.run_strategy(spark, path, spot, window=40, every=5)
    return path


def test_strategy(spark, out):
    strategy = spark.read.parquet(f"{out}/strategy")
    assert strategy.count() > 100
    assert strategy.filter("abs(sized_ret - scale * forward_ret) > 1e-12 OR scale > 2").count() == 0
    assert strategy.filter(F.col(DAY) <= dt.date(2015, 12, 31)).count() == 0


def test_profit_is_weights_times_returns(spark, out):
    legs = spark.read.parquet(f"{out}/legs")
    days = spark.read.parquet(f"{out}/leg_days")
    assert legs.filter("tradingDay > expiry OR close_next IS NULL OR w_contract = 0").count() == 0
    total = legs.agg(F.sum("pnl_leg")).collect()[0][0]
    assert days.agg(F.sum("strategy_ret")).collect()[0][0] == pytest.approx(total)


def test_one_factor_dominates(spark, out):
    diagnostics = spark.read.parquet(f"{out}/diagnostics")
    assert diagnostics.agg(F.min("pc1_var")).collect()[0][0] > 0.5
    hedge = spark.read.parquet(f"{out}/hedge_days").filter("w_px_60d IS NOT NULL")
    assert hedge.filter("w_px_30d <> -1").count() == 0


def test_every_signal_has_its_table(spark, out):
    n_days = spark.read.parquet(f"{out}/leg_days").count()
    for name in ("carry", "front_slope", "spot", "std_r", "rotation"):
        table = spark.read.parquet(f"{out}/signal_{name}").agg(F.sum("n_days"), F.count("*")).collect()[0]
        assert 0 < table[0] < n_days and 5 <= table[1] <= 10
    summary = {r.measure: r.value for r in spark.read.parquet(f"{out}/summary").collect()}
    assert summary["max_drawdown"] <= 0 < summary["annualized_volatility"]
