"""Physical plans: shuffles, push-down, skew, and where Python runs."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from termlab.operators import contracts, legs, maturity, returns, rolling_pca
from termlab.plans import workload
from termlab.plans.panel import PANEL_TENORS, Panel
from termlab.schema import hedges

SF = "/root/testdata/sf0.001"
KEYS = ["curve_id"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan_of(df).split("Initial Plan")[0]


@pytest.fixture(scope="module")
def term(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "term")
    Panel(spark, SF).term.write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_prices_are_one_shuffle_and_no_join(term):
    plan = plan_of(maturity.constant_maturity_prices(term, PANEL_TENORS, KEYS))
    assert plan.count("Exchange") == 1
    assert "Join" not in plan


def test_weights_join_on_a_unique_key(term, no_broadcast):
    plan = plan_of(maturity.add_weights(term, PANEL_TENORS, KEYS))
    assert re.search(r"SortMergeJoin \[curve_id#\d+, tradingDay#\d+, symbol#\d+L?\]", plan)


def test_weights_reuse_the_partitioning_of_the_term_structure(spark, no_broadcast):
    """Rows deduplicated by (curve, symbol, day) are not shuffled again for the weights."""
    plan = final_plan(Panel(spark, SF).weighted)
    assert "ReusedExchange" in plan
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    by_contract = {s for s in shuffles if "symbol" in s}
    assert len(by_contract) == 2  # the term structure itself, and the bracket contracts


def test_legs_shuffle_contract_rows_once(term, no_broadcast):
    """By contract for the next close, and by day for the hedge; no self-join."""
    weighted = maturity.add_weights(term, PANEL_TENORS, KEYS)
    ret = returns.log_returns(maturity.constant_maturity_prices(term, PANEL_TENORS, KEYS), PANEL_TENORS, KEYS)
    hedge = ret.withColumns({h: F.lit(0.5) for h in hedges(PANEL_TENORS)})
    plan = plan_of(legs.legs_in_one_pass(weighted, hedge, PANEL_TENORS, KEYS))
    assert plan.count("Join") == 2


def test_windows_and_moments_add_no_shuffle_to_the_curve(term):
    """Returns, row numbers, blocks and frames all run on one partitioning."""
    prices = maturity.constant_maturity_prices(term, PANEL_TENORS, KEYS)
    ret = returns.log_returns(prices, PANEL_TENORS, KEYS)
    plan = plan_of(rolling_pca.rolling_moments(ret, PANEL_TENORS, KEYS))
    assert plan.count("Exchange hashpartitioning") == 2  # (curve, day) then curve


def test_filter_and_columns_reach_the_scan(spark, term, tmp_path):
    path = str(tmp_path / "prices")
    maturity.constant_maturity_prices(term, PANEL_TENORS, KEYS).write.parquet(path)
    rows = returns.daily_rows(spark.read.parquet(path).select("curve_id", "tradingDay", "px_180d"), KEYS)
    plan = plan_of(rows)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(tradingDay,2015-12-31\)", plan)
    assert "px_360d" not in plan


def test_bar_pick_hash_aggregates_in_two_steps(spark):
    plan = plan_of(contracts.pick_nearest(Panel(spark, SF).bars, unique_times=True))
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert plan.count("Exchange") == 1
    assert "props" not in plan


@pytest.mark.parametrize("name", ["sized", "sized_with_pca", "state_matrix"])
def test_states_of_all_sources_are_one_frame(spark, name):
    """After the staged tables: returns and components by curve, the spot's days, and the stacked sources once."""
    plan = plan_of(workload.queries()[name](spark, SF))
    assert len(re.findall(r"[- ]Exchange", plan)) <= 5
    assert "SortMergeJoin" not in plan


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """A third of all contract rows on one day of one curve."""
    path = str(tmp_path_factory.mktemp("plans") / "crowded")
    day = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(1 + F.col("id") % 200)
    spark.range(0, 300_000, 1, 8).select(
        F.lit("A").alias("curve_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), day.cast("int")).alias("tradingDay"),
        F.col("id").alias("symbol"),
        (1 + F.col("id") % 900).cast("int").alias("ttm_days"),
        F.rand(1).alias("close"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def largest_share(df, columns, parts=32) -> float:
    """Largest part of the rows in one of ``parts`` hash partitions."""
    sizes = df.groupBy(F.pmod(F.hash(*columns), F.lit(parts)).alias("p")).count()
    row = sizes.agg(F.max("count").alias("m"), F.sum("count").alias("n")).collect()[0]
    return row.m / row.n


def test_a_crowded_day_is_spread_over_tasks(crowded, no_broadcast):
    weighted = maturity.add_weights(crowded, PANEL_TENORS, KEYS)
    assert largest_share(crowded, ["curve_id", "tradingDay"]) > 0.3
    assert largest_share(crowded, ["curve_id", "tradingDay", "symbol"]) < 0.05
    assert weighted.count() == 300_000
    assert maturity.weight_sums(weighted, PANEL_TENORS, KEYS).filter("n_bad > 0").count() == 0


def test_a_crowded_day_meets_its_hedge_salted(crowded, no_broadcast):
    weighted = maturity.add_weights(crowded, PANEL_TENORS, KEYS)
    hedge = crowded.select("curve_id", "tradingDay").distinct()
    hedge = hedge.withColumns({h: F.lit(0.5) for h in hedges(PANEL_TENORS)})
    placed = legs.contract_weights(weighted, hedge, PANEL_TENORS, KEYS)
    assert re.search(r"SortMergeJoin \[curve_id#\d+, tradingDay#\d+, _salt#\d+\]", plan_of(placed))
    total = placed.agg(F.count("*").alias("n"), F.sum("w_contract").alias("w")).collect()[0]
    days = hedge.count()
    assert total.n == 300_000 and total.w == pytest.approx(0.5 * len(PANEL_TENORS) * days)


WRITING = (
    "csv_bars csv_bars_mixed csv_bar_quality parquet_stage expiry_calendar contract_expiry leg_return_quantiles histogram nearest_quantile nearest_quantile_all"
).split()
UNSTAGED = sorted(
    name
    for name in workload.queries()
    if not workload.is_staged(name) and name not in WRITING
)
WITH_COMPONENTS = re.compile(r"pca|hedge|neutrality|rotation|pc1")


@pytest.mark.parametrize("name", UNSTAGED)
def test_no_cross_join_and_python_only_for_components(spark, name):
    plan = plan_of(workload.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert ("Python" in plan or "Pandas" in plan) == bool(WITH_COMPONENTS.search(name))
    for window in re.finditer(r"Window \[.*\n(.*\n){0,6}", plan):
        assert "SinglePartition" not in window.group(0)


def scans_of(plan: str, table: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{table}.parquet", plan))


@pytest.mark.parametrize("name", sorted(workload.queries()))
def test_lineitem_is_read_once(spark, name):
    """In the plan that ran, where shuffles that several branches need are made once."""
    df = workload.queries()[name](spark, SF)
    if scans_of(plan_of(df), "lineitem") > 1:
        assert scans_of(final_plan(df), "lineitem") <= 1
