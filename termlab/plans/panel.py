"""The star-schema tables read as term-structure inputs.

bars            events: symbol user_id, day of ts, close value, ts in UTC
term structure  lineitem joined to orders: curve l_returnflag, day o_orderdate,
                symbol l_suppkey, expiry l_shipdate, close l_extendedprice
spot index      daily mean of o_totalprice / 1000
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlab.operators import (
    contracts,
    drawdown,
    legs,
    maturity,
    returns,
    rolling_pca,
    signals,
    sizing,
)
from termlab.schema import DAY, SYMBOL, hedges, px
from termlab.schema import returns as return_names
from termlab.sources import tables

CURVE = ["curve_id"]
PANEL_TENORS = (180, 360, 540, 720, 900, 1080)
PANEL_STEP = 180.0
FIXED_HEDGE = (-1.0, 0.2, 0.2, 0.2, 0.2, 0.2)

# Stated here, so that no footer is read to plan a query.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
}


def utc_instant(column: str):
    """A zone-less UTC time as an instant, whatever the session's zone is."""
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return local.cast("timestamp")


class Panel:
    """Every stage of the pipeline over one scale-factor folder, built on demand."""

    keys: Sequence[str] = CURVE
    tenors: Sequence[int] = PANEL_TENORS

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def bars(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias(SYMBOL),
            F.col("ts").cast("date").alias(DAY),
            utc_instant("ts").alias("timestamp"),
            F.col("value").alias("close"),
            F.col("event_type").alias("file_path"),
        )

    @cached_property
    def contract_rows(self) -> DataFrame:
        """All contract rows, expired and repeated ones included."""
        orders = self.table("orders").selectExpr("o_orderkey AS l_orderkey", f"CAST(o_orderdate AS DATE) AS {DAY}")
        lines = self.table("lineitem").selectExpr(
            "l_orderkey",
            "l_linenumber",
            "l_returnflag AS curve_id",
            f"l_suppkey AS {SYMBOL}",
            "l_extendedprice AS close",
            "CAST(l_shipdate AS DATE) AS expiry",
        )
        return lines.join(orders, "l_orderkey").withColumn("ttm_days", F.datediff("expiry", DAY))

    @cached_property
    def term(self) -> DataFrame:
        """Unique on (curve, symbol, day)."""
        # Stated once here, so that every branch reads the same plan and reuses its shuffle.
        keyed = self.contract_rows.filter(f"curve_id IS NOT NULL AND {SYMBOL} IS NOT NULL AND {DAY} IS NOT NULL")
        return contracts.keep_first(
            contracts.live_contracts(keyed),
            [*self.keys, SYMBOL, DAY],
            ["l_orderkey", "l_linenumber", "ttm_days", "close"],
            ["close", "expiry", "ttm_days"],
            # Lines of an order are numbered from 1 to 7 and ship within 4,095 days; they differ in one of the two.
            rank=(F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4096 + F.col("ttm_days"),
        )

    @cached_property
    def brackets(self) -> DataFrame:
        return maturity.brackets(self.term, self.tenors, self.keys)

    @cached_property
    def weighted(self) -> DataFrame:
        return maturity.weights_from_brackets(self.term, self.brackets, self.tenors, self.keys)

    @cached_property
    def prices(self) -> DataFrame:
        return maturity.prices_from_brackets(self.brackets, self.tenors, self.keys)

    @cached_property
    def returned(self) -> DataFrame:
        """Returns and carry."""
        plain = returns.log_returns(self.prices, self.tenors, self.keys)
        return returns.add_carry(plain, self.tenors, PANEL_STEP)

    @cached_property
    def spot(self) -> DataFrame:
        daily = (
            self.table("orders")
            .groupBy(F.col("o_orderdate").cast("date").alias(DAY))
            .agg(F.avg(F.col("o_totalprice") / 1000.0).alias("spot"))
        )
        # One row per calendar day bounds the broadcast.
        return self.prices.select(*self.keys, DAY).join(F.broadcast(daily), DAY).select(*self.keys, DAY, "spot")

    @cached_property
    def residuals(self) -> DataFrame:
        """Front-tenor return against the third, with the columns it is bucketed by."""
        names, p = return_names(self.tenors), px(self.tenors)
        out = returns.add_residual(self.returned, names[0], names[2], self.keys)
        out = out.withColumn("slope", F.col(p[2]) - F.col(p[0]))
        return out.join(self.spot, [*self.keys, DAY], "left")

    # -- principal components ------------------------------------------------

    @cached_property
    def moments(self) -> DataFrame:
        return rolling_pca.rolling_moments(self.returned, self.tenors, self.keys)

    @cached_property
    def components(self) -> DataFrame:
        return rolling_pca.principal_components(self.moments, self.tenors)

    @cached_property
    def diagnostics(self) -> DataFrame:
        return rolling_pca.diagnostics(self.components, self.tenors, self.keys)

    def hedge(self, space: str) -> DataFrame:
        return rolling_pca.hedge_weights(self.components, self.tenors, self.keys, space)

    def hedged(self, space: str) -> DataFrame:
        """Returns and carry with the hedge of ``space``, days before the first one NULL."""
        return rolling_pca.attach_weights(self.returned, self.hedge(space), self.tenors, self.keys)

    # -- strategy ------------------------------------------------------------

    @cached_property
    def day_weights(self) -> DataFrame:
        """Hedge weights by day: fixed ones here, so that later stages check on their own."""
        fixed = dict(zip(hedges(self.tenors), FIXED_HEDGE, strict=True))
        return self.returned.withColumns({name: F.lit(w) for name, w in fixed.items()})

    @cached_property
    def carry_weights(self) -> DataFrame:
        return self.day_weights

    @cached_property
    def attribution(self) -> DataFrame:
        return rolling_pca.attribution(self.carry_weights, self.tenors)

    @cached_property
    def next_returns(self) -> DataFrame:
        return legs.next_returns(self.term, self.keys)

    @cached_property
    def positions(self) -> DataFrame:
        return legs.positions_in_one_pass(self.weighted, self.day_weights, self.tenors, self.keys)

    @cached_property
    def legs(self) -> DataFrame:
        return legs.with_return(self.positions)

    @cached_property
    def leg_days(self) -> DataFrame:
        return legs.leg_days(self.legs, self.keys)

    @cached_property
    def cross_section(self) -> DataFrame:
        return self.leg_days.drop("strategy_ret")

    @cached_property
    def pnl(self) -> DataFrame:
        return self.leg_days.select(*self.keys, DAY, "strategy_ret")

    @cached_property
    def equity(self) -> DataFrame:
        return drawdown.log_equity(self.pnl, self.keys)

    @cached_property
    def episode(self) -> DataFrame:
        return drawdown.worst_episode(self.equity, self.keys)

    @cached_property
    def regime(self) -> DataFrame:
        return drawdown.regime_source(self.prices, self.spot, self.tenors, self.keys)

    def source(self, name: str) -> DataFrame:
        """A signal source by the name used in :class:`signals.Signal`."""
        return getattr(self, name)

    def study(self, name: str) -> DataFrame:
        definition = signals.signal_definitions(self.tenors)[name]
        return signals.signal_study(self.pnl, self.source(definition.source), definition, self.keys)

    @cached_property
    def studies(self) -> DataFrame:
        """All signals at once."""
        definitions = signals.signal_definitions(self.tenors)
        sources = {d.source: self.source(d.source) for d in definitions.values()}
        return signals.signal_studies(self.pnl, sources, definitions, self.keys)

    @cached_property
    def labelled(self) -> DataFrame:
        return sizing.labelled_days(
            self.pnl, self.diagnostics, self.cross_section, self.attribution, self.spot, self.keys
        )

    @cached_property
    def states(self) -> DataFrame:
        return sizing.matrix_rows(self.labelled, self.keys)

    @cached_property
    def sized_states(self) -> DataFrame:
        return sizing.state_sizing(self.states, cap=2.0)

    @cached_property
    def strategy(self) -> DataFrame:
        return sizing.strategy_days(self.labelled, self.keys, cap=2.0)


class StagedPanel(Panel):
    """The panel with the day tables that many branches read written once.

    What is staged is day or rebalance grain: brackets, components and leg days.
    Contract rows stay in the plan.
    """

    @cached_property
    def brackets(self) -> DataFrame:
        return tables.stage(super().brackets, "brackets")

    @cached_property
    def components(self) -> DataFrame:
        return tables.stage(super().components, "components")

    @cached_property
    def leg_days(self) -> DataFrame:
        return tables.stage(super().leg_days, "leg-days")


class PricedPanel(StagedPanel):
    """The panel with its prices written once, for queries that also take the spot index's days from them."""

    @cached_property
    def prices(self) -> DataFrame:
        return tables.stage(super().prices, "prices")


class TermPanel(Panel):
    """The panel with its term structure written once, for queries that join two things made of it."""

    @cached_property
    def term(self) -> DataFrame:
        return tables.stage(super().term, "term")


class ShiftedPanel(Panel):
    """Closes less a fixed amount, so that some are not positive."""

    @cached_property
    def weighted(self) -> DataFrame:
        return super().weighted.withColumn("close", F.col("close") - 20000.0)


class HedgedPanel(StagedPanel):
    """Traded with the panel's own rolling hedge instead of fixed weights.

    Profit comes from the tradable-space hedge, carry from the standardised one.
    """

    @cached_property
    def day_weights(self) -> DataFrame:
        return self.hedged("tradable")

    @cached_property
    def carry_weights(self) -> DataFrame:
        return self.hedged("standardised")
