"""State matrix and state-dependent position size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from termlab.functions.columns import change, ratio, running, whole
from termlab.functions.days import fold_days
from termlab.functions.quantiles import nearest_quantile, with_buckets
from termlab.operators.signals import CARRY_VOL_ROWS, Signal, forward_return, signal_definitions, signal_table
from termlab.schema import DAY

# State labels from the lowest quantile bucket up.
STATE_LABELS = {
    "pca_rotation": ("STABLE", "TRANSITION", "UNSTABLE"),
    "pc1_var": ("MULTI_DIM", "ONE_DIM"),
    "std_r": (
        "LOW_DISPERSION",
        "LOWMID_DISPERSION",
        "MID_DISPERSION",
        "HIGHMID_DISPERSION",
        "HIGH_DISPERSION",
    ),
    "max_abs_r": ("NORMAL", "STRESSED", "SHOCK"),
    "carry": ("LOW", "MID", "HIGH"),
    "d_carry": ("FALL", "FLAT", "RISE"),
    "carry_vol": ("STABLE", "MIXED", "UNSTABLE"),
    "spot": ("LOW", "HIGH"),
    "d_spot": ("DOWN", "FLAT", "UP"),
}

# Size multiplier of each state; anything else counts as 1.
STATE_MULTIPLIERS = {
    "pca_rotation_state": {"STABLE": 0.8, "TRANSITION": 1.1, "UNSTABLE": 1.1},
    "pc1_var_state": {"MULTI_DIM": 1.15, "ONE_DIM": 0.75},
    "std_r_state": {
        "LOW_DISPERSION": 0.8,
        "LOWMID_DISPERSION": 0.9,
        "MID_DISPERSION": 1.0,
        "HIGHMID_DISPERSION": 1.1,
        "HIGH_DISPERSION": 1.2,
    },
    "spot_state": {"LOW": 0.7, "HIGH": 1.3},
}

# The states whose day counts are reported.
COUNTED_STATES = (
    "pca_rotation_state",
    "pc1_var_state",
    "std_r_state",
    "max_abs_r_state",
    "spot_state",
    "d_spot_state",
)


def label_states(df: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Add ``<name>_state`` for each column, bucketed over the rows given."""
    return with_buckets(df, {f"{name}_state": (name, STATE_LABELS[name]) for name in names}, keys)


def pca_states(pnl: DataFrame, diagnostics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rotation and PC1-variance states, on rebalance days that have a forward return."""
    definition = Signal("diagnostics", ("rotation", "pc1_var"), lambda _: F.col("rotation"))
    table = signal_table(pnl, diagnostics, definition, keys)
    table = table.select(*keys, DAY, F.col("rotation").alias("pca_rotation"), "pc1_var")
    return label_states(table, ["pca_rotation", "pc1_var"], keys)


def dispersion_states(daily_xs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cross-section states over all leg days."""
    table = daily_xs.select(*keys, DAY, "std_r", "max_abs_r")
    return label_states(table, ["std_r", "max_abs_r"], keys)


def carry_states(pnl: DataFrame, attribution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Carry states; the change in carry is taken after the warm-up rows are gone."""
    definition = signal_definitions()["carry_vol"]
    table = signal_table(pnl, attribution, definition, keys).select(
        *keys, DAY, F.col("port_carry").alias("carry"), F.col("signal").alias("carry_vol")
    )
    table = table.withColumn("d_carry", change(F.col("carry"), keys))
    return label_states(table, ["carry", "d_carry", "carry_vol"], keys)


def spot_states(pnl: DataFrame, spot: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Spot level and change states; the first row, which has no change, is dropped."""
    definition = signal_definitions()["spot"]
    table = signal_table(pnl, spot, definition, keys).select(*keys, DAY, "spot")
    table = table.withColumn("d_spot", change(F.col("spot"), keys)).dropna(subset=["d_spot"])
    return label_states(table, ["spot", "d_spot"], keys)


def state_matrix(
    pca: DataFrame, dispersion: DataFrame, carry: DataFrame, spot: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """All states of a day.  Rows need the first three; the spot is context."""
    on = [*keys, DAY]
    return pca.join(dispersion, on).join(carry, on).join(spot, on, "left")


# The state columns by the table whose rows they are bucketed over.
_TABLES = {
    "_pca": ("pca_rotation", "pc1_var"),
    "_dispersion": ("std_r", "max_abs_r"),
    "_carry": ("carry", "carry_vol", "d_carry"),
    "_spot": ("spot", "d_spot"),
}


def labelled_days(
    pnl: DataFrame,
    diagnostics: DataFrame,
    cross_section: DataFrame,
    attribution: DataFrame,
    spot: DataFrame,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Every day of profit or cross-section with all state columns, in one frame partitioned by curve.

    The five sources are stacked, moved once by curve and folded into one row per day; returns, rolling values, changes
    and all breakpoints are then windows within that partitioning.  A column of a table the day does not belong to
    (see :func:`pca_states`, :func:`dispersion_states`, :func:`carry_states`, :func:`spot_states`) is NULL.
    ``_pnl`` marks profit days, ``_matrix`` the rows of :func:`state_matrix`.
    """
    days = fold_days(
        {
            "pnl": (pnl, ("strategy_ret",)),
            "diagnostics": (diagnostics, ("rotation", "pc1_var")),
            "dispersion": (cross_section, ("std_r", "max_abs_r")),
            "attribution": (attribution, ("port_carry",)),
            "spot": (spot, ("spot",)),
        },
        keys,
    )
    days = days.withColumnsRenamed({"_in_pnl": "_pnl", "_in_dispersion": "_dispersion"}).filter("_pnl OR _dispersion")

    def ordered(flag: str) -> WindowSpec:
        return Window.partitionBy(*keys, flag).orderBy(DAY)

    recent = ordered("_pnl").rowsBetween(1 - CARRY_VOL_ROWS, 0)
    full = F.col("_pnl") & (F.count("port_carry").over(recent) == CARRY_VOL_ROWS)
    days = days.withColumns(
        {
            "forward_ret": F.when(F.col("_pnl"), F.lead("strategy_ret").over(ordered("_pnl"))),
            "carry_vol": F.when(full, F.stddev_samp("port_carry").over(recent)),
        }
    )
    days = days.withColumns(
        {
            flag: F.expr(f"_pnl AND forward_ret IS NOT NULL AND {c} IS NOT NULL")
            for flag, c in (("_pca", "rotation"), ("_carry", "carry_vol"), ("_spotted", "spot"))
        }
    )
    days = days.withColumns(
        {
            f"d_{c}": F.when(F.col(flag), F.col(x) - F.lag(x).over(ordered(flag)))
            for c, x, flag in (("carry", "port_carry", "_carry"), ("spot", "spot", "_spotted"))
        }
    )
    days = days.withColumn("_spot", F.expr("_spotted AND d_spot IS NOT NULL"))
    given = {"pca_rotation": "rotation", "carry": "port_carry"}
    members = [(flag, c) for flag, columns in _TABLES.items() for c in columns]
    days = days.select(
        *keys, DAY, "strategy_ret", "forward_ret", "_pnl",
        F.expr("_pca AND _dispersion AND _carry AS _matrix"),
        *[F.when(F.col(flag), F.col(given.get(c, c))).alias(c) for flag, c in members],
    )
    return label_states(days, [c for _, c in members], keys)


def matrix_rows(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """:func:`state_matrix` out of :func:`labelled_days`."""
    columns = [c for names in _TABLES.values() for c in (*names, *(f"{n}_state" for n in names))]
    return labelled.filter("_matrix").select(*keys, DAY, *columns)


def strategy_days(
    labelled: DataFrame, keys: Sequence[str] = (), cap: float = 3.0, boost: float | Column = 1.0
) -> DataFrame:
    """:func:`sized_strategy` of :func:`state_sizing`, within the partitioning of :func:`labelled_days`: no join."""
    days = state_sizing(labelled.filter("_pnl"), boost=boost, cap=cap).drop("sized_ret")
    states = [c for c in days.columns if c not in (*keys, DAY, "strategy_ret", "forward_ret", "_pnl", "_matrix")]
    upto = running(keys)
    carried = [F.last(F.when(F.col("_matrix"), F.col(c)), ignorenulls=True).over(upto).alias(c) for c in states]
    return (
        days.select(*keys, DAY, "strategy_ret", "forward_ret", *carried)
        .withColumn("sized_ret", F.col("forward_ret") * F.col("scale"))
        .dropna()
    )


def state_counts(
    matrix: DataFrame, keys: Sequence[str] = (), states: Sequence[str] = COUNTED_STATES
) -> DataFrame:
    """Days per state of each column: (keys, signal, state, n_days)."""
    present = [s for s in states if s in matrix.columns]
    tall = matrix.unpivot(list(keys), present, "signal", "state")
    return tall.groupBy(*keys, "signal", "state").agg(F.count("*").alias("n_days"))


def add_multipliers(
    matrix: DataFrame, multipliers: Mapping[str, Mapping[str, float]] = STATE_MULTIPLIERS
) -> DataFrame:
    """Add ``m_<state column>``; an unknown or missing state gets 1."""

    def multiplier(column: str) -> Column:
        entries = [F.lit(v) for pair in multipliers[column].items() for v in pair]
        return F.coalesce(F.try_element_at(F.create_map(*entries), F.col(column)), F.lit(1.0))

    return matrix.withColumns({f"m_{c}": multiplier(c) for c in multipliers})


def add_scale(
    with_multipliers: DataFrame,
    base: float = 1.0,
    boost: float | Column = 1.0,
    floor: float = 0.0,
    cap: float = 3.0,
    states: Sequence[str] = tuple(STATE_MULTIPLIERS),
) -> DataFrame:
    """Add ``raw_scale`` = base * boost * product of multipliers, and ``scale`` within bounds.

    ``boost`` may be a column, such as a joined calibration.
    """
    fixed = F.lit(float(base)) * (boost if isinstance(boost, Column) else F.lit(float(boost)))
    product = reduce(lambda acc, s: acc * F.col(f"m_{s}"), states, fixed)
    out = with_multipliers.withColumn("raw_scale", F.coalesce(product, fixed))
    return out.withColumn("scale", F.greatest(F.lit(float(floor)), F.least(F.lit(float(cap)), F.col("raw_scale"))))


def state_sizing(
    matrix: DataFrame,
    base: float = 1.0,
    boost: float | Column = 1.0,
    floor: float = 0.0,
    cap: float = 3.0,
    multipliers: Mapping[str, Mapping[str, float]] = STATE_MULTIPLIERS,
) -> DataFrame:
    """Multipliers and scale in one call; also ``sized_ret`` if there is a forward return."""
    out = add_scale(add_multipliers(matrix, multipliers), base, boost, floor, cap, tuple(multipliers))
    if "forward_ret" in out.columns:
        out = out.withColumn("sized_ret", F.col("scale") * F.col("forward_ret"))
    return out


def global_boost(
    matrix: DataFrame,
    keys: Sequence[str] = (),
    target: float = 1.0,
    base: float = 1.0,
    multipliers: Mapping[str, Mapping[str, float]] = STATE_MULTIPLIERS,
) -> DataFrame:
    """(keys, boost) that brings the mean unbounded scale to ``target``; 1 if undefined."""
    sized = state_sizing(matrix, base, multipliers=multipliers)
    boost = F.coalesce(ratio(F.lit(float(target)), F.avg("raw_scale")), F.lit(1.0))
    return sized.groupBy(*keys).agg(boost.alias("boost"))


def calibrated_sizing(
    matrix: DataFrame,
    keys: Sequence[str] = (),
    target: float = 1.0,
    base: float = 1.0,
    floor: float = 0.0,
    cap: float = 3.0,
    multipliers: Mapping[str, Mapping[str, float]] = STATE_MULTIPLIERS,
) -> DataFrame:
    """:func:`state_sizing` with each curve's own :func:`global_boost`, not collected."""
    raw = state_sizing(matrix, base, multipliers=multipliers)
    mean = F.avg("raw_scale").over(whole(keys))
    boosted = raw.withColumn("boost", F.coalesce(ratio(F.lit(float(target)), mean), F.lit(1.0)))
    return add_scale(boosted, base, F.col("boost"), floor, cap, tuple(multipliers))


def scale_summary(sized: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return sized.groupBy(*keys).agg(
        F.avg("scale").alias("avg_scale"),
        nearest_quantile(F.col("scale"), 0.5).alias("med_scale"),
        nearest_quantile(F.col("scale"), 0.95).alias("p95_scale"),
        F.max("scale").alias("max_scale"),
    )


def sized_strategy(
    pnl: DataFrame, sized_states: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Every profit day with the latest known states and scale, and ``sized_ret``.

    Days run in order within a curve.  State, multiplier and scale columns are
    carried forward from the last rebalance; returns never are.  Rows left with a
    NULL (before the first rebalance, and the last day) are dropped.
    """
    states = [c for c in sized_states.columns if c not in (*keys, DAY, "forward_ret", "sized_ret")]
    base = forward_return(pnl.select(*keys, DAY, "strategy_ret"), keys)
    joined = base.join(sized_states.select(*keys, DAY, *states), [*keys, DAY], "left")
    carried = [F.last(c, ignorenulls=True).over(running(keys)).alias(c) for c in states]
    return (
        joined.select(*keys, DAY, "strategy_ret", "forward_ret", *carried)
        .withColumn("sized_ret", F.col("forward_ret") * F.col("scale"))
        .dropna()
    )
