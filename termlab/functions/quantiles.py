"""Quantile buckets and nearest-rank quantiles.

A day-grain group (one curve, or one bucket of it) is a few thousand rows by its nature, so it is sorted in place.
Contract-grain rows have no such bound: :func:`nearest_quantiles` narrows any group by counting until the
rows left around a rank fit a stated size, and no task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlab.functions.columns import ratio, steady
from termlab.functions.joins import salted_join, unused
from termlab.sources.tables import stage


def bucket_labels(n: int, prefix: str = "D") -> list[str]:
    return [f"{prefix}{i + 1}" for i in range(n)]


def with_bucket(
    df: DataFrame,
    column: str,
    labels: Sequence[str],
    keys: Sequence[str],
    name: str,
    bucket: str | None = None,
) -> DataFrame:
    """Label each day row by the quantile bucket of ``column`` within its curve.

    Breakpoints are the linearly interpolated 1/n .. (n-1)/n quantiles of the whole
    curve; a value equal to a breakpoint belongs to the lower bucket.  Both are compared as
    :func:`~termlab.functions.columns.steady` values, so rounding noise does not part equal ones.  NULL stays
    NULL.  Equal breakpoints leave the buckets between them empty.  ``bucket`` adds
    the 1-based number, which orders labels such as D2 and D10.
    """
    return with_buckets(df, {name: (column, labels)}, keys, {name: bucket} if bucket else {})


def with_buckets(
    df: DataFrame,
    labelled: Mapping[str, tuple[str, Sequence[str]]],
    keys: Sequence[str],
    numbers: Mapping[str, str] | None = None,
) -> DataFrame:
    """:func:`with_bucket` for several label columns, ``{name: (column, labels)}``, whose breakpoints all come from one window."""
    numbers = numbers or {}
    partition = f"PARTITION BY {', '.join(keys)}" if keys else ""
    cuts, places, added = [], [], []
    for i, (name, (column, labels)) in enumerate(labelled.items()):
        n = len(labels)
        probabilities = ", ".join(f"{k / n!r}D" for k in range(1, n))
        cuts.append(F.expr(f"percentile({column}, array({probabilities})) OVER ({partition}) AS _cuts_{i}"))
        value = steady(f"CAST({column} AS DOUBLE)")
        under = f"size(filter(_cuts_{i}, c -> {steady('c')} < {value}))"
        places.append(F.expr(f"if({column} IS NULL, NULL, 1 + {under}) AS _bucket_{i}"))
        names = ", ".join(f"'{label}'" for label in labels)
        added.append(F.expr(f"get(array({names}), _bucket_{i} - 1) AS {name}"))
        if name in numbers:
            added.append(F.expr(f"_bucket_{i} AS {numbers[name]}"))
    return df.select("*", *cuts).select("*", *places).select(*df.columns, *added)


def nearest_quantile(column: Column, q: float) -> Column:
    """Aggregate: the value at rank ``round((n - 1) q)``, for day-grain groups only."""
    ordered = F.sort_array(F.collect_list(column))
    return F.get(ordered, F.round((F.size(ordered) - 1) * F.lit(q)).cast("int"))


#: Rows among which a quantile is found by sorting them in one task.
FITS = 50_000
#: Pivots a pass cuts a larger group by, and the rank error of their sketch as a part of the group.
PIVOTS, ACCURACY = 63, 10_000


def nearest_quantiles(
    df: DataFrame, column: str, quantiles: Mapping[str, float], keys: Sequence[str], fits: int = FITS
) -> DataFrame:
    """Exact nearest-rank quantiles of groups of any size, one row per ``keys``.

    The values are staged once.  While more than ``fits`` rows are left around a wanted rank, a pass cuts them at
    about ``PIVOTS`` sketched quantiles of their own, counts the rows in each cell (strictly between two pivots, or equal to
    one), and keeps the cells that hold a wanted rank, staged: about one row in sixty.  A cell of equal values is an answer.
    At last no more than ``fits`` rows are left around any rank, and sorting them gives the rest, so no window holds more.

    NULLs don't count.  Without keys there is one row, of NULLs where no value is.
    """
    group = [*keys]
    part = unused("_part", group)
    at = [*group, part]
    rows = df.filter(F.col(column).isNotNull()).select(*group, F.lit(0).cast("bigint").alias(part), F.col(column).cast("double").alias("_x"))
    rows = stage(rows, "values")
    ranks = [
        F.struct(F.lit(label).alias("label"), F.round((F.col("_n") - 1) * F.lit(q)).cast("bigint").alias("rank"))
        for label, q in quantiles.items()
    ]
    asks = stage(rows.groupBy(*at).agg(F.count("*").alias("_n")).withColumn("_asks", F.array(*ranks)), "asks")
    answers: list[DataFrame] = []
    while True:
        wide = asks.filter(F.col("_n") > fits)
        answers.append(_sorted_answers(rows, asks.filter(F.col("_n") <= fits), at))
        if wide.isEmpty():
            break
        cells, pivots = _cells(rows, wide, at)
        single = F.col("_low") == F.col("_high")
        answers.append(cells.filter(single).select(*group, F.explode("_asks.label").alias("label"), F.col("_low").alias("_x")))
        kept = cells.filter(~single)
        chosen = kept.groupBy(*at).agg(F.collect_list("_cell").alias("_kept"))
        inside = salted_join(rows, pivots.join(chosen, at), at, F.col("_x"), wide.select(*at, "_n"))
        child = (F.col(part) * (2 * PIVOTS + 2) + F.col("_cell")).alias(part)
        narrowed = inside.withColumn("_cell", _cell()).filter(F.array_contains("_kept", F.col("_cell")))
        rows = stage(narrowed.select(*group, child, "_x"), "values")
        asks = stage(kept.select(*group, child, "_n", "_asks"), "asks")
    found = reduce(DataFrame.union, answers).groupBy(*keys)
    return found.agg(*[F.max(F.when(F.col("label") == label, F.col("_x"))).alias(label) for label in quantiles])


def _sorted_answers(rows: DataFrame, asks: DataFrame, at: Sequence[str]) -> DataFrame:
    """(group, label, _x) of groups whose rows are sorted in one task each."""
    order = Window.partitionBy(*at).orderBy("_x")
    held = salted_join(rows, asks.select(*at, "_asks"), at, F.col("_x"), asks.select(*at, "_n"))
    placed = held.withColumn("_rank", F.row_number().over(order) - 1)
    wanted = F.filter("_asks", lambda a: a["rank"] == F.col("_rank"))
    return placed.select(*at[:-1], "_x", F.explode(wanted).alias("_a")).select(*at[:-1], "_a.label", "_x")


def _cell() -> Column:
    """The cell of ``_x`` among the sorted ``_pivots``: odd for a value that is a pivot, even between two.

    A binary search, so a row meets six pivots and the expression stays small: one term for each pivot makes a method too long for the
    JVM to compile.
    """
    steps = ", ".join(str(1 << k) for k in reversed(range(PIVOTS.bit_length())))
    return F.expr(
        f"aggregate(array({steps}), 0, (below, step) -> below + if(_x > get(_pivots, below + step - 1), step, 0), "
        "below -> 2 * below + int(coalesce(get(_pivots, below) = _x, false)))"
    )


def _cells(rows: DataFrame, wide: DataFrame, at: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The cells that hold a wanted rank, with their rows, extremes and ranks counted from their start; and the pivots."""
    sizes = wide.select(*at, "_n")
    probabilities = [i / (PIVOTS - 1) for i in range(PIVOTS)]
    held = salted_join(rows, wide.select(*at), at, F.col("_x"), sizes)
    sketched = F.sort_array(F.percentile_approx("_x", probabilities, ACCURACY))
    pivots = stage(held.groupBy(*at).agg(sketched.alias("_pivots")), "pivots")
    counted = (
        salted_join(rows, pivots, at, F.col("_x"), sizes)
        .groupBy(*at, _cell().alias("_cell"))
        .agg(F.count("*").alias("_in"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    )
    # At most 2 PIVOTS + 1 rows in a window.
    upto = Window.partitionBy(*at).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_in").over(upto), F.lit(0)))
    inside = F.filter("_asks", lambda a: (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_before") + F.col("_in")))
    moved = F.transform(
        inside, lambda a: F.struct(a["label"].alias("label"), (a["rank"] - F.col("_before")).alias("rank"))
    )
    cells = counted.join(wide.select(*at, "_asks"), at).withColumn("_asks", moved).filter("size(_asks) > 0")
    return stage(cells.select(*at, "_cell", F.col("_in").alias("_n"), "_low", "_high", "_asks"), "cells"), pivots


def adjusted_skewness(column: Column) -> Column:
    """Aggregate: bias-corrected skewness, NULL for fewer than 3 values."""
    n = F.count(column).cast("double")
    factor = ratio(F.sqrt(n * (n - 1)), n - 2)
    return F.when(n >= 3, F.skewness(column) * factor)


def adjusted_kurtosis(column: Column) -> Column:
    """Aggregate: bias-corrected excess kurtosis, NULL for fewer than 4 values."""
    n = F.count(column).cast("double")
    scaled = ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(column) + 6)
    return F.when(n >= 4, scaled)


def _with_edges(rows: DataFrame, edges: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach each group's ``_edges``; without a group there is one row, which a scalar subquery brings in."""
    if group:
        return salted_join(rows, edges.drop("_n"), group, F.col("_x"), edges.select(*group, "_n"))
    return rows.withColumn("_edges", edges.select("_edges").scalar())


def histogram(df: DataFrame, column: str, keys: Sequence[str], bins: int = 50) -> DataFrame:
    """Equal-width counts per curve: (keys, bin, bin_lo, bin_hi, n).  Empty bins are absent.

    The last bin includes the maximum.  A constant column falls into bin 1.  ``df`` is
    read twice, the first time for the extremes of each curve.
    """
    group = list(keys)
    rows = df.filter(F.col(column).isNotNull()).select(*group, F.col(column).cast("double").alias("_x"))
    edges = rows.groupBy(*group).agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("_edges"), F.count("*").alias("_n"))
    rows = _with_edges(rows, edges, group).select(*group, "_x", "_edges.lo", "_edges.hi")
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.coalesce(F.floor(ratio(F.col("_x") - F.col("lo"), step)), F.lit(0)) + 1
    counted = (
        rows.withColumn("bin", F.least(place, F.lit(bins)).cast("int"))
        .groupBy(*group, "bin", "lo", "hi")
        .agg(F.count("*").alias("n"))
    )
    return counted.select(
        *group,
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * step).alias("bin_lo"),
        (F.col("lo") + F.col("bin") * step).alias("bin_hi"),
        "n",
    )
