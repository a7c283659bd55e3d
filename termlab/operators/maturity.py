"""Constant-maturity weights and prices by linear interpolation in days to maturity."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from termlab.schema import DAY, SYMBOL, TENORS, px, weights
from termlab.sources.tables import require_columns


def brackets(
    term: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = (), clamp: bool = True
) -> DataFrame:
    """The contracts on either side of every tenor, one row per (keys, day).

    Column ``b_<tenor>`` is a struct (d1, sym1, px1, d2, sym2, px2): the longest
    maturity not above the tenor and the shortest not below it, with the smallest
    symbol among equal maturities and its close.  A missing side takes the nearest
    maturity there is, or stops the job when ``clamp`` is off.

    All tenors come from one aggregate whose partial results are one row per
    (task, keys, day), so a crowded day is reduced before the shuffle.  Where symbols are whole numbers, maturity and
    symbol are packed into one BIGINT and the close goes along by it: all buffers are plain numbers, so rows are hashed
    and never sorted (symbols from 0 to 2^40 - 1, or the job stops).  Text symbols order as structs.
    """
    require_columns(term, [*keys, DAY, SYMBOL, "ttm_days"])
    close = "close" if "close" in term.columns else "CAST(NULL AS DOUBLE)"
    kind = term.schema[SYMBOL].dataType
    least = _least_packed(close, kind.simpleString()) if isinstance(kind, IntegralType) else _least_struct(close)

    ends = {"_shortest": (False, "true"), "_longest": (True, "true")}
    for t in tenors:
        ends |= {f"_lo_{t}": (True, f"ttm_days <= {t}"), f"_hi_{t}": (False, f"ttm_days >= {t}")}
    aggregates = [F.expr(x) for name, (down, where) in ends.items() for x in least.collected(name, down, where)]
    grouped = term.groupBy(*keys, DAY).agg(*aggregates)
    grouped = grouped.select(*keys, DAY, *[F.expr(least.unpacked(name, down)) for name, (down, _) in ends.items()])

    def bracket(t: int) -> str:
        below, above = f"coalesce(_lo_{t}, _shortest)", f"coalesce(_hi_{t}, _longest)"
        lowest = f"abs({below}.d)"
        if not clamp:
            message = f"concat('no contract on one side of {t} days on ', {DAY})"
            lowest = f"if(_lo_{t} IS NULL OR _hi_{t} IS NULL, raise_error({message}), {lowest})"
        return (
            f"named_struct('d1', {lowest}, 'sym1', {below}.sym, 'px1', {below}.px, "
            f"'d2', abs({above}.d), 'sym2', {above}.sym, 'px2', {above}.px) AS b_{t}"
        )

    return grouped.select(*keys, DAY, *[F.expr(bracket(t)) for t in tenors])


@dataclass(frozen=True)
class _Least:
    """How the row of least (or, downward, greatest) maturity and then least symbol is found: aggregates, and the
    struct (d, sym, px) made of their results, ``d`` negative for downward ones."""

    collected: Callable[[str, bool, str], list[str]]
    unpacked: Callable[[str, bool], str]


def _least_struct(close: str) -> _Least:
    def collected(name: str, down: bool, where: str) -> list[str]:
        row = f"named_struct('d', {'-' if down else ''}ttm_days, 'sym', {SYMBOL}, 'px', {close})"
        return [f"min(CASE WHEN {where} THEN {row} END) AS {name}"]

    return _Least(collected, lambda name, down: name)


_SYMBOL_BITS = 40


def _least_packed(close: str, kind: str) -> _Least:
    top = 1 << _SYMBOL_BITS
    symbol = f"if({SYMBOL} >= 0 AND {SYMBOL} < {top}, {SYMBOL}, raise_error('a symbol is no whole number below 2^{_SYMBOL_BITS}'))"

    def collected(name: str, down: bool, where: str) -> list[str]:
        packed = f"CASE WHEN {where} THEN {'-' if down else ''}ttm_days * {top}L + {symbol} END"
        return [f"min({packed}) AS {name}", f"min_by({close}, {packed}) AS {name}_px"]

    def unpacked(name: str, down: bool) -> str:
        fields = f"'d', shiftright({name}, {_SYMBOL_BITS}), 'sym', CAST({name} & {top - 1}L AS {kind}), 'px', {name}_px"
        return f"if({name} IS NULL, NULL, named_struct({fields})) AS {name}"

    return _Least(collected, unpacked)


def bracket_gaps(term: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, tenor, side, nearest, gap_days): the sides of tenors that a day has no contract for.

    ``side`` is ``below`` if the shortest maturity is longer than the tenor, ``above`` if the longest is shorter;
    ``nearest`` is the maturity that stands in when :func:`brackets` clamps, and ``gap_days`` how far it is.  Empty where
    a run with ``clamp`` off goes through; each row is a reason why it stops.  One aggregate of two integers per day.
    """
    require_columns(term, [*keys, DAY, "ttm_days"])
    ends = term.groupBy(*keys, DAY).agg(F.min("ttm_days").alias("_short"), F.max("ttm_days").alias("_long"))
    sides = ", ".join(
        f"if(_short > {t}, named_struct('tenor', {t}, 'side', 'below', 'nearest', _short), "
        f"if(_long < {t}, named_struct('tenor', {t}, 'side', 'above', 'nearest', _long), NULL))"
        for t in tenors
    )
    rows = ends.select(*keys, DAY, F.expr(f"explode(filter(array({sides}), x -> x IS NOT NULL)) AS _gap"))
    return rows.select(*keys, DAY, "_gap.*").withColumn("gap_days", F.expr("abs(tenor - nearest)"))


def _side_weights(t: int) -> tuple[str, str]:
    """Weights of the lower and the upper contract of a bracket, d1 < d2."""
    d1, d2 = f"b_{t}.d1", f"b_{t}.d2"
    return f"try_divide({d2} - {t}D, {d2} - {d1})", f"try_divide({t}D - {d1}, {d2} - {d1})"


def _weight(t: int) -> str:
    """Weight of a symbol at tenor ``t``, given the day's bracket on the row."""
    lower, upper = _side_weights(t)
    return f"""CASE WHEN b_{t}.d1 = b_{t}.d2 THEN if({SYMBOL} = b_{t}.sym1, 1D, 0D)
        WHEN {SYMBOL} = b_{t}.sym1 THEN {lower}
        WHEN {SYMBOL} = b_{t}.sym2 THEN {upper}
        ELSE 0D END"""


def _price(t: int) -> str:
    """Close of the two bracket contracts by weight; no other contract has any."""
    lower, upper = _side_weights(t)
    return f"""CASE WHEN b_{t}.d1 = b_{t}.d2 THEN coalesce(b_{t}.px1, 0D)
        ELSE coalesce(b_{t}.px1 * {lower}, 0D) + coalesce(b_{t}.px2 * {upper}, 0D) END"""


def bracket_weights(
    day: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, day, symbol, ``weight_<tenor>d``) of the contracts in any bracket of their day.

    At most two contracts per tenor, however many trade on the day.
    """
    sides = ", ".join(f"b_{t}.sym1, b_{t}.sym2" for t in tenors)
    held = day.select("*", F.expr(f"explode(array_distinct(array({sides}))) AS {SYMBOL}"))
    named = [F.expr(f"{_weight(t)} AS {name}") for t, name in zip(tenors, weights(tenors), strict=True)]
    return held.select(*keys, DAY, SYMBOL, *named)


def weights_from_brackets(
    term: DataFrame, day: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    """Contract rows plus ``weight_<tenor>d``, from the brackets of their day.

    The join is on (keys, day, symbol), unique on both sides, so a day that holds a
    large part of all rows is spread over tasks like any other.  Contracts outside
    every bracket have weight 0.
    """
    added = [F.expr(f"coalesce({name}, 0D) AS {name}") for name in weights(tenors)]
    joined = term.join(bracket_weights(day, tenors, keys), [*keys, DAY, SYMBOL], "left")
    return joined.select(*term.columns, *added)


def add_weights(
    term: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = (), clamp: bool = True
) -> DataFrame:
    """Contract rows plus ``weight_<tenor>d``; the weights of a day sum to 1 per tenor.

    One aggregate for all tenors and one join back.
    """
    return weights_from_brackets(term, brackets(term, tenors, keys, clamp), tenors, keys)


def prices_from_brackets(
    day: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = ()
) -> DataFrame:
    named = [F.expr(f"{_price(t)} AS {name}") for t, name in zip(tenors, px(tenors), strict=True)]
    return day.select(*keys, DAY, *named)


def constant_maturity_prices(
    term: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = (), clamp: bool = True
) -> DataFrame:
    """``px_<tenor>d`` per day straight from the contract rows: one shuffle, no join.

    Equal to :func:`add_weights` then :func:`prices_from_weights`, since only the
    bracket contracts carry weight and the aggregate has already kept their closes.
    """
    require_columns(term, ["close"])
    return prices_from_brackets(brackets(term, tenors, keys, clamp), tenors, keys)


def prices_from_weights(
    weighted: DataFrame,
    keys: Sequence[str] = (),
    price_col: str = "close",
    weight_prefix: str = "weight_",
    out_prefix: str = "px_",
) -> DataFrame:
    """Weighted price sum per day for every column found by ``weight_prefix``."""
    require_columns(weighted, [*keys, DAY, price_col])
    found = [c for c in weighted.columns if c.startswith(weight_prefix)]
    if not found:
        raise ValueError(f"no column of the table starts with {weight_prefix!r}")
    sums = [
        F.expr(f"coalesce(sum(`{price_col}` * `{c}`), 0D) AS `{out_prefix}{c.removeprefix(weight_prefix)}`")
        for c in found
    ]
    return weighted.groupBy(*keys, DAY).agg(*sums)


def weight_sums(
    weighted: DataFrame, tenors: Sequence[int] = TENORS, keys: Sequence[str] = (), tolerance: float = 1e-6
) -> DataFrame:
    """Per day: the weight sum of each tenor, and how many of them are not 1."""
    sums = [F.expr(f"sum({w}) AS sum_{t}d") for t, w in zip(tenors, weights(tenors), strict=True)]
    bad = " + ".join(f"if(abs(sum_{t}d - 1) > {tolerance}D, 1, 0)" for t in tenors)
    return weighted.groupBy(*keys, DAY).agg(*sums).withColumn("n_bad", F.expr(bad))
