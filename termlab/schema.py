"""Column names and fixed values shared by all operators.

Grains
------
* bar       -- one intraday bar of one contract
* contract  -- unique on (keys, symbol, tradingDay)
* day       -- unique on (keys, tradingDay)
* rebalance -- unique on (keys, rebalance)

A day-grain curve holds at most one row per calendar day (about 250 a year), and
so does one contract.  Windows partitioned by the curve or by the contract are
therefore small whatever the size of the input.  The only other windows, in
``nearest_quantiles``, run over a stated number of rows or cells at most.
"""

from __future__ import annotations

from collections.abc import Sequence

DAY = "tradingDay"
SYMBOL = "symbol"

# They decide the results and must stay as they are.
TENORS = (30, 60, 90, 120, 150, 180)
MONTH_CODES = "FGHJKMNQUVXZ"  # January .. December
TARGET_HOUR, TARGET_MINUTE, TARGET_ZONE = 14, 55, "America/Chicago"
CENTURY_PIVOT = 79  # yy <= 79 is 20yy, above is 19yy
TRADING_DAYS = 252


def px(tenors: Sequence[int]) -> list[str]:
    return [f"px_{t}d" for t in tenors]


def returns(tenors: Sequence[int]) -> list[str]:
    return [f"r_px_{t}d" for t in tenors]


def carries(tenors: Sequence[int]) -> list[str]:
    return [f"carry_{t}d" for t in tenors]


def hedges(tenors: Sequence[int]) -> list[str]:
    return [f"w_px_{t}d" for t in tenors]


def weights(tenors: Sequence[int]) -> list[str]:
    return [f"weight_{t}d" for t in tenors]
