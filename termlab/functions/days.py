"""Several day tables as one frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.schema import DAY


def fold_days(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, day, all columns, ``_in_<name>`` of each table): one row per day that any table has.

    ``tables`` gives each table's name, rows (unique per key and day) and DOUBLE columns; the columns' names
    differ.  The tables are stacked and moved once by curve, and days are folded there, so that windows by curve that
    follow move nothing.  A column is NULL where its table has no such day.
    """
    columns = [c for _, names in tables.values() for c in names]
    flags = [f"_in_{name}" for name in tables]

    def widened(name: str, table: DataFrame, mine: Sequence[str]) -> DataFrame:
        values = [(F.col(c) if c in mine else F.lit(None)).cast("double").alias(c) for c in columns]
        return table.select(*keys, DAY, *values, *[F.lit(flag == f"_in_{name}").alias(flag) for flag in flags])

    rows = reduce(DataFrame.unionByName, [widened(name, *given) for name, given in tables.items()])
    rows = rows.repartition(*keys) if keys else rows
    return rows.groupBy(*keys, DAY).agg(*[F.max(c).alias(c) for c in (*columns, *flags)])
