"""Joining a table of one row per group to rows whose groups may be badly uneven."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(name: str, *taken: Iterable[str]) -> str:
    """``name``, with underscores in front until it is none of the ``taken`` column names, whatever their case."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name = f"_{name}"
    return name


def heavy_groups(sizes: DataFrame, on: Sequence[str], count: str, salts: str, tasks: int) -> DataFrame:
    """(on, salts) of the groups that hold more than one of ``tasks`` equal parts of all rows.

    ``salts`` is how many such parts a group fills, rounded up.  Fewer than ``tasks`` groups can be as large, whatever
    the data, and their salts add up to less than twice ``tasks``.
    """
    total = sizes.agg(F.sum(count)).scalar()
    parts = F.ceil(F.col(count) * F.lit(tasks) / total).cast("int")
    return sizes.select(*on, parts.alias(salts)).where(F.col(salts) > 1)


def salted_join(
    rows: DataFrame, per_group: DataFrame, on: Sequence[str], salt: Column, sizes: DataFrame | None = None
) -> DataFrame:
    """Inner join of ``per_group``, one row per group, to ``rows``, whose heavy groups are spread over tasks.

    Groups are counted first (or taken from ``sizes``: the ``on`` columns and a count); only those that
    would fill more than one of the session's shuffle tasks are dealt by ``salt``, and only their rows of ``per_group``
    are repeated, so that side grows by less than twice the shuffle width.  ``salt`` is an expression over ``rows``, not a
    random number, so that a task run again sends every row where it went before.  Spark turns
    the join into a broadcast where it measures few enough bytes.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = unused("_salt", rows.columns, per_group.columns)
    salts, count = f"{named}s", f"{named}_n"
    if sizes is None:
        sizes = rows.groupBy(*on).agg(F.count("*").alias(count))
    else:
        (given,) = [c for c in sizes.columns if c not in on]
        sizes = sizes.withColumnRenamed(given, count)
    # Fewer rows than the session has shuffle tasks.
    heavy = F.broadcast(heavy_groups(sizes, on, count, salts, tasks))
    known = F.coalesce(F.col(salts), F.lit(1))
    left = rows.withColumn(f"{named}_by", salt).join(heavy, [*on], "left")
    left = left.withColumn(named, F.pmod(F.xxhash64(f"{named}_by"), known).cast("int")).drop(salts, f"{named}_by")
    right = per_group.join(heavy, [*on], "left").withColumn(named, F.explode(F.sequence(F.lit(0), known - 1)))
    return left.join(right.drop(salts), [*on, named]).drop(named)
