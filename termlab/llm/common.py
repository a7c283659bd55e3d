"""Row keys, global row numbers and small digests shared by the operators.

Every operator takes the columns it names from its input by selection, so further
columns, whatever their names, never meet its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termlab.sources.tables import stage


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def text_hash() -> Column:
    """Tells rows of one doc_id apart.  Rows alike in both are one document to an operator."""
    return F.xxhash64("text")


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, for work that makes much of each row in memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


Batches = Iterator[pa.RecordBatch]


def tidied(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` for ``mapInArrow`` that gives the memory of its batches back at the end.

    Spark keeps Python workers for later tasks, and Arrow keeps what its buffers took.
    """

    @wraps(work)
    def run(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python tasks started within get that many rows at a time: whole texts make large batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Adds gapless global row numbers from 0 in the order of ``order``, nulls first.

    Rows are range-partitioned once and staged, so that a task run again sees the
    same partitions.  Only one row per partition meets in one task, to sum up the
    partitions' sizes.  Equal keys are told apart by their place in the input, so a
    key that holds a large part of the rows is split too; which of such rows comes
    first is open, so ``df`` should hold nothing but ``order`` and what follows from it.
    """
    tie, part, within = f"_{name}_tie", f"_{name}_part", f"_{name}_within"
    keys = [*order, tie]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(
        shuffle_tasks(df.sparkSession), *keys
    )
    dealt = stage(dealt.withColumn(part, F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rows = dealt.withColumn(within, F.row_number().over(Window.partitionBy(part).orderBy(*keys)))
    # One row per partition: its number is a setting, not a matter of the data.
    return rows.join(F.broadcast(starts), part).select(
        *df.columns, (F.col("_start") + F.col(within) - 1).alias(name)
    )
