"""Schema guard, Parquet stages and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise ``ValueError`` naming the absent columns.  Starts no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"The table lacks {', '.join(missing)}")


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if columns is None:
        return df
    require_columns(df, columns)
    return df.select(*columns)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Overwrite one Parquet stage.

    With ``partition_by`` the rows are rebalanced on those columns first, so a
    small partition becomes one file while a dominant one is split over many
    tasks.  ``sort_by`` orders rows inside each file; no global sort is done.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def scratch_base(checkpoints: str | None, warehouse: str, master: str) -> str:
    """The folder for staged tables: the one the cluster names for checkpoints, else the warehouse.

    A warehouse on a local disk is refused unless the master is local: other machines would not see it.
    """
    if checkpoints:
        return checkpoints.rstrip("/")
    on_disk = warehouse.startswith("file:") or "://" not in warehouse
    if on_disk and not master.startswith("local[") and master != "local":
        raise ValueError(
            f"staged tables need storage that all machines share: set spark.checkpoint.dir ({warehouse} is a local folder)"
        )
    return warehouse.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The session's own folder below :func:`scratch_base`."""
    context = spark.sparkContext
    base = scratch_base(
        spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"), context.master
    )
    return f"{base}/termlab-{context.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under :func:`scratch_root`, which is deleted when the session's JVM ends."""
    root = scratch_root(spark)
    if root not in _TIDIED:
        path, system = _hadoop(spark, root)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _TIDIED.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


#: Roots that will be deleted.
_TIDIED: set[str] = set()


def _hadoop(spark: SparkSession, name: str):
    """A Hadoop path and its file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(context._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this session staged, now.  Frames read from it end with it."""
    root = scratch_root(spark)
    path, system = _hadoop(spark, root)
    system.delete(path, True)
    _TIDIED.discard(root)


def name_by_folder(spark: SparkSession, path: str, prefix: str) -> None:
    """Name the files of a tree written with ``partitionBy`` after their folder ``<prefix><name>``: a rename, no copy."""
    root, system = _hadoop(spark, path)
    for folder in system.listStatus(root):
        name = folder.getPath().getName()
        if name.startswith(prefix):
            for i, file in enumerate(system.listStatus(folder.getPath())):
                old = file.getPath()
                if old.getName().startswith("part-"):
                    new = f"{folder.getPath().toString()}/{name.removeprefix(prefix)}-{i}.csv"
                    system.rename(old, _hadoop(spark, new)[0])


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage at a table several branches read; survives executor loss.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
