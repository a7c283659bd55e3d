"""Intraday bars from a tree of CSV files, one file per contract."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlab.schema import MONTH_CODES
from termlab.sources.tables import stage

# The columns a bar file must have.
BAR_COLUMNS = ("symbol", "timestamp", "tradingDay", "close")


def _header_reader():
    """First line of each file, read on the executors (nested: shipped by value)."""

    def first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def first_line(path: str) -> str:
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
            if uri.startswith("s3a://"):
                uri = "s3://" + uri[len("s3a://"):]
            filesystem, name = fs.FileSystem.from_uri(uri)
            line = b""
            with filesystem.open_input_stream(name) as stream:
                while b"\n" not in line:
                    chunk = stream.read(4096)
                    if not chunk:
                        break
                    line += chunk
            return line.split(b"\n", 1)[0].decode("utf-8-sig").rstrip("\r")

        for batch in batches:
            yield pd.DataFrame({"file_path": batch["file_path"], "header": batch["file_path"].map(first_line)})

    return first_lines


def header_table(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(file_path, header) of every matching file below ``root``.

    ``binaryFile`` without its ``content`` column lists files and reads none of
    them; only the first block of each file is then opened.  Paths are dealt evenly over tasks, since
    the listing groups files by their bytes.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(F.col("_metadata.file_path").alias("file_path"))
    )
    return files.repartition("file_path").mapInPandas(_header_reader(), "file_path string, header string")


def _csv_schema(header: str) -> tuple[str, bool]:
    """Positional DDL for a header, and whether it has all the bar columns."""
    names = next(csv.reader([header]), [])
    fields = []
    for position, name in enumerate(names):
        first = name in BAR_COLUMNS and name not in names[:position]
        kind = "DOUBLE" if name == "close" and first else "STRING"
        fields.append(f"`{name if first else f'_c{position}'}` {kind}")
    return ", ".join(fields), set(BAR_COLUMNS) <= set(names)


def symbol_from_file_name(file_name, root: str = "VI"):
    """``vif24.csv`` -> ``VIF24``; NULL when the name holds no contract code."""
    code = rf"(?i){root}([{MONTH_CODES}])(\d{{2}})"
    month, year = (F.regexp_extract(file_name, code, i) for i in (1, 2))
    return F.when(month != "", F.concat(F.lit(root), F.upper(month), year))


def symbol_from_path(file_path, root: str = "VI"):
    """:func:`symbol_from_file_name` of a path's last part."""
    return symbol_from_file_name(F.regexp_extract(file_path, "([^/]*)$", 1), root)


#: Files whose layouts are broadcast, at 24 bytes each; beyond that Spark chooses the join.
BROADCAST_FILES = 2_000_000


def _file_key(file_path) -> list:
    """Two 64-bit hashes of a path: narrow to ship, and together never the same for two files."""
    return [F.xxhash64(file_path).alias("_key"), F.xxhash64(file_path, F.lit("layout")).alias("_check")]


def read_bars(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Bars as (symbol, timestamp, tradingDay, close, file_path), text times, as the files have them.

    Files without the four columns are skipped.  Headers are read in one parallel job and staged; the driver sees
    the distinct ones.  One scan of the tree as lines follows, each line parsed by the layout of its file, which it finds
    by a narrow key; a file that arrives in between is left for the next run.  A line is a row: quoted line
    breaks are not supported.

    A symbol that the file doesn't give is NULL here; :func:`fill_symbols` names it after the bars are picked.
    """
    headers = stage(header_table(spark, root, glob), "headers")
    layouts = sorted(r["header"] for r in headers.select("header").distinct().collect())
    if not layouts:
        raise FileNotFoundError(f"{root} holds no file that matches {glob}")
    usable = {h: schema for h in layouts for schema, complete in [_csv_schema(h)] if complete}
    if not usable:
        raise ValueError(f"no file below {root} has all of {', '.join(BAR_COLUMNS)}")

    number = {h: i for i, h in enumerate(usable)}
    known = spark.createDataFrame([(h, i) for h, i in number.items()], "header string, layout int")
    files = headers.join(F.broadcast(known), "header").select(*_file_key("file_path"), "layout")  # one row per layout
    if headers.count() <= BROADCAST_FILES:
        files = F.broadcast(files)
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root)
        .select(
            F.regexp_replace("value", "^\ufeff|\r$", "").alias("line"),
            F.col("_metadata.file_path").alias("file_path"),
        )
    )
    rows = lines.select("*", *_file_key("file_path")).join(files, ["_key", "_check"])
    options = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = header = None
    for text, i in number.items():
        bar = F.from_csv("line", usable[text], options)
        fields = F.struct(*[bar[c].alias(c) for c in BAR_COLUMNS])
        here = F.col("layout") == i
        parsed = F.when(here, fields) if parsed is None else parsed.when(here, fields)
        header = F.when(here, F.lit(text)) if header is None else header.when(here, F.lit(text))
    rows = rows.where((F.col("line") != header) & (F.trim("line") != ""))
    return rows.select(parsed.alias("bar"), "file_path").select("bar.*", "file_path")


def fill_symbols(picked: DataFrame, root: str = "VI", strict: bool = False) -> DataFrame:
    """Rows with ``symbol`` and ``file_path``, the symbols of files that give none taken from the file's name.

    A file without a single symbol takes it from its name.  In a file with some, a row without keeps
    NULL; so does one whose file name holds no code.  ``strict`` stops the job on either.

    Meant for picked bars, one row per file, symbol and day: bars of a file without symbols form one group per day
    whether they are named before the pick or after it.  The rows are staged, so that the files are read
    once and only these few rows twice.
    """
    picked = stage(picked, "picked")
    unnamed = picked.groupBy("file_path").agg(F.max("symbol").alias("_any")).where("_any IS NULL")
    rows = picked.join(unnamed.select("file_path", F.lit(True).alias("_unnamed")), "file_path", "left")
    kind = picked.schema["symbol"].dataType
    symbol = F.coalesce("symbol", F.when(F.col("_unnamed"), symbol_from_path(F.col("file_path"), root)).cast(kind))
    if strict:
        message = F.concat(F.lit("no symbol can be found for a row of "), F.col("file_path"))
        symbol = F.coalesce(symbol, F.raise_error(message).cast(kind))
    return rows.withColumn("symbol", symbol).select(*picked.columns)
