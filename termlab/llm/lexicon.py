"""Counts of the distinct words of whole texts, and the most frequent of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.llm.common import short_batches, tidied
from termlab.sources.tables import stage

HELD = 200_000  # distinct words a task counts before it hands them on
SLICE_BYTES = 1 << 20


def spaced(keep: bytes) -> bytes:
    """A table for ``bytes.translate``: A to Z lower-cased, ASCII outside ``keep`` a space, other bytes as they are."""
    lower = bytes(range(256)).lower()
    return bytes(b if b in keep or b > 127 else 32 for b in lower)


def slices(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts in UTF-8, nulls empty, as many at a time as ``SLICE_BYTES`` hold, or one that is longer."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    held, size = [], 0
    for text in texts:
        raw = text.as_py()
        if held and size + len(raw) > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def word_counts(
    df: DataFrame, column: str, words: Callable[[list[bytes]], list[bytes]], longest: int, shortest: int = 1
) -> DataFrame:
    """``word`` (binary) and ``n``, over all texts of ``column``: words of ``shortest`` to ``longest`` bytes.

    ``words`` cuts some texts at a time.  A task counts before anything moves and hands its counts on
    whenever it holds ``HELD`` words, so its memory is bounded.  The counts are staged.
    """

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if shortest <= len(w) <= longest]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for texts in slices(batch.column(0)):
                held.update(words(texts))
                if len(held) > HELD:
                    yield handed()
        yield handed()

    with short_batches(df.sparkSession):
        found = df.select(F.col(column).cast("string")).mapInArrow(counted, "word binary, n bigint")
        return stage(found.groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent(counts: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The words counted 2^k times or more with their counts, by word, for the least k that gives ``size`` words or fewer.

    Only they come to the driver, with one row for each k.
    """
    k = F.length(F.bin("n")) - 1
    classes = counts.groupBy(k.alias("k")).agg(F.count("*").alias("words")).collect()
    least, total = None, 0
    for row in sorted(classes, reverse=True):
        total += row["words"]
        if total > size:
            break
        least = row["k"]
    if least is None:
        return []
    rows = counts.where(F.col("n") >= F.lit(1 << least)).collect()
    return sorted((bytes(r["word"]), r["n"]) for r in rows)
