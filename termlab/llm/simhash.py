"""Near-duplicate texts by SimHash: pigeonhole blocks, block join, Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlab.llm.common import short_batches, text_hash, texts_of, tidied
from termlab.llm.components import components
from termlab.sources.tables import stage

BITS = 64
SEED = 42


def simhash(text: str, width: int = 3) -> int:
    """The 64-bit fingerprint of one text.

    A to Z are lower-cased and words are what stands between ASCII white space, which is
    what ``lower`` and ``split`` do on UTF-8 bytes.  Shingles of ``width`` words count as often
    as they occur; a shorter text is one shingle and one without words has fingerprint 0.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    last = ends[width - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    total, done = np.zeros(BITS, np.int64), 0
    while done < n:  # a long text goes through in parts
        upto = min(n, done + 65536)
        hashes = np.array(
            [digest(joined[s : e - 1], SEED) for s, e in zip(starts[done:upto], last[done:upto], strict=True)],
            np.uint64,
        )
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        done = upto
    ones = np.packbits(total * 2 > n)
    return int.from_bytes(ones.tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, text_hash, fingerprint`` (BIGINT holding the 64 bits), one row per document row.

    A null text counts as empty.
    """
    texts = texts_of(docs).withColumn("text_hash", text_hash())

    @tidied
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([simhash(t, width) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))],
                names=["doc_id", "text_hash", "fingerprint"],
            )

    return texts.mapInArrow(hashed, "doc_id bigint, text_hash bigint, fingerprint bigint")


def _block(value: Column | str, i: int, blocks: int) -> Column:
    """Bits of block ``i`` in place, the others 0."""
    low, high = i * BITS // blocks, (i + 1) * BITS // blocks
    mask = ((1 << high) - 1) ^ ((1 << low) - 1)
    return F.col(value).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))


def close_pairs(
    prints: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 32
) -> DataFrame:
    """Links ``a, b`` between the distinct values of BIGINT ``f`` that differ in up to ``distance`` bits.

    Values are cut into ``blocks`` blocks.  Two close ones agree in at least ``blocks - distance``
    of them, so they meet under one of the keys made of that many blocks; each meeting is then
    verified by its Hamming distance.  No close pair is missed.

    A key that more than ``crowd`` values share (thousands of edited copies) is not joined with
    itself.  Its values are cut further: each is listed with every set of up to ``distance // 2`` of
    its bits flipped, and values that meet there are at most ``distance`` apart.  There each is linked
    to the smallest only, so such a key gives rows in proportion to its values and yet joins the same
    classes.  ``distance`` is even for that reason.
    """
    if not 0 <= distance < blocks or distance % 2:
        raise ValueError("the distance is even and below the number of blocks")
    chosen = [*combinations(range(blocks), blocks - distance)]
    cut = [sum((_block("f", i, blocks) for i in c[1:]), _block("f", c[0], blocks)) for c in chosen]
    keyed = prints.select(
        "f", F.posexplode(F.array(*[F.xxhash64(F.lit(k), v) for k, v in enumerate(cut)])).alias("way", "key")
    )
    keyed = stage(keyed, "blocks")
    sizes = keyed.groupBy("way", "key").agg(F.count("*").alias("n")).where("n > 1")
    small = keyed.join(sizes.where(F.col("n") <= crowd).select("way", "key"), ["way", "key"])
    left, right = small.select("way", "key", F.col("f").alias("a")), small.select("way", "key", F.col("f").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = left.join(right, ["way", "key"]).where("a < b").where(apart <= distance).select("a", "b")

    large = keyed.join(sizes.where(F.col("n") > crowd).select("way", "key"), ["way", "key"]).select("f").distinct()
    flips = [sum(1 << i for i in c) for r in range(distance // 2 + 1) for c in combinations(range(BITS), r)]
    masks = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("bigint") for m in flips])
    near = large.select("f", F.explode(masks).alias("_m")).select("f", F.col("f").bitwiseXOR(F.col("_m")).alias("v"))
    first = near.groupBy("v").agg(F.min("f").alias("a"), F.count("*").alias("n")).where("n > 1")
    crowded = near.join(first.select("v", "a"), "v").where("f != a").select("a", F.col("f").alias("b"))
    return pairs.union(crowded).distinct()


def classified(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """``doc_id, text_hash, fingerprint, component, component_id``: the classes of all rows.

    Rows with one fingerprint are joined before the search, which sees every distinct
    fingerprint once.  ``component`` is the class's smallest fingerprint.
    """
    with short_batches(docs.sparkSession):
        rows = stage(fingerprints(docs, width), "fingerprints")
    distinct = stage(
        rows.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")), "distinct"
    )
    classes = components(close_pairs(distinct, distance, blocks))
    named = distinct.join(classes.withColumnRenamed("node", "f"), "f", "left").withColumn(
        "component", F.coalesce("component", "f")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select(F.col("f").alias("fingerprint"), "component", "component_id")
    return rows.join(ids, "fingerprint")


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id``: one row per document row.

    ``component_id`` is the smallest doc_id among documents joined by chains of fingerprints at
    most ``distance`` bits apart.  Rows with a null doc_id are classified like others but
    lend their class no name: a class of nothing else has a null component_id.  Repeated rows
    come out as often as they came in; an empty table gives no rows.
    """
    return classified(docs, width, distance, blocks).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """One row of ``docs`` for each class, with all its columns.

    It is the row of smallest doc_id (nulls last), then of smallest text hash; of rows alike in
    both any one stays.  A null text is an empty one; an empty table gives no rows.  Rows are carried as one struct, so no
    column of theirs, whatever its name, meets a helper's.  Rows that repeat both doc_id and text are reduced in each
    task before they move.
    """
    last = F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1))
    chosen = (
        classified(docs, width, distance, blocks)
        .groupBy("component")
        .agg(F.min(F.struct(last.alias("id"), F.col("text_hash").alias("hash"))).alias("k"))
        .select("k.*")
    )
    rows = docs.select(F.struct("*").alias("row"), last.alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    return rows.dropDuplicates(["id", "hash"]).join(chosen, ["id", "hash"], "left_semi").select("row.*")
