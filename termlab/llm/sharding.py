"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

A row's place is ``permutation(row number)``; its shard is that place modulo the shard
count and its slot the quotient.  Nothing but the row number, the row count and the
seed is needed to find either, so any row can be located without reading the others.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.functions.joins import unused
from termlab.llm.common import numbered

ROUNDS = 6  # double rounds
WALK = 64


def permuted(position: str, n_rows: int, seed: int = 1) -> str:
    """SQL for the place of row ``position`` (0 to ``n_rows`` - 1) in the shuffled order.

    The network works on pairs (l, r) with l < a and r < b, where a is the root of
    ``n_rows`` rounded up and a * b is at least ``n_rows`` and below ``n_rows`` + a.  A place beyond the
    last row is walked on through the permutation until it falls inside, which keeps
    it one to one.  A walk visits each of the fewer than a outside places once at most; it
    goes outside again with probability below 1 / a, so for large tables WALK steps fail with
    probability under a^-64.  Should that happen the query stops with an error.
    """
    a = max(1, math.isqrt(max(n_rows - 1, 0)) + 1)
    b = max(1, -(-n_rows // a))
    steps = min(a * b - n_rows + 1, WALK)
    halves = ", ".join(str(i) for i in range(2 * ROUNDS))
    once = f"""aggregate(array({halves}), named_struct('l', p div {a}L, 'r', p % {a}L),
        (h, i) -> named_struct('l', h.r, 'r',
            pmod(h.l + pmod(xxhash64(h.r, i, {int(seed)}), 1099511627776L), if(i % 2 = 0, {b}L, {a}L))),
        h -> h.l * {a}L + h.r)"""
    walked = f"""aggregate(sequence(1, {steps}), {position},
        (p, s) -> if(s > 1 AND p < {n_rows}L, p, {once}))"""
    return f"""aggregate(array({walked}), -1L, (z, p) ->
        if(p < {n_rows}L, p, raise_error('the walk left the table')))"""


def assign_shards(rows: DataFrame, position: str, n_rows: int, n_shards: int, seed: int = 1) -> DataFrame:
    """Adds ``shard`` and ``slot``; shards differ by one row at most and slots have no gaps."""
    place = F.expr(permuted(position, n_rows, seed))
    placed = rows.withColumn("_place", place)
    return placed.select(
        *rows.columns,
        (F.col("_place") % n_shards).cast("int").alias("shard"),
        F.expr(f"_place div {int(n_shards)}L").alias("slot"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 1) -> DataFrame:
    """One row per document row: ``doc_id, size, text_crc32, shard, slot``.

    Rows are numbered by ascending doc_id (nulls first), ties by checksum, size and hash
    of the text.  A null text has size 8 and the checksum of the empty text.  Repeated rows are
    rows of their own: each has its own slot, and which copy has which is open since
    they can't be told apart.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    brief = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
    )
    rows = numbered(brief, ["doc_id", "text_crc32", "size", "_hash"], "_position")
    n_rows = docs.count()
    return assign_shards(rows, "_position", n_rows, n_shards, seed).select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, seed: int = 1) -> None:
    """Write whole documents as ``shard=N`` folders, files being slot ranges in order.

    Documents meet their places on doc_id and text hash; repeated rows are told apart by number.  A column of the
    documents named ``shard`` or ``slot`` stays, and the place's gets underscores in front.  Null texts are written
    as they are; an empty table writes no folder.
    """
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    )
    counts = keyed.groupBy("id", "hash").agg(F.count("*").alias("copies"))
    rows = numbered(
        counts.select("id", "hash", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")),
        ["id", "hash", "copy"],
        "position",
    )
    placed = assign_shards(rows, "position", docs.count(), n_shards, seed)
    placed = placed.select(F.col("id").alias("its_id"), F.col("hash").alias("its_hash"), "shard", "slot")
    unique = keyed.dropDuplicates(["id", "hash"])
    same = F.col("id").eqNullSafe(F.col("its_id")) & (F.col("hash") == F.col("its_hash"))
    shard, slot = (unused(c, docs.columns) for c in ("shard", "slot"))
    out = unique.join(placed, same).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    dealt = out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    dealt.write.partitionBy(shard).parquet(path)
