"""Byte-level BPE of whole texts by way of a table of distinct words.

Texts are cut into words where the tokenizer's own splitting can't reach across.  Documents go through in
blocks of bounded size.  Each block asks for its distinct words, dealt out by a hash of the word, so
that all blocks' requests for one word meet in one task, which encodes it once; the answers go
back to the blocks in the order asked, and each block puts the ids in the places of its words.
Decoding joins ids to the table of the vocabulary's pieces, whose size the vocabulary fixes: :func:`decode` as a
broadcast join of rows, and :func:`digests` within Arrow for the ids of distinct words.

Words travel once per block instead of once per occurrence, and texts travel compressed by block.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlab.llm.chat import BYTE_BPE
from termlab.llm.common import shuffle_tasks, texts_of
from termlab.llm.memo import SPELT, Tokenizer
from termlab.sources.tables import stage

BLOCK_BYTES = 24 << 20
KEEP = 400_000  # distinct words a task remembers before it starts anew

#: White space other than single spaces and line feeds, or what may begin it.
_ODD_BYTES = b"\0\t\v\f\r\x1c\x1d\x1e\x1f"
_ODD = (b"  ", b" \n", b"\n ", b"\n\n", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def words_of(text: str) -> list[bytes]:
    """The text cut where it may be: concatenated they give it back, encoded apart they give its ids.

    A space between two other characters that aren't white space begins a word, and a line feed between
    such stands alone.  Around any other white space, words are longer.
    """
    raw = text.encode()
    if (
        any(x in raw for x in _ODD)
        or len(raw.translate(None, _ODD_BYTES)) != len(raw)
        or raw[:1] in (b" ", b"\n")
        or raw[-1:] in (b" ", b"\n")
    ):
        return [w.encode() for w in _SAFE.split(text)] if text else []
    return raw.replace(b" ", b"\0 ").replace(b"\n", b"\0\n\0").split(b"\0") if raw else []


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def piece_table(path: str) -> pa.Table:
    """``id, piece, decimal`` of every id in order, whatever is no id with an empty piece.

    Byte-level vocabularies write each byte of a piece as one printable character.
    """
    byte = {chr(SPELT.get(b, b)): b for b in range(256)}
    tokenizer = library(path)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    table = [b""] * (max(tokenizer.get_vocab().values()) + 1)
    for token, i in tokenizer.get_vocab().items():
        table[i] = special[i].encode() if i in special else bytes(byte[c] for c in token)
    ids = range(len(table))
    return pa.table({"id": pa.array(ids, pa.int32()), "piece": pa.array(table, pa.binary()), "decimal": [str(i).encode() for i in ids]})


@lru_cache(maxsize=2)
def _piece_columns(path: str) -> tuple[pa.Array, pa.Array]:
    table = piece_table(path)
    return table.column("piece").combine_chunks(), table.column("decimal").combine_chunks().cast(pa.binary())


def _joined_to(column: pa.Array, counts: np.ndarray, ids: np.ndarray, between: bytes) -> list[bytes]:
    """For each word the rows of ``column`` that its ids meet, ``between`` each other.  Row i is that of id i."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(ends), column.take(pa.array(ids)))
    return pc.binary_join(words, pa.scalar(between, pa.binary())).to_pylist()


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list[str]]]:
    """Block number, doc_ids and texts; a block ends with the document that reaches ``size`` bytes."""
    part, k = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0
    for batch in batches:
        columns = (batch.column("doc_id"), batch.column("text"), pc.binary_length(batch.column("text")))
        for doc_id, text, length in zip(*(c.to_pylist() for c in columns), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += length
            if held >= size:
                yield part << 32 | k, ids, texts
                ids, texts, held, k = [], [], 0, k + 1
    if ids:
        yield part << 32 | k, ids, texts


def _asked(texts: list[str], buckets: int) -> list[list[bytes]]:
    """Distinct words of a block by bucket, in order."""
    distinct: set[bytes] = set()
    for text in texts:
        distinct.update(words_of(text))
    dealt: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in sorted(distinct):
        dealt[zlib.crc32(word) % buckets].append(word)
    return dealt


def _mark(words: list[bytes]) -> int:
    """Tells whether an answer is to the words at hand."""
    return xxhash.xxh64_intdigest(b"\0".join(words)) >> 1


REQUEST = "block bigint, bucket int, sizes array<int>, words binary"
ANSWER = "block bigint, bucket int, mark bigint, counts array<int>, ids array<int>"


def requests(texts: DataFrame, buckets: int, size: int) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, block_texts in _blocks(batches, size):
            dealt = _asked(block_texts, buckets)
            asked = [j for j, words in enumerate(dealt) if words]
            if asked:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(asked), pa.int64()),
                        pa.array(asked, pa.int32()),
                        pa.array([list(map(len, dealt[j])) for j in asked], pa.list_(pa.int32())),
                        pa.array([b"".join(dealt[j]) for j in asked], pa.binary()),
                    ],
                    names=["block", "bucket", "sizes", "words"],
                )

    return texts.mapInArrow(ask, REQUEST)


def answers(asked: DataFrame, tokenizer: str, buckets: int) -> DataFrame:
    """Every distinct word of a bucket is encoded once, whatever the number of blocks that ask for it."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = library(tokenizer), {}
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(row["sizes"]).tolist()
                words = [row["words"][s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
                new = [w for w in words if w not in known]
                if len(known) + len(new) > KEEP:
                    known, new = {}, words
                found = encoder.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
                known.update(zip(new, (np.array(x.ids, np.int32) for x in found), strict=True))
                ids = [known[w] for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]], pa.int64()),
                        pa.array([row["bucket"]], pa.int32()),
                        pa.array([_mark(words)], pa.int64()),
                        pa.array([[len(x) for x in ids]], pa.list_(pa.int32())),
                        pa.array([np.concatenate(ids)], pa.list_(pa.int32())),
                    ],
                    names=["block", "bucket", "mark", "counts", "ids"],
                )

    return asked.repartition(buckets, "bucket").mapInArrow(answer, ANSWER)


def _compressed(texts: DataFrame, size: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, block_texts in _blocks(batches, size):
            sink = pa.BufferOutputStream()
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(block_texts, pa.large_string())})
            dense = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
            with pa.ipc.new_stream(sink, table.schema, options=dense) as out:
                out.write_table(table)
            yield pa.RecordBatch.from_pydict({"block": [block], "texts": [sink.getvalue().to_pybytes()]})

    return texts.mapInArrow(pack, "block bigint, texts binary")


#: Makes a block's rows of its doc_ids, the words of text after text, and its distinct words with the number of ids of
#: each and all ids in a row.
Finish = Callable[[list, Iterator[list[bytes]], list[bytes], np.ndarray, np.ndarray], pa.Table]
#: Partitions that blocks are dealt into, for each of the session's shuffle tasks: most then hold one block or none.
SPREAD = 4


def joined(docs: DataFrame, finish: Finish, schema: str, tokenizer: str = BYTE_BPE, size: int = BLOCK_BYTES) -> DataFrame:
    """What ``finish`` makes of each block.

    The texts are cut into blocks twice, once to ask and once to be joined.  Should the input come in
    another order the second time, an answer doesn't bear the mark of its words, and
    the block encodes those words itself.
    """
    texts = texts_of(docs)
    buckets = shuffle_tasks(docs.sparkSession)
    replies = answers(requests(texts, buckets, size), tokenizer, buckets)

    def join(blocks: pa.Table, replied: pa.Table) -> pa.Table:
        by_bucket = {r["bucket"]: r for r in replied.select(["bucket", "mark"]).to_pylist()}
        row_of = {b: i for i, b in enumerate(replied.column("bucket").to_pylist())}
        out = []
        for blob in blocks.column("texts"):
            table = pa.ipc.open_stream(blob.as_buffer()).read_all()
            distinct: list[bytes] = []
            counts, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            block_texts = table.column("text").to_pylist()
            for j, words in enumerate(_asked(block_texts, buckets)):
                if not words:
                    continue
                distinct += words
                if j in by_bucket and by_bucket[j]["mark"] == _mark(words):
                    counts.append(replied.column("counts")[row_of[j]].values.to_numpy())
                    ids.append(replied.column("ids")[row_of[j]].values.to_numpy())
                else:
                    again = library(tokenizer).encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
                    counts.append(np.array([len(x.ids) for x in again], np.int32))
                    ids += [np.array(x.ids, np.int32) for x in again]
            by_text = map(words_of, block_texts)
            out.append(finish(table.column("doc_id").to_pylist(), by_text, distinct, np.concatenate(counts), np.concatenate(ids)))
        # Without texts there are answers to a block of another first pass only.
        none = np.zeros(0, np.int32)
        return pa.concat_tables(out) if out else finish([], iter(()), [], none, none)

    parts = SPREAD * buckets
    return (
        _compressed(texts, size)
        .repartition(parts, "block")
        .groupBy("block")
        .cogroup(replies.repartition(parts, "block").groupBy("block"))
        .applyInArrow(join, schema)
    )


def encode(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """``doc_id, ids``, one row per document row.  Null and empty texts have no ids."""

    def finish(doc_ids: list, texts: Iterator[list[bytes]], words: list[bytes], counts: np.ndarray, ids: np.ndarray) -> pa.Table:
        found = dict(zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True)) if words else {}
        none = np.zeros(0, np.int32)
        rows = [np.concatenate([found[w] for w in row]) if row else none for row in texts]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(rows, pa.list_(pa.int32()))})

    return joined(docs, finish, "doc_id bigint, ids array<int>", tokenizer)


def decode(encoded: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``, one row per row: each id is joined to its piece, and pieces go back by position.

    Null ids give an empty text, and so does an id outside the vocabulary or a null one.  Bytes that are no UTF-8 become
    replacement characters.  Pieces of a row meet in one task, as its text does.  The input is staged, so that
    the rows' numbers hold.
    """
    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")
    table = encoded.sparkSession.createDataFrame(piece_table(tokenizer).select(["id", "piece"]))
    # As many rows as the vocabulary has ids.
    spelt = (
        rows.select("row", F.posexplode("ids").alias("place", "id"))
        .join(F.broadcast(table), "id")
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"))
    )
    texts = spelt.select("row", _as_text(F.col("pieces.piece")).alias("text"))
    return rows.join(texts, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _as_text(pieces: Column) -> Column:
    """Pieces in a row as text, ill-formed bytes as Python's ``replace`` has them."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda v: b"".join(map(bytes, v)).decode("utf-8", "replace"))

    return text(pieces)


def digests(docs: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode` and :func:`decode` in one pass.

    The ids are written in decimal, joined by commas.  One row per document row; an empty table gives none.
    """

    def finish(doc_ids: list, texts: Iterator[list[bytes]], words: list[bytes], n: np.ndarray, ids: np.ndarray) -> pa.Table:
        pieces, decimals = _piece_columns(tokenizer)
        spelt = dict(zip(words, _joined_to(pieces, n, ids, b""), strict=True))
        listed = dict(zip(words, _joined_to(decimals, n, ids, b","), strict=True))
        counts, of_ids, of_text = [], [], []
        for row in texts:
            ids = b",".join([listed[w] for w in row])
            counts.append(ids.count(b",") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            text = b"".join([spelt[w] for w in row]).decode("utf-8", "replace")
            of_text.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "n_tokens": pa.array(counts, pa.int64()),
                "ids_sha256": pa.array(of_ids, pa.string()),
                "decoded_sha256": pa.array(of_text, pa.string()),
            }
        )

    return joined(docs, finish, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", tokenizer)
