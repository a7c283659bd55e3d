"""Token ids as wavelet matrix files: one compressed file per shard of whole documents.

File layout, all integers little-endian: the magic ``WVM1``; six unsigned 64-bit numbers
(tokens, documents, levels, and the byte lengths of the document table, the rank table and the
plane index); the document table (doc_id, has-a-doc_id flag and length of each document), the rank table
(per level the ones before each block of 512 bits, and the zeros of the level), the plane index
(byte length of each plane); then the bit planes from the highest bit down.  Tables and planes are
Zstandard frames, each readable without the others.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlab.llm.common import short_batches, shuffle_tasks, texts_of, tidied
from termlab.llm.memo import WORD_BPE, as_ids, crc32, word_encoder
from termlab.sources.tables import stage

MAGIC = b"WVM1"
HEAD = struct.Struct("<4s6Q")
BLOCK = 512
MANIFEST = "name string, part int, place int, n_docs bigint, n_tokens bigint"
DOCUMENTS = "name string, doc_id bigint, local_start bigint, n_tokens bigint, ids_crc32 bigint"


def _squeezed(data: bytes | np.ndarray) -> bytes:
    return pa.compress(memoryview(data), codec="zstd", asbytes=True)


def _unsqueezed(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of one shard.  ``known`` tells which documents have a doc_id."""
    n = len(ids)
    levels = max(1, int(ids.max(initial=0)).bit_length())
    current = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    planes, ranks = [], []
    for level in range(levels - 1, -1, -1):
        bits = (current >> level) & 1 != 0
        packed = np.packbits(bits)
        planes.append(_squeezed(packed))
        padded = np.zeros(-(-n // BLOCK) * BLOCK // 8, np.uint8)
        padded[: len(packed)] = packed
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
        before = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        ranks += [before.tobytes(), struct.pack("<Q", n - int(before[-1]))]
        # By places: a mask of evenly mixed bits takes numpy three times as long.
        current = np.concatenate([np.compress(~bits, current), np.compress(bits, current)])
    table = _squeezed(
        doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + lengths.astype("<u8").tobytes()
    )
    rank = _squeezed(b"".join(ranks))
    index = struct.pack(f"<{levels}Q", *map(len, planes))
    return b"".join([HEAD.pack(MAGIC, n, len(lengths), levels, len(table), len(rank), len(index)), table, rank, index, *planes])


class WaveletFile:
    """Queries on one file's bytes; a plane is unpacked when it is first needed."""

    def __init__(self, data: bytes) -> None:
        magic, self.n_tokens, self.n_docs, self.levels, table, rank, index = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = HEAD.size
        documents = _unsqueezed(data[at : at + table], 17 * self.n_docs)
        self.doc_ids = np.frombuffer(documents, "<i8", self.n_docs)
        self.known = np.frombuffer(documents, np.uint8, self.n_docs, 8 * self.n_docs).astype(bool)
        self.lengths = np.frombuffer(documents, "<u8", self.n_docs, 9 * self.n_docs).astype(np.int64)
        at += table
        counts = self.levels * (-(-self.n_tokens // BLOCK) + 2)
        ranks = np.frombuffer(_unsqueezed(data[at : at + rank], 8 * counts), "<u8").reshape(self.levels, -1)
        ranks = ranks.astype(np.int64)
        self._before, self._zeros = ranks[:, :-1], ranks[:, -1]
        at += rank
        sizes = struct.unpack_from(f"<{self.levels}Q", data, at)
        at += index
        ends = np.cumsum([at, *sizes]).tolist()
        self._data, self._spans = data, list(zip(ends[:-1], ends[1:], strict=True))
        self._planes: dict[int, np.ndarray] = {}

    def _plane(self, level: int) -> np.ndarray:
        if level not in self._planes:
            start, end = self._spans[level]
            self._planes[level] = np.frombuffer(_unsqueezed(self._data[start:end], -(-self.n_tokens // 8)), np.uint8)
        return self._planes[level]

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first ``i`` bits."""
        block = i // BLOCK
        first, last = block * BLOCK // 8, i >> 3
        plane = self._plane(level)
        within = int(np.bitwise_count(plane[first:last]).sum())
        rest = int(plane[last]) >> (8 - (i & 7)) if i & 7 else 0
        return int(self._before[level, block]) + within + rest.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) one or zero."""
        before = self._before[level]
        if not bit:
            before = np.minimum(np.arange(len(before)) * BLOCK, self.n_tokens) - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._plane(level)[block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        """The token at place ``i``."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value * 2 + bit
            i = int(self._zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among the first ``upto`` places end up."""
        if token >> self.levels:
            return 0, 0
        start, end = 0, upto
        for level in range(self.levels):
            s, e = self._ones(level, start), self._ones(level, end)
            if token >> (self.levels - 1 - level) & 1:
                start, end = int(self._zeros[level]) + s, int(self._zeros[level]) + e
            else:
                start, end = start - s, end - e
        return start, end

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs among the first ``i`` tokens."""
        start, end = self._range(token, i)
        return end - start

    def count(self, token: int) -> int:
        return self.rank(token, self.n_tokens)

    def select(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``token``."""
        start, end = self._range(token, self.n_tokens)
        if not 0 <= k < end - start:
            raise IndexError(k)
        i = start + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - int(self._zeros[level]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """All tokens in order, from the lowest plane up."""
        values = np.zeros(self.n_tokens, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self._plane(level), count=self.n_tokens).view(bool)
            zeros = int(self._zeros[level])
            above = np.empty_like(values)
            above[np.flatnonzero(~bits)] = values[:zeros]
            above[np.flatnonzero(bits)] = values[zeros:] | values.dtype.type(1 << (self.levels - 1 - level))
            values = above
        return values


def write_files(
    docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1, shard_tokens: int = 2_000_000
) -> DataFrame:
    """Write ``docs`` as wavelet matrix files under ``path`` and return their manifest.

    ``path`` must be storage all executors share.  Documents are in ascending doc_id order (nulls first, then by
    text hash) through the files in order of ``part, place``.  A file is closed at
    ``shard_tokens`` tokens, so no task holds more than that and one document.  Files are written under
    another name and moved, and a task run again writes the same files anew.
    """
    end = int(end_id).to_bytes(4, "little")
    sorted_texts = (
        texts_of(docs)
        .withColumn("_tie", F.xxhash64("text"))
        .withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(shuffle_tasks(docs.sparkSession), "doc_id", "_tie", "_row")
        .sortWithinPartitions("doc_id", "_tie", "_row")
        .select("doc_id", "text")
    )

    @tidied
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, store = word_encoder(tokenizer), _store(path)
        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"part-{part:06d}-{place:06d}.wvm"
            lengths = np.array([len(b) // 4 for _, b in held], np.int64)
            data = encode_file(
                as_ids(b"".join(b for _, b in held)),
                np.array([d or 0 for d, _ in held], np.int64),
                np.array([d is not None for d, _ in held], bool),
                lengths,
            )
            store.put(name, data)
            return pa.RecordBatch.from_pydict(
                {"name": [name], "part": pa.array([part], pa.int32()), "place": pa.array([place], pa.int32()),
                 "n_docs": [len(held)], "n_tokens": [int(lengths.sum())]}
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, found, ends in encoder.encode_texts(batch.column("text")):
                for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    held.append((doc_ids[first + i], found[low:high].tobytes() + end))
                    size += high - low + 1
                    if size >= shard_tokens:
                        yield flush()
                        place, size = place + 1, 0
                        held.clear()
        if held:
            yield flush()

    with short_batches(docs.sparkSession):
        return stage(sorted_texts.mapInArrow(write, MANIFEST), "manifest")


class _store:
    """Whole files in one folder of the file system that a URI or absolute path names."""

    def __init__(self, path: str) -> None:
        self._fs, self._folder = pafs.FileSystem.from_uri(path)
        self._fs.create_dir(self._folder, recursive=True)

    def put(self, name: str, data: bytes) -> None:
        hidden = posixpath.join(self._folder, f"_{name}-{uuid.uuid4().hex}")
        with self._fs.open_output_stream(hidden) as out:
            out.write(data)
        self._fs.move(hidden, posixpath.join(self._folder, name))


def read_documents(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files of ``manifest``.

    ``files`` has ``path`` and ``content`` of the folder's files.
    """

    @tidied
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                file = WaveletFile(content.as_py())
                encoded = file.tokens().astype("<u4").tobytes()
                ends = np.cumsum(file.lengths)
                starts = ends - file.lengths
                sums = [crc32(encoded[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([posixpath.basename(path.as_py())] * file.n_docs, pa.string()),
                        pa.array(file.doc_ids, mask=~file.known),
                        pa.array(starts),
                        pa.array(file.lengths),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["name", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    found = files.select("path", "content").mapInArrow(read, DOCUMENTS)
    # Sums over parts first, whose number is a setting, and within a part over its files.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("_in_part"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_in_part").over(upto), F.lit(0)).alias("_before"))
    before = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    within = manifest.select("name", "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_within"))
    starts = within.join(F.broadcast(parts), "part").select("name", (F.col("_before") + F.col("_within")).alias("_base"))
    return found.join(starts, "name").select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = 1) -> DataFrame:
    """Write the files under ``path`` and read every document back from them.

    A null text counts as empty and gives the end id alone.  Repeated rows are documents of their own, next
    to each other.  An empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    manifest = write_files(docs, path, tokenizer, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.wvm").load(path)
    return read_documents(files, manifest)
