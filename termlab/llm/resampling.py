"""Target-distribution importance resampling over hashed runs of words, read by an Aho-Corasick automaton.

The automaton knows frequent words between delimiters, each with its CRC-32 and length as payload.
One scan of a text gives the payloads of its words in order, and those of adjacent words are put together to the
CRC-32 of the run they make.  Words that the dictionary lacks are the ones no match covers; their payload is
computed on the spot, so the dictionary's size bears on speed alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlab.llm.common import numbered, short_batches, tidied
from termlab.llm.lexicon import frequent, slices, spaced, word_counts
from termlab.sources.tables import stage

DICTIONARY = 100_000  # words the automaton knows, at most
LONGEST = 48  # bytes of a word in the dictionary, at most
#: Words are runs of ASCII letters, digits and all that is not ASCII.
TABLE = spaced(b"abcdefghijklmnopqrstuvwxyz0123456789")
SEGMENT = 1 << 20
SPACE = 32


def _words(texts: list[bytes]) -> list[bytes]:
    return b" ".join(texts).translate(TABLE).split()


def _byte_steps() -> np.ndarray:
    """What CRC-32 makes of each byte value: its polynomial divided through eight bits."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1).astype(np.uint32)
    return steps


STEPS = _byte_steps()


def _followed_by_zeros(value: np.ndarray, power: int) -> np.ndarray:
    """CRC registers after 2^power further zero bytes."""
    tables = _zero_tables(power)
    return (
        tables[0][value & 255]
        ^ tables[1][(value >> np.uint32(8)) & 255]
        ^ tables[2][(value >> np.uint32(16)) & 255]
        ^ tables[3][value >> np.uint32(24)]
    )


@lru_cache(maxsize=64)
def _zero_tables(power: int) -> list[np.ndarray]:
    """For each byte of a register, what its values become after 2^power zero bytes: the map is linear over bits."""
    values = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    if power == 0:
        return [STEPS[v & 255] ^ (v >> np.uint32(8)) for v in values]
    return [_followed_by_zeros(_followed_by_zeros(v, power - 1), power - 1) for v in values]


def joined_by_space(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of ``left + " " + right`` from the parts' CRC-32 and the bytes of ``right``."""
    register = ~left.astype(np.uint32)
    crc = ~(STEPS[(register ^ np.uint32(SPACE)) & 255] ^ (register >> np.uint32(8)))
    for power in range(int(length.max()).bit_length() if len(length) else 0):
        some = (length >> power) & 1 == 1
        crc[some] = _followed_by_zeros(crc[some], power)
    return crc ^ right.astype(np.uint32)


class Scanner:
    """Payloads of the words of texts."""

    def __init__(self, dictionary: bytes) -> None:
        words = dictionary.split()
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, word in enumerate(words):
            # Bytes as characters of the same number: offsets are bytes.
            self._automaton.add_word(f" {word.decode('latin-1')} ", i)
        self._automaton.make_automaton()
        self._crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self._some = bool(words)

    def payloads(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC-32 and bytes of every word of ``joined``, which begins and ends with a delimiter."""
        spaces = joined.translate(TABLE)
        found, start = [], 0
        while start < len(spaces) - 1:
            end = spaces.find(b" ", min(start + SEGMENT, len(spaces) - 1))
            found.append(self._segment(spaces[start : end + 1], start))
            start = end
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def _segment(self, raw: bytes, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        space = np.frombuffer(raw, np.uint8) == SPACE
        first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        behind = np.flatnonzero(~space[:-1] & space[1:]) + 1
        crc = np.zeros(len(first), np.uint32)
        known = np.zeros(len(first), bool)
        if self._some:
            hits = np.fromiter(chain.from_iterable(self._automaton.iter(raw.decode("latin-1"))), np.int64)
            # A match ends at the delimiter behind its word.
            at = np.searchsorted(behind, hits[::2])
            crc[at] = self._crc[hits[1::2]]
            known[at] = True
        for i in np.flatnonzero(~known).tolist():
            crc[i] = zlib.crc32(raw[first[i] : behind[i]])
        return first + shift, crc, behind - first


@lru_cache(maxsize=1)
def _scanner(dictionary: bytes) -> Scanner:
    """One for each Python worker: tasks with the same dictionary share it."""
    return Scanner(dictionary)


@dataclass(frozen=True)
class Hashing:
    """Features are runs of 1 to ``longest_run`` words; ``buckets`` is what they are hashed to."""

    longest_run: int = 1
    buckets: int = 10_000
    dictionary: bytes = b""

    def of_slice(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text number and bucket of every feature, and the words of every text."""
        start, crc, length = _scanner(self.dictionary).payloads(b" " + b" ".join(texts) + b" ")
        begins = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
        text = np.searchsorted(begins, start, "right") - 1
        words = np.bincount(text, minlength=len(texts))
        run, places = crc, np.arange(len(crc))
        texts_of, buckets = [text], [run % np.uint32(self.buckets)]
        for k in range(1, self.longest_run):
            last = places + k
            inside = last < len(crc)
            places, last, run = places[inside], last[inside], run[inside]
            same = text[places] == text[last]
            places, last, run = places[same], last[same], run[same]
            run = joined_by_space(run, crc[last], length[last])
            texts_of.append(text[places])
            buckets.append(run % np.uint32(self.buckets))
        return np.concatenate(texts_of), np.concatenate(buckets).astype(np.int64), words


def bucket_counts(df: DataFrame, hashing: Hashing) -> dict[int, int]:
    """How many features of all texts fall into each bucket.  A task hands on one row per bucket at most."""

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(hashing.buckets, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                total += np.bincount(hashing.of_slice(texts)[1], minlength=hashing.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    with short_batches(df.sparkSession):
        found = df.select(F.col("text").cast("string")).mapInArrow(counted, "bucket bigint, n bigint")
        return {r["bucket"]: r["n"] for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target than in the source, rounded down."""
    s_all, t_all = float(sum(source.values())), float(sum(target.values()))
    found = [
        math.floor(
            1000 * math.log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((source.get(b, 0) + 1.0) * (t_all + buckets)))
        )
        for b in range(buckets)
    ]
    return np.array(found, np.int64)


def _noise(seed: str) -> Column:
    """A Gumbel draw of the row's doc_id, in thousandths, rounded down."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least_words: int = 20,
    longest_run: int = 1,
    buckets: int = 10_000,
    seed: str = "2024",
    dictionary: int = DICTIONARY,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank, n_words`` of every row of ``doc_id, text``.

    ``weight`` is the floored mean gain of the features' buckets towards ``target``'s ``text``; the ``percent`` of
    the rows of ``least_words`` words or more with the highest ``score`` (weight and a Gumbel draw) are ranked from 1,
    ties to the smaller doc_id, null ones first; the others' rank is null.

    Null and empty texts have no features and weight 0.  A null doc_id draws by an empty name.  Rows that repeat
    a doc_id are rows of their own; if they tie, either comes first.  Without documents there are no rows; an empty
    target leaves every bucket a count of 0.  Other columns, whatever their names, are left behind.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = frequent(word_counts(docs, "text", _words, LONGEST), dictionary)
    hashing = Hashing(longest_run, buckets, b" ".join(w for w, _ in known))
    gain = gains(bucket_counts(docs, hashing), bucket_counts(target, hashing), buckets)

    @tidied
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_features, weight, n_words = [], [], []
            for texts in slices(batch.column("text")):
                text, bucket, words = hashing.of_slice(texts)
                features = np.bincount(text, minlength=len(texts))
                # Sums of whole numbers below 2^53 are exact in doubles.
                total = np.bincount(text, gain[bucket], len(texts)).astype(np.int64)
                n_features.append(features)
                weight.append(total // np.maximum(features, 1))
                n_words.append(words)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (n_features, weight, n_words)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns)], names=["doc_id", "n_features", "weight", "n_words"]
            )

    schema = "doc_id bigint, n_features bigint, weight bigint, n_words bigint"
    with short_batches(docs.sparkSession):
        rows = docs.mapInArrow(weighed, schema).withColumn("score", (F.col("weight") + _noise(seed)).cast("bigint"))
        rows = stage(rows, "weights")
    drawn_from = F.col("n_words") >= least_words
    placed = numbered(rows.where(drawn_from).withColumn("falling", -F.col("score")), ["falling", "doc_id"])
    draws = percent * rows.where(drawn_from).count() // 100
    rank = F.when(F.col("position") < draws, F.col("position") + 1)
    shown = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*shown, rank.alias("rank"), "n_words").union(
        rows.where(~drawn_from).select(*shown, F.lit(None).cast("bigint").alias("rank"), "n_words")
    )
