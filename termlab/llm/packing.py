"""Packing token sequences by patterns of few lengths, fitted by non-negative least squares.

The corpus is summed up as a histogram of piece lengths, at most ``capacity`` numbers,
whatever its size.  On the driver the plan is made from that histogram alone: patterns that fill a sequence, of up to
three length bins or of one or two bins many times over, are fitted to it, their counts are rounded down, and what is
left is packed best fit first into the gaps and new sequences.  Back in Spark each
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.llm.common import numbered, short_batches, texts_of, tidied
from termlab.llm.memo import WORD_BPE, crc32, word_encoder
from termlab.sources.tables import stage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-7) -> np.ndarray:
    """The x >= 0 of least ``|a x - b|``, by active sets (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    limit = tolerance * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        j = int(np.argmax(gain)) if n else 0
        if not n or gain[j] <= limit:
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 0).all():
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[(x[at] <= limit * 1e-6) & low]
            if not len(gone):
                gone = at[low][:1]
            x[gone] = 0
            active[gone] = False
        x[:] = 0
        x[at] = z
    return x


def patterns(n_bins: int) -> list[tuple[int, ...]]:
    """Every one, two or three bins (1 to ``n_bins``) that sum to ``n_bins``, longest first."""
    found: list[tuple[int, ...]] = [(n_bins,)]
    for i in range(n_bins - 1, 0, -1):
        rest = n_bins - i
        if rest <= i:
            found.append((i, rest))
        found += [(i, j, rest - j) for j in range(min(i, rest - 1), (rest + 1) // 2 - 1, -1) if rest - j >= 1]
    return found


def repeated(n_bins: int, some: Collection[int]) -> list[tuple[int, ...]]:
    """One or two of the bins ``some``, four pieces or more in all, that fill ``n_bins`` if pieces are as long as their bin's middle.

    Twice the middle of bin b is 2b - 1, so a pattern's bins sum to 2 ``n_bins`` or one less on that scale.
    """
    found = set()
    middles = sorted(2 * b - 1 for b in some)
    for total in (2 * n_bins, 2 * n_bins - 1):
        for i, u in enumerate(middles):
            for m in range(1, total // u + 1):
                rest = total - m * u
                if not rest:
                    found.add((*[(u + 1) // 2] * m,))
                for v in middles[:i]:
                    if rest and rest % v == 0:
                        found.add((*[(u + 1) // 2] * m, *[(v + 1) // 2] * (rest // v)))
    return sorted(p for p in found if len(p) > 3)


class _Pool:
    """Unplaced pieces: how many of each length, and which lengths there are."""

    def __init__(self, histogram: Mapping[int, int]) -> None:
        self.left = dict(histogram)
        self.lengths = sorted(self.left)

    def longest(self, upto: int, taken: list[int]) -> int:
        """The longest length up to ``upto`` with a piece besides those ``taken``, or 0."""
        i = bisect.bisect_right(self.lengths, upto) - 1
        while i >= 0 and self.left[self.lengths[i]] <= taken.count(self.lengths[i]):
            i -= 1
        return self.lengths[i] if i >= 0 else 0

    def between(self, low: int, high: int) -> list[int]:
        """The lengths above ``low`` up to ``high``."""
        return self.lengths[bisect.bisect_right(self.lengths, low) : bisect.bisect_right(self.lengths, high)]

    def most(self, low: int, high: int, taken: Mapping[int, int]) -> int:
        """The length above ``low`` up to ``high`` with most pieces besides those ``taken``, or 0."""
        best = max(self.between(low, high), key=lambda x: self.left[x] - taken.get(x, 0), default=0)
        return best if best and self.left[best] > taken.get(best, 0) else 0

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))


Pattern = tuple[tuple[int, int], ...]


def plan(histogram: Mapping[int, int], capacity: int, width: int = 16) -> list[tuple[Pattern, int]]:
    """Sequences as ((length, how many of it), ...) with their number.

    Every piece of ``histogram`` (lengths 1 to ``capacity``) is in exactly one; no sequence
    exceeds ``capacity``.  The fit sees bins of ``width`` lengths; :func:`_few` and :func:`_many` choose a fitted
    pattern's lengths.  Of the fit to all patterns and that to those of up to three
    bins alone, the one with fewer sequences counts.
    """
    done: list[tuple[Pattern, int]] = []
    lengths = {int(k): int(v) for k, v in histogram.items() if v}
    if capacity in lengths:
        done.append((((capacity, 1),), lengths.pop(capacity)))
    n_bins = capacity // width
    have = np.zeros(n_bins)
    for length, n in lengths.items():
        have[min(n_bins, -(-length // width)) - 1] += n
    some = {b + 1 for b in np.flatnonzero(have).tolist()}
    few = [p for p in patterns(n_bins) if some.issuperset(p)]
    # The shortest pieces are left to fill gaps.
    many = repeated(n_bins, some - {1})
    # A bin that no pattern fills a sequence with goes alone, as often as its longest piece fits.
    for b in sorted(some.difference({1}, *few, *many)):
        many.append((b,) * (capacity // max(x for x in lengths if min(n_bins, -(-x // width)) == b)))
    tries = [_fitted(lengths, have, usable, capacity, width) for usable in (few + many, few)]
    return done + min(tries, key=lambda planned: sum(n for _, n in planned))


def _fitted(
    lengths: Mapping[int, int], have: np.ndarray, usable: list[tuple[int, ...]], capacity: int, width: int
) -> list[tuple[Pattern, int]]:
    """Sequences by ``usable`` patterns, their repeats fitted to the bins' counts and rounded down, and the rest best fit."""
    a = np.zeros((len(have), len(usable)))
    for k, pattern in enumerate(usable):
        for b in pattern:
            a[b - 1, k] += 1
    fitted = nnls(a, have) if usable else np.zeros(0)
    pool, gaps = _Pool(lengths), {}
    for k in sorted(range(len(usable)), key=lambda k: (-fitted[k], k)):
        repeats = int(fitted[k] + 1e-6)
        while repeats > 0:
            content = (_few if len(usable[k]) <= 3 else _many)(pool, usable[k], capacity, width)
            if not content:
                break
            n = min(repeats, *(pool.left[x] // m for x, m in content.items()))
            for x, m in content.items():
                pool.take(x, n * m)
            gap = capacity - sum(x * m for x, m in content.items())
            gaps.setdefault(gap, []).append((tuple(content.items()), n))
            repeats -= n
    return _best_fit(pool.left, gaps, capacity)


def _few(pool: _Pool, pattern: tuple[int, ...], capacity: int, width: int) -> dict[int, int]:
    """Lengths for a pattern of up to three bins: the longest piece of each, and the longest that still fits for the last."""
    chosen: list[int] = []
    for b in pattern:
        rest = capacity - sum(chosen)
        last = len(chosen) == len(pattern) - 1
        length = pool.longest(rest if last else b * width, chosen)
        if length <= (b - 1) * width:
            return {}
        chosen.append(length)
    return {x: chosen.count(x) for x in chosen}


def _many(pool: _Pool, pattern: tuple[int, ...], capacity: int, width: int) -> dict[int, int]:
    """Lengths for a pattern of repeated bins: the commonest of each bin or near it, and for the last two pieces those that fill best."""
    taken: dict[int, int] = {}
    ahead = 0.0  # how much longer the pieces so far are than the middles of their bins
    for b in pattern[:-2]:
        low, middle, high = (b - 1) * width, (b - 0.5) * width, b * width
        half = (low, int(middle)) if ahead > 0 else (int(middle), high)
        # The last two pieces of other patterns may have emptied a bin before its own are done.
        near = (pool.most(*span, taken) for span in (half, (low, high), (low - width, high + width), (low - 3 * width, high + width)))
        length = next(filter(None, near), 0)
        if not length:
            return {}
        ahead += length - middle
        taken[length] = taken.get(length, 0) + 1
    rest = capacity - sum(x * m for x, m in taken.items())
    listed = [x for x, m in taken.items() for _ in range(m)]
    best: tuple[int, int, int] = (0, 0, 0)
    first = pattern[-2]
    span = pool.between((first - 3) * width, (first + 2) * width)
    for x in span:
        if x < rest and pool.left[x] > taken.get(x, 0):
            y = pool.longest(rest - x, [*listed, x])
            best = max(best, (x + y, pool.left[x], x))
    if not best[2]:
        return {}
    for x in (best[2], best[0] - best[2]):
        if x:
            taken[x] = taken.get(x, 0) + 1
    return taken


def _best_fit(
    left: Mapping[int, int], gaps: dict[int, list[tuple[Pattern, int]]], capacity: int
) -> list[tuple[Pattern, int]]:
    """Pack what is left, longest first, each into the smallest gap that takes it."""
    sizes = sorted(gaps)

    def put(gap: int, pattern: Pattern, n: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(sizes, gap)
        gaps[gap].append((pattern, n))

    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):
                put(capacity, (), -(-n // (capacity // length)))
                continue
            gap = sizes[i]
            pattern, m = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
            each = min(gap // length, n)
            use = min(m, n // each)
            put(gap - each * length, (*pattern, (length, each)), use)
            if m > use:
                put(gap, pattern, m - use)
            n -= use * each
    return [x for gap in sorted(gaps) for x in gaps[gap] if x[0]]


def places(planned: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """Ranks [``low``, ``high``) of the pieces of each ``length`` and where they go.

    Rank r goes to sequence ``first + (r - low) div each``, at ``at + (r - low) mod each * length``.
    """
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in planned:
        at = 0
        for length, each in pattern:
            low = used.get(length, 0)
            used[length] = low + n * each
            rows.append((length, low, low + n * each, each, first, at))
            at += each * length
        first += n
    return pd.DataFrame(rows, columns=["length", "low", "high", "each", "first", "at"], dtype="int64")


def pieces(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as token ids and ``end_id``, cut at ``capacity``.

    An empty or null text is the end id alone.
    """
    end = int(end_id).to_bytes(4, "little")

    @tidied
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            doc_ids = batch.column("doc_id").to_pylist()
            for first, found, ends in encoder.encode_texts(batch.column("text")):
                for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    ids = found[low:high].tobytes() + end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[start : start + 4 * capacity]
                        row = (doc_ids[first + i], k, start // 4, len(part) // 4, crc32(part))
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts_of(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str = WORD_BPE, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """:func:`pieces` with ``sequence_id`` and ``offset``, one row per piece.

    Rows with a null doc_id are packed like others.  Repeated rows are documents of their own, each with
    its own place; which copy has which is open, since they can't be told apart.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    with short_batches(spark):
        cut = stage(pieces(docs, tokenizer, end_id, capacity), "pieces")
    rows = stage(numbered(cut, ["length", "doc_id", "piece", "start", "ids_crc32"], "_position"), "ranked")
    # At most ``capacity`` rows, however large the corpus.
    sizes = sorted((r["length"], r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return rows.select(*rows.columns[:-1], F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    before = dict(zip((x for x, _ in sizes), np.cumsum([0] + [n for _, n in sizes]).tolist(), strict=False))
    table = places(plan(dict(sizes), capacity))
    table["low"] += table["length"].map(before)
    table["high"] += table["length"].map(before)
    where = F.broadcast(spark.createDataFrame(table).withColumnRenamed("length", "_length"))
    return (
        rows.join(where, (F.col("length") == F.col("_length")) & (F.col("_position") >= F.col("low")) & (F.col("_position") < F.col("high")))
        .withColumn("_rank", F.col("_position") - F.col("low"))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            F.expr("first + _rank div each").alias("sequence_id"),
            F.expr("at + _rank % each * length").alias("offset"),
        )
    )
