"""Hard negatives by BOND: a vertical scan of columnar vectors that shrinks a candidate bitmap.

Rows are cut into tiles that hold their vectors by dimension.  An anchor reads a tile's dimensions in the
descending magnitude of its own components.  After some dimensions, what the unread ones can still add lies between
two sums made of the tile's least and greatest values in them; candidates whose score can no longer reach a
wanted window leave the bitmap, and the few that stay to the end have exact scores.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlab.llm.common import short_batches, shuffle_tasks, tidied
from termlab.sources.tables import stage

TILE = 4096  # rows of a tile
BLOCK = 512  # anchors of a block
CELL = 16  # tiles that a task holds at most
STRIDE = 8  # dimensions read between two looks at the bounds
MANY = 20  # one row in so many is enough to read a tile's dimensions whole
POSITIVE = "struct<positive_uid: bigint, positive_id: bigint, positive_score: bigint>"


def sound_vectors(embeddings: DataFrame, label: str) -> DataFrame:
    """``uid, vec_id, label, vector`` of the rows that take part, staged.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part.
    ``label`` is an expression over ``vec_id`` and ``label``.  ``uid`` tells rows that repeat a vec_id apart.
    """
    kind = embeddings.schema["embedding"].dataType.simpleString()
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("vector"),
    ).where(
        """vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0
           AND forall(vector, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"""
    )
    rows = rows.select("vec_id", F.expr(label).cast("bigint").alias("label"), "vector")
    return stage(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")


class Tile:
    """Some rows of one vector length: ids, labels, and a matrix with one line for each dimension."""

    def __init__(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, columns: np.ndarray) -> None:
        self.uid, self.vec_id, self.label, self.columns = uid, vec_id, label, columns
        self.low, self.high = columns.min(axis=1), columns.max(axis=1)
        self.labels = np.unique(label)


def _kind(anchors: np.ndarray, tile: Tile) -> type:
    """The narrowest number that holds every sum of products of the two exactly."""
    most = float(np.abs(anchors).max()) * float(max(abs(tile.low).max(), abs(tile.high).max())) * len(tile.low)
    if most < 1 << 24:
        return np.float32
    if most < 1 << 53:
        return np.float64
    if most < 1 << 62:
        return np.int64
    raise ValueError("The inner products of these vectors may exceed a BIGINT")


def bond(
    anchor: np.ndarray,
    tile: Tile,
    columns: np.ndarray,
    alive: np.ndarray,
    wanted: Callable[[np.ndarray, np.ndarray], np.ndarray],
) -> tuple[np.ndarray, np.ndarray]:
    """Places in the tile, and exact scores, of the candidates that ``wanted`` keeps to the end.

    ``alive`` is the bitmap to start from.  ``wanted(low, high)`` gets the bounds of the remaining candidates'
    scores and says which may still matter; with all dimensions read both are the score.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    anchor, low, high = (x.astype(columns.dtype) for x in (anchor, tile.low, tile.high))
    ends = np.stack([anchor * low, anchor * high])[:, order]
    # What dimensions from the i-th read on add at least and at most.
    least, most = (np.append(f(ends, axis=0)[::-1].cumsum(dtype=ends.dtype)[::-1], ends.dtype.type(0)) for f in (np.min, np.max))
    places = np.flatnonzero(alive)
    # While many candidates are left, whole dimensions are read: that is faster than picking theirs.
    every, score = True, np.zeros(len(alive), columns.dtype)
    for start in range(0, len(order), STRIDE):
        if every and len(places) * MANY < len(alive):
            every, score = False, score[places]
        read = order[start : start + STRIDE]
        score += anchor[read] @ (columns[read] if every else columns[read[:, None], places])
        done = min(start + STRIDE, len(order))
        theirs = score[places] if every and len(places) < len(alive) else score
        some = wanted(theirs + least[done], theirs + most[done])
        if not some.all():
            places = places[some]
            score = score if every else score[some]
        if not len(places):
            break
    return places, (score[places] if every else score).astype(np.int64)


def _reaching(n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Candidates that may be among the ``n`` highest: at least n others are sure to be as high as the cut."""

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if len(low) <= n:
            return np.ones(len(low), bool)
        return high >= np.partition(low, len(low) - n)[len(low) - n]

    return wanted


def _inside(windows: list[tuple[int, int]], n: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Candidates that may be among the ``n`` highest of a window: those that may lie in it, above its sure ones."""

    least, greatest = min(x for x, _ in windows), max(x for _, x in windows)
    widest = max(top - bottom for bottom, top in windows)
    joined = all(y <= top for (_, top), (y, _) in itertools.pairwise(sorted(windows)))

    def wanted(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        kept = (high >= least) & (low <= greatest)
        if joined and len(low) and (high - low).min() > widest:  # none is sure
            return kept
        places = np.flatnonzero(kept)
        low, high = low[places], high[places]
        some = np.zeros(len(places), bool)
        for bottom, top in windows:
            may = (high >= bottom) & (low <= top)
            sure = low[(low >= bottom) & (high <= top)]
            if len(sure) > n:
                may &= high >= np.partition(sure, len(sure) - n)[len(sure) - n]
            some |= may
        kept[places] = some
        return kept

    return wanted


def _highest(score: np.ndarray, vec_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties to the smaller vec_id."""
    return np.lexsort((vec_id, -score))[:n]


def _cut(rows: DataFrame, size: int, factor: int, extra: str = "", kind: str = "") -> DataFrame:
    """Rows in tiles of ``size`` at most, of one vector length and mostly of one label.

    ``part`` numbers the cells: the tiles that one partition made, ``CELL`` of them at most.  A label or vec_id with a
    large part of the rows is spread by the rows' ``uid``.  A tile's vectors, floor(factor * x) of each component, are
    one binary, dimension by dimension.  ``extra`` is a further column of type ``kind`` to take along.
    """
    keys = ["width", "label", "vec_id", "uid"]
    names = [extra] if extra else []
    tasks = shuffle_tasks(rows.sparkSession)
    dealt = rows.withColumn("width", F.size("vector")).repartitionByRange(tasks, *keys)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held, rows_held, made = [], 0, 0

        def cut(table: pa.Table) -> pa.RecordBatch:
            nonlocal made
            part, made = task + tasks * (made // CELL), made + 1
            vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            columns = np.floor(float(factor) * vectors.astype(np.float64).reshape(table.num_rows, -1).T)
            lists = [table.column(n).combine_chunks() for n in ("uid", "vec_id", "label", *names)]
            one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *one, pa.array([np.ascontiguousarray(columns).tobytes()], pa.binary())],
                names=["part", "uid", "vec_id", "label", *names, "columns"],
            )

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows_held
            table = pa.Table.from_batches(held)
            while table.num_rows:
                width = table.column("width").to_numpy()
                upto = min(size, int(np.searchsorted(width, width[0], "right")))
                if upto == table.num_rows and upto < size and not last:
                    break
                yield cut(table.slice(0, upto))
                table = table.slice(upto)
            held, rows_held = table.to_batches(), table.num_rows

        for batch in batches:
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held >= size:
                yield from full(False)
        if rows_held:
            yield from full(True)

    more = f" {extra} array<{kind}>," if extra else ""
    schema = f"part int, uid array<bigint>, vec_id array<bigint>, label array<bigint>,{more} columns binary"
    ordered = dealt.sortWithinPartitions(*keys).select(*keys, "vector", *names)
    with short_batches(rows.sparkSession):
        return stage(ordered.mapInArrow(tiles, schema), "tiles")


def _unpacked(batch: pa.RecordBatch, i: int) -> Tile:
    uid, vec_id, label = (batch.column(n)[i].values.to_numpy() for n in ("uid", "vec_id", "label"))
    columns = np.frombuffer(batch.column("columns")[i].as_py(), np.float64).reshape(-1, len(uid))
    return Tile(uid, vec_id, label, columns)


def _meet(blocks: DataFrame, tiles: DataFrame) -> DataFrame:
    """Every cell of tiles, and after it every block of anchors: a stated set of queries against all rows, in blocks.

    A cell is a partition of its own, and a block is copied once for each cell.  The copies are moved from task to task: there
    is no join that Spark may turn into a broadcast, as all copies together are many times what the staged blocks seem to be.
    """
    last = tiles.agg(F.max("part")).first()[0] or 0
    copied = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(last))))
    both = tiles.withColumn("anchors", F.lit(False)).unionByName(copied.withColumn("anchors", F.lit(True)), allowMissingColumns=True)
    return both.repartitionById(last + 1, "part").sortWithinPartitions("part", "anchors")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Tile, Tile, np.ndarray]]:
    """Blocks and tiles of one cell and one vector length, with the tile's columns in a sufficient kind of number."""
    cell, tiles = None, []
    for batch in batches:
        parts, anchors = (batch.column(n).to_pylist() for n in ("part", "anchors"))
        for i in range(batch.num_rows):
            if parts[i] != cell:
                cell, tiles = parts[i], []
            block = _unpacked(batch, i)
            if not anchors[i]:
                tiles.append(block)
                continue
            for tile in tiles:
                if len(block.low) == len(tile.low):
                    yield batch, i, block, tile, tile.columns.astype(_kind(block.columns, tile))


def nearest_of_label(blocks: DataFrame, tiles: DataFrame, n: int) -> DataFrame:
    """``uid, positive_uid, positive_id, positive_score``: an anchor's first ``n`` other rows of its label."""

    @tidied
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block, tile, columns in _pairs(batches):
            found = [[], [], [], []]
            for a in np.flatnonzero(np.isin(block.label, tile.labels)).tolist():
                alive = (tile.label == block.label[a]) & (tile.vec_id != block.vec_id[a])
                places, score = bond(block.columns[:, a], tile, columns, alive, _reaching(n))
                best = _highest(score, tile.vec_id[places], n)
                for x, new in zip(
                    found,
                    (np.full(len(best), block.uid[a]), tile.uid[places[best]], tile.vec_id[places[best]], score[best]),
                    strict=True,
                ):
                    x.append(new)
            if found[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x), pa.int64()) for x in found],
                    names=["uid", "positive_uid", "positive_id", "positive_score"],
                )

    schema = "uid bigint, positive_uid bigint, positive_id bigint, positive_score bigint"
    first = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "positive_uid")
    with short_batches(tiles.sparkSession, 8):
        found = stage(_meet(blocks, tiles).mapInArrow(scan, schema), "positives")
    return found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n).drop("place")


def in_windows(blocks: DataFrame, tiles: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """For each anchor and positive the first ``n`` rows of other labels with low * p <= 100 * score <= high * p."""

    @tidied
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, block, tile, columns in _pairs(batches):
            positives = batch.column("positives")[i].as_py()
            found = []
            for a in range(len(block.uid)):
                alive = tile.label != block.label[a]
                # The least and the greatest whole score that satisfy the two inequalities.
                windows = [(-(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in positives[a]]
                some = sorted({w for w in windows if w[0] <= w[1]})
                if not some or not alive.any():
                    continue
                places, score = bond(block.columns[:, a], tile, columns, alive, _inside(some, n))
                ids = tile.vec_id[places]
                for p, (bottom, top) in zip(positives[a], windows, strict=True):
                    fits = np.flatnonzero((score >= bottom) & (score <= top))
                    best = fits[_highest(score[fits], ids[fits], n)]
                    one = [block.uid[a], block.vec_id[a], p["positive_uid"], p["positive_id"], p["positive_score"]]
                    found += [(*one, ids[x], score[x]) for x in best]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=names)

    names = ["uid", "anchor_id", "positive_uid", "positive_id", "positive_score", "negative_id", "negative_score"]
    first = Window.partitionBy("uid", "positive_uid").orderBy(F.desc("negative_score"), "negative_id")
    with short_batches(tiles.sparkSession, 8):
        found = stage(_meet(blocks, tiles).mapInArrow(scan, ", ".join(f"{x} bigint" for x in names)), "negatives")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n)


def hard_negatives(
    embeddings: DataFrame,
    every: int,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    label: str = "label",
    factor: int = 256,
    tile: int = TILE,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the anchors of ``vec_id, embedding, label``.

    Scores are inner products of the vectors floor(factor * x), whole numbers; higher ones come first, ties by
    the smaller vec_id.  Anchors are the rows whose vec_id is divisible by ``every``.  An anchor's positives are its first rows
    of its label with another vec_id, and each positive's negatives the first rows of other labels with a score
    between ``low`` and ``high`` percent of the positive's; fewer if there are fewer.  ``label`` is an expression over
    ``vec_id`` and ``label`` that gives the label to go by.

    Rows with a null vec_id, label or vector, an empty vector, or a null or non-finite component take no part.
    Vectors meet those of their own length only.  Rows that repeat a vec_id are rows of their own, but never each
    other's positives.  Scores that may exceed a BIGINT are an error.  Without rows or anchors there are no results.  Other
    columns, whatever their names, are left behind.
    """
    rows = sound_vectors(embeddings, label)
    tiles = _cut(rows, tile, factor)
    anchors = rows.where(F.col("vec_id") % every == 0)
    nearest = nearest_of_label(_cut(anchors, block, factor), tiles, positives)
    wanted = nearest.groupBy("uid").agg(
        F.sort_array(F.collect_list(F.struct("positive_uid", "positive_id", "positive_score"))).alias("positives")
    )
    blocks = _cut(anchors.join(wanted, "uid"), block, factor, "positives", f"array<{POSITIVE}>")
    found = in_windows(blocks, tiles, negatives, low, high)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
