"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 for documents labelled clean, 1 to ``GRADES`` for those labelled toxic, by
how much of their wording is typical of toxic documents.  One weight vector serves all
thresholds: P(grade <= k) = sigmoid(threshold_k - weights . features).  The expected severity
is the sum over k of P(grade > k).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.llm.common import small_batches, text_hash, texts_of, tidied
from termlab.sources.tables import stage

GRADES = 3
SAMPLE = 20_000  # labelled documents a model is fitted on, at most
FEATURES = 4096  # features a model has, at most
SCORES = "doc_id bigint, text_hash bigint, severity double, p_toxic double, grade int"
EDGES = b".,;:!?\"'()[]{}<>*_-#|/\\~`"


def features(text: str) -> set[bytes]:
    """Distinct features of a whole text: its words, and their first four, five and six letters.

    Words stand between ASCII white space; A to Z are lower-cased (other letters by
    ``str.lower``) and punctuation at the ends is cut.  Beginnings catch inflected words
    that no labelled document holds in that form.
    """
    found: set[bytes] = set()
    for word in set(text.lower().encode().split()):
        found |= _of_word(word)
    return found


def _of_word(word: bytes) -> set[bytes]:
    word = word.strip(EDGES)
    if not word:
        return set()
    letters = word.decode()
    return {word, *(b"^" + letters[:n].encode() for n in (4, 5, 6) if len(letters) > n)}


@dataclass
class OrdinalModel:
    """Thresholds and one weight per feature; without toxic labels it grades everything 0."""

    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (math.inf,) * GRADES
    _met: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, repr=False, compare=False)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        hits: set[bytes] = set()
        met = self._met
        for word in set(text.lower().encode().split()):
            known = met.get(word)
            if known is None:
                if len(met) > 50_000:
                    met.clear()
                known = met[word] = tuple(x for x in _of_word(word) if x in self.weights)
            if known:
                hits.update(known)
        return sum(self.weights[x] for x in sorted(hits))

    def above(self, score: float) -> list[float]:
        """P(grade > k) for each k."""
        if not self.weights:
            return [0.0] * GRADES
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 0.1, rounds: int = 500
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds that maximise the penalised likelihood.

    ``rows`` holds the features of each document.  Gradient steps with momentum on all rows; thresholds are
    the first plus exponentials of steps, so their order holds by construction.
    """
    n, k = len(rows), GRADES
    which = np.repeat(np.arange(n), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.intp) if n else np.zeros(0, np.intp)
    share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - share) / share)
    free = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    w = np.zeros(n_features)
    first, second = np.zeros(n_features + k), np.zeros(n_features + k)
    for t in range(1, rounds + 1):
        thresholds = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        score = np.bincount(which, w[column], n)
        # Each threshold parts the grades above it from those up to it.
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -40, 40)))  # P(grade > j)
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        likely = np.maximum(full[at, grades] - full[at, grades + 1], 1e-12)
        slope = full * (1 - full)
        by_score = (slope[at, grades] - slope[at, grades + 1]) / likely
        by_threshold = np.zeros(k)
        for j in range(k):
            by_threshold[j] = (slope[grades == j, j + 1] / likely[grades == j]).sum() - (
                slope[grades == j + 1, j + 1] / likely[grades == j + 1]
            ).sum()
        grad_w = np.bincount(column, by_score[which], n_features) - penalty * w
        grad_free = np.concatenate(
            [[by_threshold.sum()], [by_threshold[i:].sum() * np.exp(free[i]) for i in range(1, k)]]
        )
        g = np.concatenate([grad_w, grad_free]) / max(1, n)
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        step = 0.1 * (1 - 0.9 * t / rounds) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-10)
        w, free = w + step[:n_features], free + step[n_features:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, toxic, text`` of up to ``sample`` labelled documents, chosen by a hash of their doc_id.

    Labels that repeat a doc_id count once, toxic if one says so; null labels and ids don't count.
    Of rows that repeat a doc_id, the one with the text of least hash stands for all, so ``sample`` bounds rows.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = texts_of(docs).join(F.broadcast(known), "doc_id").withColumn("hash", text_hash())
    # Only numbers are aggregated.  One row per labelled id, so the bound of the sample bounds the broadcast too.
    least = F.broadcast(rows.groupBy("doc_id").agg(F.min("hash").alias("hash")))
    chosen = rows.join(least, ["doc_id", "hash"])
    # Rows alike in both are one document: any of them has the text.
    return chosen.dropDuplicates(["doc_id", "hash"]).select("doc_id", "toxic", "text")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES) -> OrdinalModel:
    """A model fitted on :func:`labelled` documents.

    Features are counted in Spark; the ``n_features`` with the largest chi-squared statistic against the
    label, in three documents at least, come to the driver with the sample's rows.
    """

    @tidied
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [sorted(features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.list_(pa.binary()))],
                names=["doc_id", "toxic", "features"],
            )

    rows = labelled(docs, labels, sample).mapInArrow(listed, "doc_id bigint, toxic int, features array<binary>")
    rows = stage(rows, "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return OrdinalModel()
    counts = (
        rows.select("toxic", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("b"), F.count("*").alias("n"))
        .where("n >= 3")
    )
    a, b, n = F.col("n") - F.col("b"), F.col("b"), F.col("n").cast("double")
    odds = a * F.lit(float(n1)) - b * F.lit(float(n0))
    chi = odds * odds * float(n0 + n1) / (n * (F.lit(float(n0 + n1)) - n + 1e-9) * float(n0) * float(n1))
    best = counts.select("feature", "b", "n", chi.alias("chi")).orderBy(F.desc("chi"), "feature").limit(n_features)
    chosen = best.collect()
    number = {bytes(r["feature"]): i for i, r in enumerate(chosen)}
    typical = np.array([r["b"] / n1 > 20 * max(r["n"] - r["b"], 0.5) / n0 for r in chosen])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            kept = [[number[x] for x in row if x in number] for row in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(kept, pa.list_(pa.int32()))], names=["toxic", "kept"]
            )

    got = rows.mapInArrow(encoded, "toxic int, kept array<int>").toArrow().combine_chunks()
    toxic, lists = got.column("toxic").to_numpy(), got.column("kept").combine_chunks()
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    found = [values[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
    # In an order of their own, so that sums don't depend on which task ended first.
    order = sorted(range(len(found)), key=lambda i: (toxic[i], found[i].tobytes()))
    sparse, toxic = [found[i] for i in order], toxic[order]
    weight = np.array([typical[r].sum() for r in sparse])
    cuts = np.quantile(weight[toxic == 1], [(i + 1) / GRADES for i in range(GRADES - 1)])
    grades = np.where(toxic == 1, 1 + (weight[:, None] > cuts).sum(axis=1), 0)
    w, thresholds = fit_ordinal(sparse, grades, len(number))
    del got, lists, values, found, sparse
    pa.default_memory_pool().release_unused()
    return OrdinalModel({x: float(w[i]) for x, i in number.items()}, tuple(float(t) for t in thresholds))


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, text_hash, severity, p_toxic, grade`` of every document row, over its whole text.

    ``severity`` is the expected grade, ``p_toxic`` the probability of a grade above 0 and ``grade`` the
    highest one that is as likely reached as not.  A null or empty text is graded by the thresholds alone.  Repeated
    rows and null doc_ids are graded like others, other columns are left behind, and an empty table gives no rows.
    """
    texts = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))

    @tidied
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            above = [model.above(model.score(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([sum(p) for p in above], pa.float64()),
                    pa.array([p[0] for p in above], pa.float64()),
                    pa.array([sum(x >= 0.5 for x in p) for p in above], pa.int32()),
                ],
                names=["doc_id", "text_hash", "severity", "p_toxic", "grade"],
            )

    return texts.mapInArrow(scored, SCORES)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`grade` by a model trained on ``labels``, with the decision ``toxic`` (a grade above 0).

    Without labelled documents of both kinds all are graded 0; an empty table gives no rows.
    """
    return grade(docs, train(docs, labels)).select(
        "doc_id", "severity", "p_toxic", "grade", (F.col("grade") > 0).alias("toxic")
    )


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with all their columns, without the rows whose text is toxic.  Moves no row.

    A null text is an empty one and never toxic by its words.  Repeated rows stay or go together; an empty table, or one
    without toxic labels, stays as it is.
    """
    model = train(docs, labels)

    @tidied
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([model.above(model.score(t or ""))[0] < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
