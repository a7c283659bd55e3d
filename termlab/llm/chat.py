"""Chat formatting at token level: segments encoded apart, reserved ids spliced between them.

A conversation is, turn by turn, ``HEAD role SEP text END``.  The three marks are ids beyond
the vocabulary, so no text can produce them.  Where the marks are written out as text, a control
string that occurs inside a role or text gets a backslash in front, which :func:`unescape`
takes away again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termlab.llm.common import numbered, small_batches, tidied
from termlab.llm.memo import Tokenizer
from termlab.sources.tables import stage

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
HEAD, SEP, END = 50257, 50258, 50259
MARKS = {HEAD: "<|turn|>", SEP: "<|text|>", END: "<|end|>"}
#: Control strings of this template and of common others.
CONTROL = (*MARKS.values(), "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ANY_CONTROL = "|".join(re.sub(r"([|/<>\[\]])", r"\\\1", c) for c in CONTROL)
_ESCAPE = re.compile(rf"(\\*)({ANY_CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*)({ANY_CONTROL})")


def escape(text: str) -> str:
    r"""Put one more backslash before each control string.

    None of them holds a backslash, begins as another ends or lies within another, so the
    occurrences stay what they were and :func:`unescape` finds exactly these.
    """
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


@lru_cache(maxsize=2)
def library(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, position``: rows numbered over the whole table by conversation, turn (nulls first), role and text."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return numbered(turns, ["conv_id", "turn", "role", "text"], "position")


def splice(roles: list[list[int]], texts: list[list[int]], learn: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a conversation and its loss mask.

    The mask is a running sum over +1 where a text to be learnt begins and -1 behind its end mark.
    """
    parts: list[list[int]] = []
    for role, text in zip(roles, texts, strict=True):
        parts += [[HEAD], role, [SEP], text, [END]]
    ends = np.cumsum([len(p) for p in parts])
    ids = np.concatenate([np.asarray(p, np.int32) for p in parts]) if parts else np.zeros(0, np.int32)
    step = np.zeros(len(ids) + 1, np.int64)
    for k, wanted in enumerate(learn):
        if wanted:
            step[ends[5 * k + 2]] += 1
            step[ends[5 * k + 4]] -= 1
    return ids, np.cumsum(step)[:-1].astype(bool)


SAMPLES = "conv_id bigint, position bigint, ids array<int>, mask array<boolean>, n bigint"
STRETCH = 10_000  # turns whose lengths are summed up in one window


def format_turns(conversations: DataFrame, tokenizer: str = BYTE_BPE, learnt_role: str = "assistant") -> DataFrame:
    """``conv_id, position, ids, mask, n``: the training sample of each conversation, one row per turn, staged.

    A sample is its conversation's ``ids`` in order of ``position``; ``n`` is the number of a row's ids.
    ``mask`` marks the texts of ``learnt_role`` with their end marks.  Rows are ordered by turn (nulls
    first), then by role and text; repeated rows are turns of their own.  Null roles and texts are empty, and
    rows with a null conv_id make up one conversation.  An empty table gives no rows.

    No task holds a conversation: turns are numbered by a sort that splits long ones and encoded wherever they are.
    """

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(tokenizer)
        for batch in small_batches(batches):
            roles = batch.column("role").to_pylist()
            parts = []
            for texts in (roles, batch.column("text").to_pylist()):
                found = encoder.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)
                parts.append([x.ids for x in found])
            made = [splice([r], [t], [x == learnt_role]) for r, t, x in zip(*parts, roles, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    batch.column("position"),
                    pa.array([i for i, _ in made], pa.list_(pa.int32())),
                    pa.array([m for _, m in made], pa.list_(pa.bool_())),
                    pa.array([len(i) for i, _ in made], pa.int64()),
                ],
                names=["conv_id", "position", "ids", "mask", "n"],
            )

    turns = ordered_turns(conversations).select("conv_id", "position", "role", "text")
    return stage(turns.mapInArrow(tidied(assemble), SAMPLES), "turns")


def format_conversations(
    conversations: DataFrame, tokenizer: str = BYTE_BPE, learnt_role: str = "assistant"
) -> DataFrame:
    """:func:`format_turns` with ``start``, how many ids of the conversation come before the row, instead of ``n``.

    It is a running sum over stretches of ``STRETCH`` turns and then within them.
    """
    turns = format_turns(conversations, tokenizer, learnt_role).withColumn("stretch", F.expr(f"position div {STRETCH}"))
    sums = turns.groupBy("conv_id", "stretch").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("conv_id").alias("its_id"), F.col("stretch").alias("its_stretch"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")
    )
    # Most stretches hold many whole conversations, so they are dealt by both.
    order = Window.partitionBy("conv_id", "stretch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    brief = turns.select("conv_id", "stretch", "position", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("within"))
    same = F.col("conv_id").eqNullSafe(F.col("its_id")) & (F.col("stretch") == F.col("its_stretch"))
    starts = brief.join(sums, same).select(F.col("position").alias("at"), (F.col("before") + F.col("within")).alias("start"))
    return turns.join(starts, F.col("position") == F.col("at")).select("conv_id", "position", "start", "ids", "mask")


def parse(ids: np.ndarray, mask: np.ndarray, decoder: Tokenizer) -> tuple[list[tuple[str, str]], str, str]:
    """Turns, text under the mask and the written-out form, from a sample alone."""
    marks = np.flatnonzero(ids >= HEAD)
    turns: list[list[str]] = []
    learnt: list[str] = []
    written: list[str] = []
    bounds = [*marks.tolist(), len(ids)]
    for at, upto in zip(bounds[:-1], bounds[1:], strict=True):
        mark, segment = int(ids[at]), ids[at + 1 : upto]
        text = decoder.decode(segment.tolist(), skip_special_tokens=False) if len(segment) else ""
        written += [MARKS[mark], text]
        plain = unescape(text)
        if mark == HEAD:
            turns.append([plain, ""])
        elif mark == SEP:
            turns[-1][1] = plain
            if len(segment) and mask[at + 1 : upto].all():
                learnt.append(plain)
    return [(r, t) for r, t in turns], "".join(learnt), "".join(written)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, ids: np.ndarray, mask: np.ndarray, decoder: Tokenizer) -> None:
        turns, learnt, written = parse(ids, mask, decoder)
        self.n_turns += len(turns)
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode())
        self.loss_chars += len(learnt)
        self.loss.update(learnt.encode())
        self.formatted_chars += len(written)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(samples: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Digests of each conversation of :func:`format_turns`, decoded from its ids and masks.

    A digest runs over a conversation from its first turn to its last, so one task reads it, but a
    batch of turns at a time: memory doesn't grow with the conversation.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = library(tokenizer)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        current, digest, done = None, None, []

        def handed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(kinds)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in small_batches(batches):
            for conv_id, ids, mask in zip(
                batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("mask"), strict=True
            ):
                if digest is None or conv_id != current:
                    if digest:
                        done.append((current, *digest.row()))
                    current, digest = conv_id, _Digest()
                digest.add(ids.values.to_numpy(), mask.values.to_numpy(zero_copy_only=False), decoder)
            yield handed()
        if digest:
            done.append((current, *digest.row()))
        yield handed()

    rows = samples.select("conv_id", "position", "ids", "mask")
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return dealt.mapInArrow(tidied(read), DIGESTS)
