"""Embeddings, conversations, the registered queries and the pipeline."""

from __future__ import annotations

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from compare import connect, difference, duck_rows, spark_rows

import __spark_entry__ as entry
import corpus_pipeline
from termlab.llm import chat, packing, quantised, queries, secret_scan, simhash, toxicity

SF = "/root/testdata/sf0.001"


# --- embeddings -------------------------------------------------------------------------


def brute_links(rows, threshold):
    def sound(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links = collections.defaultdict(set)
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1:]
            if sound(v, a) and sound(w, b) and a == b and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    return links


@pytest.mark.parametrize("tile", [5, 2048])
def test_near_duplicate_vectors(spark, tile):
    r = np.random.default_rng(3)
    seeds = r.normal(size=(5, 8))
    rows = []
    for i in range(90):
        v = seeds[i % 5] + r.normal(size=8) * r.choice([0.05, 0.3, 1.0])
        rows.append((i, (v * 10.0 ** r.integers(-3, 4)).tolist(), int(i % 2)))
    rows += [(100 + i, rows[0][1], 0) for i in range(4)]  # copies
    rows += [(7, rows[3][1], 1), (7, [1.0] * 8, None), (None, rows[0][1], 0)]  # repeated and null ids
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 8, 0), (203, [1.0, None] + [0.0] * 6, 0)]
    rows += [(204, [float("nan")] + [1.0] * 7, 0), (205, [float("inf")] + [1.0] * 7, 0), (206, [1.0, 2.0], 0)]
    links = brute_links(rows, 0.93)
    schema = "vec_id bigint, embedding array<double>, label int"
    got = quantised.near_duplicate_vectors(spark.createDataFrame(rows, schema), 0.93, tile).collect()
    seen, component = {}, {}
    for i in range(len(rows)):
        if i in seen:
            continue
        group, queue = [], [i]
        seen[i] = True
        while queue:
            x = queue.pop()
            group.append(x)
            for y in links[x]:
                if y not in seen:
                    seen[y] = True
                    queue.append(y)
        least = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
        component.update(dict.fromkeys(group, least))
    expected = collections.Counter((rows[i][0], len(links[i]), component[i]) for i in range(len(rows)))
    assert collections.Counter((x.vec_id, x.n_links, x.component_id) for x in got) == expected
    assert quantised.near_duplicate_vectors(spark.createDataFrame([], schema)).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(0)
    vectors = r.normal(size=(300, 16)) * (10.0 ** r.integers(-20, 20, size=(300, 1)))
    unit, codes, scale, error = quantised.quantise(vectors)
    true = unit @ unit.T
    about = (codes.astype(float) @ codes.T.astype(float)) * np.outer(scale, scale)
    bound = error[:, None] + error + error[:, None] * error
    assert (np.abs(true - about) <= bound + 1e-9).all()
    i, j = quantised.possible((unit, codes, scale, error), (unit, codes, scale, error), 0.5)
    assert set(zip(*np.nonzero(true >= 0.5), strict=True)) <= set(zip(i, j, strict=True))


# --- conversations ----------------------------------------------------------------------


def test_chat(spark):
    r = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\\\", " ", "é", "中", "hello", "<", "|", "[", "\n"]
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 5)):
            text = "".join(r.choice(parts) for _ in range(r.randint(0, 8)))
            rows.append((conv, turn, r.choice(["user", "assistant", "<|end|>", None]), text))
    rows += [(70, 0, "assistant", None), (70, None, "user", "first"), (70, 0, "assistant", None), (None, 3, "user", "no id")]
    rows += [(71, 1, "assistant", "word " * 20000)]
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame([(*x, "extra", 1) for x in rows], schema + ", ids string, mask int").repartition(3)
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(df)).collect()}
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        row = got[conv]
        learnt = "".join(t for _, a, t in turns if a == "assistant")
        everything = "".join(f"{a}\n{t}\n" for _, a, t in turns)
        written = sum(23 + len(chat.escape(a)) + len(chat.escape(t)) for _, a, t in turns)
        assert (row.n_turns, row.loss_chars, row.formatted_chars) == (len(turns), len(learnt), written)
        assert row.turns_sha256 == hashlib.sha256(everything.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


def test_escaping_is_reversible():
    r = random.Random(2)
    parts = [*chat.CONTROL, "\\", "\\", "x", " "]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 10)))
        assert chat.unescape(chat.escape(text)) == text


def test_masks_are_running_sums():
    ids, mask = chat.splice([[1], [2]], [[3, 4], [5]], [False, True])
    assert ids.tolist() == [chat.HEAD, 1, chat.SEP, 3, 4, chat.END, chat.HEAD, 2, chat.SEP, 5, chat.END]
    assert mask.tolist() == [False] * 9 + [True] * 2


# --- queries and pipeline ---------------------------------------------------------------


def test_all_are_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in queries.queries()}) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    left = spark_rows(queries.queries()[name](spark, SF))
    assert difference(left, duck_rows(connect(SF), queries.oracle_sql()[name])) is None


def test_pipeline_stages(spark):
    """Each stage against a plain account of what it should do to its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}

    model = toxicity.train(docs, labels)
    clean = stages["toxicity"](spark, docs, SF).checkpoint()
    kept = {i for i, t in texts.items() if model.above(model.score(t))[0] < 0.5}
    assert {r.doc_id for r in clean.collect()} == kept and clean.columns == docs.columns

    unique = stages["near_duplicates"](spark, clean, SF).checkpoint()
    prints = {i: simhash.simhash(texts[i]) for i in kept}
    least = {}
    for i in sorted(kept):
        least[i] = next((least[j] for j in sorted(least) if (prints[i] ^ prints[j]).bit_count() <= 2), i)
    assert {r.doc_id for r in unique.collect()} == {i for i in kept if least[i] == i}

    masked = stages["secrets"](spark, unique, SF).checkpoint()
    assert masked.columns == docs.columns
    spans = {r.doc_id: r.spans for r in secret_scan.spans(unique).collect()}
    for r in masked.collect():
        text, out, at = texts[r.doc_id], [], 0
        for s in spans.get(r.doc_id, []):
            if s.start >= at:
                out += [text[at : s.start], "[SECRET]"]
            at = max(at, s.end)
        assert r.text == "".join(out) + text[at:] and r.n_chars == len(r.text)

    packed = stages["packing"](spark, masked, SF).collect()
    assert {r.doc_id for r in packed} == {i for i in kept if least[i] == i}
    fill = collections.Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) * 1.01 + 2
    assert len(packed) == packing.pack(masked).count()
