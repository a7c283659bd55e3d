"""Every registered text query at sf0.001, by its contract, against plain Python; and the pipeline on awkward rows."""

from __future__ import annotations

import collections
import hashlib
import zlib

import numpy as np
import pytest
from awkward import ROWS
from pyspark.sql import functions as F
from test_texts import BYTE, WORD, base_spans, classes, fingerprint_of, sha

import __spark_entry__ as entry
import corpus_pipeline
from termlab.llm import secret_scan, sharding, simhash, toxicity
from termlab.sources.tables import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return {r.doc_id: r.text or "" for r in rows}


def rows_of(spark, name):
    return entry.queries()[name](spark, SF).collect()


def word_ids(text: str, end: int) -> np.ndarray:
    return np.array([*WORD.encode(text, add_special_tokens=False).ids, end], "<u4")


def test_op1(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op1_fingerprints")}
    ids = list(docs)
    assert list(got) and set(got) == set(ids)
    by_text = collections.defaultdict(set)
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, n = docs[i], len(docs[i]) // 4
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == sha(text[: len(text) - n] + docs[following][:n])
        by_text[text].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_op2(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op2_secrets")}
    assert set(got) == set(docs)
    for i, text in docs.items():
        spans = base_spans(text)
        listed = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i].base_sha256 == sha(listed)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(listed.split(",")) - {""} <= set(got[i].spans.split(","))


def test_op4(spark, docs):
    got = rows_of(spark, "op4_sharding")
    slots = collections.defaultdict(list)
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in got) == list(docs) and set(slots) == set(range(24))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op5(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op5_simhash")}
    prints = {i: fingerprint_of(t) for i, t in docs.items()}
    of = classes(sorted(set(prints.values())), 2)
    least = {}
    for i in sorted(docs):
        least.setdefault(of[prints[i]], i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {
        i: (f"{prints[i]:016x}", least[of[prints[i]]]) for i in docs
    }


def test_op7(spark, docs):
    got = rows_of(spark, "op7_packing")
    expected = {}
    for i, text in docs.items():
        ids = word_ids(text, 0)
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            expected[(i, k)] = (s, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1


def test_op8(spark, docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows_of(spark, "op8_bpe")}
    for i, text in docs.items():
        ids = BYTE.encode(text, add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(",".join(map(str, ids))), sha(BYTE.decode(ids, skip_special_tokens=False)))
    assert len(got) == len(docs)


def test_op9(spark, docs):
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op9_wavelet")}
    start, expected = 0, {}
    for i, text in docs.items():
        ids = word_ids(text, 1)
        expected[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == expected


def test_op10(spark, docs):
    got = {r.doc_id: r for r in rows_of(spark, "op10_toxicity")}
    assert set(got) == set(docs)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [i for i, toxic in labels.items() if i in got and toxic is not None and got[i].toxic != bool(toxic)]
    assert len(wrong) <= 0.05 * len(labels)


# --- awkward tables ---------------------------------------------------------------------

#: Names that helpers use or used within the operators.
NAMES = "id hash row spans merged clean found_id found_hash __id __hash __hash0 __text __m _hash text_hash copies position shard slot key part k"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, len(t or "")) for i, t in ROWS]
    plain = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    return plain.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce("text", F.lit("-"))).alias(n) for n in NAMES.split()])


def test_no_helper_column_meets_one_of_the_input(spark, clashing):
    labels = spark.createDataFrame([(2, 0), (9, 1)], "doc_id bigint, toxic int")
    for out in (simhash.keep_one(clashing), secret_scan.redact(clashing), toxicity.reject_toxic(clashing, labels)):
        assert out.columns == clashing.columns
        for r in out.collect():
            mine = next(t for i, t in ROWS if i == r.doc_id and (t or "")[:9] == (r.text or "")[:9])
            assert all(r[n] == f"{n} of {'-' if mine is None else mine}" for n in NAMES.split())
    assert secret_scan.redact(clashing).count() == len(ROWS)
    path = scratch_path(spark, "clash")
    sharding.write_shards(clashing, path, 3)
    back = spark.read.parquet(path)
    assert {"shard", "_shard", "slot", "_slot"} <= set(back.columns) and back.count() == len(ROWS)
    assert back.where("shard = concat('shard of ', coalesce(text, '-'))").count() == len(ROWS)


@pytest.fixture(scope="module")
def awkward_dir(spark, tmp_path_factory):
    """The awkward rows, copies, a text of two megabytes, and labels that repeat, lack ids or name no document."""
    folder = str(tmp_path_factory.mktemp("awkward"))
    long = " ".join(f"word{i % 5000} of {i}" for i in range(150_000))
    rows = [*ROWS, (50, long), (51, long), (52, long + " end")]
    rows += [(60 + i, "a group of copies that says the same thing again and again") for i in range(40)]
    table = [(i, t, "en", "hot", None if t is None else len(t)) for i, t in rows]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(table, schema).repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(2, 1, 0), (2, 1, 0), (None, 1, 1), (999, 0, 1), (60, 1, None), (7, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "some item text")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_pipeline_on_awkward_rows(spark, awkward_dir):
    folder, rows = awkward_dir
    got = corpus_pipeline.run(spark, folder).collect()
    # Without toxic labels among the documents nothing is toxic; of each class the least id stays, nulls last.
    prints = {t: fingerprint_of(t or "") for _, t in rows}
    of = classes(sorted(set(prints.values())), 2)
    best = {}
    for i, t in rows:
        best[of[prints[t]]] = min(best.get(of[prints[t]], (1 << 63) - 1), (1 << 63) - 1 if i is None else i)
    kept = {None if i == (1 << 63) - 1 else i for i in best.values()}
    assert {r.doc_id for r in got} == kept
    lengths = collections.defaultdict(int)
    for r in got:
        lengths[r.doc_id] += r.length
    long = next(t for i, t in rows if i == 50)
    assert lengths[50] == len(WORD.encode(long, add_special_tokens=False).ids) + 1
    fill = collections.Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_pipeline_on_an_empty_table(spark, awkward_dir, tmp_path):
    folder, _ = awkward_dir
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


TEXT_QUERIES = sorted(n for n in entry.queries() if n.startswith("op") and n.split("_")[0] in {f"op{k}" for k in (1, 2, 4, 5, 7, 8, 9, 10, 11)})


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_long_and_awkward_rows_come_out_once_each(spark, awkward_dir, name):
    folder, rows = awkward_dir
    out = entry.queries()[name](spark, folder)
    if name == "op7_packing":
        out = out.where("piece = 0")
    got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    assert got == collections.Counter(i for i, _ in rows)


def test_decoding_joins_ids_to_pieces(spark):
    """Whole texts by the join of ids to pieces, in a plan that has it; ids of no piece are left out."""
    from termlab.llm import word_table

    texts = ["naïve  text 中", "", "a\n\nb <|endoftext|>", "x" * 5000]
    rows = [(i, BYTE.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)]
    rows += [(90, [10**8, -1]), (91, None), (92, [None] + rows[0][1])]
    got = word_table.decode(spark.createDataFrame(rows, "doc_id bigint, ids array<int>"))
    assert "BroadcastHashJoin [id" in got._jdf.queryExecution().executedPlan().toString()
    expected = {**{i: BYTE.decode(ids, skip_special_tokens=False) for i, ids in rows[:4]}, 90: "", 91: "", 92: texts[0]}
    assert {r.doc_id: r.text for r in got.collect()} == expected


def test_one_conversation_is_spread_over_tasks(spark):
    """A third of all turns in one conversation: no partition of the formatted turns holds them all."""
    from termlab.llm import chat

    df = spark.range(6000).selectExpr("if(id % 3 = 0, 0, id) AS conv_id", "id AS turn", "'assistant' AS role", "concat('turn ', id) AS text")
    turns = chat.ordered_turns(df)
    parts = turns.where("conv_id = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1
    made = chat.format_conversations(df)
    hot = made.where("conv_id = 0").orderBy("position").collect()
    at = 0
    for r in hot:
        assert r.start == at
        at += len(r.ids)
    row = chat.read_back(made).where("conv_id = 0").first()
    said = [f"turn {i}" for i in range(0, 6000, 3)]
    assert (row.n_turns, row.loss_chars) == (2000, len("".join(said)))
    assert row.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
