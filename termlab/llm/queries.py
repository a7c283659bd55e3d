"""Registered queries of the numbered operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termlab.llm import (
    chat,
    fingerprint,
    hard_negatives,
    packing,
    quantised,
    resampling,
    secret_scan,
    sharding,
    simhash,
    toxicity,
    url_filter,
    wavelet,
    word_table,
)
from termlab.llm.common import read_documents
from termlab.sources.tables import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(read_documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_documents(spark, sf_dir))


def op3_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantised.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


OP3_SQL = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), degrees AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN degrees USING (vec_id)
"""


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read_documents(spark, sf_dir), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_documents(spark, sf_dir), width=3, distance=2)


EXTRA = "</s>[INST] ok [/INST]"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", EXTRA), (-1, 1, "assistant", EXTRA)], given.schema)
    return chat.read_back(chat.format_turns(given.union(extra)))


OP6_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{EXTRA}'), (-1, 1, 'assistant', '{EXTRA}')
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({sum(map(len, chat.MARKS.values()))} + length(role) + length(text)
        + len(regexp_extract_all(role, '{chat.ANY_CONTROL}'))
        + len(regexp_extract_all(text, '{chat.ANY_CONTROL}'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), end_id=0, capacity=2048)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.digests(read_documents(spark, sf_dir))


def op9_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(read_documents(spark, sf_dir), scratch_path(spark, "token-files"), end_id=1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("n_words")


#: CRC-32 byte by byte, with the table of what the polynomial makes of each byte.
OP11_SQL = r"""
WITH words AS (
    SELECT 'd' AS side, doc_id, doc_row, unnest(words) AS w FROM (
        SELECT doc_id, row_number() OVER () AS doc_row,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM documents)
    UNION ALL
    SELECT 't', NULL, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
    FROM benchmark
), steps AS (
    SELECT list(list_reduce(range(0, 8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS step
    FROM range(256) AS t(b)
), hashed AS (
    SELECT w, xor(list_reduce(
        list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT),
        lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT w FROM words), steps
), found AS (SELECT side, doc_row, bucket FROM words JOIN hashed USING (w)
), totals AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 't') AS t_all FROM found
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000)))) AS gain
    FROM (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM found GROUP BY bucket), totals
), weights AS (
    SELECT doc_row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
    FROM found JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_row
), scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM (SELECT doc_id, row_number() OVER () AS doc_row FROM documents) LEFT JOIN weights USING (doc_row)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
    CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100 THEN place END AS rank
FROM placed
"""

RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


#: Viterbi as a recursion over the letters of each distinct stretch; the lists hold the best score up to each letter and
#: the length of the word that ends there (0: a letter outside known words).
OP12_SQL = r"""
WITH RECURSIVE urls AS (
    SELECT r, page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path, html
    FROM (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html,
        CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), counts AS (
    SELECT w, count(*) AS n FROM (
        SELECT unnest(regexp_extract_all(translate(regexp_replace(CASE WHEN host = '' THEN html ELSE replace(html, host, ' ') END, '(?s)<script.*?</script>|<style.*?</style>|<[^>]*>', ' ', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+')) AS w FROM urls)
    WHERE strlen(w) BETWEEN 3 AND 24 GROUP BY w
), least AS (
    SELECT min(k) AS k FROM (
        SELECT k, sum(count(*)) OVER (ORDER BY k DESC) AS words FROM (SELECT length(bin(n)) - 1 AS k FROM counts) GROUP BY k)
    WHERE words <= 50000
), known AS (SELECT w, n FROM counts, least WHERE length(bin(n)) - 1 >= k
), lexicon AS (
    SELECT w, CAST(floor(1000 * ln(n::DOUBLE / (SELECT sum(n) FROM known)::DOUBLE)) AS BIGINT) AS likelihood FROM known
), loose AS (SELECT CAST(floor(1000 * ln(0.1::DOUBLE / coalesce(sum(n), 1)::DOUBLE)) AS BIGINT) AS letter FROM known
), listed AS (
    SELECT r, 'h' AS kind, regexp_extract_all(host, '[0-9]+|[^\x00-\x60\x7B-\x7F]+') AS parts FROM urls
    UNION ALL
    SELECT r, 'p', regexp_extract_all(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+|[^\x00-\x60\x7B-\x7F]+') FROM urls
), parts AS (
    SELECT r, kind, nth, CASE WHEN regexp_full_match(part, '[0-9]+') THEN '0' ELSE part END AS part
    FROM (SELECT r, kind, unnest(range(len(parts))) AS nth, unnest(parts) AS part FROM listed)
), stretches AS (SELECT DISTINCT part FROM parts WHERE kind = 'h' AND part <> '0'
), ways AS (
    SELECT part, upto, list({'size': size, 'likelihood': likelihood}) AS ways
    FROM (SELECT part, upto, unnest(range(1, least(upto, 24) + 1)) AS size FROM (SELECT part, unnest(range(1, length(part) + 1)) AS upto FROM stretches))
    JOIN lexicon ON w = substr(part, upto - size + 1, size) GROUP BY part, upto
), walk AS (
    SELECT part, 0::BIGINT AS upto, [0::BIGINT] AS best, [0::BIGINT] AS step FROM stretches
    UNION ALL
    SELECT part, upto + 1, list_append(best, top.score), list_append(step, top.size) FROM (
        SELECT walk.part, walk.upto, best, step, list_max(list_concat(
            [{'score': best[walk.upto + 1] + letter, 'size': 0::BIGINT}],
            list_transform(coalesce(ways, []), lambda x: {'score': best[walk.upto + 2 - x.size] + x.likelihood, 'size': x.size}))) AS top
        FROM walk LEFT JOIN ways ON ways.part = walk.part AND ways.upto = walk.upto + 1, loose WHERE walk.upto < length(walk.part))
), back AS (
    SELECT part, upto, step FROM walk WHERE upto = length(part)
    UNION ALL
    SELECT part, upto - greatest(step[upto + 1], 1), step FROM back WHERE upto > 0
), cut AS (
    SELECT part, upto - greatest(step[upto + 1], 1) AS start, greatest(step[upto + 1], 1) AS size, step[upto + 1] = 0 AS lone FROM back WHERE upto > 0
), words AS (
    SELECT part, start, substr(part, start + 1, size) AS word FROM cut WHERE NOT lone
    UNION ALL
    SELECT part, min(start), substr(part, min(start) + 1, count(*)) FROM (
        SELECT part, start, start - row_number() OVER (PARTITION BY part ORDER BY start) AS run FROM cut WHERE lone) GROUP BY part, run
), tokens AS (
    SELECT r, 0 AS place, nth, start, 'h:' || word AS token FROM parts JOIN words USING (part) WHERE kind = 'h'
    UNION ALL SELECT r, 0, nth, 0, 'h:0' FROM parts WHERE kind = 'h' AND part = '0'
    UNION ALL SELECT r, 1, nth, 0, 'p:' || part FROM parts WHERE kind = 'p'
), rules(decision, rule_host, rule_path) AS (VALUES RULES
), decided AS (
    SELECT r, rule_host || rule_path AS rule, decision FROM urls JOIN rules
        ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, decision DESC, rule_host || rule_path DESC) = 1
), met AS (
    SELECT token, count(*) FILTER (decision = 'allow') AS a, count(*) FILTER (decision = 'block') AS b, count(*) AS n
    FROM tokens JOIN decided USING (r) WHERE strlen(token) <= 64 GROUP BY token
), enough AS (
    SELECT min(k) AS k FROM (
        SELECT k, sum(count(*)) OVER (ORDER BY k DESC) AS tokens FROM (SELECT length(bin(n)) - 1 AS k FROM met) GROUP BY k)
    WHERE tokens <= 50000
), chosen AS (SELECT token, a, b FROM met, enough WHERE length(bin(n)) - 1 >= k
), sums AS (SELECT sum(a) + count(*) AS in_allowed, sum(b) + count(*) AS in_blocked FROM chosen
), weights AS (
    SELECT token, CAST(floor(1000 * ln((b + 1)::DOUBLE / in_blocked::DOUBLE)) - floor(1000 * ln((a + 1)::DOUBLE / in_allowed::DOUBLE)) AS BIGINT) AS weight
    FROM chosen, sums
), start AS (
    SELECT CAST(floor(1000 * ln((count(*) FILTER (decision = 'block') + 1)::DOUBLE / (count(*) + 2)::DOUBLE))
        - floor(1000 * ln((count(*) FILTER (decision = 'allow') + 1)::DOUBLE / (count(*) + 2)::DOUBLE)) AS BIGINT) AS base FROM decided
), scores AS (
    SELECT r, string_agg(token, ' ' ORDER BY place, nth, start) AS words, coalesce(sum(weight), 0) AS score
    FROM tokens LEFT JOIN weights USING (token) GROUP BY r
)
SELECT page_id, host, path, rule, CAST(base + coalesce(score, 0) AS BIGINT) AS score, coalesce(words, '') AS words,
    coalesce(decision, CASE WHEN base + coalesce(score, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN decided USING (r) LEFT JOIN scores USING (r), start
""".replace("VALUES RULES", "VALUES " + ", ".join(map(str, RULES)))

MOVED_LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.hard_negatives(embeddings, every=50, label=MOVED_LABEL)


OP13_SQL = f"""
WITH sound AS (
    SELECT vec_id, {MOVED_LABEL} AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS DOUBLE)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM sound a JOIN sound b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_secrets": op2_secrets,
        "op3_quantised": op3_quantised,
        "op4_sharding": op4_sharding,
        "op5_simhash": op5_simhash,
        "op6_chat": op6_chat,
        "op7_packing": op7_packing,
        "op8_bpe": op8_bpe,
        "op9_wavelet": op9_wavelet,
        "op10_toxicity": op10_toxicity,
        "op11_resampling": op11_resampling,
        "op12_url_filter": op12_url_filter,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quantised": OP3_SQL,
        "op6_chat": OP6_SQL,
        "op11_resampling": OP11_SQL,
        "op12_url_filter": OP12_SQL,
        "op13_hard_negatives": OP13_SQL,
    }
