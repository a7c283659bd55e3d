"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document is the multiset of its lower-cased words; a word's weight is its count.  Sample k draws
for each word r and c from Gamma(2, 1) and b from U(0, 1), all from a hash of word and k.  A word of
weight w gets t = floor(ln w / r + b) and the value ln c - r (t - b + 1); the smallest wins.  Two
documents have the same winner, word and t, with a probability equal to the generalised
Jaccard similarity of their weights (sum of minima over sum of maxima).  Since the value is
settled by word, t and k, the smallest value itself stands for the winner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termlab.functions.joins import heavy_groups
from termlab.llm.common import numbered, shuffle_tasks, text_hash, texts_of
from termlab.sources.tables import stage

SAMPLES = 64
PER_ROW = 8  # samples taken in one pass over a word
DIGITS = 4  # hexadecimal digits kept of each sample
SPACE = r"[\x20\x09-\x0D]+"


def _draw(k: str, word: str = "h") -> str:
    """SQL for the struct (r, b, c): -r, b and ln c of a word hash and sample number."""
    # Products of two uniforms; their logarithms are minus a Gamma(2, 1) variate.
    low = "4294967295L"
    one = f"xxhash64({word}, {k})"
    two = f"xxhash64({k}, {word})"
    u12 = f"((shiftrightunsigned({one}, 32) + 0.5D) * (({one} & {low}) + 0.5D) / 18446744073709551616D)"
    u34 = (
        f"((shiftrightunsigned({two}, 40) + 0.5D) * ((shiftrightunsigned({two}, 16) & 16777215L) + 0.5D)"
        " / 281474976710656D)"
    )
    beta = f"(({two} & 65535L) / 65536D)"
    return f"ln({u12})", beta, f"ln(-ln({u34}))"


def smallest(weight_logs: list[str], samples: int = SAMPLES, per_row: int = PER_ROW) -> list[list[Column]]:
    """For each weight column (its logarithm, null where the word is absent) the aggregates of one row block.

    The block number is in column ``block``; its samples are ``block * per_row + j``.
    """
    out = []
    for log_weight in weight_logs:
        mins = []
        for j in range(per_row):
            r, beta, c = _draw(f"(block * {per_row} + {j})")
            # r is negative here: -r of the definition.
            value = f"{c} + {r} * (floor({beta} - {log_weight} / {r}) - {beta} + 1D)"
            mins.append(F.expr(f"min({value})"))
        out.append(mins)
    return out


def _digits(values: list[str]) -> str:
    """SQL for the hexadecimal form of a block's samples."""
    keep = (1 << 4 * DIGITS) - 1
    parts = [f"lpad(hex(xxhash64({v}) & {keep}L), {DIGITS}, '0')" for v in values]
    return f"lower(concat({', '.join(parts)}))"


EMPTY = "-" * DIGITS * SAMPLES


def likeness(a: str, b: str) -> Column:
    """Share of equal samples, an unbiased estimate of the generalised Jaccard similarity.

    Two texts without words are alike (1), one without and one with words are not (0).
    """
    return F.expr(
        f"""aggregate(sequence(0, {SAMPLES - 1}), 0,
            (n, i) -> n + if(substring({a}, {DIGITS} * i + 1, {DIGITS}) = substring({b}, {DIGITS} * i + 1, {DIGITS}), 1, 0)
        ) / {float(SAMPLES)}D"""
    )


def signatures(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``fingerprint`` and ``edited_fingerprint`` of texts given in parts.

    ``parts`` has ``keys``, ``piece`` (text cut at white space), ``here`` and ``there`` (1 if the piece is in the
    text, or in its second version).  The two versions share the draws of their common words.  If ``parts``
    is partitioned by some of the keys, nothing is moved.
    """
    words = parts.select(*keys, "here", "there", F.explode(F.split(F.lower("piece"), SPACE)).alias("word"))
    counts = (
        words.where("word != ''")
        .groupBy(*keys, F.xxhash64("word").alias("h"))
        .agg(F.sum("here").alias("n"), F.sum("there").alias("m"))
    )
    logs = counts.select(
        *keys,
        "h",
        F.when(F.col("n") > 0, F.ln("n")).alias("ln_n"),
        F.when(F.col("m") > 0, F.ln("m")).alias("ln_m"),
        F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // PER_ROW - 1))).alias("block"),
    )
    here, there = smallest(["ln_n", "ln_m"])
    names = [f"{side}{j}" for side in "nm" for j in range(PER_ROW)]
    mins = logs.groupBy(*keys, "block").agg(*[c.alias(x) for c, x in zip(here + there, names, strict=True)])
    blocks = mins.select(
        *keys,
        "block",
        F.expr(f"if(n0 IS NULL, '{'-' * DIGITS * PER_ROW}', {_digits(names[:PER_ROW])})").alias("n"),
        F.expr(f"if(m0 IS NULL, '{'-' * DIGITS * PER_ROW}', {_digits(names[PER_ROW:])})").alias("m"),
    )
    gathered = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "n", "m"))).alias("s"))
    return gathered.select(
        *keys,
        F.array_join("s.n", "").alias("fingerprint"),
        F.array_join("s.m", "").alias("edited_fingerprint"),
    )


FIRST_KEY = -(1 << 63)
KEYS = ["key", "part", "text_hash"]


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Texts with the heads that replace their ends: ``key, part, text_hash, text, next_key, next_part, next_hash, head``.

    ``key`` is doc_id with nulls as the least BIGINT, so they come first.  The next document is that of the next
    larger key, after the last the first; where several texts share that key, it is the one of
    least text hash.  ``head`` is at least as long as the part it replaces, if the next text is.

    All uses of the texts read the same columns hashed by ``key, part``, so they are moved once.  ``part`` is 0 but
    for keys with so many rows that they would fill more than one task: their texts are dealt by hash.
    """
    base = texts_of(docs).select(
        F.coalesce("doc_id", F.lit(FIRST_KEY)).alias("key"), text_hash().alias("text_hash"), "text"
    )
    ids = base.groupBy("key").agg(
        F.min("text_hash").alias("pick"),
        F.max(F.expr("char_length(text) div 4")).cast("int").alias("most"),
        F.count("*").alias("n"),
    )
    placed = numbered(ids, ["key"], "place")
    last = placed.agg(F.max("place")).first()[0] or 0
    # Fewer rows than the session has shuffle tasks.
    heavy = stage(heavy_groups(placed, ["key"], "n", "parts", shuffle_tasks(docs.sparkSession)), "heavy")
    parts = F.coalesce("parts", F.lit(1))
    after = placed.select(
        F.when(F.col("place") == 0, F.lit(last)).otherwise(F.col("place") - 1).alias("place"),
        F.col("key").alias("next_key"),
        F.col("pick").alias("next_hash"),
    ).join(F.broadcast(heavy.withColumnRenamed("key", "next_key")), "next_key", "left")
    after = after.select("place", "next_key", "next_hash", F.pmod("next_hash", parts).cast("int").alias("next_part"))
    following = stage(
        placed.join(after, "place").select(F.col("key").alias("prior"), "most", "next_key", "next_part", "next_hash"), "next"
    )
    base = base.join(F.broadcast(heavy), "key", "left").select(
        "key", F.pmod("text_hash", parts).cast("int").alias("part"), "text_hash", "text"
    )
    # The hashes are compared by order, not as a join key, so that the texts stay hashed by key and part alone.
    chosen = F.col("text_hash").between(F.col("next_hash"), F.col("next_hash"))
    heads = (
        base.join(following, (F.col("key") == F.col("next_key")) & (F.col("part") == F.col("next_part")) & chosen)
        .select(F.col("prior").alias("key"), "next_key", "next_part", "next_hash", F.expr("substring(text, 1, most)").alias("head"))
        .join(F.broadcast(heavy), "key", "left")
        .withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .groupBy("key", "part")
        .agg(*[F.max(c).alias(c) for c in ("next_key", "next_part", "next_hash", "head")])
    )
    return base.join(heads, ["key", "part"])


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness to each other and the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.  The edited text has its
    last quarter (of code points, rounded down) replaced by as many first ones of the next document, or
    all if that is shorter.  Null texts are empty.  Repeated rows come out as often as they came in.  The only document of a
    table is its own next one; an empty table gives no rows.
    """
    pairs = edited_pairs(docs)
    kept = "substring(text, 1, cast(char_length(text) - char_length(text) div 4 as int))"
    new = "substring(head, 1, cast(char_length(text) div 4 as int))"
    brief = pairs.select(
        *KEYS,
        F.char_length("text").cast("bigint").alias("n_chars"),
        "next_key",
        "next_part",
        "next_hash",
        F.sha2(F.expr(f"concat({kept}, {new})").cast("binary"), 256).alias("edited_sha256"),
    )
    # What both texts share ends at the last space before the replaced part.
    cut = (
        pairs.dropDuplicates(KEYS)
        .select(*KEYS, "text", F.expr(kept).alias("kept"), F.expr(new).alias("new"))
        .withColumn("shared", F.expr("char_length(kept) - char_length(substring_index(kept, ' ', -1))"))
        .select(
            *KEYS,
            F.explode(
                F.expr(
                    """array(
                        struct(substring(text, 1, shared) AS piece, 1 AS here, 1 AS there),
                        struct(substring(text, shared + 1) AS piece, 1 AS here, 0 AS there),
                        struct(concat(substring(kept, shared + 1), new) AS piece, 0 AS here, 1 AS there))"""
                )
            ).alias("p"),
        )
        .select(*KEYS, "p.*")
    )
    prints = signatures(cut, KEYS)
    found = stage(
        brief.join(prints, KEYS, "left").select(
            *brief.columns,
            F.coalesce("fingerprint", F.lit(EMPTY)).alias("fingerprint"),
            F.coalesce("edited_fingerprint", F.lit(EMPTY)).alias("edited_fingerprint"),
        ),
        "fingerprints",
    )
    its = ["next_key", "next_part", "next_hash"]
    nexts = found.select(*[F.col(c).alias(x) for c, x in zip(KEYS, its, strict=True)], F.col("fingerprint").alias("next_fingerprint"))
    return found.join(nexts.dropDuplicates(its), its).select(
        F.nullif("key", F.lit(FIRST_KEY)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
