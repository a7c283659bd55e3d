"""Secrets in texts: fixed patterns, and a battery of randomness tests for everything else.

Candidates are runs of key characters with a digit and a letter among them; '=' only ends one, as padding, so
names and values part there.  A run with '+' or '/' as well as '-' or '_' has no one alphabet, so its longest
stretches of either are candidates instead.  For each
distinct one an encoding is inferred and three tests of "drawn at random from that
alphabet" are made: chi-squared on the symbols' counts, Wald-Wolfowitz runs of the alphabet's halves, and
serial correlation of neighbouring symbols.  Their p-values are combined (Fisher).  Ordinary strings fail:
within each length band, candidates are rejected as random by the Benjamini-Hochberg procedure,
so at most a share ``RATE`` of those discarded is expected to be random.  What is not rejected and
is long enough for the tests to have had a chance is a secret.  DataFrame expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termlab.llm.common import text_hash, texts_of
from termlab.sources.tables import stage

# The base patterns, and the kinds in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
SHORTEST = {"assign": 12, "access": 18, "hex": 16, "random": 20}


def _run(more: str) -> str:
    """Whole runs of letters, digits and ``more`` with a digit and a letter, at least 20 long with the padding at the end."""
    k = f"[A-Za-z0-9{more}]"
    padding = f"=++(?!{k})"
    return (
        f"(?<!{k})(?=[A-Za-z0-9={more}]{{20}})(?=[A-Za-z{more}]*+[0-9])(?=[0-9{more}]*+[A-Za-z])"
        f"(?:{k}{{20,}}+(?:{padding})?|{k}{{1,19}}+{padding})"
    )


CANDIDATE = _run("+/_-")
STRETCHES = (_run("+/"), _run("_-"))  # of a candidate that mixes the two alphabets

# Alphabets in order of their codes.
UPPER, LOWER, NUMBERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    ("hex", "[0-9A-F]+", NUMBERS + "ABCDEF"),
    ("base32", "[A-Z2-7]+=*", UPPER + "234567"),
    ("base36", "[0-9a-z]+", NUMBERS + LOWER),
    ("base62", "[0-9A-Za-z]+", NUMBERS + UPPER + LOWER),
    ("base64", "[A-Za-z0-9+/]+=*", UPPER + LOWER + NUMBERS + "+/"),
    ("base64url", "[A-Za-z0-9_-]+=*", UPPER + LOWER + NUMBERS + "-_"),
)
RATE = 0.05
POWER_BITS = 90  # information a random string must carry to be told from an ordinary one
STEPS = 200  # p-values are rounded up to a twentieth of a power of ten


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _positions(kind: str, pattern: str, group: int = 0) -> str:
    """SQL for the matches of one kind: piece lengths between them, the matches, and the tested group.

    Most texts match nothing, which one search tells.
    """
    p = _quoted(pattern)
    tested = f"regexp_extract_all(text, {p}, {group})" if group else "cast(NULL AS array<string>)"
    return f"""CASE WHEN text RLIKE {p} THEN named_struct('kind', '{kind}',
        'gaps', transform(split(text, {p}, -1), x -> char_length(x)),
        'found', regexp_extract_all(text, {p}, 0), 'tested', {tested}) END"""


def _stretches(pattern: str) -> str:
    """SQL for the matches of ``pattern`` in ``value`` and the lengths between them."""
    p = _quoted(pattern)
    return f"""named_struct('gaps', transform(split(value, {p}, -1), x -> char_length(x)),
        'found', regexp_extract_all(value, {p}, 0))"""


def matches(texts: DataFrame) -> DataFrame:
    """``key columns, kind, start, end, value`` of every match that passes its length rule.

    A candidate that mixes alphabets is replaced by its stretches of each, which may overlap.

    ``texts`` has ``doc_id, text_hash, text``.  A text split at the matches gives what lies between them, so
    places are running sums of lengths; only numbers and matched values leave the text's
    row.  Rows alike in doc_id and text count once.
    """
    kinds = [
        _positions("assign", ASSIGN, 2),
        _positions("access", ACCESS),
        _positions("hex", HEX.replace("+", "{16,}")),
        _positions("random", CANDIDATE),
    ]
    rows = (
        texts.select("doc_id", "text_hash", F.explode(F.expr(f"array({', '.join(kinds)})")).alias("m"))
        .where("m IS NOT NULL")
        .select(
            "doc_id",
            "text_hash",
            "m.kind",
            F.posexplode(
                F.expr(
                    """transform(m.found, (v, k) -> named_struct(
                        'gap', m.gaps[k], 'value', v, 'tested', coalesce(m.tested[k], v)))"""
                )
            ).alias("i", "x"),
        )
        .groupBy("doc_id", "text_hash", "kind", "i")
        .agg(F.max("x").alias("x"))
    )
    upto = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("i")
    end = F.sum(F.col("x.gap") + F.char_length("x.value")).over(upto)
    shortest = F.create_map(*[F.lit(v) for kv in SHORTEST.items() for v in kv])
    rows = (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - F.char_length("x.value"))
        .where(F.char_length("x.tested") >= shortest[F.col("kind")])
        .select("doc_id", "text_hash", "kind", "start", "end", F.col("x.value").alias("value"))
    )
    mixed = "kind = 'random' AND value RLIKE '[+/]' AND value RLIKE '[-_]'"
    whole = "named_struct('gaps', array(0, 0), 'found', array(value))"
    cut = f"CASE WHEN {mixed} THEN array({', '.join(map(_stretches, STRETCHES))}) ELSE array({whole}) END"
    rows = (
        rows.select("doc_id", "text_hash", "kind", F.col("start").alias("from"), F.posexplode(F.expr(cut)).alias("way", "m"))
        .select(
            "doc_id",
            "text_hash",
            "kind",
            "from",
            "way",
            F.posexplode(F.expr("transform(m.found, (v, k) -> named_struct('gap', m.gaps[k], 'value', v))")).alias("i", "x"),
        )
    )
    # Dealt as above, so no row moves.
    upto = Window.partitionBy("doc_id", "text_hash", "kind", "from", "way").orderBy("i")
    end = F.col("from") + F.sum(F.col("x.gap") + F.char_length("x.value")).over(upto)
    return rows.withColumn("end", end).select(
        "doc_id",
        "text_hash",
        "kind",
        (F.col("end") - F.char_length("x.value")).alias("start"),
        "end",
        F.col("x.value").alias("value"),
    )


def _p_normal(z: str) -> str:
    """Two-sided p-value of a standard normal, by the Abramowitz and Stegun formula 26.2.17."""
    t = f"(1D / (1D + 0.2316419D * abs({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"greatest(1e-300D, least(1D, 2D * 0.3989422804014327D * exp(-{z} * {z} / 2D) * {poly}))"


def battery(values: DataFrame) -> DataFrame:
    """``value, encoding, symbols, p`` of distinct strings; without an encoding p is null.

    ``p`` is the combined probability of so uneven a string if it were random.
    """
    encoding = "CASE " + " ".join(f"WHEN value RLIKE '^{rx}$' THEN '{name}'" for name, rx, _ in ALPHABETS) + " END"
    alphabet = "CASE encoding " + " ".join(f"WHEN '{name}' THEN '{a}'" for name, _, a in ALPHABETS) + " END"
    codes = (
        values.select("value")
        .distinct()
        .withColumn("encoding", F.expr(encoding))
        .withColumn("alphabet", F.expr(alphabet))
        .withColumn("codes", F.expr("transform(split(trim(TRAILING '=' FROM value), ''), c -> instr(alphabet, c) - 1)"))
        .withColumn("n", F.expr("cast(size(codes) AS double)"))
        .withColumn("a", F.expr("cast(char_length(alphabet) AS double)"))
    )
    half = "(2 * x >= a)"
    sums = codes.withColumns(
        {
            "squares": F.expr(
                "aggregate(transform(sequence(0, cast(a AS int) - 1), s -> size(filter(codes, x -> x = s))), 0D, (t, c) -> t + cast(c AS double) * c)"
            ),
            "upper": F.expr(f"cast(size(filter(codes, x -> {half})) AS double)"),
            "runs": F.expr(
                """1D + size(filter(zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes)),
                   (p, q) -> (2 * p >= a) <> (2 * q >= a)), z -> z))"""
            ),
            "mean": F.expr("aggregate(codes, 0D, (t, x) -> t + x) / n"),
        }
    ).withColumns(
        {
            "spread": F.expr("aggregate(codes, 0D, (t, x) -> t + (x - mean) * (x - mean))"),
            "along": F.expr(
                """aggregate(zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes)),
                   (p, q) -> (p - mean) * (q - mean)), 0D, (t, z) -> t + z)"""
            ),
        }
    )
    # The variance of the statistic is exact for any n, so that few symbols per cell do no harm.
    chi = "((a / n * squares - n) - (a - 1)) / sqrt(2D * (a - 1) * (1D - 1D / n))"
    runs = """CASE WHEN upper = 0 OR upper = n THEN sqrt(n) ELSE
        (runs - 1D - 2D * upper * (n - upper) / n)
        / sqrt(greatest(1e-9D, 2D * upper * (n - upper) * (2D * upper * (n - upper) - n) / (n * n * (n - 1D)))) END"""
    serial = "CASE WHEN spread = 0 THEN sqrt(n) ELSE (along / spread + 1D / n) * sqrt(n) END"
    tested = sums.withColumns({"z_chi": F.expr(chi), "z_runs": F.expr(runs), "z_serial": F.expr(serial)})
    # Only too uneven counts speak against chance; too even ones do not.
    fisher = f"""-2D * (ln(if(z_chi <= 0, 1D - {_p_normal('z_chi')} / 2D, {_p_normal('z_chi')} / 2D))
        + ln({_p_normal('z_runs')}) + ln({_p_normal('z_serial')}))"""
    return (
        tested.withColumn("fisher", F.expr(fisher))
        .withColumn(
            "p",
            F.expr("if(encoding IS NULL, NULL, greatest(1e-300D, exp(-fisher / 2) * (1D + fisher / 2 + fisher * fisher / 8)))"),
        )
        .select("value", "encoding", (F.col("n") * F.log2("a")).alias("bits"), F.col("n").cast("int").alias("symbols"), "p")
    )


def band(symbols: Column | str) -> Column:
    """Length bands of the false-discovery control, doubling in width."""
    return F.floor(F.log2(F.col(symbols) / F.lit(20.0))).cast("int")


def random_values(values: DataFrame, rate: float = RATE) -> DataFrame:
    """The ``value`` of those distinct strings that are not rejected as random.

    Benjamini and Hochberg's step is made on counts of rounded p-values per length band, a table of
    bounded size (bands times ``STEPS``), so no band is ever sorted or gathered.
    """
    tested = stage(battery(values).where("p IS NOT NULL").withColumn("band", band("symbols")), "battery")
    step = F.least(F.lit(STEPS), F.floor(-F.log10("p") * 20)).cast("int")
    tested = tested.withColumn("step", step)
    counts = tested.groupBy("band", "step").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("band")
    down = whole.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    passed = counts.select(
        "band", "step", F.sum("n").over(down).alias("rejected"), F.sum("n").over(whole).alias("all")
    ).where(F.pow(F.lit(10.0), -F.col("step") / 20) <= F.lit(rate) * F.col("rejected") / F.col("all"))
    cut = passed.groupBy("band").agg(F.min("step").alias("cut"))
    return (
        tested.join(cut, "band", "left")
        .where("cut IS NULL OR step < cut")
        .where(F.col("bits") >= POWER_BITS)
        .select("value")
    )


def _order(kind: Column | str) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind) if isinstance(kind, str) else kind)


def outside(base: DataFrame, random: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, kind, start, end``: what random spans cover and base spans don't; stretches that overlap become one."""

    def edges(spans: DataFrame, in_base: int) -> DataFrame:
        both = "array(named_struct('at', start, 'way', 1), named_struct('at', end, 'way', -1))"
        return spans.select(*keys, F.explode(F.expr(both)).alias("x")).select(
            *keys, "x.at", (F.col("x.way") * in_base).alias("b"), (F.col("x.way") * (1 - in_base)).alias("r")
        )

    order = Window.partitionBy(*keys).orderBy("at")
    upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Edges at one place have the same sums, so only the first of them can be a turn.
    return (
        edges(base, 1)
        .union(edges(random, 0))
        .withColumn("on", (F.sum("r").over(upto) > 0) & (F.sum("b").over(upto) == 0))
        .withColumn("turn", F.col("on") != F.lag("on", 1, False).over(order))
        .where("turn")
        .withColumn("until", F.lead("at").over(order))
        .where("on")
        .select(*keys, F.lit("random").alias("kind"), F.col("at").alias("start"), F.col("until").alias("end"))
    )


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans`` of the documents with any: the secrets by start, then kind.

    Each span has ``start`` and ``end`` (code points, end exclusive) and ``kind``.  Base spans (assign, access,
    hex) are all kept and may overlap one another; a random span overlaps none: of a candidate that reaches
    beyond the base spans in it, all is tested and what lies outside them is added.  A document's
    spans are gathered, which the length of its text bounds.
    """
    texts = texts_of(docs).withColumn("text_hash", text_hash()).select("doc_id", "text_hash", "text")
    found = stage(matches(texts), "matches")
    keys = ["doc_id", "text_hash"]
    base = F.col("kind") != "random"
    # Of a candidate, the part from its first letter or digit to its last has to reach beyond a base span.
    first = F.when(base, F.col("start")).otherwise(F.expr("start + char_length(value) - char_length(trim(LEADING '+/_=-' FROM value))"))
    last = F.expr("end - char_length(value) + char_length(trim(TRAILING '+/_=-' FROM value))")
    ahead = Window.partitionBy(*keys).orderBy(first, _order("kind")).rowsBetween(Window.unboundedPreceding, -1)
    clear = found.withColumn("_covered", F.max(F.when(base, F.col("end"))).over(ahead)).where(
        base | (F.coalesce("_covered", F.lit(0)) < last)
    )
    clear = stage(clear.select(*keys, "kind", "start", "end", "value"), "clear")
    added = clear.where(~base)
    added = outside(clear.where(base), added.join(random_values(added), "value"), keys)
    every = clear.where(base).select(*keys, "kind", "start", "end").union(added)
    gathered = F.array_sort(F.collect_list(F.struct("start", _order("kind").alias("place"), "end", "kind")))
    return every.groupBy(*keys).agg(gathered.alias("spans"))


def _listed(condition: str) -> str:
    return f"""array_join(transform(filter(coalesce(spans, array()), s -> {condition}),
        s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"""


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``: one row per document row.

    Null and empty texts have none.  Repeated rows come out as often as they came in, each with the
    same spans; an empty table gives no rows.
    """
    rows = texts_of(docs).select("doc_id", text_hash().alias("text_hash"))
    found = spans(docs).withColumnRenamed("doc_id", "_doc_id").withColumnRenamed("text_hash", "_text_hash")
    same = rows["doc_id"].eqNullSafe(found["_doc_id"]) & (rows["text_hash"] == found["_text_hash"])
    counted = {
        f"n_{k}": F.expr(f"cast(size(filter(coalesce(spans, array()), s -> s.kind = '{k}')) AS bigint)") for k in KINDS
    }
    return rows.join(found, same, "left").select(
        "doc_id",
        *[counted[f"n_{k}"].alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.expr(_listed("s.kind <> 'random'")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_listed("true")).alias("spans"),
        counted["n_random"].alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with all rows and columns, each secret in ``text`` replaced by ``mark``.

    Overlapping spans are replaced by one mark.  ``n_chars``, if there is one, is counted anew for changed texts.
    Null and empty texts stay as they are, repeated rows are all masked alike, and an empty table gives no rows.
    Rows are carried as one struct, so no column of theirs, whatever its name, meets a helper's.
    """
    found = spans(docs).select(F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "spans")
    # Spans are in order of start: one that starts before the furthest end so far adds nothing but its end.
    merged = """aggregate(spans, array(struct(0L AS s, 0L AS e)), (r, x) ->
        if(x.start < element_at(r, -1).e,
           concat(slice(r, 1, size(r) - 1), array(struct(element_at(r, -1).s AS s, greatest(element_at(r, -1).e, x.end) AS e))),
           concat(r, array(struct(x.start AS s, x.end AS e)))))"""
    pieces = """transform(sequence(1, size(merged)), i -> substring(row.text, cast(merged[i - 1].e + 1 AS int),
        cast(if(i < size(merged), merged[i].s, char_length(row.text)) - merged[i - 1].e AS int)))"""
    keyed = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"),
    )
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("hash") == F.col("found_hash"))
    joined = keyed.join(found, same, "left").withColumn("merged", F.expr(merged))
    clean = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(F.expr(pieces), mark))
    out = joined.select("row", "spans", clean.alias("clean"))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        counted = F.char_length("clean").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(counted)
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
