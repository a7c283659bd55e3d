"""Importance resampling, URL verdicts and hard negatives against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from awkward import ROWS
from pyspark.sql import functions as F

from termlab.llm import hard_negatives, lexicon, resampling, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- resampling -------------------------------------------------------------------------


def runs(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_resampling(docs, target, percent, least, longest, buckets):
    def bucket(x):
        return zlib.crc32(x.encode()) % buckets

    s, t = collections.Counter(), collections.Counter()
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            counts.update(map(bucket, runs(text, longest)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        words, features = runs(text, longest)
        gains = [
            math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
            for b in map(bucket, features)
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, None, len(words)])
    drawn = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, row in enumerate(drawn[: percent * len(drawn) // 100]):
        row[4] = i + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize(("longest", "dictionary"), [(1, 0), (1, 50), (3, 50), (2, 100_000)])
def test_resampling_against_brute_force(spark, longest, dictionary):
    rng = random.Random(longest)
    vocabulary = ["".join(rng.choices("abcdéß中", k=rng.randint(1, 9))) for _ in range(200)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(150)]
    docs += [(i, None if t is None else t.upper() + ", " + t) for i, t in ROWS]
    docs += [(900, vocabulary[0] * 40 + " " + "z" * 200), (901, "A" * 2_000_000 + " b" * 30), (7, docs[7][1]), (7, docs[7][1])]
    target = [" ".join(rng.choices(vocabulary[:30], k=20)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, rank int, n_words int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, wanted, 30, 10, longest, 997, dictionary=dictionary)
    expected = brute_resampling(docs, target, 30, 10, longest, 997)
    rows = got.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()
    assert sorted(map(tuple, rows), key=repr) == expected


def test_resampling_of_nothing(spark, no_docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(no_docs, target).count() == 0
    some = spark.createDataFrame([(1, "a " * 30), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_features, r["rank"]) for r in resampling.resample(some, target.where("false"), 100).collect()}
    assert got == {1: (30, 1), 2: (0, None)}


def test_frequent_words_come_in_whole_classes(spark):
    counts = spark.createDataFrame([(w.encode(), n) for w, n in (("a", 9), ("b", 8), ("c", 7), ("d", 4), ("e", 1))], "word binary, n bigint")
    assert lexicon.frequent(counts, 5) == [(b"a", 9), (b"b", 8), (b"c", 7), (b"d", 4), (b"e", 1)]
    assert lexicon.frequent(counts, 4) == [(b"a", 9), (b"b", 8), (b"c", 7), (b"d", 4)]
    assert lexicon.frequent(counts, 3) == [(b"a", 9), (b"b", 8)]
    assert lexicon.frequent(counts, 1) == []


# --- URLs -------------------------------------------------------------------------------


def splits(letters, likelihood, letter):
    """All ways to write ``letters`` as known words and single letters: (score, words with single letters marked)."""
    if not letters:
        yield 0, ()
        return
    for rest, words in splits(letters[:-1], likelihood, letter):
        yield rest + letter, (*words, (letters[-1], False))
    for n in range(1, len(letters) + 1):
        if letters[-n:] in likelihood:
            for rest, words in splits(letters[:-n], likelihood, letter):
                yield rest + likelihood[letters[-n:]], (*words, (letters[-n:], True))


def test_viterbi_finds_the_likeliest_split():
    rng = random.Random(4)
    counts = [("".join(rng.choices("abc", k=rng.randint(1, 4))).encode(), rng.randint(1, 300)) for _ in range(20)]
    model = url_filter.Unigrams.of(sorted(dict(counts).items()))
    for _ in range(200):
        letters = "".join(rng.choices("abcd", k=rng.randint(0, 9)))
        found = model.split(letters)
        assert "".join(found) == letters
        best = max(score for score, _ in splits(letters, model.likelihood, model.letter))
        mine = sum(model.likelihood.get(w, len(w) * model.letter) for w in found)
        assert mine == best


def test_names_are_cut_into_words():
    model = url_filter.Unigrams.of([(w, 50) for w in (b"best", b"news", b"online", b"casino", b"shop")])
    assert model.split("bestcasinoonline") == ("best", "casino", "online")
    assert model.split("xqnewsxq") == ("xq", "news", "xq")
    tokens = url_filter.Tokens(model)
    assert tokens.of("www.bestnews24.shop", "/Casino/2024/a-b.html") == [
        "h:www", "h:best", "h:news", "h:0", "h:shop", "p:casino", "p:0", "p:a", "p:b", "p:html",
    ]


RULES = [("allow", "org", "/"), ("block", "a.org", "/x/"), ("block", "a.org", "/"), ("allow", "b.a.org", ""), ("allow", "", "/any")]
URLS = [
    "http://ORG/", "https://a.org", "https://z.a.org/x/1", "https://b.a.org/x", "http://aa.org/y?u=://c.org/", "ftp://u@a.org:8/x/",
    "no scheme", None, "", "://", "x://a.org#f", "http://com/any/1", "http://É.org/É?q", "http://a.org./x/", "http://" + "a." * 50_000 + "org/",
]


def test_rules_and_parts_of_urls(spark):
    pages = spark.createDataFrame([(i, u, "<p>some words", "r") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, RULES).collect()}
    for i, url in enumerate(URLS):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group().translate(UPPER)
        path = re.match(r"[^?#]*", rest[len(host) :]).group() if rest else ""
        fits = [
            (len(h + p), v == "block", h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule = max(fits, default=None)
        assert (got[i].host, got[i].path) == (host, path), url
        assert got[i].rule == (rule[2] if rule else None), url
        if rule:
            assert got[i].verdict == ("block" if rule[1] else "allow")
        else:
            assert got[i].verdict == ("block" if got[i].score > 0 else "allow")


def test_the_classifier_learns_what_rules_say(spark):
    """Half of the casino and news hosts are decided by rules; the words alone carry over to the others."""
    rng = random.Random(9)
    rows = []
    for i in range(600):
        bad = i % 2
        name = rng.choice(["casino", "poker", "slots"] if bad else ["news", "library", "school"]) + rng.choice(["best", "city", "online"])
        rows.append((i, f"https://{name}.{'bad' if bad else 'good'}{'' if i % 4 < 2 else 'x'}/{rng.randint(1, 99)}", "<b>casino poker slots news library school best city online</b>"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = url_filter.judge(pages, [("block", "bad", "/"), ("allow", "good", "/")]).collect()
    open_ = [r for r in got if r.rule is None]
    assert len(open_) == 300 and all((r.verdict == "block") == bool(r.page_id % 2) for r in open_)
    assert "h:casino" in " ".join(r.words for r in open_)


def test_pages_of_no_use(spark):
    schema = "page_id bigint, url string, html string, host string, verdict int"
    assert url_filter.judge(spark.createDataFrame([], schema), RULES).count() == 0
    rows = [(None, None, None, "h", 1), (1, "http://a.com/p", None, "h", 1), (1, "http://a.com/p", "", "h", 1)]
    got = url_filter.judge(spark.createDataFrame(rows, schema), []).collect()
    assert [(r.rule, r.verdict, r.score) for r in got] == [(None, "allow", 0)] * 3


# --- hard negatives ---------------------------------------------------------------------


def brute_negatives(rows, every, positives, negatives, low, high):
    sound = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            sound.append((vec_id, [math.floor(256 * x) for x in v], label))
    out = []
    for anchor_id, a, label in (r for r in sound if r[0] % every == 0):
        scored = [
            (-sum(x * y for x, y in zip(a, v, strict=True)), vec_id, other == label)
            for vec_id, v, other in sound
            if vec_id != anchor_id and len(v) == len(a)
        ]
        for p, positive_id, _ in sorted(x for x in scored if x[2])[:positives]:
            fits = sorted((n, i) for n, i, same in scored if not same and low * -p <= 100 * -n <= high * -p)
            out += [(anchor_id, positive_id, k + 1, i, -p, -n) for k, (n, i) in enumerate(fits[:negatives])]
    return sorted(out)


@pytest.mark.parametrize(("tile", "block"), [(7, 3), (4096, 512)])
def test_hard_negatives_against_brute_force(spark, tile, block):
    r = np.random.default_rng(6)
    seeds = r.normal(size=(4, 12))
    rows = [(i, (seeds[i % 4] * r.choice([0.2, 1.0]) + r.normal(size=12) * 0.4).tolist(), int(r.integers(3))) for i in range(160)]
    rows += [(200 + i, rows[3][1], 1) for i in range(30)]  # copies and ties
    rows += [(300 + i, [0.0] * 12, i % 2) for i in range(6)] + [(400, [1.0, 2.0], 0), (410, [2.0, 1.0], 0), (420, [1.5, 1.0], 1)]
    rows += [(None, rows[0][1], 0), (500, None, 0), (510, [], 0), (520, [None] * 12, 0), (530, [float("nan")] * 12, 0)]
    rows += [(540, [float("inf")] + [1.0] * 11, 0), (550, rows[1][1], None), (560, [3e3] * 12, 2), (570, [-2e5] * 12, 2)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id bigint, embedding array<double>, label int, uid string").repartition(4)
    got = hard_negatives.hard_negatives(df, 10, 4, 3, 50, 95, tile=tile, block=block)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(rows, 10, 4, 3, 50, 95)


def test_hard_negatives_of_repeated_ids_and_of_nothing(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    empty = spark.createDataFrame([], schema)
    assert hard_negatives.hard_negatives(empty, 10).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 0)], schema), 10).count() == 0
    rows = [(10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [1.0, 0.0], 0), (12, [0.8, 0.0], 1), (12, [0.8, 0.0], 1)]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, schema), 10).collect()
    # Each of the two anchors has its one positive and both negatives of one id.
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in got) == [(10, 11, 1, 12)] * 2 + [(10, 11, 2, 12)] * 2
    huge = spark.createDataFrame([(10, [1e9, 1e9], 0), (11, [1e9, 1e9], 0), (12, [1e9, 1e9], 1)], "vec_id bigint, embedding array<double>, label int")
    with pytest.raises(Exception, match="BIGINT"):
        hard_negatives.hard_negatives(huge, 10).collect()


def test_every_block_meets_every_tile_without_a_broadcast(spark):
    """Copies of small blocks are large together: they must not come to the driver.  A cell holds a bounded number of tiles."""
    vectors = [(i, [float(i % 7), float(i % 5)], i % 3) for i in range(400)]
    rows = hard_negatives.sound_vectors(spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int"), "label")
    tiles = hard_negatives._cut(rows, 1, 1)
    anchors = rows.where("vec_id % 10 = 0").withColumn("positives", F.array(F.struct(*(F.lit(x).cast("bigint").alias(n) for x, n in enumerate(("positive_uid", "positive_id", "positive_score"))))))
    blocks = hard_negatives._cut(anchors, 3, 1, "positives", f"array<{hard_negatives.POSITIVE}>")
    assert tiles.groupBy("part").count().agg(F.max("count")).first()[0] <= hard_negatives.CELL < 400 / 8
    met = hard_negatives._meet(blocks, tiles)
    got = [(a, t) for _, _, block, tile, _ in hard_negatives._pairs(met.toArrow().to_batches()) for a in block.vec_id.tolist() for t in tile.vec_id.tolist()]
    assert sorted(got) == [(a, t) for a in range(0, 400, 10) for t in range(400)]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_bond_reads_few_dimensions_of_most_candidates():
    """Where some dimensions carry most of the scores, candidates leave before all are read."""
    r = np.random.default_rng(1)
    vectors = np.floor(256 * r.normal(size=(4000, 64)) * np.where(np.arange(64) < 8, 1.0, 0.02))
    tile = hard_negatives.Tile(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), np.ascontiguousarray(vectors.T))
    seen = []
    wanted = hard_negatives._reaching(5)

    def watched(low, high):
        seen.append(len(low))
        return wanted(low, high)

    places, score = hard_negatives.bond(vectors[0], tile, tile.columns, np.ones(4000, bool), watched)
    exact = vectors @ vectors[0]
    assert (score == exact[places]).all() and set(np.argsort(-exact)[:5]) <= set(places.tolist())
    assert seen[0] == 4000 and seen[1] < 400


@pytest.mark.parametrize("share", [1.0, 0.6, 0.01])
@pytest.mark.parametrize("windows", [[(900, 1500)], [(900, 1500), (1400, 1600)], [(200, 300), (900, 1500)], [(10**9, 2 * 10**9)]])
def test_bond_keeps_the_first_of_each_window(share, windows):
    """With many and with few candidates, in windows that overlap and in windows apart."""
    r = np.random.default_rng(3)
    vectors = np.floor(20 * r.normal(size=(3000, 24)))
    tile = hard_negatives.Tile(np.arange(3000), np.arange(3000), np.zeros(3000, np.int64), np.ascontiguousarray(vectors.T))
    alive = r.random(3000) < share
    exact = (vectors @ vectors[0]).astype(np.int64)
    places, score = hard_negatives.bond(vectors[0], tile, tile.columns.astype(np.float32), alive, hard_negatives._inside(windows, 3))
    assert (score == exact[places]).all() and alive[places].all()
    for bottom, top in windows:
        fits = np.flatnonzero(alive & (exact >= bottom) & (exact <= top))
        assert set(fits[hard_negatives._highest(exact[fits], fits, 3)].tolist()) <= set(places.tolist())
