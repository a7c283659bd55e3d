"""Fingerprints, the randomness battery and the ordinal model against plain Python."""

from __future__ import annotations

import collections
import math
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from test_texts import toxic_corpus

from termlab.llm import fingerprint, secret_scan, toxicity

# --- consistent weighted sampling -------------------------------------------------------


def chained(*parts: bytes) -> int:
    """A hash of several values, each seeded by the one before, as a signed number."""
    h = 42
    for part in parts:
        h = xxhash.xxh64_intdigest(part, h)
    return h - (1 << 64) if h >> 63 else h


def plain_values(text: str) -> list[float]:
    """For each sample the least ln c - r (t - b + 1) over the words, with r and c from Gamma(2, 1) and b uniform."""
    found = [math.inf] * fingerprint.SAMPLES
    for word, weight in collections.Counter(text.lower().split()).items():
        h = struct.pack("<q", chained(word.encode()))
        for k in range(fingerprint.SAMPLES):
            number = struct.pack("<i", k)
            one, two = chained(h, number) % (1 << 64), chained(number, h) % (1 << 64)
            r = -math.log(((one >> 32) + 0.5) * ((one & 0xFFFFFFFF) + 0.5) / 2**64)
            c = -math.log(((two >> 40) + 0.5) * ((two >> 16 & 0xFFFFFF) + 0.5) / 2**48)
            b = (two & 65535) / 65536
            t = math.floor(math.log(weight) / r + b)
            found[k] = min(found[k], math.log(c) - r * (t - b + 1))
    return found


def plain_digits(value: float) -> set[str]:
    """The digits kept of a value or of its nearest neighbours: logarithms may differ in their last bits."""
    near = {value}
    for _ in range(4):
        near |= {math.nextafter(x, s) for x in near for s in (-math.inf, math.inf)}
    return {f"{chained(struct.pack('<d', x)) & 0xFFFF:04x}" for x in near}


def test_fingerprints_are_those_of_the_definition(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "été", "x1", "zz"]
    texts = [" ".join(rng.choices(words, k=rng.randint(4, 40))) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in fingerprint.compare_edited(docs).collect()}
    for i, text in enumerate(texts):
        head = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        for whole, found in ((text, got[i].fingerprint), (text[: len(text) - n] + head[:n], got[i].edited_fingerprint)):
            for k, value in enumerate(plain_values(whole)):
                assert found[4 * k : 4 * k + 4] in plain_digits(value), (i, k)

        def alike(a, b):
            return sum(a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(64)) / 64

        assert got[i].near_edited == alike(got[i].fingerprint, got[i].edited_fingerprint)
        assert got[i].near_next == alike(got[i].fingerprint, got[(i + 1) % len(texts)].fingerprint)


def test_a_key_with_a_third_of_the_rows_is_dealt_by_text(spark):
    docs = spark.range(900).selectExpr("if(id % 3 = 0, NULL, id) AS doc_id", "concat('some words and ', id) AS text")
    pairs = fingerprint.edited_pairs(docs)
    parts = pairs.where(f"key = {fingerprint.FIRST_KEY}").groupBy("part").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) < 200
    assert pairs.where(f"key > {fingerprint.FIRST_KEY} AND part > 0").isEmpty()
    got = fingerprint.compare_edited(docs)
    assert got.count() == 900 and got.where("doc_id IS NULL").count() == 300


# --- the battery ------------------------------------------------------------------------


def plain_p(value: str) -> tuple[str, float, int] | None:
    """Encoding, combined p-value and symbols: chi-squared, runs and serial correlation by Fisher."""
    for name, pattern, alphabet in secret_scan.ALPHABETS:
        if re.fullmatch(pattern, value):
            break
    else:
        return None
    codes = [alphabet.index(c) for c in value.rstrip("=")]
    n, a = len(codes), len(alphabet)
    counts = collections.Counter(codes)
    chi = (sum(a / n * c * c for c in counts.values()) - n - (a - 1)) / math.sqrt(2 * (a - 1) * (1 - 1 / n))
    high = [2 * x >= a for x in codes]
    upper = sum(high)
    turns = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    if upper in (0, n):
        runs = math.sqrt(n)
    else:
        both = 2 * upper * (n - upper)
        runs = (turns - 1 - both / n) / math.sqrt(max(1e-9, both * (both - n) / (n * n * (n - 1))))
    mean = sum(codes) / n
    spread = sum((x - mean) ** 2 for x in codes)
    along = sum((p - mean) * (q - mean) for p, q in zip(codes, codes[1:], strict=False))
    serial = (along / spread + 1 / n) * math.sqrt(n) if spread else math.sqrt(n)

    def two_sided(z):
        return max(1e-300, math.erfc(abs(z) / math.sqrt(2)))

    # Only too uneven counts speak against chance.
    tail = max(1e-300, two_sided(chi) / 2 if chi > 0 else 1 - two_sided(chi) / 2)
    fisher = -2 * (math.log(tail) + math.log(two_sided(runs)) + math.log(two_sided(serial)))
    return name, math.exp(-fisher / 2) * (1 + fisher / 2 + fisher * fisher / 8), n


def random_strings(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    found = []
    for _ in range(n):
        _, _, alphabet = rng.choice(secret_scan.ALPHABETS)
        size = rng.randint(20, 70)
        skew = rng.choice([1.0, 1.0, 0.5, 0.2])
        letters = alphabet[: max(4, int(len(alphabet) * skew))]
        found.append("".join(rng.choices(letters, k=size)) + "=" * rng.choice([0, 0, 1, 2]))
    return [*{*found}]


def test_p_values_are_those_of_the_tests(spark):
    values = [*random_strings(600, 7), "a" * 30, "ab" * 20, "not=one", "ÄÖ", "0" * 25]
    got = {r.value: r for r in secret_scan.battery(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    checked = 0
    for value in values:
        expected = plain_p(value)
        row = got[value]
        if expected is None:
            assert row.p is None
            continue
        assert (row.encoding, row.symbols) == (expected[0], expected[2])
        if expected[1] > 1e-9:
            # The normal tail is a polynomial good to 1e-7.
            assert math.log(row.p) == pytest.approx(math.log(expected[1]), abs=0.02), value
            checked += 1
    assert checked > 300


def test_the_false_discovery_cut_is_benjamini_and_hochbergs(spark):
    values = random_strings(1500, 8)
    df = spark.createDataFrame([(v,) for v in values], "value string")
    rows = [r for r in secret_scan.battery(df).collect() if r.p is not None]
    bands = collections.defaultdict(list)
    for r in rows:
        # P-values rounded up to a twentieth of a power of ten.
        step = min(secret_scan.STEPS, math.floor(-math.log10(r.p) * 20))
        bands[math.floor(math.log2(r.symbols / 20))].append((10 ** (-step / 20), step, r))
    kept = set()
    for tested in bands.values():
        tested.sort(key=lambda x: x[0])
        cut = 0.0
        for rank, (p, step, _) in enumerate(tested, 1):
            # Equal p-values stand or fall together, at the rank of the last of them.
            last = rank == len(tested) or tested[rank][1] != step
            if last and p <= secret_scan.RATE * rank / len(tested):
                cut = p
        kept |= {r.value for p, _, r in tested if p > cut and r.bits >= secret_scan.POWER_BITS}
    assert {r.value for r in secret_scan.random_values(df).collect()} == kept
    assert 100 < len(kept) < len(values)


# --- the ordinal model ------------------------------------------------------------------


def penalised_likelihood(parameters, rows, grades, n_features, penalty):
    """Log-likelihood of a cumulative-link model over grades 0 to 3, less the ridge penalty, written out plainly."""
    w, free = parameters[:n_features], parameters[n_features:]
    thresholds = np.cumsum([free[0], *np.exp(free[1:])])
    total = 0.0
    for row, grade in zip(rows, grades, strict=True):
        upto = [0.0, *(1 / (1 + math.exp(-(t - w[row].sum()))) for t in thresholds), 1.0]
        total += math.log(max(upto[grade + 1] - upto[grade], 1e-300))
    return total - penalty / 2 * float(w @ w)


def test_the_fit_is_where_the_likelihood_is_flat():
    r = np.random.default_rng(4)
    rows = [np.flatnonzero(r.random(6) < 0.4) for _ in range(300)]
    true = np.array([2.0, -1.0, 0.5, 1.5, 0.0, -2.0])
    score = np.array([true[x].sum() for x in rows]) + r.logistic(size=300)
    grades = np.searchsorted([0.0, 1.5, 3.0], score)
    w, thresholds = toxicity.fit_ordinal(rows, grades, 6, penalty=0.1, rounds=4000)
    free = np.array([thresholds[0], *np.log(np.diff(thresholds))])
    at = np.concatenate([w, free])
    best = penalised_likelihood(at, rows, grades, 6, 0.1)
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-4
        slope = (penalised_likelihood(at + step, rows, grades, 6, 0.1) - penalised_likelihood(at - step, rows, grades, 6, 0.1)) / 2e-4
        assert abs(slope) < 0.05 * len(rows) ** 0.5, i
        for far in (0.3, -0.3):
            assert penalised_likelihood(at + step * far * 1e4, rows, grades, 6, 0.1) < best
    assert np.corrcoef(w, true)[0, 1] > 0.95


def plain_features(text: str) -> set[str]:
    found = set()
    for word in text.lower().encode().split():
        letters = word.strip(toxicity.EDGES).decode()
        if letters:
            found |= {letters, *("^" + letters[:n] for n in (4, 5, 6) if len(letters) > n)}
    return found


def test_grades_follow_from_weights_and_thresholds(spark, odd_docs):
    docs, labels = toxic_corpus(400, 1)
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.weights) > 5
    rows = docs.union(odd_docs.select("doc_id", "text"))
    texts = collections.Counter((r.doc_id, r.text or "") for r in rows.collect())
    expected = collections.Counter()
    for (doc_id, text), n in texts.items():
        score = sum(model.weights.get(x.encode(), 0.0) for x in plain_features(text))
        above = [1 / (1 + math.exp(t - score)) for t in model.thresholds]
        expected[(doc_id, round(sum(above), 9), round(above[0], 9), sum(x >= 0.5 for x in above))] += n
    got = toxicity.grade(rows, model).collect()
    assert collections.Counter((r.doc_id, round(r.severity, 9), round(r.p_toxic, 9), r.grade) for r in got) == expected
