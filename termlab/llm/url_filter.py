"""URL filters: rules by host and path, and for the rest a naive Bayes verdict on segmented hosts and path tokens.

Host names run words together, so they are cut by unigram Viterbi: of all ways to split a stretch of letters into
words of the pages' own texts, the likeliest.  The classifier is multinomial naive Bayes, trained on the pages that a
rule decides.  All likelihoods are whole thousandths of a natural logarithm, rounded down, so that sums and ties
don't depend on the order of addition.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termlab.llm.common import tidied
from termlab.llm.lexicon import frequent, spaced, word_counts
from termlab.sources.tables import stage

LEXICON = 50_000  # words of the unigram model, at most
SHORTEST, LONGEST = 3, 24  # bytes of a word of the unigram model; shorter ones would chop every unknown name
TOKENS = 50_000  # tokens of the classifier, at most
REMEMBERED = 20_000  # segmented stretches a task keeps at hand
MARKUP = re.compile(rb"<script.*?</script>|<style.*?</style>|<[^>]*>", re.DOTALL)
#: Words are runs of ASCII letters and all that is not ASCII.
TABLE = spaced(b"abcdefghijklmnopqrstuvwxyz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CASE = str.maketrans(UPPER, LOWER)
PARTS = re.compile(r"[0-9]+|[^\x00-\x60\x7B-\x7F]+")


def _words(texts: list[bytes]) -> list[bytes]:
    return b" ".join(MARKUP.sub(b" ", text) for text in texts).translate(TABLE).split()


def _log(share: float) -> int:
    return math.floor(1000 * math.log(share))


@dataclass(frozen=True)
class Unigrams:
    """Word likelihoods; a letter that no known word covers costs as much as a word seen a tenth of a time."""

    likelihood: dict[str, int] = field(default_factory=dict)
    letter: int = 0

    @classmethod
    def of(cls, counts: Iterable[tuple[bytes, int]]) -> Unigrams:
        counts = list(counts)
        total = sum(n for _, n in counts) or 1
        return cls({w.decode("utf-8", "replace"): _log(n / total) for w, n in counts}, _log(0.1 / total))

    def split(self, letters: str) -> tuple[str, ...]:
        """The likeliest words of a stretch; of equally likely ways the one whose last words are longer.

        Adjacent letters outside known words make one word.
        """
        best, step = [0], [0]
        longest = max(map(len, self.likelihood), default=1)
        for end in range(1, len(letters) + 1):
            top, back = best[end - 1] + self.letter, 0  # 0: a letter outside known words
            for size in range(1, min(end, longest) + 1):
                known = self.likelihood.get(letters[end - size : end])
                if known is not None and best[end - size] + known >= top:
                    top, back = best[end - size] + known, size
            best.append(top)
            step.append(back)
        words, end, loose = [], len(letters), ""
        while end:
            if step[end]:
                words += [loose] * bool(loose) + [letters[end - step[end] : end]]
                loose, end = "", end - step[end]
            else:
                loose, end = letters[end - 1] + loose, end - 1
        return tuple(reversed(words + [loose] * bool(loose)))


class Tokens:
    """Tokens of a URL: ``h:`` words of the segmented host, ``p:`` words of the path, digits as 0."""

    def __init__(self, unigrams: Unigrams) -> None:
        self._unigrams = unigrams
        self._remembered = lru_cache(maxsize=REMEMBERED)(unigrams.split)

    def _split(self, letters: str) -> tuple[str, ...]:
        return self._remembered(letters) if len(letters) < 64 else self._unigrams.split(letters)

    def of(self, host: str, path: str) -> list[str]:
        found = []
        for part in PARTS.findall(host):
            found += ["h:0"] if part[0].isdecimal() and part.isascii() else [f"h:{w}" for w in self._split(part)]
        for part in PARTS.findall(path.translate(CASE)):
            found.append("p:0" if part[0].isdecimal() and part.isascii() else f"p:{part}")
        return found


@dataclass(frozen=True)
class Rules:
    """``(verdict, host, path)`` triples.  A rule fits its host and the hosts below, for paths that start with its own."""

    by_host: dict[str, list[tuple[int, str, str, str]]]
    depth: int

    @classmethod
    def of(cls, rules: Iterable[tuple[str, str, str]]) -> Rules:
        by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for verdict, host, path in rules:
            by_host.setdefault(host, []).append((len(host + path), verdict, host + path, path))
        return cls(by_host, max((host.count(".") + 1 for host in by_host), default=0))

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits, of equally long ones a block and then the last by text, and its verdict."""
        names = host.rsplit(".", self.depth)
        fits = []
        for i in range(len(names)):
            for n, verdict, text, begin in self.by_host.get(".".join(names[i:]), ()):
                if path.startswith(begin):
                    fits.append((n, verdict == "block", text))
        if not fits:
            return None, None
        _, block, text = max(fits)
        return text, "block" if block else "allow"


@dataclass(frozen=True)
class NaiveBayes:
    """How much each token, and the share of blocked pages, speaks for a block."""

    weights: dict[str, int] = field(default_factory=dict)
    start: int = 0

    @classmethod
    def of(cls, tokens: Iterable[tuple[str, int, int]], allowed: int, blocked: int) -> NaiveBayes:
        """From each token's counts in allowed and in blocked pages, and the numbers of such pages."""
        tokens = list(tokens)
        in_allowed = sum(a for _, a, _ in tokens) + len(tokens)
        in_blocked = sum(b for _, _, b in tokens) + len(tokens)
        return cls(
            {t: _log((b + 1) / in_blocked) - _log((a + 1) / in_allowed) for t, a, b in tokens},
            _log((blocked + 1) / (allowed + blocked + 2)) - _log((allowed + 1) / (allowed + blocked + 2)),
        )

    def score(self, tokens: Iterable[str]) -> int:
        """Above 0 for a block.  Tokens met in no decided page say nothing."""
        return self.start + sum(self.weights.get(t, 0) for t in tokens)


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, html``: the host in lower case (A to Z), both empty without ``://``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit("")).alias("rest")
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), rest, F.col("html").cast("string").alias("html"))
    return pages.select(
        "page_id",
        F.translate(F.regexp_extract("rest", "^([^/?#]*)([^?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^([^/?#]*)([^?#]*)", 2).alias("path"),
        "html",
    )


def own_texts(urls: DataFrame) -> DataFrame:
    """``text``: the html without the page's own host.  Sites name themselves, which would make every host a word."""
    return urls.select(F.expr("if(host = '', html, replace(html, host, ' '))").alias("text"))


def token_counts(urls: DataFrame, rules: Rules, unigrams: Unigrams) -> DataFrame:
    """``token, a, b``: counts in the pages that a rule allows and blocks; the null token counts the pages.

    A task counts before anything moves and hands its counts on whenever it holds many.
    """

    @tidied
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, held = Tokens(unigrams), {}

        def handed() -> pa.RecordBatch:
            columns = [list(held), [n[0] for n in held.values()], [n[1] for n in held.values()]]
            held.clear()
            kinds = [pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["token", "a", "b"])

        for batch in batches:
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                verdict = rules.decide(host, path)[1]
                if verdict:
                    for token in (None, *tokens.of(host, path)):
                        held.setdefault(token, [0, 0])[verdict == "block"] += 1
            if len(held) > 100_000:
                yield handed()
        yield handed()

    found = urls.select("host", "path").mapInArrow(counted, "token string, a bigint, b bigint")
    return stage(found.groupBy("token").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "tokens")


def train(urls: DataFrame, rules: Rules, unigrams: Unigrams, size: int = TOKENS) -> NaiveBayes:
    """Fitted on all pages that a rule decides, with their most frequent ``size`` tokens at most."""
    counts = token_counts(urls, rules, unigrams)
    pages = counts.where("token IS NULL").first()
    if pages is None:
        return NaiveBayes()
    # A token of unbounded length would not be one of a bounded model.
    some = counts.where("token IS NOT NULL AND octet_length(token) <= 64")
    chosen = frequent(some.select(F.encode("token", "utf-8").alias("word"), (F.col("a") + F.col("b")).alias("n")), size)
    least = min((n for _, n in chosen), default=1)
    rows = some.where(F.col("a") + F.col("b") >= least).collect()
    return NaiveBayes.of([(r["token"], r["a"], r["b"]) for r in rows], pages["a"], pages["b"])


def judge(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], lexicon: int = LEXICON, tokens: int = TOKENS
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score, words`` of every row of ``page_id, url, html``.

    ``rule`` is the host and path of the rule that decides, else null; ``score`` is the classifier's (above 0: block) and
    decides without a rule; ``words`` are the tokens it saw.  The unigram model counts the words of all pages' html but for
    their own hosts, the classifier all pages that a rule decides; without such pages it allows.

    A null url, or one without ``://``, has an empty host and path, so only the share of blocked pages speaks.  Null
    html has no words.  Rows that repeat a page_id are rows of their own; null ids stay null; no pages give no rows.
    Other columns, whatever their names, are left behind.
    """
    known = Rules.of(rules)
    whole = parsed(pages)
    urls = whole.drop("html")
    unigrams = Unigrams.of(frequent(word_counts(own_texts(whole), "text", _words, LONGEST, SHORTEST), lexicon))
    model = train(urls, known, unigrams, tokens)

    @tidied
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Tokens(unigrams)
        for batch in batches:
            rules_, verdicts, scores, words = [], [], [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                rule, verdict = known.decide(host, path)
                found = seen.of(host, path)
                score = model.score(found)
                rules_.append(rule)
                verdicts.append(verdict or ("block" if score > 0 else "allow"))
                scores.append(score)
                words.append(" ".join(found))
            columns = [pa.array(rules_, pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns, pa.array(words, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "score", "words"],
            )

    schema = "page_id bigint, host string, path string, rule string, verdict string, score bigint, words string"
    return urls.mapInArrow(judged, schema)
