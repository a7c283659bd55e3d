"""Tokenising by remembered words, for tokenizers whose words never reach over white space."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

# The library's own threads would compete with the other tasks of the machine.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


SLICE_BYTES = 6 << 20
KEPT_BYTES = 64 << 20  # of remembered words, about 300,000
#: What a remembered word takes besides its ids: a string, a number and their place in a table.
WORD_BYTES = 200

#: Marks behind a plain letter or digit and before white space, which the tokenizer parts from it anyway.
MARKS = r"([a-z0-9À-ÖØ-öø-ÿ])([.,!?;:%#$&*]+)(\s|$)"
ASCII_LETTERS = "^[a-z]+$"
#: Words of letters of ASCII and Latin-1 alone.  To these the tokenizer does nothing but lower-casing before it
#: spells their bytes as printable characters and merges those, so the steps before can be left out.
PLAIN_LETTERS = "^[a-zÀ-ÖØ-öø-ÿ]+$"


def spelling() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


SPELT = spelling()


def _matching(words: pa.Array, pattern: str) -> list[bool]:
    return pc.match_substring_regex(words, pattern).to_pylist()


class WordEncoder:
    """Ids of whole texts.

    The vocabulary drops white space and its words end at it, so the ids of a text are those of the
    stretches between ASCII white space in a row.  It drops case too, so A to Z are lower-cased
    first, and it parts letters from marks, so the marks behind a word are made a stretch of their own.  Arrow cuts a
    slice of texts into stretches and numbers the distinct ones; those met before are remembered by number, with all
    ids in one array, and new ones go to the library, whose answer is the definition.  When the remembered words take
    ``keep`` bytes, all but those of the slice at hand are forgotten, so memory is bounded and what is common stays.
    """

    def __init__(self, path: str, keep: int = KEPT_BYTES) -> None:
        self._library = Tokenizer.from_file(path)
        self._library.no_padding()
        self._library.no_truncation()
        self._keep = keep
        self._forget()

    def _forget(self) -> None:
        self._number: dict[str, int] = {}
        self._length = np.zeros(0, np.int64)
        self._ids = np.zeros(0, "<u4")

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in a row."""
        listed, plain = words.to_pylist(), _matching(words, PLAIN_LETTERS)
        merge = self._library.model.tokenize
        other = [w for w, letters in zip(listed, plain, strict=True) if not letters]
        rest = iter(self._library.encode_batch_fast(other, add_special_tokens=False))
        found = []
        for word, letters, ascii_letters in zip(listed, plain, _matching(words, ASCII_LETTERS), strict=True):
            if ascii_letters:
                found.append([t.id for t in merge(word)])
            elif letters:
                found.append([t.id for t in merge(word.lower().encode().decode("latin-1").translate(SPELT))])
            else:
                found.append(next(rest).ids)
        length = np.fromiter(map(len, found), np.int64, len(found))
        return length, np.fromiter(chain.from_iterable(found), "<u4", int(length.sum()))

    def _places(self, words: pa.Array) -> np.ndarray:
        """The numbers under which distinct ``words`` are remembered, new ones included."""
        listed = words.to_pylist()
        at = np.fromiter(map(self._number.get, listed, repeat(-1)), np.int64, len(listed))
        missing = np.flatnonzero(at < 0)
        if len(missing) and len(self._number) * WORD_BYTES + self._ids.nbytes > self._keep:
            self._forget()
            missing = np.arange(len(listed))
        if len(missing):
            length, ids = self._encode_words(words.take(pa.array(missing)))
            at[missing] = len(self._length) + np.arange(len(missing))
            self._number.update(zip([listed[i] for i in missing.tolist()], at[missing].tolist(), strict=True))
            self._length = np.concatenate([self._length, length])
            self._ids = np.concatenate([self._ids, ids])
        return at

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """For slices of non-null ``texts``: the first row, all ids in a row, and where each text's end.

        The last list has one more number than the slice has texts, from 0 on.
        """
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(texts):
            before = int(sizes[start - 1]) if start else 0
            upto = max(start + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
            part = texts.take(pa.array(np.arange(start, upto))).cast(pa.large_string())
            # The special tokens are spelt in lower case only.
            part = pc.if_else(pc.match_substring(part, "<|"), part, pc.ascii_lower(part))
            part = pc.replace_substring_regex(part, pattern=MARKS, replacement=r"\1 \2\3")
            split = pc.ascii_split_whitespace(part)
            numbers = split.flatten().dictionary_encode()
            at = self._places(numbers.dictionary)
            index = at[numbers.indices.to_numpy(zero_copy_only=False)]
            first = np.cumsum(self._length) - self._length
            counts = self._length[index]
            ends = np.concatenate([[0], np.cumsum(counts)])
            place = np.repeat(first[index] - ends[:-1], counts) + np.arange(ends[-1])
            offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
            yield start, self._ids[place], ends[offsets].tolist()
            start = upto

    def encode(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for _, ids, _ in self.encode_texts(pa.array([text])))


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, kept from task to task."""
    return WordEncoder(path)


def as_ids(encoded: bytes) -> np.ndarray:
    return np.frombuffer(encoded, "<u4")


def crc32(encoded: bytes) -> int:
    return zlib.crc32(encoded)
