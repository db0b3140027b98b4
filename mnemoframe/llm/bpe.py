"""Byte-pair encoding by forced boundaries, and decoding.

A byte pair that occurs inside no vocabulary token can never be merged over, so a cut between the two is certain.
Words are split at such pairs; every fragment is encoded on its own and the ids are concatenated. Words come from the
tokenizer's own rules: special tokens first, then composed form, single blanks, lower case per character, and the
word pattern. White space separates words whatever stands around it, so the result of a run of non-blank characters
depends on it alone; each worker keeps one table of runs and one of words, as packed ids, emptied before they pass
KEPT_BYTES.

Null and empty texts have no tokens. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable
from array import array
from functools import lru_cache
from itertools import chain
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import text_of, unused

WORD_END = "</w>"
KEPT_BYTES = 64 << 20
ENTRY = 100
LONG = 64
BLANKS = regex.compile(r"[^\x20\x09-\x0D]+")
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+").findall
ODD_BLANKS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(free)
            free += 1
    return [names[b] for b in range(256)]


def runs_of(text: str) -> list[str]:
    """Runs of characters that are not ASCII blanks. split() also takes four control characters for blanks."""
    return BLANKS.findall(text) if any(c in text for c in ODD_BLANKS) else text.split()


def words_of(run: str) -> list[str]:
    """Words of a run in composed form and lower case. Capital sigma has one lower form here, whatever follows."""
    if run.isascii():
        return PLAIN_WORDS(run.lower())
    return WORDS(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())


class Known(dict):
    """Results by string, computed when first asked for. Emptied before its bytes pass the bound; long strings are not kept."""

    def __init__(self, make: Callable[[str], object], bound: int = KEPT_BYTES):
        super().__init__()
        self.make, self.bound, self.used = make, bound, 0

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= LONG:
            size = getsizeof(key) + getsizeof(value) + ENTRY
            if self.used + size > self.bound:
                self.clear()
                self.used = 0
            self.used += size
            self[key] = value
        return value


class Encoder:
    """Encodes and decodes with a tokenizer file: byte-level pieces, an end-of-word mark, ranked merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(merges)}
        self.merged = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.model = Tokenizer.from_file(path).model
        self.symbols = byte_symbols()
        self.joined = {a + b for t in self.vocab for a, b in zip(t.removesuffix(WORD_END), t.removesuffix(WORD_END)[1:])}
        self.decimal = {i: str(i) for i in self.token}
        self.word = Known(self._word)
        self.run = Known(self._run)

    def _fragment(self, piece: str, last: bool) -> list[int]:
        """Ids of one fragment. The library's model always marks the end of what it gets as the end of a word, so it
        can take the last fragments only; the others are merged here, by rank, the leftmost of the lowest first."""
        if last:
            return [t.id for t in self.model.tokenize(piece)]
        ids = [self.vocab[c] for c in piece]
        rank, merged, never = self.rank.get, self.merged, len(self.merged)
        ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < never:
            if len(ids) > LONG:  # all places of the pair in one pass: long fragments stay affordable
                out, i = [], 0
                while i < len(ids):
                    here = i < len(ranks) and ranks[i] == low
                    out.append(merged[low] if here else ids[i])
                    i += 1 + here
                ids = out
                ranks = [rank(a << 32 | b, never) for a, b in zip(ids, ids[1:])]
                continue
            i = ranks.index(low)
            ids[i:i + 2] = [merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], never)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], never)
        return ids

    def _word(self, word: str) -> bytes:
        text = word if word.isascii() and word.isalpha() else "".join(map(self.symbols.__getitem__, word.encode("utf-8")))
        joined, end = self.joined, len(text)
        cuts = [0, *(i for i in range(1, end) if text[i - 1:i + 1] not in joined), end]
        return array("i", chain.from_iterable(self._fragment(text[a:b], b == end) for a, b in zip(cuts, cuts[1:]))).tobytes()

    def _run(self, run: str) -> bytes:
        ids = []
        for part in self.special_split.split(run) if "<|" in run else (run,):
            if part in self.special:
                ids.append(array("i", [self.special[part]]).tobytes())
            elif part.isascii() and part.isalpha():
                ids.append(self.word[part.lower()])
            elif part:
                ids += map(self.word.__getitem__, words_of(part))
        return b"".join(ids)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.run.__getitem__, runs_of(text))), np.int32)

    def digests(self, ids: list[int]) -> tuple[str, str]:
        """Hexadecimal digests of the decimal ids, with one blank between them, and of the decoded text."""
        text = " ".join([self.decimal[i] for i in ids])
        return hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()

    def decode(self, ids: list[int]) -> str:
        """The tokens with one blank between them, as the tokenizer has no decoder; unknown ids have no token."""
        return " ".join([self.token[i] for i in ids if i in self.token])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path)


def encoded_batch(own: Encoder, texts: pa.Array, each: Callable[[list[int]], None] | None = None) -> pa.ListArray:
    """Lists of ids, text by text, so that only the ids of a batch are held; `each` is called with those of every text."""
    flat, ends = array("i"), array("i", [0])
    for t in texts:
        ids = own.encode(t.as_py() or "")
        flat.frombytes(ids.view(np.uint8))
        ends.append(len(flat))
        if each:
            each(ids.tolist())
    return pa.ListArray.from_arrays(*[pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)]) for x in (ends, flat)])


def encoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """docs with a column of token ids; an earlier column of that name is replaced."""
    return docs.withColumn(ids, F.arrow_udf(lambda texts: encoded_batch(encoder(path), texts), "array<int>")(text_of(text)))


def decoded(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the decoded text of a column of ids; a null list decodes to the empty text."""
    def batch(lists: pa.Array) -> pa.Array:
        own = encoder(path)
        return pa.array([own.decode(x or []) for x in lists.to_pylist()], pa.string())

    return docs.withColumn(text, F.arrow_udf(batch, "string")(ids))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str | None = None) -> DataFrame:
    """Every row with n_tokens, ids_sha256 and decoded_sha256, and a column of ids if named: one pass, digests taken from the ids."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")

    def batch(texts: pa.Array) -> pa.Array:
        own, sizes, digests = encoder(path), [], []

        def each(x: list[int]) -> None:
            sizes.append(len(x))
            digests.append(own.digests(x))

        lists = encoded_batch(own, texts, each)
        columns = [pa.array(sizes, pa.int64()), *[pa.array([d[k] for d in digests], pa.string()) for k in (0, 1)]]
        return pa.StructArray.from_arrays(columns + [lists] * bool(ids), names + ["ids"] * bool(ids))

    trip = unused(docs, "trip")
    out = docs.withColumn(trip, F.arrow_udf(batch, kind)(text_of(text)))
    return out.withColumns({c: F.col(trip)[c] for c in names} | ({ids: F.col(trip)["ids"]} if ids else {})).drop(trip)
