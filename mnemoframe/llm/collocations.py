"""Phrase collocation mining by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z only), cut into pieces at punctuation and line ends, and into words at blanks. Two prefix polynomials
over the bytes give every word two fingerprints of 64 bits, two more over the words give them to every phrase of up to four words,
for whole Arrow batches at once in numpy. Spark adds up the fingerprints; a row carries its count and the smallest and largest
hash of a document it occurs in, as pointers. Only then are the texts of frequent phrases read, from the documents
pointed to. Where the two texts of one fingerprint differ, its phrases are counted again by their texts.

A phrase is only counted if its parts may be frequent: bitmaps of a fixed 2 ** BITS bits hold the fingerprints of frequent
words, then of frequent pairs. A bit set by another fingerprint costs work and changes nothing.

Null texts count as empty, a null language is `und`; repeated rows count as often as they occur, and ids are only used to
point to texts. Texts are read whole; the memory of a task grows with its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, text_of, written

LONGEST = 4
BITS = 27
CHUNK = 1 << 17
HELD = 1 << 18
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
ROWS = "level int, fp long, chk long, c long, low long, high long, lang string"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below size."""
    def of(b: int) -> np.ndarray:
        each = np.full(size, b, np.uint64)
        each[0] = 1
        return np.multiply.accumulate(each)
    return of(base), of(pow(base, -1, 1 << 64))


def spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(values: np.ndarray, base: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Fingerprints of values[a:b] by a prefix polynomial."""
    power, inverse = powers(base, 1 << max(17, len(values).bit_length()))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=total[1:])
    return lambda a, b: (total[b] - total[a]) * inverse[a]


class Words:
    """Words of some documents, joined end to end in data, with starts of documents; seeds is one number per document and base."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, seeds: np.ndarray):
        self.data = LOWER[data]
        kind = KIND[data]
        inside = kind == 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        own = starts[(starts > 0) & (starts < len(data))]
        first[own] = inside[own]
        last[own - 1] = inside[own - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(starts, self.start, side="right") - 1
        self.piece = np.cumsum(kind == 2)[self.start] + self.doc
        self.seeds, self.phrase = seeds, []
        size = (self.end - self.start).astype(np.uint64)
        for base in BASES.tolist():
            word = spread(spans(self.data.astype(np.uint64) + np.uint64(1), base)(self.start, self.end) + size)
            self.phrase.append(spans(word, base))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words and both fingerprints of all phrases of n words."""
        at = np.arange(max(0, len(self.start) - n + 1))
        at = at[self.piece[at] == self.piece[at + n - 1]]
        fp, chk = (spread(self.phrase[b](at, at + n) + self.seeds[b][self.doc[at]] + np.uint64(n)) for b in (0, 1))
        return at, fp, chk

    def text(self, at: int, n: int) -> str:
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.start[at:at + n], self.end[at:at + n])]).decode()


def seeds_of(langs: list[str]) -> np.ndarray:
    known: dict[str, list[int]] = {}
    each = [known.setdefault(x, [xxhash.xxh64_intdigest(x, s) for s in (1, 2)]) for x in langs]
    return np.array(each, np.uint64).reshape(-1, 2).T


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[Words, int, int]]:
    """Words of a batch with columns text and lang, for some rows at a time: from row, to row."""
    text = batch.column("text")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    ends = np.frombuffer(text.buffers()[1], kind)[text.offset:text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    langs, a = batch.column("lang").to_pylist(), 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, side="right")) - 1)
        if ends[b] > ends[a]:
            yield Words(data[ends[a]:ends[b]], ends[a:b] - ends[a], seeds_of(langs[a:b])), a, b
        a = b


def has(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    at = fp >> np.uint64(64 - BITS)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def kept(words: Words, n: int, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of n words all of whose words (n = 2) or pairs (n > 2) have their bit."""
    at, fp, chk = words.grams(n)
    if bits is None or n == 1:
        return at, fp, chk
    part, own, _ = words.grams(min(n - 1, 2))
    good = np.zeros(len(words.start) + 1, bool)
    good[part] = has(bits, own)
    ok = np.ones(len(at), bool)
    for k in range(n - min(n - 1, 2) + 1):
        ok &= good[at + k]
    return at[ok], fp[ok], chk[ok]


def summed(fp: np.ndarray, chk: np.ndarray, key: np.ndarray, level: int) -> pa.RecordBatch:
    """One row per run of equal fingerprints in sorted order."""
    order = np.argsort(fp)
    fp, chk, key = fp[order], chk[order], key[order]
    cut = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (chk[1:] != chk[:-1])])) if len(fp) else np.empty(0, np.int64)
    c = np.diff(np.append(cut, len(fp)))
    low, high = (op.reduceat(key, cut) if len(cut) else key for op in (np.minimum, np.maximum))
    return pa.record_batch([pa.array(np.full(len(cut), level, np.int32)), *[pa.array(x) for x in (fp[cut].view(np.int64), chk[cut].view(np.int64), c.astype(np.int64), low, high)],
                            pa.nulls(len(cut), pa.string())], names=["level", "fp", "chk", "c", "low", "high", "lang"])


def counted(docs: DataFrame, levels: tuple[int, ...], bits: object | None, least: int) -> DataFrame:
    """Fingerprints of phrases of the given lengths that occur at least `least` times; docs: (key, lang, text). With length 1 also
    one row of level 0 per language with its number of words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in levels}
        total: dict[str, int] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for n in levels:
                if held[n]:
                    yield summed(*[np.concatenate(x) for x in zip(*held[n])], n)
                    held[n].clear()

        for batch in batches:
            key, langs = batch.column("key").to_numpy(zero_copy_only=False), batch.column("lang").to_pylist()
            for words, a, b in chunks(batch):
                for n in levels:
                    at, fp, chk = kept(words, n, bits.value if bits is not None else None)
                    held[n].append((fp, chk, key[a:b][words.doc[at]]))
                    size += len(at)
                if 1 in levels:
                    for d, c in enumerate(np.bincount(words.doc, minlength=b - a).tolist()):
                        total[langs[a + d]] = total.get(langs[a + d], 0) + c
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()
        if total:
            zero = [0] * len(total)
            yield pa.record_batch([pa.array(zero, pa.int32()), pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in total], pa.int64()), pa.array(zero, pa.int64()),
                                   pa.array(list(total.values()), pa.int64()), pa.array(zero, pa.int64()), pa.array(zero, pa.int64()), pa.array(list(total), pa.string())],
                                  names=["level", "fp", "chk", "c", "low", "high", "lang"])

    each = docs.mapInArrow(rows, ROWS).groupBy("level", "fp", "chk", "lang").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"))
    return written(each.where((F.col("c") >= least) | (F.col("level") == 0)), "phrases")


def bitmap(found: DataFrame) -> object:
    """A broadcast bitmap of the fingerprints: 2 ** BITS bits, whatever the number of rows."""
    spot = F.shiftrightunsigned("fp", 64 - BITS)
    words = found.where("level > 0").groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << BITS - 6, np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    return found.sparkSession.sparkContext.broadcast(bits.view(np.uint64))


def texts_of(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(level, fp, chk, lang, phrase) of the fingerprints, from the documents they point to."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, langs, out = batch.column("wanted").to_pylist(), batch.column("lang").to_pylist(), []
            for words, a, b in chunks(batch):
                asked = [set(w) for w in wanted[a:b]]
                every = np.array(list(set().union(*asked)), np.int64).view(np.uint64)
                for n in range(1, LONGEST + 1):
                    at, fp, chk = words.grams(n)
                    near = np.flatnonzero(np.isin(fp, every))
                    seen = set()
                    for i, f, c in zip(near.tolist(), fp[near].view(np.int64).tolist(), chk[near].view(np.int64).tolist()):
                        doc = int(words.doc[at[i]])
                        if (f, c, doc) not in seen and f in asked[doc]:
                            seen.add((f, c, doc))
                            out.append((n, f, c, langs[a + doc], words.text(int(at[i]), n)))
            level, fp, chk, lang, phrase = zip(*out) if out else ((),) * 5
            yield pa.record_batch([pa.array(level, pa.int32()), pa.array(fp, pa.int64()), pa.array(chk, pa.int64()), pa.array(lang, pa.string()), pa.array(phrase, pa.string())],
                                  names=["level", "fp", "chk", "lang", "phrase"])

    pointed = found.where("level > 0").select("fp", F.explode(F.array("low", "high")).alias("key")).groupBy("key").agg(F.collect_set("fp").alias("wanted"))
    return docs.join(pointed, "key").select("lang", "text", "wanted").mapInArrow(rows, "level int, fp long, chk long, lang string, phrase string")


def recounted(docs: DataFrame, clashes: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, words, a) of the phrases under the clashing fingerprints, counted by their texts."""
    bits = bitmap(clashes.withColumn("level", F.lit(1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, out = batch.column("lang").to_pylist(), []
            for words, a, _ in chunks(batch):
                for n in range(1, LONGEST + 1):
                    at, fp, _ = words.grams(n)
                    near = has(bits.value, fp)
                    out += [(n, f, langs[a + d], words.text(i, n)) for i, f, d in zip(at[near].tolist(), fp[near].view(np.int64).tolist(), words.doc[at[near]].tolist())]
            level, fp, lang, phrase = zip(*out) if out else ((),) * 4
            yield pa.record_batch([pa.array(level, pa.int32()), pa.array(fp, pa.int64()), pa.array(lang, pa.string()), pa.array(phrase, pa.string())], names=["words", "fp", "lang", "phrase"])

    each = docs.select("lang", "text").mapInArrow(rows, "words int, fp long, lang string, phrase string").join(clashes, "fp", "left_semi")
    return each.groupBy("lang", "phrase", "words").agg(F.count("*").alias("a")).where(F.col("a") >= least)


def frequent(docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of up to four words that occur `least` times, and (lang, n)."""
    plain = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    plain = plain.select(F.xxhash64("lang", "text").alias("key"), "lang", "text")
    one = counted(plain, (1,), None, least)
    words = bitmap(one)
    two = counted(plain, (2,), words, least)
    pairs = bitmap(two)
    more = counted(plain, (3, 4), pairs, least)
    for bits in (words, pairs):  # the counts are written
        bits.destroy()
    found = one.unionAll(two).unionAll(more)
    named = texts_of(plain, found).groupBy("level", "fp", "chk").agg(F.min(F.struct("lang", "phrase")).alias("x"), F.max(F.struct("lang", "phrase")).alias("y"))
    named = written(named.join(found.where("level > 0").select("level", "fp", "chk", "c"), ["level", "fp", "chk"]), "named")
    clashes = named.where("x <> y").select("fp").distinct()
    sure = named.where("x = y")
    if not clashes.isEmpty():
        sure = sure.join(clashes, "fp", "left_anti")
    phrases = sure.select("x.lang", "x.phrase", F.col("level").alias("words"), F.col("c").alias("a"))
    if not clashes.isEmpty():
        phrases = phrases.unionAll(recounted(plain, clashes, least).select("lang", "phrase", "words", "a"))
    totals = written(one.where("level = 0").groupBy("lang").agg(F.sum("c").alias("n")), "totals")
    for table in (one, two, more):
        forget(table)
    return phrases, totals


def ranked(docs: DataFrame, least: int = 30, scale: int = 2_000_000, covered: int = 80, top: int = 2000, **columns: str) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of two to four words of each language.

    A cut after the first k words gives l and r, the counts of both parts, and floor(scale * a / (l + r)); the lowest score counts,
    then the smallest k. A phrase is dropped where a longer one that holds it occurs at least `covered` hundredths as often.
    Products are decimals of 38 digits.
    """
    phrases, totals = frequent(docs, least, **columns)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    parts = F.split("phrase", " ")
    many = phrases.where("words > 1").withColumn("parts", parts)
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = many.select("lang", "phrase", "a", "parts", cut).select("lang", "phrase", "a", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), " ").alias("first"),
                                                                   F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts")), " ").alias("rest"))
    left, right = phrases.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    value = F.expr(f"cast(a as decimal(20,0)) * {scale}BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).select("lang", "phrase", "a", F.struct(value.alias("score"), "k", "l", "r").alias("s"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(parts, i, m), ' '))))")
    cover = many.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_over = scored.join(cover, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    rows = left_over.select("lang", "phrase", "a", "s.l", "s.r", "s.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
