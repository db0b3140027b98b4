"""Byte-level BPE encoding and decoding by Spark's higher-order functions.

A rank file gives a rank to byte strings; within each match of a pattern the neighbours whose joined bytes have the lowest
rank are joined, the leftmost first, until no joined pair has a rank. Here a word is the list of its cuts, positions in its
bytes; a step of a fold over that list takes away the cut of the lowest pair. Ranks stand in a literal array of small maps, of which
the hash of a key names one.

Distinct words are counted over all texts; the most frequent ones, at most `kept` of up to LONG bytes each, are encoded once and
become a row of such maps. Every other word is folded where it stands, so the bound of the table decides the work only.

In a list of over SHORT cuts all places of the lowest pair are joined in one step. That equals one place after the other
unless the joined token is part of one with a lower rank; such tokens are marked in the map and joined place by place.

Null and empty texts have no tokens; texts are encoded whole. Decoding joins the pieces of the ids; null ids, ids outside the
vocabulary and a null list has no bytes (null). A column of the name of the result is replaced.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, text_of, unused, written

SHORT = 40
LONG = 64
KEPT = 1 << 18
HOT = 1 << 14
PROBES = 3
NONE = 1 << 40
# Letters and numbers that Unicode 14 to 16 added, for JVMs with an older table.
NEW_LETTERS = """870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3
A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC
105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240
11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33
12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE
1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6
1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"""
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def java_pattern(pattern: str) -> str:
    """The pattern with \\s, \\p{L} and \\p{N} as the newest Unicode has them; a class inside a class is a union
    in Java. The outer range lets common characters pass by the list."""
    for name, ranges in ((r"\p{L}", NEW_LETTERS), (r"\p{N}", NEW_NUMBERS)):
        added = "".join("-".join(f"\\x{{{end}}}" for end in r.split("-")) for r in ranges.split())
        pattern = pattern.replace(name, f"[{name}[\\x{{800}}-\\x{{10FFFF}}&&[{added}]]]")
    return "(?U)" + pattern


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a fold over nothing, of which only the last step is taken."""
    return F.aggregate(F.array(), value, lambda held, _: held, body)


class LiteralMap:
    """A literal map from byte strings: an array of small maps, as Spark looks through all keys of one. The hash of a key names its map;
    bytes stand as hexadecimal digits, as from_json has text keys only."""

    def __init__(self, entries: dict[str, object] | dict[bytes, object], kind: str, key: str):
        self.text, self.places = key == "string", 1 << max(1, len(entries) // 2).bit_length()
        maps: list[dict[str, object]] = [{} for _ in range(self.places)]
        for k, value in entries.items():
            name = k if self.text else k.hex().upper()
            maps[xxhash.xxh64_intdigest(name, seed=42) & self.places - 1][name] = value
        self.table = F.from_json(F.lit(json.dumps(maps)), f"array<map<string,{kind}>>")

    def bound(self, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
        """body(find) with the table standing once in the expression; find gives the value of a key, null if there is none."""
        at = lambda table, k: F.get(table, F.xxhash64(k).bitwiseAND(F.lit(self.places - 1)).cast("int"))[k]
        return let(self.table, lambda table: body(lambda key: let(key if self.text else F.hex(key), lambda k: at(table, k))))


Find = Callable[[Column], Column]


def pair(find: Find, cuts: Column, data: Column, i: Column) -> Column:
    """The rank of the bytes from the cut i, counted from 0, over the next one to the one after; null at the end."""
    return find(F.substring(data, F.get(cuts, i), F.get(cuts, i + 2) - F.get(cuts, i)))


def state(cuts: Column, ranks: Column) -> Column:
    """low: the lowest rank and, in the lower half, its first place."""
    low = lambda r: F.array_min(F.transform(r, lambda x, i: F.shiftleft(x.cast("long"), 32).bitwiseOR(i.cast("long"))))
    return let(ranks, lambda r: F.struct(cuts.alias("cuts"), r.alias("ranks"), low(r).alias("low")))


def one_joined(find: Find, s: Column, data: Column) -> Column:
    """The state without the cut of the first lowest pair: only the pairs before and after it get new ranks."""
    def at(p: Column) -> Column:  # the pair's place, counted from 1, is that of its inner cut, counted from 0
        cuts = F.concat(F.slice(s.cuts, F.lit(1), p), F.slice(s.cuts, p + 2, F.size(s.cuts)))
        new = lambda c: F.when(p > 1, F.array(pair(find, c, data, p - 2), pair(find, c, data, p - 1))).otherwise(F.array(pair(find, c, data, p - 1)))
        return let(cuts, lambda c: state(c, F.concat(F.slice(s.ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), new(c), F.slice(s.ranks, p + 2, F.size(s.ranks)))))
    return let(s.low.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int") + 1, at)


def all_joined(find: Find, s: Column, data: Column) -> Column:
    """The state without the cuts of all lowest pairs that do not overlap."""
    marks = F.split(F.regexp_replace(F.array_join(F.transform(s.ranks, lambda r: F.when(r == F.shiftright(s.low, 32), "1").otherwise("0")), ""), "11", "10"), "")
    cuts = let(marks, lambda m: F.filter(s.cuts, lambda c, i: F.coalesce(F.get(m, i - 1), F.lit("0")) != "1"))
    return let(cuts, lambda c: state(c, F.transform(c, lambda x, i: pair(find, c, data, i))))


def entry(find: Find, data: Column, place: Column) -> Column:
    """A pair as one long: its rank, NONE where it has none, and its three cuts, counted from 0, which are `place`."""
    left, right = F.shiftright(place, 12).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    return F.coalesce(F.shiftleft(find(F.substring(data, left + 1, right - left)).cast("long"), 18), F.lit(NONE << 18)).bitwiseOR(place)


def short_folded(find: Find, data: Column) -> Column:
    """Twice the ids of a word of 2 to SHORT bytes. The least entry is the first lowest pair; the pair before it ends where it ends from
    then on, the pair after it starts where it starts. So a step looks for no place and cuts no list apart."""
    n = F.octet_length(data)
    start = F.transform(F.sequence(F.lit(0), n - 2), lambda i: let((i * 4161 + 66).cast("long"), lambda place: entry(find, data, place)))
    bits = lambda e, mask: e.bitwiseAND(F.lit(mask).cast("long"))
    LEFT, INNER, RIGHT = 63 << 12, 63 << 6, 63

    def joined(low: Column, e: Column) -> Column:
        before, after = bits(F.shiftright(low, 6), INNER) == bits(e, INNER), bits(F.shiftleft(low, 6), INNER) == bits(e, INNER)
        new = lambda place: let(place, lambda p: entry(find, data, p))
        return F.when(before, new(bits(e, LEFT | INNER).bitwiseOR(bits(low, RIGHT)))).when(after, new(bits(low, LEFT).bitwiseOR(bits(e, INNER | RIGHT)))).otherwise(e)

    step = lambda pairs: let(F.array_min(pairs), lambda low: F.when(low < F.lit(NONE << 18), F.transform(F.array_remove(pairs, low), lambda e: joined(low, e))).otherwise(pairs))
    cut = lambda e, place: bits(F.shiftright(e, place), 63).cast("int")
    token = lambda left, right: find(F.substring(data, left + 1, right - left))
    tokens = lambda pairs: F.flatten(F.array(F.array(token(cut(F.get(pairs, F.lit(0)), 12), cut(F.get(pairs, F.lit(0)), 6))), F.transform(pairs, lambda e: token(cut(e, 6), cut(e, 0)))))
    return F.aggregate(F.sequence(F.lit(2), n), start, lambda pairs, _: step(pairs), tokens)


def folded(find: Find, data: Column) -> Column:
    """Ids of the bytes of one word. A word that is a token itself is that token."""
    n = F.octet_length(data)
    start = let(F.sequence(F.lit(1), n + 1), lambda c: state(c, F.transform(c, lambda x, i: find(F.substring(data, x, F.when(i < n - 1, F.lit(2)))))))
    step = lambda s: F.when((F.size(s.cuts) > SHORT) & (F.shiftright(s.low, 32).bitwiseAND(F.lit(1)) == 0), all_joined(find, s, data)).otherwise(one_joined(find, s, data))
    end = F.aggregate(F.sequence(F.lit(1), n), start, lambda s, _: F.when(s.low.isNull(), s).otherwise(step(s)), lambda s: s.cuts)
    ids = let(end, lambda cuts: F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1), lambda c, i: find(F.substring(data, c, F.get(cuts, i + 1) - c))))
    ids = F.when((n > 1) & (n <= SHORT), short_folded(find, data)).otherwise(ids)
    return F.transform(let(find(data), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(ids)), lambda r: F.shiftright(r, 1))


def rank_map(path: str) -> LiteralMap:
    """Twice the rank of each piece, plus one where a piece is part of one of lower rank."""
    ranks = ranks_of(path)
    lower = {part for piece, rank in ranks.items() for i in range(1, len(piece)) for part in (piece[:i], piece[i:]) if ranks.get(part, -1) > rank}
    return LiteralMap({piece: rank << 1 | (piece in lower) for piece, rank in ranks.items()}, "int", "binary")


class KnownWords:
    """Ids of frequent words in one row, which a scalar subquery hands to the tasks: an array of small maps, as in LiteralMap. The hash of a
    word names its map, which holds the PROBES most frequent of its words; the others are left out. The HOT first words are asked for in
    a small array before the large one, as it stays in the processor's cache."""

    def __init__(self, spark: SparkSession, rows: DataFrame | pa.Table):
        rows = spark.createDataFrame(rows) if isinstance(rows, pa.Table) else rows
        words = rows.count()
        self.parts = [(f"maps{i}", 1 << max(1, 2 * n - 1).bit_length()) for i, n in enumerate((min(HOT, words), words))]
        hot, whole = (self._placed(own, name, places) for own, (name, places) in zip((rows.orderBy(F.desc("n"), "word").limit(HOT), rows), self.parts))
        self.table = written(hot.crossJoin(whole).select(F.struct(*[name for name, _ in self.parts]).alias("table")), "known").scalar()

    @staticmethod
    def _placed(rows: DataFrame, name: str, places: int) -> DataFrame:
        """One row: the maps in the order of their places, null where there is no word."""
        place = F.xxhash64("word").bitwiseAND(F.lit(places - 1)).alias("place")
        first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "word", "ids"))), 1, PROBES)
        maps = rows.groupBy(place).agg(F.map_from_entries(F.transform(first, lambda w: F.struct(w.word, w.ids))).alias("map"))
        placed = rows.sparkSession.range(places).join(maps, F.col("id") == F.col("place"), "left").select("id", F.struct("map").alias("held"))
        return placed.repartition(1).sortWithinPartitions("id").agg(F.collect_list("held").alias("held")).select(F.col("held.map").alias(name))

    def joined(self, df: DataFrame, name: str, body: Callable[[Callable[[Column], Column]], Column]) -> DataFrame:
        """df with a column body(look); look gives the ids of a word, a lambda's variable, or null. The subquery stands in a column
        of its own, as it may not be written inside a higher-order function; used once, it is moved there by the optimizer."""
        look = lambda table, word: F.coalesce(*[F.get(table[name], F.xxhash64(word).bitwiseAND(F.lit(places - 1)).cast("int"))[word] for name, places in self.parts])
        held = unused(df, "held")
        return df.withColumn(held, self.table).withColumn(name, let(F.col(held), lambda table: body(lambda word: look(table, word)))).drop(held)


def frequent(words: DataFrame, ranks: LiteralMap, kept: int) -> KnownWords | None:
    """Ids of the words of a column `word` that occur most often, at most `kept` of them; None if there are none."""
    counts = written(words.where(F.octet_length("word") <= LONG).groupBy("word").agg(F.count("*").alias("n")).where("n > 1"), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    least, total = None, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # some hundreds of levels
        total += r.n
        if total > kept:
            break
        least = r.level
    ids = ranks.bound(lambda find: let(F.col("word").cast("binary"), lambda data: folded(find, data))).alias("ids")
    known = None if least is None else KnownWords(words.sparkSession, written(counts.where(level >= least).select("word", ids, "n"), "ids"))
    forget(counts)
    return known


def words_of(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(text_of(text), F.lit(java_pattern(pattern)), F.lit(0))


def encoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids", text: str = "text", kept: int = KEPT) -> DataFrame:
    """docs with a column of token ids."""
    ranks = rank_map(path)
    known = frequent(docs.select(F.explode(words_of(text, pattern)).alias("word")), ranks, kept)

    def each(find: Find, look: Find | None) -> Column:
        fold = lambda w: let(w.cast("binary"), lambda data: folded(find, data))
        return F.transform(words_of(text, pattern), lambda w: F.coalesce(look(w), fold(w)) if look else fold(w))

    whole = lambda look: F.flatten(ranks.bound(lambda find: each(find, look)))
    return known.joined(docs, ids, whole) if known else docs.withColumn(ids, whole(None))


def decoded(docs: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """docs with the bytes of a column of ids, whose pieces are joined as hexadecimal digits in linear time."""
    ranks = ranks_of(path)
    pieces = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return docs.withColumn(data, F.unhex(F.array_join(let(table, lambda t: F.transform(ids, lambda i: F.get(t, i))), "")))
