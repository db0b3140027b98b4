"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import functions as F

from mnemoframe.llm import byte_bpe, queries

PATH = P.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})


def texts():
    draw = random.Random(4)
    pool = ["the", " of", "ing", "é", "ß", "Ω", "漢", " ", "  ", "\n", "'s", "'LL", "12", "٣", "!!", "--", "_", "\t", "😀", "\U000323af", "\u0870", "\x85", "\xa0", "\u3000", "<|endoftext|>"]
    out = ["", "hello world  don't", "a" * 3001, "日本語" * 60, "".join(draw.choice("etaoin") for _ in range(4000)), " " * 500 + "x", "ab" * 700]
    out += ["".join(draw.choice(pool) for _ in range(draw.randint(1, 30))) for _ in range(400)]
    out += ["".join(chr(draw.choice([draw.randint(0, 126), draw.randint(128, 0x2FFF), draw.randint(0x3000, 0xD7FF), draw.randint(0xE000, 0x10FFFF)])) for _ in range(30)) for _ in range(400)]
    return out + ["".join(draw.choice("abcdefghinorst") for _ in range(draw.randint(30, 200))) for _ in range(40)] * 2


def test_ids_equal_the_library(spark):
    own = texts()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(own)] + [(None, None, 2)], "doc_id long, text string, ids int").repartition(8)
    for kept in (0, 300):  # without the map of frequent words and with it
        for r in byte_bpe.decoded(byte_bpe.encoded(docs, PATH, P.PATTERN, kept=kept), PATH).collect():
            text = own[r.doc_id] if r.doc_id is not None else ""
            assert r.ids == LIBRARY.encode_ordinary(text) and bytes(r.decoded) == text.encode(), text[:80]


def test_odd_ids_and_empty_tables(spark):
    ids = spark.createDataFrame([([31373, None, 99999999, -1, 995],), (None,), ([],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded) for r in byte_bpe.decoded(ids, PATH).collect()] == [b"hello world", None, b""]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encoded(none, PATH, P.PATTERN).count() == 0


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_byte_bpe(spark, sf).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = LIBRARY.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text[r.doc_id].encode()).hexdigest())


def test_a_key_is_found_at_its_place_only(spark):
    found = byte_bpe.LiteralMap({f"w{i}": i for i in range(5000)}, "int", "string")
    got = spark.range(6000).select("id", found.bound(lambda find: find(F.concat(F.lit("w"), F.col("id").cast("string")))).alias("v")).collect()
    assert all(r.v == (r.id if r.id < 5000 else None) for r in got)


def test_short_words_equal_the_library(spark):
    """Words around the bound of the short fold, by that fold alone where it applies."""
    draw = random.Random(6)
    pool = ["a", "b", "e", "the", "ing", "tion", "é", "漢", "1", "!", " ", "\n"]
    own = sorted({"".join(draw.choice(pool) for _ in range(draw.randint(1, 16))) for _ in range(1500)} | {"aab" * k for k in range(1, 20)} | {"a" * k for k in range(1, 60)})
    short = [w for w in own if 2 <= len(w.encode()) <= byte_bpe.SHORT]
    ranks, rank_of = byte_bpe.rank_map(PATH), byte_bpe.ranks_of(PATH)
    words = spark.createDataFrame([(w,) for w in short], "word string").repartition(6)
    whole = byte_bpe.folded
    for r in words.select("word", ranks.bound(lambda find: whole(find, F.encode("word", "UTF-8"))).alias("ids")).collect():
        assert r.ids == LIBRARY._encode_single_piece(r.word.encode()), r.word
    some = words.where(~F.col("word").isin([w for w in short if w.encode() in rank_of]))
    for r in some.select("word", ranks.bound(lambda find: byte_bpe.short_folded(find, F.encode("word", "UTF-8"))).alias("ids")).collect():
        assert [i >> 1 for i in r.ids] == LIBRARY._encode_single_piece(r.word.encode()), r.word


def test_frequent_words_reach_the_tasks_by_a_subquery(spark):
    """No word is a literal of the plan; a word gets its own ids or none, and few get none."""
    rows = pa.table({"word": [f"w{i}é" for i in range(20000)], "ids": pa.array([[i, i + 1][:1 + i % 2] for i in range(20000)], pa.list_(pa.int32())), "n": range(20000, 0, -1),
                     "hash": pa.array([xxhash.xxh64_intdigest(f"w{i}é", seed=42) for i in range(20000)], pa.uint64()).view(pa.int64())})
    words = spark.range(30000).select("id", F.array(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("é")), F.lit("?")).alias("own"))
    found = byte_bpe.KnownWords(spark, rows).joined(words, "found", lambda look: F.transform("own", look))
    assert "w19999" not in found._jdf.queryExecution().toString()
    got = {r.id: r.found for r in found.collect()}
    assert all(v[1] is None and v[0] in ([i, i + 1][:1 + i % 2], None)[i >= 20000:] for i, v in got.items())
    assert sum(got[i][0] is not None for i in range(10000)) > 9900 and sum(v[0] is not None for v in got.values()) > 18000


def test_words_left_out_of_the_table_are_folded(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HOT", 4)
    monkeypatch.setattr(byte_bpe, "PROBES", 1)
    own = [" ".join(f"zq{i}xk theoninghees{i % 7}" for i in range(k, k + 60)) for k in range(40)]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").withColumn("held", F.lit("kept"))
    for r in byte_bpe.encoded(docs, PATH, P.PATTERN).collect():
        assert r.ids == LIBRARY.encode_ordinary(own[r.doc_id]) and r.held == "kept"


def test_the_table_of_frequent_words_is_built_by_spark(spark, monkeypatch):
    """Words and ids do not pass the driver's Python; a place holds its most frequent words, at most PROBES of them."""
    monkeypatch.setattr(type(spark.range(0)), "toArrow", None)
    monkeypatch.setattr(byte_bpe, "HOT", 2)
    monkeypatch.setattr(byte_bpe, "PROBES", 1)
    own = [w for i in range(64) for w in [f"zq{i}theon"] * (i + 2)]
    words = spark.createDataFrame([(w,) for w in own], "word string").repartition(4)
    known = byte_bpe.frequent(words, byte_bpe.rank_map(PATH), 1000)
    got = {r.word: r.ids[0] for r in known.joined(words.distinct().withColumn("list", F.array("word")), "ids", lambda look: F.transform("list", look)).collect()}
    assert all(v in (None, LIBRARY._encode_single_piece(w.encode())) for w, v in got.items())
    places: dict[int, list[int]] = {}
    for i in range(64):
        places.setdefault(xxhash.xxh64_intdigest(f"zq{i}theon", seed=42) & 127, []).append(i)
    held = {max(own) for own in places.values()} | {62, 63}
    assert {i for i in range(64) if got[f"zq{i}theon"] is not None} == held and len(held) < 64
