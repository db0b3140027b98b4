"""Encoding against the tokenizers library itself, and the token files against a plain encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mnemoframe.llm import bpe, token_files
from mnemoframe.llm.bpe import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\t", "Hello world's end, don't", "ΑΣ ΑΣΑ", "é é", "İstanbul", "<|endoftext|> <|startoftext|>x", "a\x1cb\x85c\xa0d", "x" * 3000, "日本語 \U0001F600!!", "½²٣", "tab\x0bvt\x0cff"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n):
    draw, parts = random.Random(5), [*"ab cdeÉéΣσςİ1234½'.!\n\xa0\x1c", "<|endoftext|>", "'s", "ing", "THE ", "\U0001F600", "é"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 60))) for _ in range(n)]


def test_encoder_equals_library(library):
    own = Encoder(PATH)
    for t in ODD + random_texts(1500):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want, t
        assert own.decode(want) == library.decode(want, skip_special_tokens=False), t


def test_no_token_spans_a_cut(library):
    own = Encoder(PATH)
    assert all(t[i:i + 2] in own.joined for t in own.vocab for i in range(len(t.removesuffix("</w>")) - 1))


def test_round_trip_columns(spark, library):
    import hashlib
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.round_trip(docs, PATH).collect()}
    ids = {r.doc_id: r for r in bpe.decoded(bpe.encoded(docs, PATH), PATH).collect()}
    for i, t in enumerate([*ODD, ""]):
        want = library.encode(t, add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert ids[i].ids == want and ids[i].decoded == back
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0


def test_token_files_hold_every_document_in_order(spark, library, tmp_path):
    texts = [*ODD, None, *random_texts(120)]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(7, "repeated id"), (7, "repeated id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = f"file://{tmp_path}/tokens"
    manifest = token_files.write_shards(docs, PATH, folder, 2, length=64)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, text) in zip(got, order, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.stored(docs.limit(0), PATH, 2).count() == 0


def test_sequences_are_views_with_masks(tmp_path):
    path = str(tmp_path / "s.arrow")
    with pa.OSFile(path, "wb") as sink:
        w = token_files.ShardWriter(sink, pa.uint16(), 9, length=4, rows=2)
        for k in range(7):
            w.add(np.arange(k, 2 * k, dtype=np.uint16).tobytes())
        w.close()
    flat = np.concatenate([np.arange(k, 2 * k) for k in range(7)])
    shard = token_files.Shard(path)
    assert len(shard) == 6 and len({len(b) for b in shard.batches[:-1]}) == 1
    for r in range(len(shard)):
        ids, mask = shard[r]
        assert not ids.flags.owndata and len(ids) == len(mask) == 4
        n = sum(mask.to_pylist())
        assert ids[:n].tolist() == flat[4 * r:4 * r + n].tolist() and set(ids[n:].tolist()) <= {9}
    assert shard.tokens(3, 12).tolist() == flat[3:15].tolist()


def test_shards_are_streams_any_reader_opens(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string")
    manifest = token_files.write_shards(docs, PATH, f"file://{tmp_path}/t", 2, length=8).collect()
    table = pa.concat_tables([pa.ipc.open_stream(f"{m.path.removeprefix('file://')}.arrow").read_all() for m in manifest])
    assert table.schema.field("input_ids").type.list_size == 8 and sum(sum(x) for x in table["mask"].to_pylist()) == sum(m.n_tokens for m in manifest)
    assert docs.select(F.count("*")).first()[0] == 2
