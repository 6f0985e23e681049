import hashlib

import numpy as np
import public_tokenizers
import pytest

from cohortlens.llm import bpe, packing

FILE = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read()
TEXTS = [None, "", " ", "Hello  world\n\n it's 123,456 … <|endoftext|>", "\x00a\x85b c   d", "naïve Ébène 日本語 🙂🙂 ٣٤", "x" * 5000, "a b " * 3000,
         "the the the", "the the the", "\r\n\t\x0b\x0c'S 's 'll", "é" * 700 + " " * 900]


@pytest.mark.parametrize("block, gathered", [(7_000_000, 300_000), (50, 7)])
def test_ids_and_bytes_are_the_librarys(spark, monkeypatch, block, gathered):
    monkeypatch.setattr(bpe, "BLOCK", block)
    monkeypatch.setattr(bpe, "GATHERED", gathered)
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "clash", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(3)
    got = bpe.decode(bpe.encode(df, "text", FILE), "ids", FILE).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "block", "ids", "decoded"}
    enc = bpe.encoder(FILE, public_tokenizers.PATTERN)
    for r in got:
        assert r.text == TEXTS[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "")


def test_empty_table_and_other_vocabulary(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, "text", FILE).count() == 0
    other = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    (row,) = bpe.encode(spark.createDataFrame([(1, "straße größe")], "doc_id long, text string"), "text", other).collect()
    assert np.frombuffer(row.ids, "<u4").tolist() == bpe.encoder(other, public_tokenizers.PATTERN).encode_ordinary("straße größe")


def test_null_ids_decode_to_null_and_arrays(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(np.array([64, 65], "<u4").tobytes()))], "doc_id long, ids binary")
    got = {r.doc_id: r for r in bpe.decode(df, "ids", FILE).withColumn("list", bpe.ids_array("ids")).collect()}
    assert got[1].decoded is None and got[1]["list"] is None and got[2]["list"] == [64, 65]


def test_query(spark):
    got = {r.doc_id: r for r in bpe.op6_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    enc = bpe.encoder(FILE, public_tokenizers.PATTERN)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_packing_round_trips():
    for values in ([], [0], [1, 2 ** 32 - 1, 7], list(range(5000))):
        assert packing.unpack_ints(packing.pack_ints(np.array(values, np.uint32))).tolist() == values
    words = [b"", b"\x00", "é".encode(), b"a" * 300]
    assert packing.unpack_words(packing.pack_words(words)).to_pylist() == words
