import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlens.llm import sharding


def plain_jump(key, shards):
    key, b, j = key % 2 ** 64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = [0, 1, 2, 2 ** 63, 2 ** 64 - 1, *range(1000, 1500)]
    for shards in (1, 2, 8, 9, 1000):
        assert sharding.jump(np.array(keys, np.uint64), shards).tolist() == [plain_jump(k, shards) for k in keys]
    assert sharding.jump(np.array([], np.uint64), 8).tolist() == []


def test_another_shard_takes_rows_only_into_itself():
    keys = np.arange(20000, dtype=np.uint64)
    old, new = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(new[old != new]) == {8} and abs((old != new).mean() - 1 / 9) < 0.01
    assert max(Counter(old.tolist()).values()) < 1.1 * 20000 / 8


def test_query(spark):
    got = sharding.op2_jump_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) == (len(body) + 1, zlib.crc32(body), "key", plain_jump(r.doc_id, 8), plain_jump(r.doc_id, 9))
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_repeated_rows_and_nulls_have_places(spark, chunk):
    rows = [(None, "x", 9)] * 3 + [(5, None, 9)] * 50 + [(i, "t", 9) for i in range(40)]
    df = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string, shard int"), "doc_id", 3)
    assert df.columns == ["doc_id", "text", "shard", "grown_shard"] and df.count() == len(rows)
    got = sharding.numbered(df, ["doc_id", "text", "shard"], buckets=4, chunk=chunk).collect()
    for shard in range(3):
        mine = [r.slot for r in got if r.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    assert {r.shard for r in got if r.doc_id is None} == {plain_jump(0, 3)}


def test_empty_table_string_keys_and_files(spark, tmp_path):
    assert sharding.assign(spark.createDataFrame([], "k string"), "k").count() == 0
    df = spark.createDataFrame([(f"k{i % 5}", i) for i in range(100)], "k string, v int")
    shards = {}
    for r in sharding.assign(df, "k", 4).collect():
        assert shards.setdefault(r.k, r.shard) == r.shard
    sharding.write_shards(df, "k", str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and all(shards[r.k] == r.shard for r in back.collect())
    with pytest.raises(ValueError):
        sharding.assign(df, "k", 0)
