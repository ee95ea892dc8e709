import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallyframe.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype("<u4")
    data = tokens.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (tokens.unpack(data, bits, len(ids)) == ids).all()


def test_width_is_least():
    assert [tokens.width(n) for n in (1, 2, 3, 256, 257, 50257, 65537)] == [1, 1, 2, 8, 9, 16, 17]


def test_shard_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50257, n).astype("<u4") for n in (0, 3, 700, 1, 0, 64, 65)]
    with open(tmp_path / "x", "wb") as f:
        writer = tokens.ShardWriter(f, 16, block_ids=64)
        for i, d in enumerate(docs):
            writer.add(None if i == 0 else i, d)
        facts = writer.close()
    assert facts["tokens"] == sum(map(len, docs)) and facts["bytes"] == (tmp_path / "x").stat().st_size
    store, path = tokens.open_store(str(tmp_path / "x"))
    with store.open_input_file(path) as f:
        shard = tokens.ShardReader(f)
        assert shard.keys == [None, 1, 2, 3, 4, 5, 6]
        for i, d in enumerate(docs):
            assert (shard.document(i) == d).all()
        whole = np.concatenate(docs)
        for a, b in [(0, 0), (0, 1), (63, 65), (100, 640), (0, len(whole))]:
            assert (shard.ids(a, b) == whole[a:b]).all()


def test_words_encode_like_whole_texts():
    cache, _ = tokens.byte_bpe_encoder.__wrapped__(PATH)
    cache.limit = 40
    random.seed(3)
    parts = ["a", "the", "don't", "it's,", "x.", "\n", " ", "  ", "\t", "é", "3", "<|endoftext|>", "!!", " ", "　", "日本", "\x1c"]
    texts = ["".join(random.choice(parts) + random.choice(["", " "]) for _ in range(random.randint(0, 12))) for _ in range(3000)]
    got = [list(x) for i in range(0, 3000, 500) for x in cache.encode(texts[i : i + 500])]
    assert got == cache.encode_batch(texts)


def test_shards_match_direct_encoding(spark, small):
    manifest = tokens.write_shards(small, "doc_id", "text", PATH)
    got = tokens.read_digests(manifest).orderBy("start").collect()
    direct = Tokenizer.from_file(PATH)
    order = sorted(((r.doc_id, r.text or "") for r in small.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    assert len(got) == len(order)
    for row, (key, text) in zip(got, order):
        ids = np.array(direct.encode(text, add_special_tokens=False).ids + [0], "<u4")
        assert tuple(row) == (key, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    ids = {r.start: r.ids for r in tokens.read_shards(manifest).collect()}
    assert sum(map(len, ids.values())) == start and ids[0][-1] == 0


def test_every_shard_is_read_by_a_task_of_its_own(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so small a table is one shard
    try:
        manifest = tokens.write_shards(docs, "doc_id", "text", PATH)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    shards = manifest.count()
    found = tokens.read_digests(manifest).withColumn("part", F.spark_partition_id())
    assert shards > 1 and found.groupBy("part").count().count() == shards


@pytest.mark.parametrize("seed", range(5))
def test_order_of_new_words_changes_nothing(seed):
    cache, _ = tokens.byte_bpe_encoder.__wrapped__(PATH)
    words = ["a", "don't", "<|endoftext|>", "é", "日本", "\u00a0x", "x.\n", "'", "1234567"]
    random.seed(seed)
    random.shuffle(words)
    cache._learn_few(words)
    assert cache.kept == {w: np.array(cache.encode_batch([" " + w])[0], "<u4").tobytes() for w in words}


def test_empty_table(spark, small):
    manifest = tokens.write_shards(small.filter("false"), "doc_id", "text", PATH)
    assert tokens.read_digests(manifest).count() == 0


def test_white_space_around_blanks_and_at_the_ends():
    cache, _ = tokens.byte_bpe_encoder(PATH)
    texts = [
        "a b", "a\n b", "a \nb", "a  b", " a b", "a b ", "a b\n", "a b \n", "a\n", "\na b", "a b ", "a   b\n\n", "\n b",
        "a b\n c d\n", "one\ttwo three\t", "a b\n\n c", " ", "\n", "x y\r\n", "é ü　", "a 　b c\n",
    ]
    for order in (texts, texts[::-1]):
        for size in (1, 4, len(texts)):
            got = [list(x) for i in range(0, len(order), size) for x in cache.encode(order[i : i + size])]
            assert got == cache.encode_batch(order)
