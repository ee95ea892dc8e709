import importlib

import pytest

pipeline = importlib.import_module("corpus_pipeline")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents before and after every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(steps):
    assert len(pipeline.STAGES) == 5
    for before, after in zip(steps[:4], steps[1:5]):
        assert after.dtypes == before.dtypes


def test_quality_keeps_clean_documents(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    all_ids = {r.doc_id for r in steps[0].collect()}
    good = [i for i in all_ids if labels.get(i) == 1]
    bad = [i for i in all_ids if labels.get(i) == 0]
    assert sum(i in kept for i in good) >= 0.98 * len(good)
    assert sum(i in kept for i in bad) <= 0.1 * len(bad) + 1


def test_line_stage_sets_lengths(steps):
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())
    assert steps[2].count() < steps[1].count()


def test_near_copies_leave_one(steps):
    from tests.llm.test_jaccard import brute

    parts = brute([(r.doc_id, r.text) for r in steps[2].select("doc_id", "text").collect()])
    assert {r.doc_id for r in steps[3].collect()} == {part for _, part in parts.values()}


def test_mix_reorders_without_loss(steps):
    assert sorted(map(tuple, steps[4].collect())) == sorted(map(tuple, steps[3].collect()))


def test_every_document_is_encoded(steps):
    assert {r.doc_id for r in steps[5].collect()} == {r.doc_id for r in steps[4].collect()}
    assert steps[5].filter("NOT (round_trip AND parity)").count() == 0


def test_result_holds_the_ids(steps):
    import public_tokenizers
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in steps[4].collect()}
    rows = steps[5].collect()
    assert rows and all(r.ids == reference.encode(texts[r.doc_id]) for r in rows)


def test_result_is_in_the_order_of_the_mix(spark, tmp_path, monkeypatch):
    """Several sources over several files of uneven sizes, through the last stages of run()."""
    from collections import Counter

    from pyspark.sql import functions as F

    from rallyframe.llm import mixing

    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(20) + F.pmod(F.xxhash64("id"), F.lit(400))), lambda i: F.substring(F.sha1(F.concat_ws("-", F.col("id").cast("string"), i.cast("string"))), 1, 6)))
    source = F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").otherwise("c")
    spark.range(4000).select(F.col("id").alias("doc_id"), source.alias("source"), text.alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    # The stages before the mix are tested above.
    monkeypatch.setattr(pipeline, "STAGES", pipeline.STAGES[3:])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.place for r in rows] == list(range(4000))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    placed = sorted((r.slot, r.start, r._key) for r in mixing.schedule(docs).collect())
    assert [r.doc_id for r in rows] == [k for _, _, k in placed]
    # While all sources last, no source is a block or more off its share at any slot.
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    sizes = Counter(sources.values())
    blocks = {s: -(-n // 64) for s, n in sizes.items()}
    slots = mixing.shares(mixing.default_weights(blocks), 1000)
    seen, left = Counter(), dict(sizes)
    for t in range(sum(blocks.values())):
        if min(left.values()) < 64:
            break
        s = sources[rows[64 * t].doc_id]
        assert all(sources[r.doc_id] == s for r in rows[64 * t : 64 * t + 64])
        seen[s] += 1
        left[s] -= 64
        assert all(abs(seen[x] - slots[x] * (t + 1) / 1000) < 1 for x in slots)
    assert t > 10
