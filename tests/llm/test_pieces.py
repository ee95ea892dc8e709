import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from rallyframe.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def message(*items):
    """Protobuf bytes of (field, value): str, bytes, float, bool or int."""
    out = b""
    for number, value in items:
        if isinstance(value, float):
            out += bytes([number << 3 | 5]) + struct.pack("<f", value)
        elif isinstance(value, (str, bytes)):
            data = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(data)) + data
        else:
            out += varint(number << 3) + varint(int(value))
    return out


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def unigram_model(path):
    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    words = ["▁", "▁the", "▁cat", "▁ca", "t", "s", "a", "c", "▁t", "he", "h", "e", "▁s", "at", "▁sat", "▁on"]
    listed += [(w, -1.0 - 0.37 * i, 1) for i, w in enumerate(words)]
    model = message(*[(1, message((1, p), (2, s), (3, t))) for p, s, t in listed])
    model += message((2, message((3, 1), (4, len(listed)), (35, True), (40, 0), (41, 1), (42, 2), (43, -1 & (2**64 - 1)))))
    model += message((3, message((1, "identity"), (3, True), (4, False), (5, True))))
    path.write_bytes(model)
    return str(path)


def mixed_texts(n):
    random.seed(4)
    parts = ["the", "cat", "sat", "on", "don't", "\n", " ", "  ", "\t", "é", "3", "<s>", "<unk>", "<0x0A>", "!!", "　", "日本", "🙂", "aaaa", "▁"]
    return ["".join(random.choice(parts) + random.choice(["", " "]) for _ in range(random.randint(0, 12))) for _ in range(n)]


def test_parity_on_bpe_model():
    codec = pieces.PieceCodec(PATH, threads=2, limit=50)
    texts = mixed_texts(3000) + ["", " ", "word " * 2000]
    got = [list(x) for i in range(0, len(texts), 400) for x in codec.encode(texts[i : i + 400])]
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert got == reference.encode(texts)
    back = codec.decode([np.array(x) for x in got])
    assert back == [t.replace("▁", " ") for t in texts]


def test_parity_on_unigram_model(tmp_path):
    path = unigram_model(tmp_path / "u.model")
    codec = pieces.PieceCodec(path, threads=1)
    assert codec.model.kind == pieces.UNIGRAM and codec.model.byte_fallback
    reference = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["the cat sat on the cat", "", "cats", "thé  cat", " a", "tttt on"]
    assert [list(x) for x in codec.encode(texts)] == reference.encode(texts)


def test_report_and_separate_steps(spark, small):
    rows = pieces.encode_report(small, PATH).collect()
    assert len(rows) == small.count() and all(r.round_trip and r.parity for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (3, 4)} == {0}
    encoded = pieces.encode_ids(small, PATH)
    texts = sorted((r.doc_id or 0, r.text) for r in pieces.decode_ids(encoded, PATH).collect())
    assert texts == sorted((r.doc_id or 0, r.text or "") for r in small.collect())
    assert pieces.encode_report(small.filter("false"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_order_of_new_words_changes_nothing(seed):
    """Words reach the cache in the order of a set; any order must give the same ids."""
    random.seed(seed)
    codec = pieces.PieceCodec(PATH, threads=1)
    words = ["▁", "▁ésat", "ésat", "▁▁", "cat", "a▁", "日本", "é", "<0x0A>", "sat", "\u00a0", "🙂x"]
    random.shuffle(words)
    codec._learn_few(words)
    alone = {w: np.array(codec.encode_batch([pieces.MARK + w])[0], "<u4").tobytes() for w in words}
    assert codec.kept == alone


@pytest.mark.parametrize("words", [["▁", "▁ésat"], ["▁ésat", "▁"]])
def test_marks_that_meet_are_not_joined(words):
    codec = pieces.PieceCodec(PATH, threads=1)
    codec._learn_few(words)
    for w in words:
        assert codec.kept[w] == np.array(codec.encode_batch([pieces.MARK + w])[0], "<u4").tobytes()


def test_a_text_that_differs_is_encoded_whole(small, monkeypatch):
    """Wrong ids in the cache reach no result: the text is encoded again."""
    made = []

    class Rows:
        def mapInArrow(self, work, schema):
            made.append(work)

    codec = pieces.PieceCodec(PATH, threads=1)
    codec.kept["moon"] = np.array([5, 6], "<u4").tobytes()
    monkeypatch.setattr(pieces, "codec_of", lambda *_: codec)
    monkeypatch.setattr(pieces, "_rows", lambda *_: Rows())
    pieces.encode_ids(small, PATH, checked=True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the cat sat", "on the moon"])], ["doc_id", "_text"])
    part = next(iter(made[0]([batch])))
    assert part.column(3).to_pylist() == [True, True]
    assert part.column(1).to_pylist() == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(["the cat sat", "on the moon"])


def test_written_ids_are_those_of_whole_texts(spark, small):
    written = pieces.written_ids(small.withColumn("place", small["drop"]), PATH, also=["place"])
    assert written.inputFiles() and all("pieces-" in f for f in written.inputFiles())
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r["drop"]: r.text or "" for r in small.collect()}
    rows = pieces.ids_report(written, PATH, also=["place", "ids"]).collect()
    assert len(rows) == small.count() and all(r.ids == reference.encode(texts[r.place]) and r.n_pieces == len(r.ids) for r in rows)


def test_parity_sees_a_fault_of_the_assembled_ids(spark, small, monkeypatch):
    made = []

    class Rows:
        def mapInArrow(self, work, schema):
            made.append(work)

    class Cut(pieces.PieceCodec):
        def encode(self, texts, end=()):
            return [x[:-1] if "moon" in t else x for t, x in zip(texts, super().encode(texts, end))]

        def whole(self, text):
            return super().whole(text)[:-1]

    codec = Cut(PATH)
    monkeypatch.setattr(pieces, "codec_of", lambda *_: codec)
    monkeypatch.setattr(pieces, "_rows", lambda *_: Rows())
    pieces.encode_ids(small, PATH, checked=True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["the cat sat", "on the moon"])], ["doc_id", "_text"])
    assert [x for part in made[0]([batch]) for x in part.column(3).to_pylist()] == [True, False]


def test_report_sees_changed_files(spark, small):
    written = pieces.written_ids(small, PATH)
    changed = written.selectExpr("doc_id", "slice(ids, 1, 3) AS ids", "text_sha256", "parity")
    rows = pieces.ids_report(changed, PATH).collect()
    assert {r.doc_id for r in rows if not r.round_trip} >= {1, 2, 5, 7} and all(r.n_pieces <= 3 for r in rows)
