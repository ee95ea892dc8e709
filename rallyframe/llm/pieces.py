"""SentencePiece models run by the tokenizers library: encoding, decoding, parity.

The model file is a protobuf message; its pieces, types, scores and normaliser settings are
read from the wire format and rebuilt as a tokenizer: normaliser (character map, dummy prefix,
white-space mark), unigram scores or merges in order of score, byte fallback, decoder. The ids
of every whole text, as assembled from its words, are compared with those of the sentencepiece
library, written to the shared folder, read again and decoded.
"""

import functools
import hashlib
import os
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rallyframe.llm.files import stored
from rallyframe.llm.tokens import WordCache

MARK = "▁"
# Piece types and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data):
    """(number, value) of every field of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {kind}")


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list = field(default_factory=list)
    scores: list = field(default_factory=list)
    types: list = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @classmethod
    def parse(cls, data):
        model = cls()
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                model.pieces.append(piece)
                model.scores.append(score)
                model.types.append(kind)
            elif number == 2:
                for n, v in fields(value):
                    if n == 3:
                        model.kind = v
                    elif n == 35:
                        model.byte_fallback = bool(v)
            elif number == 3:
                for n, v in fields(value):
                    if n == 2:
                        model.charsmap = v
                    elif n == 3:
                        model.dummy_prefix = bool(v)
                    elif n == 4:
                        model.squeeze = bool(v)
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        return model

    def merges(self):
        """Pairs that make a piece, best score first."""
        ranks = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED)}
        order = sorted((i for i, t in enumerate(self.types) if t == NORMAL), key=lambda i: (-self.scores[i], i))
        pairs = []
        for i in order:
            piece = self.pieces[i]
            cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
            pairs += sorted((c for c in cuts if c[0] in ranks and c[1] in ranks), key=lambda c: (ranks[c[0]], ranks[c[1]]))
        return pairs

    def separable(self):
        """Whether a cut before the mark never divides a piece."""
        return not any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types) if t in (NORMAL, USER_DEFINED))

    def tokenizer(self, normalise=True):
        """The tokenizer; without ``normalise`` it takes text whose blanks are marks already."""
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

        unknown = self.types.index(UNKNOWN)
        if self.kind == UNIGRAM:
            model = models.Unigram(list(zip(self.pieces, self.scores)), unknown, self.byte_fallback)
        else:
            vocabulary = {p: i for i, p in enumerate(self.pieces)}
            model = models.BPE(
                vocabulary, self.merges(), unk_token=self.pieces[unknown], fuse_unk=True, byte_fallback=self.byte_fallback
            )
        tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if normalise:
            if self.squeeze:
                steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
            steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
            steps += [normalizers.Replace(" ", MARK)]
        if steps:
            tokenizer.normalizer = normalizers.Sequence(steps)
        own = [p for p, t in zip(self.pieces, self.types) if t == USER_DEFINED]
        if own:
            tokenizer.add_tokens([AddedToken(p, normalized=False) for p in own])
        tail = [decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []
        tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
        return tokenizer


class PieceCodec(WordCache):
    """Encodes and decodes batches of texts with the rebuilt tokenizer."""

    def __init__(self, path, threads=2, limit=200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        with open(path, "rb") as file:
            self.model = PieceModel.parse(file.read())
        model = self.model
        self.by_words = model.separable() and not model.charsmap and not model.squeeze and model.dummy_prefix
        self.tokenizer = model.tokenizer(normalise=not self.by_words)
        sizes = [len(p.encode()) if t in (NORMAL, USER_DEFINED) else t == BYTE for p, t in zip(model.pieces, model.types)]
        first, mark = (MARK, MARK) if self.by_words else ("", " ")
        super().__init__(self._batch, np.array(sizes, np.int64), mark, first, limit)
        said = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for p, t in zip(model.pieces, model.types)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.concatenate([[0], np.cumsum([len(x) for x in said])])

    def _batch(self, texts):
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _whole(self, text):
        # A literal mark may join the one that stands for a blank.
        return not self.by_words or MARK in text

    def whole(self, text):
        """Ids of a text encoded in one go."""
        marked = self.first + text.replace(" ", self.mark) if text and self.by_words else text
        return np.array(self._batch([marked])[0], "<u4")

    def decode_bytes(self, ids, cuts):
        """(bytes, offsets) of the texts whose ids lie between the ``cuts`` of one array of ids."""
        sizes = np.diff(self.said_at)[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(ends[-1]) + np.repeat(self.said_at[ids] - ends[:-1], sizes)
        data, at = self.said[place], ends[cuts]
        if not self.model.dummy_prefix:
            return data, at, at[1:]
        # The blank that encoding put before the text.
        first = np.zeros(len(at) - 1, np.int64)
        full = at[1:] > at[:-1]
        first[full] = data[at[:-1][full]] == 32
        return data, at[:-1] + first, at[1:]

    def decode(self, many):
        """Texts of id arrays; bytes that are no UTF-8 become replacement characters."""
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in many])]).astype(np.int64)
        data, starts, stops = self.decode_bytes(np.concatenate([*many, np.zeros(0, np.int64)]).astype(np.int64), cuts)
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), stops.tolist())]


@functools.lru_cache(maxsize=2)
def codec_of(path, threads):
    """The codec of a model file, kept by the worker process so that its tasks share the words met so far."""
    return PieceCodec(path, threads)


@functools.lru_cache(maxsize=2)
def reference_of(path):
    """The sentencepiece library's processor of a model file."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _rows(docs, key, text, also=()):
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), *also)


def encode_ids(docs, path, key="doc_id", text="text", threads=2, checked=False, also=()):
    """(key, ids array<int>) per row, over whole texts; null texts are empty and give no ids.

    Columns of longs named in ``also`` follow. ``checked`` adds ``text_sha256`` and ``parity``: whether
    the ids of the whole text are those that the sentencepiece library gives it. A text whose assembled
    ids differ is encoded again in one go before that is said.
    """
    names = [key, "ids", *also, *(["text_sha256", "parity"] if checked else [])]

    def work(batches):
        from rallyframe.llm.text import slices

        for whole in batches:
            for batch in slices(whole, 1, 1 << 20):
                codec = codec_of(path, threads)
                texts = batch.column(1).to_pylist()
                found = codec.encode(texts)
                if checked:
                    said = reference_of(path).encode(texts, num_threads=1)
                    same = [x.tolist() == y for x, y in zip(found, said)]
                    for i in np.flatnonzero(~np.array(same, bool)).tolist():
                        found[i] = codec.whole(texts[i])
                        same[i] = found[i].tolist() == said[i]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                values = pa.array(np.concatenate([*found, np.zeros(0, "<u4")]).astype(np.int32))
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), values), *batch.columns[2:]]
                if checked:
                    columns += [pa.array([_digest(t.encode()) for t in texts], pa.binary()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)

    more = "".join(f", `{c}` long" for c in also) + (", text_sha256 binary, parity boolean" if checked else "")
    return _rows(docs, key, text, [F.col(c).cast("long").alias(c) for c in also]).mapInArrow(work, f"`{key}` long, ids array<int>{more}")


def _digest(data):
    return hashlib.sha256(data).digest()


def decode_ids(encoded, path, key="doc_id", ids="ids", threads=2):
    """(key, text) of encoded rows; null and empty ids give an empty text."""

    def work(batches):
        for batch in batches:
            codec = codec_of(path, threads)
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts = codec.decode([np.array(x or [], np.int64) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(F.col(key).cast("long").alias(key), F.col(ids).cast("array<int>")).mapInArrow(
        work, f"`{key}` long, text string"
    )


def written_ids(docs, path, key="doc_id", text="text", threads=2, also=()):
    """The checked rows of ``encode_ids``, written to the shared folder and read from there."""
    return stored(encode_ids(docs, path, key, text, threads, True, also), "pieces")


def ids_report(written, path, key="doc_id", threads=2, also=()):
    """(key, n_pieces, ids_crc32, round_trip, parity) and the columns ``also`` of rows of ``written_ids``.

    All but parity is worked out from the ids as they were read.
    """
    kept = [written.schema[c] for c in also]

    def work(batches):
        for batch in batches:
            codec = codec_of(path, threads)
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                cuts = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                data, starts, stops = codec.decode_bytes(ids.astype(np.int64), cuts)
                data, packed = data.tobytes(), ids.astype("<u4").tobytes()
                back = [_digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
                places = (cuts * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(np.diff(cuts), pa.int64()),
                        pa.array([zlib.crc32(packed[a:b]) for a, b in zip(places[:-1], places[1:])], pa.int64()),
                        pa.array([d == b for d, b in zip(part.column(2).to_pylist(), back)], pa.bool_()),
                        *part.columns[3:],
                    ],
                    [key, "n_pieces", "ids_crc32", "round_trip", "parity", *also],
                )

    schema = written.select(key).schema.add("n_pieces", "long").add("ids_crc32", "long").add("round_trip", "boolean").add("parity", "boolean")
    for c in kept:
        schema = schema.add(c)
    return written.select(key, "ids", "text_sha256", "parity", *also).mapInArrow(work, schema)


def encode_report(docs, path, key="doc_id", text="text", threads=2):
    """Encode, write, read, decode and verify every whole text: (key, n_pieces, ids_crc32, round_trip, parity).

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian 32-bit integers;
    ``round_trip`` says that decoding the written ids gives the text back (a literal white-space mark
    decodes to a blank, in either library); ``parity`` that both libraries give the whole text the same
    ids. Null texts are empty; null keys, ties and repeated rows stay as they are; an empty table
    gives no rows; other columns are ignored.
    """
    return ids_report(written_ids(docs, path, key, text, threads), path, key, threads)
