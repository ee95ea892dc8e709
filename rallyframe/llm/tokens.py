"""Token ids in a bit-packed binary format with random access.

A shard file holds, little-endian throughout:

    b"RFTK" | version u16 | bits u16 | ids per block u32
    blocks: ids packed at ``bits`` bits each, lowest bit first, every block on a byte border
    block offsets u64[blocks + 1] | keys i64[docs] | key is set u8[docs] | token starts u64[docs + 1]
    footer: blocks u64 | docs u64 | position of the block offsets u64 | b"RFTK"

``bits`` is the least width that holds the vocabulary, so any id of any document is found by
arithmetic: block ``i // ids_per_block``, bit ``(i % ids_per_block) * bits``.
"""

import functools
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.llm.files import open_store, stored
from rallyframe.session import scratch_path

MAGIC = b"RFTK"
HEAD = struct.Struct("<4sHHI")
FOOT = struct.Struct("<QQQ4s")
BLOCK_IDS = 1 << 16

MANIFEST = "part int, file string, docs long, tokens long, bytes long"


def width(vocabulary):
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids, bits):
    """Ids as bytes at ``bits`` bits each."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(spread[:, :bits], bitorder="little").tobytes()


def unpack(data, bits, count):
    """The first ``count`` ids of packed bytes, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype("<u4")
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = spread
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class ShardWriter:
    """Streams documents into one shard; holds one block of ids and the tables of the tail."""

    def __init__(self, stream, bits, block_ids=BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        stream.write(HEAD.pack(MAGIC, 1, bits, block_ids))
        self.at, self.blocks, self.pending, self.waiting = HEAD.size, [HEAD.size], [], 0
        self.keys, self.starts = [], [0]

    def add(self, key, ids):
        self.keys.append(key)
        self.starts.append(self.starts[-1] + len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block_ids:
            self._flush()

    def _flush(self, last=False):
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, "<u4")
        while len(ids) >= self.block_ids or (last and len(ids)):
            data = pack(ids[: self.block_ids], self.bits)
            self.stream.write(data)
            self.at += len(data)
            self.blocks.append(self.at)
            ids = ids[self.block_ids :]
        self.pending, self.waiting = [ids], len(ids)

    def close(self):
        self._flush(last=True)
        tail = [
            np.array(self.blocks, "<u8"), np.array([k or 0 for k in self.keys], "<i8"),
            np.array([k is not None for k in self.keys], "u1"), np.array(self.starts, "<u8"),
        ]
        for table in tail:
            self.stream.write(table.tobytes())
        self.stream.write(FOOT.pack(len(self.blocks) - 1, len(self.keys), self.at, MAGIC))
        return {
            "docs": len(self.keys), "tokens": self.starts[-1],
            "bytes": self.at + sum(t.nbytes for t in tail) + FOOT.size,
        }


class ShardReader:
    """Random access to one shard through a seekable stream."""

    def __init__(self, stream):
        self.stream = stream
        magic, _, self.bits, self.block_ids = HEAD.unpack(self._read(0, HEAD.size))
        size = stream.size()
        blocks, docs, tail, end = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token shard, or cut off")
        data = self._read(tail, size - FOOT.size - tail)
        self.blocks = np.frombuffer(data, "<u8", blocks + 1)
        keys = np.frombuffer(data, "<i8", docs, 8 * (blocks + 1))
        known = np.frombuffer(data, "u1", docs, 8 * (blocks + 1 + docs))
        self.keys = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.starts = np.frombuffer(data[8 * (blocks + 1 + docs) + docs :], "<u8", docs + 1).astype(np.int64)

    def _read(self, at, size):
        self.stream.seek(at)
        return self.stream.read(size)

    def ids(self, start, stop):
        """Ids at token positions ``start`` to ``stop`` of the shard; reads only the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self._read(int(self.blocks[first]), int(self.blocks[last + 1] - self.blocks[first]))
        parts = []
        for block in range(first, last + 1):
            count = min(self.block_ids, int(self.starts[-1]) - block * self.block_ids)
            low = int(self.blocks[block] - self.blocks[first])
            parts.append(unpack(data[low : low + -(-count * self.bits // 8)], self.bits, count))
        ids = np.concatenate(parts)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, row):
        return self.ids(int(self.starts[row]), int(self.starts[row + 1]))


class WordCache:
    """Encodes texts by their space-separated words, each distinct word once while it is kept.

    The split patterns take a blank only together with what follows it, so a cut before a
    single blank between two visible characters never divides a match: the ids of the words,
    each with the blank before it, are the ids of the whole. Texts with other white space
    around a blank (a word that is empty, or begins or ends with white space) are encoded whole.
    New words are encoded as one joined text. ``sizes`` has the bytes that each id stands for (0: not
    fixed), so every word must begin and end where ids do; a joined text of which that does not hold
    is encoded word by word. ``limit`` bounds what is kept between batches, in two halves of which
    the older one goes first; never what is encoded.
    """

    def __init__(self, encode_batch, sizes, mark=" ", first="", limit=500_000):
        self.encode_batch, self.sizes, self.mark, self.first, self.limit = encode_batch, sizes, mark, first, limit
        self.kept, self.older = {}, {}  # None: no word to cut before

    def _whole(self, text):
        """Whether a text is encoded in one go whatever its words are."""
        return False

    def _learn(self, words):
        """Encode words that follow a blank and keep their ids."""
        plain = [w for w in words if w and len(w.strip()) == len(w)]
        if len(plain) < len(words):
            self.kept.update(dict.fromkeys(set(words).difference(plain)))
        for i in range(0, len(plain), 4096):
            self._learn_few(plain[i : i + 4096])

    def _starts(self, data):
        """Where the mark stands in UTF-8 bytes."""
        mark = self.mark.encode()
        many = len(data) - len(mark) + 1
        hit = data[:many] == mark[0]
        for i in range(1, len(mark)):
            hit &= data[i : many + i] == mark[i]
        return np.flatnonzero(hit)

    def _learn_few(self, words):
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        joined = [self.mark + self.mark.join(g) for g in groups]
        for group, text, ids in zip(groups, joined, self.encode_batch(joined)):
            ids = np.array(ids, "<u4")
            told = np.frombuffer(text.encode(), np.uint8)
            stops = np.append(self._starts(told)[1:], len(told))
            reached = np.cumsum(self.sizes[ids])
            last = np.minimum(np.searchsorted(reached, stops), len(ids) - 1)
            if len(stops) == len(group) and self.sizes[ids].all() and reached[-1] == stops[-1] and (reached[last] == stops).all():
                data, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
                parts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            else:
                parts = [np.array(x, "<u4").tobytes() for x in self.encode_batch([self.mark + w for w in group])]
            self.kept.update(zip(group, parts))

    def _known(self, words):
        """The kept ids of distinct words, in their order; new words are learnt."""
        if len(self.kept) > self.limit // 2:  # words met since then stay, the others go at the next turn
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        fresh = [w for w in words if w not in kept]
        if older:
            kept.update((w, older[w]) for w in fresh if w in older)
            fresh = [w for w in fresh if w not in older]
        self._learn(fresh)
        return [kept[w] for w in words]

    def encode(self, texts, end=()):
        """One unsigned 32-bit array per text, ``end`` appended.

        Words are cut and numbered by Arrow; every place of a text then names an entry of a table of
        ids: a known word, a first word, a last word that ends with white space, or a whole text.
        """
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        codes = coded.indices.to_numpy()
        first, inner = cuts[:-1], np.ones(len(codes), bool)
        inner[first] = False
        alone, apart, tails, tailed = np.zeros(len(texts), bool), [], [], []
        for i, text in enumerate(texts):
            blank = text.find(" ")
            head = text if blank < 0 else text[:blank]
            apart.append(head)
            if text and (self._whole(text) or (blank >= 0 and (not head or head[-1].isspace()))):
                alone[i] = True
            elif blank >= 0 and text[-1] != " " and text[-1].isspace():
                tail = text[text.rfind(" ") + 1 :]
                if tail[0].isspace():
                    alone[i] = True
                else:
                    tails.append(tail)
                    tailed.append(i)
        inner[cuts[1:][tailed] - 1] = False
        inner &= ~np.repeat(alone, np.diff(cuts))
        used = np.zeros(len(coded.dictionary), bool)
        used[codes[inner]] = True
        # As numpy objects: a list straight from Arrow makes a scalar of every word, at ten times the cost.
        ids = self._known(coded.dictionary.filter(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        number = np.cumsum(used) - 1
        odd = np.array([x is None for x in ids], bool)
        if odd.any():
            met = np.flatnonzero(inner)[odd[number[codes[inner]]]]
            alone[np.searchsorted(cuts, met, side="right") - 1] = True
            inner &= ~np.repeat(alone, np.diff(cuts))
        heads = [
            self.first + (t.replace(" ", self.mark) if whole else h) if t else ""
            for t, h, whole in zip(texts, apart, alone.tolist())
        ]
        said = [np.array(x, "<u4").tobytes() for x in self.encode_batch(heads + [self.mark + t for t in tails])]
        entries = [*(x or b"" for x in ids), *said, b"", np.array(end, "<u4").tobytes()]
        nothing, stop = len(entries) - 2, len(entries) - 1
        places = np.full(len(codes), nothing)
        places[inner] = number[codes[inner]]
        # A last word is not the first one: its text holds a blank.
        last = np.array(tailed, np.int64)
        shown = ~alone[last]
        places[cuts[1:][last[shown]] - 1] = len(ids) + len(heads) + np.flatnonzero(shown)
        places[first] = len(ids) + np.arange(len(heads))
        if end:
            places, cuts = np.insert(places, cuts[1:], stop), cuts + np.arange(len(cuts))
        table = np.frombuffer(b"".join(entries), "<u4")
        sizes = np.array([len(x) // 4 for x in entries], np.int64)
        starts, counts = np.cumsum(sizes) - sizes, sizes[places]
        stops = np.cumsum(counts)
        out = table[np.repeat(starts[places] - stops + counts, counts) + np.arange(stops[-1])]
        at = np.concatenate([[0], stops])[cuts].tolist()
        return [out[a:b] for a, b in zip(at[:-1], at[1:])]


@functools.lru_cache(maxsize=2)
def byte_bpe_encoder(tokenizer_path):
    """(encoder of lists of texts to id arrays, vocabulary size) of a byte-level tokenizer file.

    Kept by the worker process, so that its tasks share the words met so far.
    """
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    tokenizer = Tokenizer.from_file(tokenizer_path)
    size = tokenizer.get_vocab_size()
    sizes = np.zeros(size, np.int64)
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[number] = len(token)  # one character for each byte
    for number, token in tokenizer.get_added_tokens_decoder().items():
        sizes[number] = len(token.content.encode())

    def batch(texts):
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    return WordCache(batch, sizes), size


def write_shards(docs, key, text, tokenizer_path, end_id=0, folder=None):
    """Encode ``text`` of every row and write shards in ascending ``key`` order.

    Rows are range-partitioned by key before they are encoded (texts are smaller than their
    ids), and every task writes one shard under a name of its own. Returns the manifest, one
    row per shard in order. Only finished attempts reach the manifest, so a retried task
    leaves at most an unlisted file.

    Null texts are empty; null keys come first; equal keys follow their texts; an empty
    table gives an empty manifest; other columns are ignored.
    """
    folder = folder or scratch_path(docs.sparkSession, "shards")
    rows = docs.select(
        F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    # Ranged by key alone: the sample that sets the ranges goes to the driver and holds no texts.
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")

    def write(batches):
        from rallyframe.llm.text import slices

        writer = stream = None
        for whole in batches:
            for batch in slices(whole, 1):
                if writer is None:
                    cache, vocabulary = byte_bpe_encoder(tokenizer_path)
                    part = TaskContext.get().partitionId()
                    name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                    store, path = open_store(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    stream = store.open_output_stream(path)
                    writer = ShardWriter(stream, width(vocabulary))
                encoded = cache.encode(batch.column(1).to_pylist(), () if end_id is None else (end_id,))
                for k, ids in zip(batch.column(0).to_pylist(), encoded):
                    writer.add(k, ids)
        if writer is not None:
            facts = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name], **{k: [v] for k, v in facts.items()}}
            )

    return stored(ordered.mapInArrow(write, MANIFEST), "manifest")


def _documents(manifest, build, schema):
    """Run ``build(keys, starts, ids, cuts)`` over runs of a shard's documents of about a million ids.

    Every shard is one task: a number of partitions that is asked for is left as it is by adaptive
    execution, and rows are dealt out in turn. Starts come from the running total over the manifest,
    which has one row per shard.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select(
        "file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start")
    ).repartition(max(1, manifest.count()))

    def read(batches):
        for listing in batches:
            for file, base in zip(listing.column(0).to_pylist(), listing.column(1).to_pylist()):
                store, path = open_store(file)
                with store.open_input_file(path) as stream:
                    shard = ShardReader(stream)
                    low = 0
                    while low < len(shard.keys):
                        room = int(shard.starts[low]) + (1 << 20)
                        high = max(low + 1, int(np.searchsorted(shard.starts, room, side="right")) - 1)
                        cuts = shard.starts[low : high + 1]
                        ids = shard.ids(int(cuts[0]), int(cuts[-1]))
                        yield build(pa.array(shard.keys[low:high], pa.int64()), cuts[:-1] + base, ids, cuts - cuts[0])
                        low = high

    return listed.mapInArrow(read, schema)


def read_shards(manifest):
    """One row per stored document: key, position of its first id among all ids, ids."""

    def build(keys, starts, ids, cuts):
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64)))
        return pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), lists], ["key", "start", "ids"])

    return _documents(manifest, build, "key long, start long, ids array<long>")


def read_digests(manifest):
    """One row per stored document: key, start, number of ids and their unsigned CRC-32."""

    def build(keys, starts, ids, cuts):
        data, at = ids.tobytes(), (cuts * 4).tolist()
        crc = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64())
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(starts, pa.int64()), pa.array(np.diff(cuts), pa.int64()), crc],
            ["key", "start", "n_tokens", "ids_crc32"],
        )

    return _documents(manifest, build, "key long, start long, n_tokens long, ids_crc32 long")
