"""Byte-level helpers for Arrow batches of texts, used inside tasks."""

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial hashes below.
BASE = np.uint64(0x9E3779B97F4A7C15)


def slices(batch, column, max_bytes=4 << 20):
    """Cut a record batch into runs of rows with about ``max_bytes`` of text (one row at least)."""
    sizes = np.diff(offsets(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        room = np.cumsum(sizes[start:])
        stop = start + max(1, int(np.searchsorted(room, max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def offsets(array):
    """Byte offsets of a string array from its own start (nulls count as empty)."""
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    raw = np.frombuffer(array.buffers()[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return raw - raw[0]


def flat(array):
    """(all UTF-8 bytes, row offsets) of a string array; nulls are empty."""
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = offsets(array)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    first = int(np.frombuffer(array.buffers()[1], kind)[array.offset])
    data = array.buffers()[2]
    if data is None or not bounds[-1]:
        return np.zeros(0, np.uint8), bounds
    return np.frombuffer(data, np.uint8)[first : first + bounds[-1]], bounds


def mix(x):
    """Finaliser that spreads the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n, _kept=[np.ones(1, np.uint64)]):  # noqa: B006 - grows once per worker
    """The first ``n`` powers of BASE modulo 2**64."""
    while len(_kept[0]) < n:
        old = _kept[0]
        _kept[0] = np.concatenate([old, old * (old[-1:] * BASE)])
    return _kept[0][:n]


#: Bytes that ``segment_hashes`` spreads to 64-bit terms at a time.
PIECE = 1 << 18


def _terms(data, starts, sizes):
    """The sums of (byte + 1) * BASE ** place over the byte ranges."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    inside = np.arange(int(ends[-1]), dtype=np.int64)
    at = data[inside + np.repeat(starts - begins, sizes)].astype(np.uint64)
    inside -= np.repeat(begins, sizes)
    at += np.uint64(1)
    at *= powers(int(sizes.max()))[inside]
    return np.add.reduceat(at, begins)


def segment_hashes(data, starts, stops):
    """One 64-bit hash per byte range; ranges are disjoint, ascending and not empty.

    Works on PIECE bytes at a time, longer ranges piece by piece, so memory follows the number
    of ranges and not of bytes.
    """
    sizes = stops - starts
    sums = np.zeros(len(starts), np.uint64)
    total = np.cumsum(sizes)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(total, total[first] - sizes[first] + PIECE, side="right")))
        if sizes[first] > PIECE:
            scale = np.ones(1, np.uint64)
            for low in range(int(starts[first]), int(stops[first]), PIECE):
                size = min(PIECE, int(stops[first]) - low)
                sums[first : first + 1] += _terms(data, np.array([low]), np.array([size])) * scale
                scale = scale * powers(PIECE)[-1:] * BASE
            last = first + 1
        else:
            sums[first:last] = _terms(data, starts[first:last], sizes[first:last])
        first = last
    return mix(sums + sizes.astype(np.uint64) * BASE)


def word_spans(data, bounds):
    """(starts, stops) in bytes of the words of texts, and the number of the first word of each text.

    Words are runs of bytes other than blank and ``\\t`` to ``\\r``; ``bounds`` are the texts' offsets,
    so the third array has one entry more than there are texts.
    """
    visible = np.ones(len(data) + 2, bool)
    visible[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    visible[0] = visible[-1] = False
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(visible[1:] & (~visible[:-1] | edge))
    stops = np.flatnonzero(visible[:-1] & (~visible[1:] | edge))
    return starts[starts < len(data)], stops, np.searchsorted(starts, bounds)
