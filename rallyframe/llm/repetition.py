"""Quality rules on repetition: characters inside duplicated n-grams and lines.

Words are runs of anything but blank and ``\\t`` to ``\\r``. Every word has a 64-bit hash; sums of
hash times a power of an odd base run along a batch, so the hash of any window of n words is one
difference of two sums times an inverse power: a rolling hash at the same price for every n.
Equal windows of a text are found by one sort of these hashes for each n. A word is covered at
length n if it lies in a window of n words that equals an earlier one of its text; the coverage
is the share of the characters (code points) of all words that covered words hold. A line that
equals an earlier one of its text is a duplicate.

A text that the base rules pass is rejected if its coverage at any length of SHARES, the share of
its characters in duplicate lines, or its symbols for each word go beyond their bounds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rallyframe.llm import text as bytes_

#: Window of the base rule, the least words of a text, and the largest percentage of repeated words.
BASE_WINDOW, LEAST_WORDS, REPEAT_PERCENT = 8, 20, 30
#: Bounds of the method: percentage of word characters inside duplicated n-grams, by n.
SHARES = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: The same for characters inside duplicate lines; and symbols for a hundred words.
LINE_PERCENT, SYMBOL_PERCENT = 20, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: The inverse of the base modulo 2**64.
INVERSE = np.uint64(pow(int(bytes_.BASE), -1, 1 << 64))
#: Bytes of text worked on at a time; a longer text is worked on whole.
SLICE = 1 << 20


def _inverse_powers(n, _kept=[np.ones(1, np.uint64)]):  # noqa: B006 - grows once per worker
    while len(_kept[0]) < n:
        old = _kept[0]
        _kept[0] = np.concatenate([old, old * (old[-1:] * INVERSE)])
    return _kept[0][:n]


def window_hashes(hashes, n):
    """Hashes of all windows of ``n`` neighbours, from running sums of hash * BASE ** place."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * bytes_.powers(len(hashes)), dtype=np.uint64)])
    return (sums[n:] - sums[:-n]) * _inverse_powers(len(hashes) - n + 1)


def _repeats(owner, values):
    """(has an equal earlier one, has an equal one) for 64-bit hashes of the same owner."""
    marked = bytes_.mix(values + owner.astype(np.uint64) * bytes_.BASE)
    order = np.argsort(marked)
    new = np.ones(len(values), bool)
    new[1:] = marked[order[1:]] != marked[order[:-1]]
    heads = np.flatnonzero(new)
    earlier = np.ones(len(values), bool)
    if len(heads):
        earlier[np.minimum.reduceat(order, heads)] = False
    either = np.zeros(len(values), bool)
    either[order] = np.repeat(np.diff(np.append(heads, len(values))) > 1, np.diff(np.append(heads, len(values))))
    return earlier, either


def _inside(starts, n, count):
    """Whether each of ``count`` words lies in a window of ``n`` words at one of the ``starts``."""
    edges = np.bincount(starts, minlength=count + 1) - np.bincount(starts + n, minlength=count + 1)
    return np.cumsum(edges[:count]) > 0


def covered(hashes, owner, n):
    """Whether each word lies in a window of ``n`` words that its text holds twice or more.

    Two arrays: in any such window, and in one that is not its first.
    """
    count = max(0, len(hashes) - n + 1)
    inside = np.flatnonzero(owner[:count] == owner[n - 1 :]) if count else np.zeros(0, np.int64)
    earlier, either = _repeats(owner[inside], window_hashes(hashes, n)[inside])
    return _inside(inside[either], n, len(hashes)), _inside(inside[earlier], n, len(hashes))


def _sums(weights, cuts):
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(weights, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]


def measures(array, lengths=tuple(SHARES)):
    """Arrays of one value per text of an Arrow string array, by name; see ``scored``."""
    data, bounds = bytes_.flat(array)
    starts, stops, cuts = bytes_.word_spans(data, bounds)
    owner = np.repeat(np.arange(len(array)), np.diff(cuts))
    points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[stops] - points[starts]
    hashes = bytes_.segment_hashes(data, starts, stops)
    out = {
        "n_words": np.diff(cuts), "word_chars": _sums(chars, cuts), "n_symbols": _sums(SYMBOLS[data], bounds),
    }
    # Lines end at each line feed and at the end of each text; those with a word are compared whole.
    feeds = np.flatnonzero(data == 10)
    line_starts = np.union1d(bounds[:-1], feeds + 1)
    line_stops = np.minimum(np.append(line_starts[1:], len(data)), len(data))
    line_stops = line_stops - np.isin(line_stops - 1, feeds, assume_unique=False)
    of_line = np.searchsorted(starts, np.append(line_starts, len(data)))
    # An empty text at the end of a line's range shares its start with the next text; it holds no word.
    full = np.flatnonzero(np.diff(of_line) > 0)
    line_owner = owner[of_line[full]]
    repeated, _ = _repeats(line_owner, bytes_.segment_hashes(data, line_starts[full], line_stops[full]))
    line_chars = np.concatenate([np.zeros(1, np.int64), np.cumsum(chars, dtype=np.int64)])
    inside = line_chars[of_line[full + 1]] - line_chars[of_line[full]]
    out["n_dup_lines"] = np.bincount(line_owner[repeated], minlength=len(array))
    out["dup_line_chars"] = np.bincount(line_owner[repeated], weights=inside[repeated], minlength=len(array)).astype(np.int64)
    at_length = {n: covered(hashes, owner, n) for n in {BASE_WINDOW, *lengths}}
    out["n_repeat_words"] = _sums(at_length[BASE_WINDOW][0], cuts)
    for n in lengths:
        out[f"dup{n}_chars"] = _sums(np.where(at_length[n][1], chars, 0), cuts)
    return out


def scored(docs, key="doc_id", text="text", shares=None, line_percent=LINE_PERCENT, symbol_percent=SYMBOL_PERCENT):
    """(key, measures, base_failed, kept) per row, over whole texts.

    ``n_words``, ``word_chars`` (code points of words), ``n_symbols`` (characters of ``#*$%&|<>``),
    ``n_dup_lines`` and ``dup_line_chars`` (lines with a word that equal an earlier line, and the
    characters of their words), ``n_repeat_words`` (words in windows of BASE_WINDOW found twice or
    more, the first included) and ``dup<n>_chars`` for every n of ``shares`` (characters of words in
    windows of n words that equal an earlier one) are longs. ``base_failed``: fewer than
    LEAST_WORDS words, or more than REPEAT_PERCENT of them repeated. ``kept``: not so, and no
    measure above its bound in percent.

    Null and empty texts have no words and fail. Null keys, ties and repeated rows stay as they
    are; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    shares = dict(SHARES if shares is None else shares)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup{n}_chars" for n in shares]]

    def work(batches):
        for whole in batches:
            for batch in bytes_.slices(whole, 1, SLICE):
                found = measures(batch.column(1), tuple(shares))
                words, chars = found["n_words"], found["word_chars"]
                failed = (words < LEAST_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * words)
                bad = 100 * found["dup_line_chars"] > line_percent * chars
                bad |= 100 * found["n_symbols"] > symbol_percent * words
                for n, most in shares.items():
                    bad |= 100 * found[f"dup{n}_chars"] > most * chars
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *[pa.array(found[c], pa.int64()) for c in counts], pa.array(failed), pa.array(~(failed | bad))],
                    ["id", *counts, "base_failed", "kept"],
                )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = "id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", key)
