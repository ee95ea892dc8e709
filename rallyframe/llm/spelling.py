"""Spelling variants: words one edit apart, by PartEnum signatures of their letter multisets.

A word's letters with their occurrence numbers ((e, 0), (e, 1), ...) are a binary vector. One
inserted or deleted letter changes the vector in one place, one replaced letter in two. The places
are partitioned into PARTS parts. By pigeonhole two vectors that differ in d places agree on all of
some ``PARTS - d`` parts, so a word is enumerated over every choice of parts that may differ:

* replaced: its length and the letters of all but two parts;
* inserted or deleted: the length of the shorter word and the letters of all but one part, once
  as the shorter word and once as the longer one.

Anagrams share signatures, so a signature also names a half: one edit leaves the first or the last half
of the shorter word whole, and words of a signature meet only by equal halves. That divides
every large group and loses no pair. Words that meet in the equi-join are verified by edit distance.
"""

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rallyframe.llm import text as bytes_
from rallyframe.llm.files import stored

#: Parts of the places of the letter vectors.
PARTS = 4
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words held by a task before they are handed on, and characters searched at a time.
HELD, PIECE = 300_000, 1 << 20


def _pieces(text):
    """A text cut where no run goes on."""
    start = 0
    while len(text) - start > PIECE:
        stop = start + PIECE
        run = RUN.match(text, stop)
        stop = run.end() if run else stop
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


def runs(text):
    """How often each maximal run of letters occurs in a text; only A-Z are lower-cased."""
    lowered = text.encode().lower().decode()
    found = Counter()
    for piece in _pieces(lowered):
        found.update(RUN.findall(piece))
    return found


def word_counts(docs, key="doc_id", text="text", min_chars=5, min_count=3, change=None):
    """(word, n): words of ``min_chars`` code points or more that occur ``min_count`` times or more in all texts.

    Words are maximal runs of ``A-Za-z`` and U+00C0 to U+00FF. ``change(key)`` may give a function
    from a word of that row to the word that is counted. A task adds up its words, Spark adds up the
    tasks. Null texts hold no words; null keys and repeated rows count like others; an empty table
    gives no rows; other columns are ignored.
    """

    def batch_of(counts):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def count(batches):
        held = Counter()
        for whole in batches:
            for batch in bytes_.slices(whole, 1, 1 << 20):
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    turn = change(k) if change else None
                    for word, n in runs(t).items():
                        word = turn(word) if turn else word
                        if len(word) >= min_chars:
                            held[word] += n
                    if len(held) > HELD:
                        yield batch_of(held)
                        held = Counter()
        yield batch_of(held)

    rows = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def planted_change(key):
    """The deletion that the query plants: where 97 divides the crc32 of ``key:word``, one letter goes."""
    start = zlib.crc32(f"{'' if key is None else key}:".encode())

    def change(word):
        h = zlib.crc32(word.encode(), start)
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def _halves(words, sizes):
    """Hashes of the first and of the last half of each word, as halves of a word of the given size."""

    def hashed(texts):
        data = [t.encode() for t in texts]
        return np.array([zlib.crc32(x) << 32 | zlib.adler32(x) for x in data], np.uint64)

    first = [n // 2 for n in sizes]
    return hashed(w[:k] for w, k in zip(words, first)), hashed(w[len(w) - n + k :] for w, n, k in zip(words, sizes, first))


def letter_parts(words, parts=PARTS):
    """One row per word, one column per part: the summed hashes of the word's letters in that part.

    Place (letter, occurrence) lies in part (code point + occurrence) mod ``parts``.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((letters, owner))
    letters = letters[order]  # sorted inside each word; owner is as it was
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    occurrence = (np.arange(len(letters)) - np.repeat(first, np.diff(np.append(first, len(letters))))).astype(np.uint64)
    place = bytes_.mix(letters * np.uint64(1 << 32) + occurrence + np.uint64(1))
    part = ((letters + occurrence) % np.uint64(parts)).astype(np.int64)
    sums = np.zeros(len(words) * parts, np.uint64)
    np.add.at(sums, owner * parts + part, place)
    return sums.reshape(len(words), parts)


def signatures(words, parts=PARTS):
    """(word number, signature, role) arrays: role 0 for replaced, 1 for the shorter and 2 for the longer word."""
    sums, sizes = letter_parts(words, parts), [len(w) for w in words]
    salted = list(bytes_.mix(sums + np.arange(1, parts + 1, dtype=np.uint64) * bytes_.BASE).T)
    # By role: how many parts may differ, and the size of the shorter word of a pair.
    roles = [(2, sizes), (1, sizes), (1, [n - 1 for n in sizes])]
    out = []
    for role, (differ, shorter) in enumerate(roles):
        length = np.array(shorter, np.uint64) * bytes_.BASE
        for side, half in enumerate(_halves(words, shorter)):
            place = length + bytes_.mix(half + np.uint64(side))
            for dropped in combinations(range(parts), differ):
                mark = np.uint64(sum(1 << p for p in dropped) + 256 * differ)
                letters = sum((salted[p] for p in range(parts) if p not in dropped), np.full(len(words), mark))
                out.append((np.arange(len(words)), bytes_.mix(place + bytes_.mix(letters)), np.full(len(words), role, np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out))


def near_pairs(counts, parts=PARTS):
    """(a, b, n_a, n_b) for all pairs of words of ``counts`` (word, n) that are one edit apart, a < b, once."""

    def sign(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                number, signature, role = signatures(part.column(0).to_pylist(), parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signature.view(np.int64)), pa.array(role, pa.int8()), part.column(0).take(pa.array(number)), part.column(1).take(pa.array(number))],
                    ["sig", "role", "word", "n"],
                )

    signed = stored(counts.select("word", "n").mapInArrow(sign, "sig long, role byte, word string, n long"), "signatures")
    one = signed.filter("role < 2").select("sig", "role", F.col("word").alias("a"), F.col("n").alias("n_a"))
    two = signed.filter("role <> 1").select(
        F.col("sig").alias("sig2"), F.col("role").alias("role2"), F.col("word").alias("b"), F.col("n").alias("n_b")
    )
    # Roles 0 and 0 meet in order of the words, role 1 meets role 2; signatures of the kinds differ.
    met = one.join(two, (F.col("sig") == F.col("sig2")) & (F.col("role") * 2 == F.col("role2")))
    near = met.filter("(role = 1 OR a < b) AND a <> b AND abs(length(a) - length(b)) <= 1 AND levenshtein(a, b, 1) = 1")
    ordered = near.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
        F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
    )
    return ordered.distinct()


def variants(counts, ratio=2, parts=PARTS):
    """(word, form, root, n, n_near, form_n) for every row of ``counts`` (word, n; words are distinct).

    ``form``: of the words one edit away the one with the largest n (ties: the smallest in
    code-point order), if its n is at least ``ratio`` times the word's; else null, and ``form_n`` too.
    ``root``: the end of the chain of forms, the word itself without one. ``n_near`` counts the
    words one edit away. A word has at most a few near words for each letter of the alphabet and
    place, so no group is large. No words give no rows.
    """
    spark = counts.sparkSession
    counts = stored(counts.select("word", "n"), "words")
    pairs = stored(near_pairs(counts, parts), "near")
    both = pairs.select(F.col("a").alias("w"), F.col("b").alias("near"), F.col("n_b").alias("m")).union(
        pairs.select(F.col("b").alias("w"), F.col("a").alias("near"), F.col("n_a").alias("m"))
    )
    most = both.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.max("m").alias("m"))
    # Fixed-width maxima first; then the least word among those of the largest n.
    tied = both.join(most.select(F.col("w").alias("_w"), F.col("m").alias("_m")), (F.col("w") == F.col("_w")) & (F.col("m") == F.col("_m")), "left_semi")
    best = tied.groupBy(F.col("w").alias("_w")).agg(F.min("near").alias("near"))
    chosen = most.join(best, F.col("w") == F.col("_w")).drop("_w")
    named = counts.join(chosen, F.col("word") == F.col("w"), "left").withColumn("_up", F.col("m") >= ratio * F.col("n"))
    forms = stored(
        named.select(
            "word", F.when(F.col("_up"), F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("_up"), F.col("m")).alias("form_n"),
        ), "forms",
    )
    # A chain's n at least doubles from word to word, so its length is bounded by the bits of n; every round halves it.
    step = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        after = step.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        moved = stored(
            step.join(after, F.col("root") == F.col("_from"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")),
            "roots",
        )
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    ends = step.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    return forms.join(ends, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n"
    )
