"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is good or bad. Emission weights see the line's own features and those
of the lines next to it, transition weights the labels of neighbours. Training takes the label
of a document for all its lines; a document's score is the mean of its lines' forward-backward
marginals, weighted by their lengths and calibrated by a logistic curve on the training rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rallyframe.llm import text as bytes_

#: Rows a model is fitted on, at most. Training cuts longer documents into runs of RUN lines.
SAMPLE = 4000
#: Lines of one text that the fit reads, at most.
LINES = 5000
RUN = 32
STEPS = 150
PENALTY = 1e-3

# Byte classes.
LOWER, UPPER, DIGIT, BLANK, STOP, SYMBOL, HIGH = range(7)
_CLASS = np.full(256, SYMBOL, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = LOWER, UPPER, DIGIT, HIGH
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = STOP

OWN = 16
WIDTH = OWN + 2 * OWN


def line_features(array):
    """(features of every line, byte length of every line, number of lines of every text).

    Lines end at ``\\n``; an empty text is one empty line.
    """
    data, bounds = bytes_.flat(array)
    ends = np.flatnonzero(data == 10)
    # A line end at the very end of a text opens a last, empty line that belongs to that text.
    starts = np.sort(np.concatenate([bounds[:-1], ends + 1]), kind="stable")
    doc = _owners(bounds, ends)
    lines = len(starts)
    stops = np.concatenate([starts[1:], bounds[-1:]]) if lines else starts
    owner = np.repeat(np.arange(lines), stops - starts)
    counts = np.bincount(owner * 7 + _CLASS[data], minlength=7 * lines).reshape(lines, 7).astype(float)
    size = counts.sum(1)
    visible = _CLASS[data] != BLANK
    fresh = np.ones(len(data), bool)
    if len(data):
        fresh[1:] = ~visible[:-1]
        fresh[bounds[:-1][bounds[:-1] < len(data)]] = True
    word_start = np.flatnonzero(visible & fresh)
    close = np.ones(len(data), bool)
    if len(data):
        close[:-1] = ~visible[1:]
        close[bounds[1:][bounds[1:] > 0] - 1] = True
    word_stop = np.flatnonzero(visible & close) + 1
    hashes = bytes_.segment_hashes(data, word_start, word_stop)
    in_line = owner[word_start] if len(data) else np.zeros(0, np.int64)
    words = np.bincount(in_line, minlength=lines).astype(float)
    different = np.bincount(_distinct(in_line, hashes), minlength=lines).astype(float)
    longest = np.zeros(lines)
    np.maximum.at(longest, in_line, (word_stop - word_start).astype(float))
    sums = np.zeros(lines, np.uint64)
    np.add.at(sums, in_line, hashes)
    again = _repeats(doc, sums, words)
    safe, safe_words = np.maximum(size, 1), np.maximum(words, 1)
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER], 1)
    own = np.empty((lines, OWN))
    own[:, 0] = counts[:, UPPER] / letters
    own[:, 1] = np.minimum(counts[:, SYMBOL] / safe * 5, 3)
    own[:, 2] = counts[:, DIGIT] / safe
    own[:, 3] = np.minimum(counts[:, STOP] / safe * 5, 3)
    own[:, 4] = counts[:, HIGH] / safe
    own[:, 5] = np.minimum((size - counts[:, BLANK]) / safe_words / 10, 3)
    own[:, 6] = different / safe_words
    own[:, 7] = np.log1p(words) / 5
    own[:, 8] = np.log1p(size) / 8
    own[:, 9] = again
    own[:, 10] = longest > 40
    own[:, 11] = words == 0
    own[:, 12] = counts[:, SYMBOL] > 0.02 * safe
    own[:, 13] = counts[:, UPPER] > 0.5 * letters
    own[:, 14] = (different < 0.5 * words) & (words > 4)
    own[:, 15] = 1
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if lines else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if lines else first
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0)) if lines else own
    after = np.where(last[:, None], 0, np.roll(own, -1, axis=0)) if lines else own
    return np.hstack([own, before, after]), size, np.bincount(doc, minlength=len(array))


def _owners(bounds, ends):
    """The text of every line, in order: one line for each text and one more for each line end."""
    per = np.ones(len(bounds) - 1, np.int64)
    np.add.at(per, np.searchsorted(bounds[1:], ends, side="right"), 1)
    return np.repeat(np.arange(len(per)), per)


def _distinct(line, hashes):
    """The line of every distinct (line, hash)."""
    order = np.lexsort((hashes, line))
    a, b = line[order], hashes[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep]


def _repeats(doc, sums, words):
    """1 for every line with words that its text holds more than once."""
    order = np.lexsort((sums, doc))
    a, b = doc[order], sums[order]
    same = np.zeros(len(a), bool)
    if len(a):
        equal = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(a))
    out[order] = same
    return out * (words > 0)


def chain(emission, lengths, transition):
    """Forward-backward over runs of lines: (log partition per run, P(good) per line, pair marginals summed).

    ``emission`` is the score of good against bad of every line, runs one after another.
    """
    start = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max()) if len(lengths) else 0), side="left")
    alpha, beta = np.zeros((len(emission), 2)), np.zeros((len(emission), 2))
    for t, n in enumerate(active):
        at = start[order[:n]] + t
        if t:
            past = alpha[at - 1]
            alpha[at, 0] = np.logaddexp(past[:, 0] + transition[0, 0], past[:, 1] + transition[1, 0])
            alpha[at, 1] = np.logaddexp(past[:, 0] + transition[0, 1], past[:, 1] + transition[1, 1])
        alpha[at, 1] += emission[at]
    for t in range(len(active) - 2, -1, -1):
        at = start[order[: active[t + 1]]] + t
        ahead = beta[at + 1].copy()
        ahead[:, 1] += emission[at + 1]
        for s in (0, 1):
            beta[at, s] = np.logaddexp(ahead[:, 0] + transition[s, 0], ahead[:, 1] + transition[s, 1])
    ends = start + lengths - 1
    total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    per_line = np.repeat(total, lengths)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - per_line, 0))
    inner = np.ones(len(emission), bool)
    inner[start] = False
    at = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            pairs[i, j] = np.exp(
                alpha[at - 1, i] + transition[i, j] + j * emission[at] + beta[at, j] - per_line[at]
            ).sum()
    return total, good, pairs


@dataclass(frozen=True)
class Model:
    """Weights of the field and of the calibration; ``prior`` alone where there was nothing to learn."""

    prior: float
    weights: np.ndarray | None = None
    transition: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0

    def lines(self, array):
        """(P(good) of every line, its length, lines per text)."""
        features, size, per = line_features(array)
        if self.weights is None:
            return np.full(len(size), self.prior), size, per
        return chain(features @ self.weights, per, self.transition)[1], size, per

    def scores(self, array):
        if not len(array):
            return np.zeros(0)
        good, size, per = self.lines(array)
        if self.weights is None:
            return np.full(len(array), self.prior)
        mean = _mean(good, size, per)
        return 1 / (1 + np.exp(-(self.slope * _logit(mean) + self.shift)))


def _mean(good, size, per):
    doc = np.repeat(np.arange(len(per)), per)
    weight = size + 1e-6
    return np.bincount(doc, good * weight, len(per)) / np.bincount(doc, weight, len(per))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(features, size, per, labels):
    """Fit field and calibration to documents given as lines (as from ``line_features``)."""
    labels = np.asarray(labels, float)
    prior = float((labels.sum() + 1) / (len(labels) + 2))
    if not len(labels) or labels.min() == labels.max():
        return Model(prior)
    # Runs of at most RUN lines, each with its document's label.
    pieces = [(i, min(RUN, n - k)) for i, n in enumerate(per) for k in range(0, n, RUN)]
    runs = np.array([n for _, n in pieces])
    truth = np.repeat(labels[[i for i, _ in pieces]], runs)
    share = np.where(labels[[i for i, _ in pieces]] == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    # A long document counts no more than a short one, and both labels alike.
    balance = np.repeat(share / np.array([per[i] for i, _ in pieces]), runs)
    scale = 1 / balance.sum()
    weights, transition = np.zeros(WIDTH), np.zeros((2, 2))
    state = [np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)]
    starts = np.concatenate([[0], np.cumsum(runs)[:-1]])
    inner = np.ones(len(truth), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    for i in (0, 1):
        for j in (0, 1):
            seen[i, j] = ((truth[at - 1] == i) & (truth[at] == j)).sum()
    for step in range(1, STEPS + 1):
        _, good, pairs = chain(features @ weights, runs, transition)
        slope = np.concatenate(
            [
                features.T @ ((truth - good) * balance) * scale - PENALTY * weights,
                ((seen - pairs) / max(len(at), 1) - 0.05 * transition).ravel(),
            ]
        )
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = 0.15 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        weights, transition = weights + move[:WIDTH], transition + move[WIDTH:].reshape(2, 2)
    x = _logit(_mean(chain(features @ weights, np.asarray(per), transition)[1], size, per))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve, kept gentle
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        g = np.array([((labels - p) * x).sum() - 0.1 * (slope - 1), (labels - p).sum() - 0.1 * shift])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope + move[0], shift + move[1]
    return Model(prior, weights, transition, float(slope), float(shift))


def held_out(key):
    """Rows kept from training: crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def train(docs, labels, key="doc_id", text="text", label="quality", sample=SAMPLE, lines=LINES):
    """Fit on at most ``sample`` labelled rows that are not held out, chosen by a hash of the key.

    Of rows with one key one is taken, and of a text at most its first ``lines`` lines, so that what
    reaches the driver is bounded. The bounds concern the fit alone; scores read whole texts.

    Labels without key or value are left out; of several labels of a key the commoner counts
    (a tie: good). Without labels of both kinds the model is the smoothed share of good rows.
    """
    chosen = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("_key")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key").limit(sample)
    )
    # At most ``sample`` rows.
    texts = docs.select(F.col(key).cast("long").alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    # One row of each key: of several, the text with the least hash.
    rows = (
        texts.join(F.broadcast(chosen), F.col("_id") == F.col("_key")).groupBy("_id", "_label")
        .agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    )

    def describe(batches):
        for whole in batches:
            for batch in bytes_.slices(whole, 2):
                features, size, per = line_features(batch.column(2))
                cut = np.concatenate([[0], np.cumsum(per)])
                ends = np.minimum(cut[1:], cut[:-1] + lines)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), batch.column(1),
                        pa.array([features[a:b, :OWN].astype("<f4").tobytes() for a, b in zip(cut[:-1], ends)], pa.binary()),
                        pa.array([size[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], ends)], pa.binary()),
                    ],
                    ["key", "label", "features", "size"],
                )

    got = rows.mapInArrow(describe, "key long, label int, features binary, size binary").collect()
    got.sort(key=lambda r: (r["key"], r["features"]))
    if not got:
        return Model(0.5)
    blocks = [np.frombuffer(r["features"], "<f4").reshape(-1, OWN).astype(float) for r in got]
    zero = np.zeros((1, OWN))
    features = np.vstack([np.hstack([b, np.vstack([zero, b[:-1]]), np.vstack([b[1:], zero])]) for b in blocks])
    size = np.concatenate([np.frombuffer(r["size"], "<f4").astype(float) for r in got])
    return fit(features, size, np.array([len(b) for b in blocks]), [r["label"] for r in got])


def scored(docs, model, key="doc_id", text="text"):
    """(key, held_out, score, predicted) per row: predicted is 1 from a score of 0.7.

    Reads whole texts and nothing else of a row. Null texts are empty, and an empty text is
    scored as one empty line; null keys are not held out; repeated rows stay repeated.
    """
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def work(batches):
        for whole in batches:
            for batch in bytes_.slices(whole, 1):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(model.scores(batch.column(1)), pa.float64())], [key, "score"]
                )

    return rows.mapInArrow(work, f"`{key}` long, score double").select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def good_only(docs, model, text="text", least=0.7):
    """The rows of ``docs`` whose text scores ``least`` or more; all columns stay as they are."""
    names = docs.columns
    place = names.index(text)

    def work(batches):
        for whole in batches:
            for batch in bytes_.slices(whole, place):
                yield batch.filter(pa.array(model.scores(batch.column(place)) >= least, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
