import itertools
import zlib

import numpy as np
import pyarrow as pa

from rallyframe.llm import quality


def test_chain_matches_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 1, 5])
    e, t = rng.standard_normal(9), rng.standard_normal((2, 2))
    total, good, pairs = quality.chain(e, lengths, t)
    at, seen = 0, np.zeros((2, 2))
    for i, n in enumerate(lengths):
        z, marginal, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + j] * s[j] for j in range(n)) + sum(t[s[j], s[j + 1]] for j in range(n - 1)))
            z += w
            marginal += w * np.array(s)
            for j in range(n - 1):
                two[s[j], s[j + 1]] += w
        assert abs(total[i] - np.log(z)) < 1e-9 and np.allclose(good[at : at + n], marginal / z)
        seen += two / z
        at += n
    assert np.allclose(pairs, seen)


def test_features_do_not_depend_on_the_batch():
    texts = ["Good line.\nANOTHER!! ONE!!\n", "", None, "x", "a b a b a b a b\nsame\nsame", "é ü\n\n", "w " * 5000]
    features, size, per = quality.line_features(pa.array(texts))
    assert per.tolist() == [(t or "").count("\n") + 1 for t in texts]
    assert size.sum() == sum(len((t or "").encode()) for t in texts)
    at = 0
    for t, n in zip(texts, per):
        alone, _, _ = quality.line_features(pa.array([t or ""]))
        assert np.allclose(alone, features[at : at + n]), t
        at += n


def rows(n):
    rng = np.random.default_rng(9)
    words = ["the", "rain", "falls", "on", "quiet", "fields", "and", "rivers", "all", "night"]
    for i in range(n):
        lines = [" ".join(rng.choice(words, 8)).capitalize() + "." for _ in range(rng.integers(1, 6))]
        bad = i % 4 == 0
        if bad:
            lines = [x.upper().replace(" ", "!! ") if i % 8 else x.replace(" ", "*** ") for x in lines]
        yield i, "\n".join(lines), int(not bad)


def test_learns_from_rows_that_are_not_held_out(spark):
    data = list(rows(400))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").selectExpr("*", "1 AS _label", "2 AS score")
    flip = {i: (q if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q) for i, _, q in data}
    labels = spark.createDataFrame([(i, q) for i, q in flip.items()] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    truth = {i: q for i, _, q in data}
    held = [i for i in got if got[i].held_out]
    assert {i for i in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    # Labels of held-out rows are all wrong above; had they been used, this would fail.
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97


def test_odd_rows_and_no_labels(spark, small):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(small, none)
    got = quality.scored(small, model).collect()
    assert len(got) == small.count() and {r.score for r in got} == {0.5}
    one = quality.train(small, spark.createDataFrame([(1, 1), (5, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in quality.scored(small, one).collect())
    both = quality.train(small, spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int"))
    scores = quality.scored(small, both).collect()
    assert all(0 <= r.score <= 1 for r in scores) and len({r.score for r in scores if r.doc_id in (3, 4)}) == 1
    kept = quality.good_only(small, both)
    assert kept.columns == small.columns
    assert quality.scored(small.filter("false"), both).count() == 0


def test_the_fit_is_bounded_in_rows_and_lines(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda f, s, n, y: seen.append((len(f), list(n), y)))
    rows = [(1, "a line of words\n" * 50 + str(i)) for i in range(20)] + [(3, "one line"), (4, "two\nlines")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    kept = [k for k in (1, 3, 4) if zlib.crc32(str(k).encode()) % 4 != 2]
    quality.train(docs, marks, lines=10)
    most = {1: 10, 3: 1, 4: 2}
    assert seen[0][1] == [most[k] for k in kept] and seen[0][0] == sum(most[k] for k in kept)
