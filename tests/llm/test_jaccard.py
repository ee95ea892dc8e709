import itertools
import random
import re

import pytest

from rallyframe.llm import jaccard
from rallyframe.llm.components import connected_components


def brute(rows, percent=75):
    """doc_id -> (set size, component) by comparing every pair."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets[key] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def corpus():
    random.seed(8)
    word = lambda: "".join(random.choice("abcdef") for _ in range(4))
    passage = " ".join(word() for _ in range(20))
    rows, base = [], [word() for _ in range(60)]
    for i in range(90):  # one large group of near copies, some of them far from each other
        text = list(base)
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            text[random.randrange(60)] = word()
        rows.append((i * 3, " ".join(text)))
    for i in range(60):  # a passage that many share
        rows.append((1000 + i, passage + " " + " ".join(word() for _ in range(random.randint(3, 60)))))
    for i in range(40):  # pairs at and around the border
        text = [word() for _ in range(random.randint(5, 30))]
        rows.append((2000 + 2 * i, " ".join(text)))
        text[-random.randint(1, 3)] = word()
        rows.append((2001 + 2 * i, " ".join(text)))
    rows += [(3000, "One two"), (3001, "one  TWO"), (3002, ""), (3003, None), (3004, " \n"), (3005, "Äb c d e f"), (3006, "äb c d e f")]
    rows += [(3100 + i, "exact copy of a text with more than five words in it") for i in range(30)]
    return rows


@pytest.mark.parametrize("percent", [75, 60])
def test_components_match_brute_force(spark, percent):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, percent=percent).collect()}
    assert got == brute(rows, percent)


def test_frequent_list_does_not_change_the_result(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark, small):
    got = jaccard.near_duplicates(small).collect()
    assert len(got) == small.count()
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert {(r.n_shingles, r.component_id) for r in got if r.doc_id == 3} == {(0, 3)}
    kept = jaccard.first_of_each(small)
    # The two rows with key 6 are equal in all columns: one of them stays.
    assert kept.columns == small.columns and kept.count() == small.count() - 1
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({r.doc_id for r in small.collect()}, key=repr)
    assert jaccard.near_duplicates(small.filter("false")).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(7, 7), (500, 499), (499, 498), (498, 500)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 161)} | {i: 0 for i in range(40)} | {498: 498, 499: 498, 500: 498}
    assert got == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_are_decided_by_themselves(spark):
    """Keys that rows share, null keys and equal rows: no text is lost and no copy stays."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (None, b, "y"), (None, c, "y"), (7, c + " more", "z"), (9, "", "z"), (9, "", "z"), (None, None, None)]
    rows += [(5, "an exact copy of a row with words enough", "q")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)
    got = sorted(((r.doc_id, r.text, r.tag) for r in jaccard.first_of_each(docs).collect()), key=repr)
    want = [(1, a, "x"), (2, b, "x"), (7, c + " more", "z"), (9, "", "z"), (9, "", "z"), (None, None, None), (5, "an exact copy of a row with words enough", "q")]
    assert got == sorted(want, key=repr)


def test_full_sets_are_counted_whole(spark):
    """Shingles that all members of a group share are listed wherever they lie in the order of hashes."""
    import numpy as np
    import pyarrow as pa

    random.seed(3)
    base = [f"w{random.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(base + [f"own{i}x{j}" for j in range(20)]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    shared = jaccard.shingle_sets(pa.array([" ".join(base)]))[0]
    listed = jaccard.frequent_shingles(docs)
    assert set(shared.tolist()) == set(listed.tolist())
    assert listed.dtype == np.uint64


def test_only_the_first_shared_shingle_stands_for_a_pair(spark):
    """A row that needs shared shingles before it to reach the similarity is no candidate."""
    rows = [(1, 2, 100, 100, 0, 0), (1, 2, 100, 100, 14, 14), (1, 2, 100, 100, 15, 15), (1, 2, 100, 100, 20, 3), (1, 1, 100, 100, 0, 0), (1, 2, 100, 70, 0, 0)]
    names = "component1 long, component2 long, n1 int, n2 int, pos1 int, pos2 int"
    got = [tuple(r) for r in spark.createDataFrame(rows, names).filter(jaccard._may_link(75)).collect()]
    assert got == rows[:2]


def test_far_copies_of_one_text_match_brute_force(spark):
    """Copies whose edits leave them below the similarity stay alone beside a large component."""
    random.seed(11)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(160):
        text = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 4, 6, 8])):
            text[random.randrange(150)] = f"own{i}x{random.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == brute(rows)
