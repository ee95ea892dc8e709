import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from rallyframe.llm import spelling


def one_edit(a, b):
    """Whether exactly one code point is inserted, deleted or replaced; by trying all."""
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, min_chars=5, min_count=3):
    total = Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= min_chars and n >= min_count}


def brute_variants(counts, ratio=2):
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def vocabulary(seed, n):
    random.seed(seed)
    syllables = ["er", "en", "th", "éa", "ti", "on", "ß", "au", "re", "ÿ", "÷"]
    words = {"".join(random.choice(syllables) for _ in range(random.randint(2, 6))) for _ in range(n)}
    for w in list(words)[: n // 2]:
        at = random.randrange(len(w))
        words |= {w[:at] + w[at + 1 :], w[:at] + random.choice("abeé") + w[at:], w[:at] + random.choice("xyé") + w[at + 1 :]}
    words |= {"a" * k for k in range(1, 30)} | {"ab" * k for k in range(1, 8)} | {"e", "é", "ee"}
    return {w: random.choice([3, 4, 5, 6, 8, 12, 25, 50, 100, 200, 400]) for w in words if w}


@pytest.mark.parametrize("parts", [2, 4, 5])
def test_variants_match_all_pairs(spark, parts):
    counts = vocabulary(parts, 250)
    rows = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(rows, parts=parts).collect()}
    assert got == brute_variants(counts)


def test_long_chains_reach_their_end(spark):
    words = ["q" * 5 + "ab" * i for i in range(1)] + ["q" * k for k in range(6, 36)]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: r.root for r in spelling.variants(rows).collect()}
    assert set(got.values()) == {"q" * 35} and len(got) == 31


def test_counts_match_plain_search(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    random.seed(4)
    pool = ["Ärger", "ärger", "HELLO", "hello", "naïve", "x÷y×zab", "İstanbul", "don't", "łódka", "abcde1fghij", "straße", "ÿÿÿÿÿ"]
    rows = [(i if i % 9 else None, " ".join(random.choices(pool, k=random.randint(0, 60)))) for i in range(200)]
    rows += [(7, None), (8, ""), (9, "hello" * 40), (9, "hello" * 40), (10, "hello " * 4000)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r.n for r in spelling.word_counts(docs, change=spelling.planted_change).collect()}
    assert got == brute_counts(rows)


def test_rows_of_all_kinds(spark, small):
    counts = spelling.word_counts(small, min_count=1)
    got = {r.word: r for r in spelling.variants(counts).collect()}
    assert "there" not in got or got["there"].n_near >= 0
    assert got["looked"].n == 3 and got["another"].n == 2
    assert spelling.variants(spelling.word_counts(small.limit(0))).count() == 0
