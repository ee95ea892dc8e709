import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rallyframe.llm import repetition
from rallyframe.llm import text as bytes_

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, lengths=tuple(repetition.SHARES)):
    """The measures of one text, window by window."""
    words = WORD.findall(text or "")
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or "")}
    seen, dup = set(), []
    for line in (text or "").split("\n"):
        if WORD.search(line):
            if line in seen:
                dup.append(line)
            seen.add(line)
    out["n_dup_lines"], out["dup_line_chars"] = len(dup), sum(len(w) for x in dup for w in WORD.findall(x))

    def inside(n, first):
        windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, met = Counter(windows), {}
        return {i + j for i, w in enumerate(windows) if count[w] > 1 and (met.setdefault(w, i) != i or first) for j in range(n)}

    out["n_repeat_words"] = len(inside(8, True))
    for n in lengths:
        out[f"dup{n}_chars"] = sum(len(words[i]) for i in inside(n, False))
    return out


def odd_texts():
    random.seed(3)
    word = lambda: random.choice(["a", "bb", "ß", "ccc", "日本", "#x", "|", "d e", "f" * 40])
    texts = [None, "", " ", "\n", "\n\n", "a", "a\n", "\na\na", "x y\nx y\n x y\nx y", "a\x0bb\x1cc\x85d", "a" * 5000, "a b " * 3000]
    for n in (3, 8, 9, 16, 17, 40, 200, 900):
        for _ in range(12):
            texts.append("".join(word() + random.choice(" \n\t  ") for _ in range(n)))
    passage = " ".join(f"w{i}" for i in range(12))
    texts += [passage + " x " + passage, passage + "\n" + passage, " ".join(f"v{i}" for i in range(400)), passage * 2]
    return texts


@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_measures_match_brute_force(monkeypatch, piece):
    monkeypatch.setattr(bytes_, "PIECE", piece)
    texts = odd_texts()
    got = repetition.measures(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert {k: int(v[i]) for k, v in got.items()} == brute(t), t


def test_segment_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8)
    cuts = np.sort(np.random.default_rng(2).choice(4000, 60, replace=False))
    whole = bytes_.segment_hashes(data, cuts[:-1], cuts[1:])
    monkeypatch.setattr(bytes_, "PIECE", 16)
    assert (bytes_.segment_hashes(data, cuts[:-1], cuts[1:]) == whole).all()
    assert len(set(whole.tolist())) == len(whole)


def test_window_hashes_are_equal_for_equal_windows_only():
    ids = np.random.default_rng(5).integers(1, 4, 500).astype(np.uint64)
    hashes = bytes_.mix(ids)
    for n in (1, 2, 5, 500, 501):
        got = repetition.window_hashes(hashes, n)
        windows = [tuple(ids[i : i + n]) for i in range(max(0, 501 - n))]
        assert len(got) == len(windows) and len(set(got.tolist())) == len(set(windows))
        assert len(set(zip(windows, got.tolist()))) == len(set(windows))


def test_rules_over_rows(spark, small):
    got = {}
    for r in repetition.scored(small).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert len(got[6]) == 2 and got[3][0].n_words == 0 and got[3][0].base_failed and not got[3][0].kept
    assert got[5][0].base_failed and got[1][0].kept and got[None][0].n_words == 14
    assert repetition.scored(small.limit(0)).count() == 0


def test_thresholds(spark):
    fresh = " ".join(f"w{i}" for i in range(60))
    line = "a line that stands here again and again"
    rows = [
        (1, fresh), (2, fresh + " " + " ".join(f"w{i}" for i in range(11))), (3, "\n".join([fresh, line, line])),
        (4, fresh + " ###" * 8), (5, " ".join(f"w{i}" for i in range(19))), (6, (line + "\n") * 4), (7, fresh + " ###" * 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in repetition.scored(docs).collect()}
    # 2: an n-gram of eleven words twice covers over a tenth; 3: the line is twice a short one.
    assert got == {1: (False, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (True, False), 7: (False, True)}
