import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rallyframe.llm import prefixes
from rallyframe.operators import ordered


def brute_rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def brute_nodes(convs):
    """Every node from every prefix of every conversation."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = sorted(c for c in who if len(convs[c]) == len(path))
        sha = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.add((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), len(kids), leaves, saved, sha))
    return out


def talk(seed, n=120):
    random.seed(seed)
    texts = ["", "a", "bé", "a b", "日本", None, "long " * 300]
    rows = []
    for c in range(n):
        conv = random.choice([c, c, 100 + c, 200 + c // 2, 7000 + c])
        for t in range(random.choice([0, 1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17])):
            turn = t if random.random() < 0.97 else None
            role = random.choice(["user", "assistant"]) if random.random() < 0.1 else ("user", "assistant")[t % 2]
            rows.append((conv, turn, role, random.choice(texts) if random.random() < 0.25 else f"turn {t}"))
    rows += [(9000 + i, t, "user", f"same {t}") for i in range(40) for t in range(9)]
    rows += [(5000, t, None, None) for t in range(150)]
    rows += [(5001, t, None, None) for t in range(149)] + [(None, 0, "user", "nobody")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, rows, block=prefixes.BLOCK):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", conv string, place int").repartition(5)
    turns, ids = prefixes.rebuilt(frame)
    return [tuple(r) for r in prefixes.prefix_nodes(turns, ids, block).collect()]


@pytest.mark.parametrize("seed,block", [(1, 4), (2, 1), (3, 7)])
def test_nodes_match_all_prefixes(spark, seed, block):
    rows = talk(seed)
    got = found(spark, rows, block)
    assert len(got) == len(set(got))
    assert set(got) == brute_nodes(brute_rebuilt(rows))


def test_long_conversations_are_cut(spark, monkeypatch):
    """Chunks of long conversations and short pieces of ids change nothing."""
    groups = ordered.ordered_groups
    monkeypatch.setattr(prefixes, "ordered_groups", lambda df, keys, position: groups(df, keys, position, max_rows=16))
    monkeypatch.setattr(prefixes, "IDS", 3)
    rows = talk(5, 60)
    assert set(found(spark, rows)) == brute_nodes(brute_rebuilt(rows))


def test_turnless_and_empty(spark):
    # crc32("3") % 6 and crc32("105") % 6 decide how many turns go; the base 0 and 100 are absent.
    rows = [(c, 0, "user", "x") for c in (3, 5, 105, 106)]
    assert set(found(spark, rows)) == brute_nodes(brute_rebuilt(rows))
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_plain_conversations(spark):
    """The operator's own interface, without the rebuilding of the query."""
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yes"), (2, 0, "u", "hi"), (2, 1, "a", "no"), (3, 0, "u", "hi")]
    placed = prefixes.numbered_turns(spark.createDataFrame(rows, SCHEMA)).withColumn("depth", prefixes.F.col("place") + 1)
    got = {tuple(r)[:7] for r in prefixes.prefix_nodes(placed, placed.select("conv")).collect()}
    assert got == {(1, 0, None, 3, 1, 2, 4), (1, 1, 1, 3, 2, 2, 4), (1, 2, 1, 1, 0, 1, 0), (2, 2, 1, 1, 0, 1, 0)}
