import numpy as np
import pytest

from rallyframe.llm import neighbours


def brute(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        rows = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in rows]
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["clusters", "sphere", "norms"])
def test_recall(spark, kind):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.standard_normal((n, 32))
    if kind == "clusters":
        x = x * 0.4 + rng.standard_normal((20, 32))[rng.integers(0, 20, n)]
    if kind == "norms":
        x *= rng.uniform(0.2, 3, (n, 1))
    else:
        x /= np.linalg.norm(x, axis=1)[:, None]
    x = x.astype("<f4").astype(float)
    ids = rng.permutation(n)
    got = {}
    for r in neighbours.nearest(table(spark, ids, x), shard_rows=500).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute(ids, x, 20, 20)
    assert set(got) == set(want)
    hits = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21))
        hits += len({v for _, v, _ in rows} & {v for v, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_copies_and_ties(spark):
    ids = np.arange(600)
    x = np.ones((600, 8))
    x[500:] = np.random.default_rng(1).standard_normal((100, 8))
    got = {}
    for r in neighbours.nearest(table(spark, ids, x), shard_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(ids, x.astype("<f4").astype(float), 20, 20)
    for q in range(0, 500, 20):
        assert got[q] == [v for v, _ in want[q]]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 2.0, 3.0]), (8, []), (20, [0.0, 2.0]), (1, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in neighbours.nearest(docs).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 1, 1.0), (20, 3, 0, 0.0)]
    assert neighbours.nearest(docs.filter("false")).count() == 0


def test_chi_square():
    assert abs(neighbours.chi_square(7.344, 8) - 0.5) < 1e-3
    assert abs(neighbours.chi_square(neighbours.stopping_point()) - neighbours.CONFIDENCE) < 1e-9


def test_rows_are_copied_once_for_the_visitors_of_their_cell(spark):
    index = spark.range(1000).selectExpr("id AS key", "id AS row", "array(1f) AS v", "CAST(id % 10 AS INT) AS cell", "0 AS shard")
    cells = spark.range(10).selectExpr("CAST(id AS INT) AS cell", "1 AS shards")
    asked = spark.range(100).selectExpr("id AS key", "id AS row", "array(1f) AS v", "0d AS known", "CAST(id % 10 AS INT) AS cell")
    copies = [neighbours.meetings(index, asked, cells, n)[0].count() for n in (10, 5, 1)]
    assert copies == [1000, 2000, 10_000]
    hot = asked.withColumn("cell", (asked.key % 2).cast("int") * asked.cell % 2)
    dealt, each = neighbours.meetings(index, hot, cells, 100)
    assert dealt.count() == 200 and each.count() == 100


def test_small_blocks_give_the_same(spark):
    x = np.random.default_rng(2).standard_normal((400, 6))
    docs = table(spark, np.arange(400), x)
    one = sorted(map(tuple, neighbours.nearest(docs, shard_rows=40).collect()))
    assert one == sorted(map(tuple, neighbours.nearest(docs, shard_rows=40, block_queries=2).collect()))


def test_double_vectors_keep_their_digits(spark):
    rows = [(0, [1.0, 1e-12]), (1, [1.0, 1.0]), (2, [1.0 + 1e-12, 0.0]), (3, [1e200, 0.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [3, 1, 2] and got[1]["score"] == 1.0 + 1e-12


def test_another_row_with_the_key_of_the_query_is_a_candidate(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (1, [0.5, 0.0])]
    got = sorted(map(tuple, neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()))
    assert got == [(0, 1, 0, 2.0), (0, 1, 0, 2.0), (0, 2, 1, 0.5), (0, 2, 1, 1.0)]


def test_clashing_column_names(spark):
    plain = table(spark, np.arange(30), np.random.default_rng(1).standard_normal((30, 4)))
    extra = plain.selectExpr("*", "1 AS key", "2 AS v", "3 AS cell", "4 AS row", "5 AS shard", "6 AS block")
    assert sorted(map(tuple, neighbours.nearest(plain).collect())) == sorted(map(tuple, neighbours.nearest(extra).collect()))
