import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import ordered


def numbers(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")


@pytest.mark.parametrize("accuracy", [20, 10_000])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.75, 0.8, 1.0])
def test_exact_quantile_matches_pandas(spark, monkeypatch, q, accuracy):
    monkeypatch.setattr(ordered, "ACCURACY", accuracy)
    rng = random.Random(7)
    values = [rng.gauss(0, 1) ** 3 for _ in range(400)] + [1.5] * 300 + [1e6]
    assert ordered.exact_quantile(numbers(spark, values), "v", q) == pytest.approx(
        pd.Series(values).quantile(q), rel=1e-12
    )


def test_quantile_edge_cases(spark):
    assert ordered.exact_quantile(numbers(spark, [1, 2, 2, 3, 7, 9, 11.0]), "v", 0.75) == 8.0
    assert ordered.exact_quantile(numbers(spark, [4.0] * 9), "v", 0.5) == 4.0
    assert ordered.exact_quantile(numbers(spark, [None]), "v", 0.5) is None
    assert ordered.exact_quantile(numbers(spark, [None, float("nan"), 2.0]), "v", 0.5) == 2.0


def test_quantile_ends_on_infinities_and_any_spread(spark):
    inf = float("inf")
    wide = [-1.7e308, 1.7e308, inf, -inf] + [float(i) for i in range(125)]
    listed = sorted(wide)
    for at in (0, 1, 64, 127, 128):  # 128 steps: every share is exact
        assert ordered.exact_quantile(numbers(spark, wide), "v", at / 128) == listed[at]
    assert ordered.exact_quantile(numbers(spark, [inf, inf, 1.0]), "v", 0.75) == inf


def sizes(groups):
    return sorted(r["count"] for r in groups.df.groupBy(*groups.part).count().collect())


def test_chunks_are_cut_by_rows(spark):
    far = spark.range(2000).select(F.lit("k").alias("k"), F.when(F.col("id") == 1999, 10**15).otherwise(F.col("id")).alias("pos"))
    assert max(sizes(ordered.ordered_groups(far, ["k"], "pos", 20))) <= 21
    nulls = spark.range(2000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("pos"))
    cut = ordered.ordered_groups(nulls, ["k"], "pos", 20)
    assert max(sizes(cut)) <= 21
    got = ordered.running_sums(cut, ["pos"], {"n": F.lit(1)}).rows().collect()
    assert all(r["n"] == r["pos"] for r in got) and len(got) == 2000
    ends = spark.createDataFrame([("k", -(2**63)), ("k", 2**63 - 1), ("k", 0)], "k string, pos bigint")
    assert sizes(ordered.ordered_groups(ends, ["k"], "pos", 1)) == [1, 1, 1]


def test_percent_rank_shares_ties(spark):
    ranked = ordered.average_percent_rank(numbers(spark, [1, 2, 2, 3, 7, 9, 11.0, None]), "v", "r").collect()
    got = {(r["v"], None if r["r"] is None else round(r["r"], 6)) for r in ranked}
    assert got == {(1, 0.142857), (2, 0.357143), (3, 0.571429), (7, 0.714286), (9, 0.857143), (11, 1.0), (None, None)}
    assert len(ranked) == 8


def test_percent_rank_with_a_dominant_value(spark):
    values = [5.0] * 300 + [float(i % 97) for i in range(600)]
    ranked = ordered.average_percent_rank(numbers(spark, values), "v", "r").collect()
    expected = pd.Series(values).rank(pct=True)
    assert sorted(round(r["r"], 9) for r in ranked) == sorted(expected.round(9))


def test_row_ids_follow_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("t")).repartition(7)
    got = ordered.with_row_ids(df, ["k"], "rid").select("rid", "k").collect()
    assert sorted(tuple(r) for r in got) == [(i + 1, i) for i in range(1000)]


def grouped(spark, max_rows):
    rows = [("hot", i, i % 3 == 0) for i in range(500)] + [(f"m{i % 20}", 1000 + i, i % 2 == 0) for i in range(100)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, pos bigint, flag boolean")
    return df, ordered.ordered_groups(df, ["k"], "pos", max_rows)


@pytest.mark.parametrize("max_rows", [20, 10_000])
@pytest.mark.parametrize("inclusive", [False, True])
def test_running_sums_do_not_depend_on_chunks(spark, max_rows, inclusive):
    df, groups = grouped(spark, max_rows)
    got = ordered.running_sums(groups, ["pos"], {"n": F.col("flag").cast("int")}, inclusive).rows()
    frame = df.toPandas().sort_values(["k", "pos"])
    frame["n"] = frame.groupby("k")["flag"].cumsum() - (0 if inclusive else frame["flag"].astype(int))
    assert sorted(tuple(r) for r in got.select("k", "pos", "n").collect()) == sorted(
        frame[["k", "pos", "n"]].itertuples(index=False, name=None)
    )


def test_only_large_groups_are_cut(spark):
    _, groups = grouped(spark, 20)
    counts = dict(groups.df.groupBy("k").agg(F.count_distinct("chunk")).collect())
    assert counts.pop("hot") == 25 and set(counts.values()) == {1}
    assert grouped(spark, 10_000)[1].hot is None


@pytest.mark.parametrize("max_rows", [20, 10_000])
def test_previous_values_cross_chunk_boundaries(spark, max_rows):
    df, groups = grouped(spark, max_rows)
    got = ordered.previous_values(groups, ["pos"], {"before": ("pos", -1), "raw": ("pos", None)}).rows()
    frame = df.toPandas().sort_values(["k", "pos"])
    frame["before"] = frame.groupby("k")["pos"].shift(1).fillna(-1).astype(int)
    assert sorted(tuple(r) for r in got.select("k", "pos", "before").collect()) == sorted(
        frame[["k", "pos", "before"]].itertuples(index=False, name=None)
    )
    assert got.filter("raw IS NULL").count() == df.select("k").distinct().count()


def test_group_rows_reach_every_chunk(spark):
    df, groups = grouped(spark, 20)
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = groups.join_groups(table).rows()
    assert joined.count() == df.count() and joined.filter("n IS NULL").count() == 0


def test_every_large_group_is_cut_however_many_there_are(spark):
    df = spark.range(6000).select((F.col("id") % 1500).alias("k"), F.col("id").alias("pos"))
    groups = ordered.ordered_groups(df, ["k"], "pos", max_rows=2)
    assert groups.hot.count() == 1500 and max(sizes(groups)) == 2
