import random
import struct

import pytest
from pyspark.sql import functions as F

from rallyframe.functions.packing import ordered_bits, packed, packed_number
from rallyframe.operators import metrics as mx
from rallyframe.operators.state import last_rows


def bits(x):
    raw = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -raw if x < 0 else raw


def doubles():
    random.seed(7)
    edge = [0.0, -0.0, 1.0, 0.5, 0.1, 5e-324, 2.0**-1022, 2.0**-1023, 1e-300, 1e308, float("inf"), 2.0**53 + 2]
    edge += [2.0**k for k in range(-1074, 1024, 37)]
    close = [x for k in range(-60, 60, 7) for x in (2.0**k, 2.0**k * (1 - 2**-53), 2.0**k * (1 + 2**-52))]
    made = [struct.unpack("<d", struct.pack("<q", random.randrange(2047 << 52)))[0] for _ in range(2000)]
    made += [random.random() for _ in range(2000)]
    return edge + close + made + [-x for x in close + made[:500]]


def test_bits_are_those_of_the_double(spark):
    values = doubles()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: r["b"] for r in df.select("i", ordered_bits(F.col("v")).alias("b")).collect()}
    assert all(got[i] == bits(v) for i, v in enumerate(values))


def test_keys_are_ordered_by_value_then_number(spark):
    values = [v for v in doubles() if abs(v) != float("inf")][:800]
    random.seed(2)
    rows = [(v, random.choice([None, 0, 1, 2, 10**12, -5])) for v in values for _ in range(2)]
    df = spark.createDataFrame(rows + [(None, 3), (float("nan"), 1)], "v double, n bigint")
    got = df.select("v", "n", packed(F.col("v"), F.col("n")).alias("k")).withColumn("back", packed_number(F.col("k"))).collect()
    known = [r for r in got if r["v"] is not None]
    assert all(r["k"] is None for r in got if r["v"] is None) and all(r["back"] == r["n"] for r in known)
    plain = [r for r in known if r["v"] == r["v"]]
    by_key = sorted(plain, key=lambda r: r["k"])
    want = sorted(plain, key=lambda r: (r["v"], r["n"] is not None, r["n"] or 0))
    assert [(r["v"], r["n"]) for r in by_key] == [(r["v"], r["n"]) for r in want]
    assert max(known, key=lambda r: r["k"])["v"] != max(known, key=lambda r: r["k"])["v"]  # NaN is last


LOG = "match_id string, tour string, point_number bigint, player1 string, player2 string, match_winner string, p1_win_prob_before double, p1_wp_delta double, p2_wp_delta double, p1_sets_won int, p2_sets_won int"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    random.seed(1)
    rows = [
        (f"2020-usopen-1{m:03d}", random.choice(["ATP", "WTA", None]), p, f"A{m}", f"B{m}", random.choice([f"A{m}", f"B{m}"]) if p else None,
         random.choice([0.05, 0.02, 0.02, 0.97, 0.99, 0.5]), 0.1, -0.1, p % 2, 0)
        for m in range(60) for p in range(12)
    ]
    path = str(tmp_path_factory.mktemp("packed") / "log")
    spark.createDataFrame(rows, LOG).write.parquet(path)
    return spark.read.parquet(path), rows


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_extremes_need_no_sort_of_groups(spark, stored):
    log, _ = stored
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (mx.extreme_points(log), mx.top_upsets(log), mx.unlikely_results(log), last_rows(log, ["match_id"], "point_number")):
            text = final_plan(df)
            assert "SortAggregate" not in text and "HashAggregate" in text
            assert "Python" not in text and "Cartesian" not in text
        # Whole rows meet the few chosen ones without an exchange of the points.
        assert final_plan(mx.top_upsets(log)).count("BroadcastHashJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_extremes_match_plain_search(stored):
    log, rows = stored
    want = {}
    for m, _, p, a, b, winner, prob, *_ in rows:
        for player, before in ((a, prob), (b, 1 - prob)):
            if winner:
                want.setdefault((player, m), []).append((player == winner, before, p))
    expected = {}
    for key, seen in want.items():
        wins = sorted((x, p) for won, x, p in seen if won and x <= 0.1)
        losses = sorted((-x, p) for won, x, p in seen if not won and x >= 0.9)
        if wins or losses:
            expected[key] = (*(wins[0] if wins else (None, None)), *((-losses[0][0], losses[0][1]) if losses else (None, None)))
    got = {(r[0], r[1]): tuple(r[2:]) for r in mx.extreme_points(log).collect()}
    assert got == expected


def test_last_rows_with_nulls_and_ties(spark):
    rows = [("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 5, "n"), ("b", None, "only"), ("c", 2, "t"), ("c", 2, "t")]
    got = sorted((tuple(r) for r in last_rows(spark.createDataFrame(rows, "k string, n bigint, v string"), ["k"], "n").collect()), key=repr)
    assert got == sorted([("a", 3, "y"), (None, 5, "n"), ("b", None, "only"), ("c", 2, "t")], key=repr)
