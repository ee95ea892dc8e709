import pytest
from pyspark.sql import functions as F

from rallyframe.operators import filters as flt
from rallyframe.operators import metrics as mx


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        ("m1", 2023, "a", "b", 1, 0, "ATP"), ("m1", 2023, "a", "b", 2, 0, "ATP"), ("m2", 2024, "a", "c", 0, 1, "WTA"),
        ("m3", 2023, "d", None, 0, 0, "ATP"), ("m4", 2023, "b", "d", 3, 0, "ATP"), ("m5", 2024, "c", "a", 0, 2, "WTA"),
    ]
    return spark.createDataFrame(
        rows, "match_id string, year int, player1 string, player2 string, p1_sets_won int, p2_sets_won int, tour string"
    )


def test_active_and_inactive_players(log, rows):
    assert rows(flt.active_players(log)) == [("a",), ("c",)]
    assert rows(flt.inactive_players(log)) == [("b",), ("d",)]


def test_unknown_players_are_neither_active_nor_inactive(log, rows):
    assert rows(flt.keep_by_activity(log, "Active"), "match_id") == [("m1",), ("m1",), ("m2",), ("m5",)]
    assert rows(flt.keep_by_activity(log, "Inactive"), "match_id") == [("m1",), ("m1",), ("m3",), ("m4",)]
    assert flt.keep_by_activity(log, "All").count() == 6


def test_masking(log, rows):
    masked = flt.mask_by_status(log, "Active")
    assert rows(masked.distinct(), "match_id", "player1", "player2")[:3] == [
        ("m1", "a", None), ("m1", "a", None), ("m2", "a", "c"),
    ]
    kept = flt.mask_by_status(log, "Inactive", suffix="_x")
    assert kept.filter("match_id = 'm4'").select("player1", "player1_x").first() == ("b", "b")
    assert rows(flt.mask_by_status(log, "All")) == rows(log)


def test_point_totals_by_role(log, rows):
    assert rows(flt.point_totals(log)) == [("a", 4), ("b", 3), ("c", 2), ("d", 2)]
    assert rows(flt.point_totals(log, role="player1")) == [("a", 3), ("b", 1), ("c", 1), ("d", 1)]


def test_min_points_need_only_one_player(log):
    assert flt.with_min_points(log, 3).count() == 5
    assert flt.with_min_points(log, 0).count() == 6
    assert flt.with_player1_total(log, 2).select("total_points").distinct().collect() == [(3,)]


def test_finished_matches_drop_out_by_tour(log, rows):
    assert rows(flt.valid_matches(log).select("match_id").distinct()) == [("m1",), ("m2",), ("m3",)]
    assert flt.valid_matches(log, {"ATP": 9, "WTA": 9}).count() == 6


def test_filters_build_only_what_is_restricted(spark):
    assert flt.Filters().match_predicate() is None
    df = spark.createDataFrame([(2023, "ATP", "US Open"), (2024, "WTA", "US Open")], "year int, tour string, tournament_name string")
    assert flt.Filters(years=(2024,)).apply(df).count() == 1
    assert flt.Filters(tour="ATP", tournament="Wimbledon").apply(df).count() == 0
    hostile = flt.Filters(tour="x' OR '1'='1")
    assert hostile.apply(df).count() == 0


def test_high_pressure_flag_includes_the_threshold(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "importance double")
    assert flt.with_high_pressure(df, 25).filter("is_high_pressure").count() == 2
    empty = df.filter(F.lit(False))
    assert flt.with_high_pressure(empty).count() == 0


def test_unscored_points_count_as_not_under_pressure(spark):
    rows = [("a", "b", v) for v in (1.0, 2.0, None, 9.0)]
    df = spark.createDataFrame(rows, "player1 string, player2 string, importance double")
    flagged = flt.with_high_pressure(df, 25)
    assert flagged.filter("is_high_pressure IS NULL").count() == 0
    share = mx.pressure_share(flagged).filter("player = 'a'").first()
    assert (share["total_points"], share["high_pressure_points"], share["high_pressure_pct"]) == (4, 1, 0.25)


def test_player_lookups_leave_points_undealt(spark):
    rows = [("m1", "a", None, 2024), ("m1", "a", None, 2024), ("m2", None, "b", 2023), ("m3", "c", "a", 2023)]
    df = spark.createDataFrame(rows, "match_id string, player1 string, player2 string, year int")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    try:
        for got, wanted in (
            (flt.keep_by_activity(df, "Active"), {"m1", "m3"}), (flt.keep_by_activity(df, "Inactive"), {"m2", "m3"}),
            (flt.with_min_points(df, 3), {"m1", "m3"}),
        ):
            assert {r["match_id"] for r in got.collect()} == wanted
            plan = got._jdf.queryExecution().executedPlan().toString()
            joins = [x for x in plan.splitlines() if "SortMergeJoin" in x]
            # The outermost join is the one that brings flags to the points.
            assert "match_id" in joins[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_years_are_numbers_in_order(spark):
    df = spark.createDataFrame([(2024,), (2020,), (2024,), (None,)], "year int")
    assert [r["year"] for r in flt.year_options(df).collect()] == [2020, 2024]


def test_default_thresholds():
    assert flt.default_min_points("ATP", 3) == 1200 and flt.default_min_points("WTA", 2) == 400
    assert flt.default_min_pressure_points("ATP", 2) == 100 and flt.default_min_pressure_points("WTA", 1) == 30
