import pytest
from pyspark.sql import functions as F

from rallyframe.operators import metrics as mx
from rallyframe.operators.filters import Filters
from rallyframe.plans import reports


@pytest.fixture(scope="module")
def log(spark):
    """Two busy players and one with few points, whose points are the most important ones."""
    rows = []
    for i in range(40):
        rows.append(("m1", i, "a", "b", 2024, "ATP", i / 100, i % 2 == 0))
    for i in range(5):
        rows.append(("m2", i, "c", "a", 2024, "ATP", 0.9, True))
    rows.append(("m3", 1, "d", "a", 2023, "ATP", None, False))
    schema = "match_id string, point_number int, player1 string, player2 string, year int, tour string, importance double, server_win boolean"
    return spark.createDataFrame(rows, schema).withColumns(
        {"server_name": F.col("player1"), "returner_name": F.col("player2"), "returner_win": ~F.col("server_win")}
    )


def test_threshold_follows_the_gate(log):
    every = Filters(tour="ATP")
    # Over all points the five important ones would raise the threshold; the gate removes them first.
    gated = reports.pressure_points(log, every, min_points=10)
    assert {r["player1"] for r in gated.select("player1").distinct().collect()} == {"a"}
    assert gated.filter("is_high_pressure").count() == 10
    report = reports.pressure_tab(log, every, min_points=10, min_ranking_points=1)
    assert [(r["place"], r["player"]) for r in report.collect()] == [(1, "a")]


def test_masked_players_are_left_out(log):
    report = reports.pressure_points(log, Filters(status="Active"), min_points=1)
    assert {r["player1"] for r in report.collect()} == {"a", "c"}


def test_gated_points_are_stored_once(log):
    """Threshold and report scan the stored points, not the chain of filters, masks and joins."""
    files = reports.pressure_points(log, Filters(status="Active"), min_points=1).inputFiles()
    assert files and all("/gated-" in f for f in files)


def test_head_and_tail(spark):
    rows = [(f"p{i}", float(i)) for i in range(15)] + [("x", None)]
    got = mx.pressure_extremes(spark.createDataFrame(rows, "player string, v double"), "v", 3).collect()
    assert [r["player"] for r in got if r["side"] == "most"] == ["p14", "p13", "p12"]
    assert [(r["player"], r["place"]) for r in got if r["side"] == "least"] == [("p0", 1), ("p1", 2), ("p2", 3)]
