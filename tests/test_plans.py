"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import metrics as mx
from rallyframe.operators.filters import Filters
from rallyframe.operators.state import rebuild_state
from rallyframe.plans import star
from rallyframe.plans.build import scored_log

LOG = "match_id string, year int, set_no int, game_no int, point_number bigint, point_server int, point_winner int, player1 string, player2 string"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """A stored log, read with broadcasts off so that plans look as they do on large data."""
    path = str(tmp_path_factory.mktemp("plan") / "log")
    rows = [(f"202{m % 5}-usopen-1{m % 7}0{m % 9}", 2020 + m % 5, 1, g, m * 100 + g * 6 + p, 1 + g % 2, 1 + (m + p) % 2, f"A. {m}", f"B. {m}")
            for m in range(30) for g in range(1, 9) for p in range(6)]
    spark.createDataFrame(rows, LOG).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def point_exchanges(text):
    """Hash exchanges that carry points: their input still has the server of each point."""
    lines = text.splitlines()
    return [line for line, source in zip(lines, lines[1:]) if "Exchange hash" in line and "point_server" in source]


def test_points_are_exchanged_once_for_the_whole_state(log):
    text = plan(rebuild_state(log))
    assert len(point_exchanges(text)) == 1
    assert "SinglePartition" not in text and "Python" not in text


def test_game_rows_share_one_aggregate_of_the_points(log):
    state = rebuild_state(log)
    state.collect()
    final = plan(state).split("== Initial Plan ==")[0]
    reused = [line for line in final.splitlines() if "ReusedExchange" in line or "ReusedQueryStage" in line]
    assert len(reused) == 1


def test_scoring_adds_no_exchange_of_points(log):
    before, after = plan(rebuild_state(log)), plan(scored_log(log))
    assert after.count("MapInArrow") == 1
    assert "CartesianProduct" not in after and "BroadcastNestedLoopJoin" not in after
    assert len(point_exchanges(after)) == len(point_exchanges(before)) == 1


def test_metrics_combine_before_the_shuffle(log):
    scored = log.withColumns({"p1_win_prob_before": F.lit(0.5), "p1_wp_delta": F.lit(0.1), "p2_wp_delta": F.lit(-0.1)})
    text = plan(mx.match_consistency(scored))
    assert text.count("Exchange") == 1 and "partial_stddev_pop" in text and text.count("FileScan") == 1


def test_top_k_is_not_a_global_sort(log):
    assert "TakeOrderedAndProject" in plan(mx.top_rows(log, "point_number", ["match_id"], 10))


def test_star_filters_reach_the_match_scan(log):
    matches = log.select(
        "match_id", "year", "player1", "player2", F.lit("ATP").alias("tour"), F.lit("US Open").alias("tournament_name")
    )
    players = log.select(F.col("player1").alias("player"), F.lit("Active").alias("player_status")).distinct()
    joined = star.star_join(log.select("match_id", "point_number"), matches, players, Filters(years=(2021,)), ["match_id", "point_number"])
    text = plan(joined)
    assert "PushedFilters: [" in text and "year" in re.search(r"PushedFilters: \[[^\]]*year[^\]]*\]", text).group(0)
    narrow = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    assert all("set_no" not in s and "point_server" not in s for s in narrow)


@pytest.mark.parametrize("rules", ["reference", "standard"])
def test_points_read_tiebreak_cells_where_they_meet_their_game(log, rules):
    """No exchange, sort or window above the join of points and games, so no point carries a list."""
    lines = plan(scored_log(log, rules)).split("== Initial Plan ==")[0].splitlines()
    top = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any(word in line for line in lines[:top] for word in ("Exchange", "Sort", "Window"))
    assert "_p" in lines[top] or "match_id" in lines[top]


def test_pairs_are_valued_behind_the_exchange_that_makes_them_distinct(log):
    text = plan(scored_log(log))
    lines = text.splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    below = lines[at + 1 : at + 4]
    assert "HashAggregate(keys=[pa#" in below[0] + below[1]
    assert any("Exchange hashpartitioning(pa#" in line for line in below)
