import pytest
from matches import Log, tiebreak_set
from pyspark.sql import functions as F

from rallyframe.functions.scores import score_labels, swap_for_server
from rallyframe.operators import state as st


def test_love_game_and_next_row(spark, rows):
    log = Log().game(1, 1, "1111").game(1, 2, "2").frame(spark)
    got = rows(st.rebuild_state(log), "point_number", "p1_points_pre", "p2_points_pre", "p1_games_won", "p2_games_won", "game_win")
    assert got == [(1, 0, 0, 0, 0, None), (2, 1, 0, 0, 0, None), (3, 2, 0, 0, 0, None), (4, 3, 0, 0, 0, 1), (5, 0, 0, 1, 0, 2)]


@pytest.mark.parametrize("server,expected", [
    (1, ["0-0", "15-0", "15-15", "30-15", "30-30", "40-30", "40-40", "AD-40", "40-40", "40-AD"]),
    (2, ["0-0", "0-15", "15-15", "15-30", "30-30", "30-40", "40-40", "40-AD", "40-40", "AD-40"]),
])
def test_deuce_labels_are_server_first(spark, server, expected):
    log = Log().game(1, server, "1212121222").frame(spark)
    labelled = st.rebuild_state(log).withColumns(score_labels()).withColumn("own", swap_for_server())
    got = labelled.orderBy("point_number").select("score", "own").collect()
    assert [r["score"] for r in got] == expected
    flipped = ["-".join(reversed(x.split("-"))) if server == 2 else x for x in expected]
    assert [r["own"] for r in got] == flipped


def test_tiebreak_and_set_change(spark):
    log = tiebreak_set().frame(spark)
    got = st.rebuild_state(log).withColumns(score_labels()).orderBy("point_number").collect()
    breaker = [r for r in got if r["is_tiebreak"]]
    assert {(r["set_no"], r["game_no"]) for r in breaker} == {(1, 13)}
    assert [r["score"] for r in breaker][:4] == ["0-0", "1-0", "1-1", "2-1"]
    assert {r["game_win"] for r in breaker} == {1}
    after = [r for r in got if r["set_no"] == 2]
    assert {(r["p1_sets_won"], r["p2_sets_won"]) for r in after} == {(1, 0)}
    assert (after[0]["p1_games_won"], after[0]["p2_games_won"]) == (0, 0)
    assert all((r["p1_sets_won"], r["p2_sets_won"]) == (0, 0) for r in got if r["set_no"] == 1)


def test_unfinished_game_gives_no_credit_but_decides_the_match(spark):
    log = tiebreak_set().frame(spark)
    got = st.rebuild_state(log)
    last = got.orderBy(F.desc("point_number")).first()
    assert (last["p1_game_won"], last["p2_game_won"], last["match_winner_code"]) == (0, 0, 2)


def test_recorded_winner_goes_first(spark):
    log = tiebreak_set().frame(spark)
    known = spark.createDataFrame([("2020-usopen-1101", " A. One ")], "match_id string, winner string")
    blank = spark.createDataFrame([("2020-usopen-1101", "")], "match_id string, winner string")
    assert st.with_match_winner(log, known).first()["match_winner"] == " A. One "
    assert st.with_match_winner(log, blank).first()["match_winner"] == "B. Two"
    assert st.with_match_winner(log).first()["match_winner"] == "B. Two"


@pytest.mark.parametrize("max_rows", [2, 1_000_000])
def test_input_order_and_chunking_do_not_matter(spark, rows, max_rows):
    plain = rows(st.set_columns(st.rebuild_state(tiebreak_set().frame(spark))))
    other = rows(st.set_columns(st.rebuild_state(tiebreak_set().frame(spark, shuffled=True), max_rows=max_rows)))
    assert plain == other


def test_set_columns_include_the_current_game(spark):
    log = Log().game(1, 1, "1111").game(1, 2, "1111").frame(spark)
    got = st.set_columns(st.rebuild_state(log)).orderBy("point_number").collect()
    assert [r["set1_p1"] for r in got] == [1.0] * 4 + [2.0] * 4
    assert {r["set2_p1"] for r in got} == {0.0}


def test_sets_by_start_credits_the_previous_point(spark, rows):
    log = Log().game(1, 1, "1112").game(2, 1, "11").game(3, 1, "2").frame(spark)
    got = rows(st.carried_state(log), "point_number", "new_set_start", "p1_sets_by_start", "p2_sets_by_start")
    assert got == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 1, 0, 1), (6, 0, 0, 1), (7, 1, 1, 1)]


def test_lag_orders_numbers_not_text(spark, rows):
    log = Log().game(1, 1, "1" * 12).frame(spark).withColumn("game_no", F.col("point_number").cast("int"))
    got = rows(st.carried_state(log, {"prev": ("game_no", 0)}), "point_number", "prev")
    assert sorted(got) == [(i, i - 1) for i in range(1, 13)]


def test_state_never_falls_inside_a_set(spark):
    from pyspark.sql import Window

    w = Window.partitionBy("match_id", "set_no").orderBy("point_number")
    state = st.rebuild_state(tiebreak_set().frame(spark))
    drops = state.withColumn("fall", F.lag("p1_games_won").over(w) > F.col("p1_games_won")).filter("fall")
    assert drops.count() == 0
