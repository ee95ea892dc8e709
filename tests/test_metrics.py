import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import metrics as mx
from rallyframe.operators import players as pl

DDL = (
    "match_id string, point_number bigint, player1 string, player2 string, tour string, point_winner int, point_server int, "
    "p1_win_prob_before double, p1_win_prob_if_p1_wins double, p1_win_prob_if_p2_wins double, importance double, "
    "p1_wp_delta double, p2_wp_delta double, points_stake int, is_high_pressure boolean, match_winner string, "
    "server_name string, returner_name string, server_win boolean, returner_win boolean, p1_sets_won int, p2_sets_won int, score string"
)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for n in range(300):
        p1, p2 = rng.sample(["a", "b", "c", "d"], 2)
        if n % 40 == 0:
            p2 = None
        w, s, p, u, d = rng.choice([1, 2]), rng.choice([1, 2]), rng.random(), rng.random(), rng.random()
        delta = (u if w == 1 else d) - p
        rows.append((
            f"2020-usopen-{n % 9}", n, p1, p2, rng.choice(["ATP", "WTA"]), w, s, p, u, d, abs(u - d), delta, -delta, 10,
            rng.random() < 0.3, rng.choice([p1, p2, None]), p1 if s == 1 else p2, p2 if s == 1 else p1, w == s, w != s,
            n % 2, 0, rng.choice(["0-0", "40-AD", "3-2", "15-30"]),
        ))
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def sides(log):
    f = log.toPandas()
    one = f.assign(player=f.player1, delta=f.p1_wp_delta, wp=f.p1_win_prob_before, won=f.match_winner == f.player1)
    two = f.assign(player=f.player2, delta=f.p2_wp_delta, wp=1 - f.p1_win_prob_before, won=f.match_winner == f.player2)
    both = pd.concat([one, two], ignore_index=True)
    return both[both.player.notna()]


def by_player(df, column):
    return {r["player"]: r[column] for r in df.collect()}


def test_two_rows_per_point_without_unknown_players(log, sides):
    assert mx.per_player(log).count() == len(sides)


def test_player_deltas(log, sides):
    got = mx.player_deltas(log)
    assert by_player(got, "total_delta") == pytest.approx(sides.groupby("player").delta.sum().to_dict())
    high = sides[sides.is_high_pressure].groupby("player").delta
    assert by_player(got, "avg_delta_hp") == pytest.approx(high.mean().to_dict())
    assert by_player(got, "tour") == sides.groupby("player").tour.agg(lambda x: x.mode()[0]).to_dict()


def test_most_common_tour_breaks_ties_alphabetically(log):
    tied = log.limit(4).withColumns({"player1": F.lit("z"), "player2": F.lit(None).cast("string")})
    tied = tied.withColumn("tour", F.when(F.monotonically_increasing_id() % 2 == 0, "WTA").otherwise("ATP"))
    assert mx.player_deltas(tied).first()["tour"] == "ATP"


def test_match_consistency_uses_the_population_spread(log, sides):
    expected = sides.groupby(["match_id", "player"]).delta.std(ddof=0)
    got = {(r["match_id"], r["player"]): r for r in mx.match_consistency(log).collect()}
    assert {k: r["wp_delta_std"] for k, r in got.items()} == pytest.approx(expected.to_dict())
    assert all(r["consistency_score"] is None for r in got.values() if r["wp_delta_std"] == 0)


def test_consistency_index_spans_all_players(log, sides):
    g = sides.groupby("player")
    expected = g.wp.mean() / g.delta.std() * g.delta.count() ** 0.5
    expected = (expected - expected.min()) / (expected.max() - expected.min())
    assert by_player(mx.consistency(log), "consistency_index") == pytest.approx(expected.to_dict())
    few = mx.consistency(log, min_points=int(g.size().max()))
    kept = by_player(few, "consistency_index")
    assert 0 < len(kept) < 4
    assert kept == pytest.approx({p: expected[p] for p in kept})


def test_one_point_player_has_no_consistency(log):
    single = log.limit(1)
    assert [r["consistency"] for r in mx.consistency(single).collect()].count(None) >= 1


def test_clutch_and_rank(log, sides):
    clutch = sides.delta * sides.importance * sides.points_stake
    total = clutch.groupby(sides.player).sum()
    assert by_player(mx.expected_points_added(mx.clutch_by_match(log)), "expected_points_added") == pytest.approx(total.to_dict())
    joint = mx.consistency_and_clutch(log)
    assert by_player(joint, "expected_points_added") == pytest.approx(total.to_dict())
    assert by_player(joint, "clutch_percentile") == pytest.approx(total.rank(pct=True).to_dict())
    per_match = mx.clutch_by_match(log)
    means = clutch.groupby([sides.match_id, sides.player]).sum().groupby("player").mean()
    assert by_player(mx.clutch_by_player(per_match), "avg_clutch_score") == pytest.approx(means.to_dict())


def test_pressure_rankings_average_roles_without_weights(log):
    f = log.toPandas()
    per_role = []
    for name, win in (("server_name", "server_win"), ("returner_name", "returner_win")):
        for player, g in f[f[name].notna()].groupby(name):
            high = g[g.is_high_pressure]
            if len(high) >= 10:
                per_role.append((player, g[win].mean(), high[win].mean(), len(high)))
    frame = pd.DataFrame(per_role, columns=["player", "all", "high", "n"])
    frame["delta"] = frame.high - frame["all"]
    got = mx.pressure_rankings(log, 10)
    assert by_player(got, "clutch_delta") == pytest.approx(frame.groupby("player").delta.mean().to_dict())
    assert by_player(got, "high_pressure_points") == frame.groupby("player").n.sum().to_dict()


def test_pressure_share(log, sides):
    g = sides.groupby("player").is_high_pressure
    assert by_player(mx.pressure_share(log), "high_pressure_pct") == pytest.approx(g.mean().to_dict())
    assert mx.pressure_share(log, 10**6).count() == 0


def test_unlikely_results_count_matches_once(log, sides):
    known = sides[sides.match_winner.notna()]
    wins = known[known.won & (known.wp <= 0.2)].groupby("player").match_id.nunique().to_dict()
    losses = known[~known.won & (known.wp >= 0.8)].groupby("player").match_id.nunique().to_dict()
    got = mx.unlikely_results(log, 0.2, 0.8)
    assert {p: n for p, n in by_player(got, "unlikely_wins").items() if n} == wins
    assert {p: n for p, n in by_player(got, "unlikely_losses").items() if n} == losses


def test_score_summary_keeps_standard_tokens_only(log):
    got = {r["score"]: r for r in mx.score_summary(log).collect()}
    assert set(got) == {"0-0", "40-AD", "15-30"}
    f = log.toPandas()
    assert got["0-0"]["win_rate"] == pytest.approx(f[f.score == "0-0"].server_win.mean())


def test_upsets_take_the_earliest_lowest_point(log):
    same = log.filter("match_winner IS NOT NULL").withColumn("p1_win_prob_before", F.lit(0.4))
    same = same.withColumn("match_winner", F.col("player1"))
    first = same.groupBy("match_id").agg(F.min("point_number")).collect()
    got = {(r["match_id"], r["point_number"]) for r in mx.top_upsets(same, 100).collect()}
    assert got == {tuple(r) for r in first}


def test_top_swings_and_scenarios(log):
    ready = log.withColumns(
        {"year": F.lit(2020), "tournament_name": F.lit("US Open"), "p1_games_won": F.lit(1), "p2_games_won": F.lit(2)}
    )
    top = mx.top_swings(ready, 3)
    expected = log.toPandas().importance.nlargest(3).tolist()
    assert [r["abs_swing"] for r in top.collect()] == pytest.approx(expected)
    long = mx.swing_scenarios(top).collect()
    assert len(long) == 6
    assert [r["point_outcome"] for r in long].count("Actual") == 3
    assert all(r["prob_delta"] >= 0 for r in long)


def test_rates_from_one_scan_equal_the_joined_stats(log):
    rates = {r["player"]: r for r in pl.player_rates(log).collect()}
    stats = pl.combine_stats(pl.serve_stats(log), pl.return_stats(log)).filter("player IS NOT NULL").collect()
    for s in stats:
        assert rates[s["player"]]["serve_point_win_pct"] == pytest.approx(s["serve_point_win_pct"])
        assert rates[s["player"]]["return_point_win_pct"] == pytest.approx(s["return_point_win_pct"])


def test_missing_role_gets_the_default_rate(spark):
    one = spark.createDataFrame([("a", "b", True, False)], "server_name string, returner_name string, server_win boolean, returner_win boolean")
    got = {r["player"]: tuple(r)[1:] for r in pl.player_rates(one).collect()}
    assert got == {"a": (1.0, 0.38), "b": (0.62, 0.0)}


def test_tour_classes(spark):
    df = spark.createDataFrame(
        [("a", "ATP"), ("b", "WTA"), ("c", "ATP"), ("c", "WTA"), ("d", None), ("e", "UNKNOWN")], "player string, tour string"
    )
    assert {r["player"]: r["tour"] for r in pl.classify_tours(df).collect()} == {
        "a": "ATP", "b": "WTA", "c": "Both", "d": None, "e": "Both",
    }


def test_other_codes_resolve_to_nobody(spark):
    df = spark.createDataFrame([(0, 3, "a", "b")], "point_winner int, point_server int, player1 string, player2 string")
    assert pl.with_roles(df).select("server_name", "returner_name", "point_winner_name").first() == (None, None, None)
