import random

import pytest
from matches import tiebreak_set
from pyspark.sql import functions as F

from rallyframe.functions.model import game_win_prob
from rallyframe.operators.winprob import pair_values, score_points, with_game_values
from rallyframe.plans.build import scored_log

DDL = (
    "match_id string, player1_serve_point_win_pct double, player1_return_point_win_pct double, "
    "player2_serve_point_win_pct double, player2_return_point_win_pct double, best_of int, p1_sets_won int, "
    "p2_sets_won int, p1_games_won int, p2_games_won int, p1_points int, p2_points int, point_server int"
)
GOLDENS = [
    ((0.64, 0.62, 3, 0, 0, 0, 0, 0, 0, 1), 0.57746),
    ((0.60, 0.66, 5, 1, 1, 6, 6, 0, 0, 2), 0.31906),
    ((0.65, 0.60, 3, 1, 1, 5, 4, 4, 2, 1), 0.99266),
    ((0.58, 0.61, 3, 0, 1, 7, 6, 0, 1, 2), 0.18739),
    ((0.62, 0.62, 3, 1, 1, 6, 6, 1, 0, 1), 0.34011),
]


def frame(spark, states):
    """States (pA, pB, best_of, s1, s2, g1, g2, a, b, server) with rates that give pA and pB."""
    return spark.createDataFrame(
        [(f"m{i}", pa, 1 - pb, pb, 1 - pa, *rest) for i, (pa, pb, *rest) in enumerate(states)], DDL
    )


def score(spark, states, rules="reference"):
    return score_points(frame(spark, states), rules).orderBy(F.length("match_id"), "match_id").collect()


def test_reference_goldens(spark):
    got = score(spark, [g for g, _ in GOLDENS])
    assert [round(r["p1_win_prob_before"], 5) for r in got] == [v for _, v in GOLDENS]


def simulate(rng, state, rules):
    """Plain sampler written from the rules, for checking only."""
    pa, pb, best_of, s1, s2, g1, g2, a, b, server = state
    need = 3 if best_of == 5 else 2

    def won(who):
        return rng.random() < (pa if who == 1 else 1 - pb)

    def ends_set(x, y):
        return x >= 6 and x - y >= 2 or rules == "standard" and (x, y) == (7, 6)

    while s1 < need and s2 < need:
        breaker = g1 == 6 and g2 == 6
        if breaker and rules == "reference":
            a = b = 0
        target = 7 if breaker else 4
        turn = server
        if breaker and rules == "standard" and ((a + b + 1) // 2) % 2:
            starter = 3 - server
        else:
            starter = server
        first = True
        while True:
            if rules == "standard" or not first:
                if max(a, b) >= target and abs(a - b) >= 2:
                    break
            first = False
            n = a + b
            if breaker:
                if rules == "standard":
                    turn = starter if ((n + 1) // 2) % 2 == 0 else 3 - starter
                else:
                    turn = starter if ((n + 3) // 4) % 2 == 0 else 3 - starter
            if won(turn):
                a += 1
            else:
                b += 1
        if a > b:
            g1 += 1
        else:
            g2 += 1
        a = b = 0
        server = 3 - server
        if ends_set(g1, g2):
            s1, g1, g2 = s1 + 1, 0, 0
        elif ends_set(g2, g1):
            s2, g1, g2 = s2 + 1, 0, 0
    return s1 == need


@pytest.mark.parametrize("rules", ["reference", "standard"])
def test_against_a_sampler(spark, rules):
    states = [
        (0.66, 0.58, 3, 0, 1, 3, 4, 2, 1, 2),
        (0.61, 0.63, 5, 2, 1, 6, 6, 0, 0, 1),
        (0.70, 0.52, 3, 1, 0, 6, 5, 3, 3, 2),
        (0.59, 0.60, 5, 1, 2, 2, 5, 0, 3, 1),
    ]
    if rules == "standard":
        states += [(0.64, 0.60, 3, 0, 0, 6, 6, 4, 3, 1), (0.64, 0.60, 3, 1, 1, 6, 6, 8, 8, 2)]
    rng = random.Random(11)
    samples = 4000
    for state, row in zip(states, score(spark, states, rules)):
        p = row["p1_win_prob_before"]
        share = sum(simulate(rng, state, rules) for _ in range(samples)) / samples
        assert abs(share - p) <= 4 * (p * (1 - p) / samples) ** 0.5 + 1e-9, (state, p, share)


def test_standard_values_are_consistent(spark):
    """Before = chance-weighted mean of the two outcomes, everywhere."""
    states = [(0.63, 0.6, bo, s1, s2, g1, g2, a, b, srv)
              for bo, s1, s2 in ((3, 0, 1), (5, 2, 0)) for g1, g2 in ((0, 0), (5, 4), (6, 5), (6, 6))
              for a, b in ((0, 0), (3, 2), (3, 3), (4, 3), (2, 3)) for srv in (1, 2)]
    for state, r in zip(states, score(spark, states, "standard")):
        x = state[0] if state[9] == 1 else 1 - state[1]
        mean = x * r["p1_win_prob_if_p1_wins"] + (1 - x) * r["p1_win_prob_if_p2_wins"]
        assert r["p1_win_prob_before"] == pytest.approx(mean, abs=1e-9), state
        assert 0 <= r["p1_win_prob_before"] <= 1 and r["importance"] >= 0


def test_reference_importance_is_zero_in_a_tiebreak(spark):
    row = score(spark, [(0.62, 0.6, 3, 0, 0, 6, 6, 3, 2, 1)])[0]
    assert row["importance"] == 0
    assert score(spark, [(0.62, 0.6, 3, 0, 0, 6, 6, 3, 2, 1)], "standard")[0]["importance"] > 0


def test_finished_matches_and_missing_inputs(spark):
    done = score(spark, [(0.6, 0.6, 3, 2, 1, 0, 0, 0, 0, 1), (0.6, 0.6, 3, 1, 2, 0, 0, 0, 0, 1)])
    assert [r["p1_win_prob_before"] for r in done] == [1.0, 0.0]
    gap = frame(spark, [(0.6, 0.6, 3, 0, 0, 0, 0, 0, 0, 1)]).withColumn("p1_points", F.lit(None).cast("int"))
    row = score_points(gap).first()
    assert row["error"] == "p1_points" and row["p1_win_prob_before"] is None and row["importance"] is None


def test_two_point_lead_plays_on_only_under_reference_rules(spark):
    df = spark.createDataFrame([(0.6, 4, 2)], "x double, a int, b int")
    ref, std = df.select(game_win_prob("x", "a", "b"), game_win_prob("x", "a", "b", "standard")).first()
    deuce = 0.36 / 0.52
    assert ref == pytest.approx(0.6 + 0.4 * (0.6 + 0.4 * deuce)) and std == 1.0


def test_pipeline_agrees_with_the_general_operator(spark, rows):
    """Values that travel with the games equal values joined back by state."""
    for rules in ("reference", "standard"):
        log = scored_log(tiebreak_set().frame(spark), rules)
        names = ["p1_win_prob_before", "p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins", "importance"]
        again = score_points(log.drop(*names, "error"), rules)
        for left, right in zip(rows(log, "point_number", *names), rows(again, "point_number", *names)):
            assert left == pytest.approx(right, abs=1e-12)


def test_deltas_mirror_each_other(spark):
    log = scored_log(tiebreak_set().frame(spark))
    assert log.filter(F.abs(F.col("p1_wp_delta") + F.col("p2_wp_delta")) > 0).count() == 0
    assert log.filter(F.col("error") != "").count() == 0


def test_certain_servers_do_not_break_the_recursion(spark):
    """With two unbreakable servers a level set never ends; both sides count as even."""
    for rules in ("reference", "standard"):
        for r in score(spark, [(1.0, 1.0, 3, 0, 0, 0, 0, 0, 0, 1), (0.0, 0.0, 5, 1, 1, 6, 6, 0, 0, 2)], rules):
            assert 0 <= r["p1_win_prob_before"] <= 1
    assert score(spark, [(1.0, 1.0, 3, 1, 1, 7, 7, 0, 0, 1)])[0]["p1_win_prob_before"] == 0.5
    assert score(spark, [(1.0, 0.0, 3, 0, 0, 0, 0, 0, 0, 1)])[0]["p1_win_prob_before"] == 1.0


def test_every_distinct_pair_is_valued_once(spark):
    """As many valued rows as pairs, whatever repeats; rows without a rate or best_of give none."""
    states = [(0.6 + i % 3 / 100, 0.6, 3 if i % 2 else 5, 0, 0, i % 7, 0, 0, 0, 1) for i in range(60)]
    rows = frame(spark, states).repartition(4)
    bare = rows.limit(1).withColumn("best_of", F.lit(None).cast("int"))
    bare = bare.unionByName(rows.limit(1).withColumn("player1_serve_point_win_pct", F.lit(None).cast("double")))
    for rules in ("reference", "standard"):
        pairs = pair_values(rows.unionByName(bare), rules).collect()
        assert len(pairs) == len({(r["pa"], r["pb"], r["need"]) for r in pairs}) == 6
        assert {(r["need"], len(r["chances"])) for r in pairs} == {(2, 4 * 54 * 2), (3, 9 * 54 * 2)}
        assert {len(r["breaker"]) for r in pairs} == {2 if rules == "reference" else 2 * 81}
        valued = with_game_values(rows.unionByName(bare), rules)
        assert valued.count() == 62 and valued.filter("win1 IS NULL").count() == 2
    assert pair_values(rows.limit(0)).count() == 0


def test_matches_may_name_the_pairs(spark, rows):
    """Pairs taken from match rows value the games as pairs taken from the games do."""
    states = frame(spark, [(0.61, 0.6, 3, 0, 1, g, 5, 0, 0, 1) for g in range(7)])
    rates = [c for c in states.columns if c.endswith("pct")]
    few = states.select(*rates, "best_of").distinct()
    names = ["p1_games_won", "win1", "lose1", "win2", "lose2"]
    assert rows(with_game_values(states), *names) == rows(with_game_values(states, matches=few), *names)


def test_values_equal_single_games_played_out(spark):
    """Cells looked up for a game equal the chance-weighted mean of the following games' cells."""
    games = [(0.63, 0.6, 3, 1, 0, a, b, 0, 0, 1) for a in range(6) for b in range(6)]
    for rules in ("reference", "standard"):
        at = {(r["p1_games_won"], r["p2_games_won"]): r for r in with_game_values(frame(spark, games), rules).collect()}
        hold, other = game_chance(0.63), game_chance(0.4)
        for (a, b), r in at.items():
            if a < 5 and b < 5:
                after = at[(a + 1, b)]
                assert r["win1"] == pytest.approx(other * after["win2"] + (1 - other) * after["lose2"], abs=1e-12)
                after = at[(a, b + 1)]
                assert r["lose2"] == pytest.approx(hold * after["win1"] + (1 - hold) * after["lose1"], abs=1e-12)


def game_chance(x):
    """Chance to win a game from love, summed over its scores."""
    y = 1 - x
    return x**4 + 4 * x**4 * y + 10 * x**4 * y**2 + 20 * x**3 * y**3 * x**2 / (1 - 2 * x * y)
