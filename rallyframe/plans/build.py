"""The batch build: raw logs -> state -> rates -> scores -> serving tables."""

from pyspark.sql import functions as F

from rallyframe.functions.cleaning import cast_columns, drop_sentinels, numeric_only
from rallyframe.functions.ids import best_of, round_number, tour
from rallyframe.functions.names import initial_form
from rallyframe.functions.scores import (
    by_code,
    match_winner_before,
    points_stake,
    probability_deltas,
    score_labels,
    token_points,
)
from rallyframe.operators.players import attach_rates, player_rates, with_roles, with_serve_outcome
from rallyframe.operators.state import rebuild_state
from rallyframe.operators.winprob import probabilities, with_game_values

_RENAMES = {
    "SetNo": "set_no", "GameNo": "game_no", "PointNumber": "point_number", "PointWinner": "point_winner",
    "PointServer": "point_server",
}


def one_per_match(matches):
    """One row per match id: of several spellings the first in order, those with both players first."""
    row = F.struct(
        (F.col("player1").isNull().cast("int") + F.col("player2").isNull().cast("int")).alias("missing"), "player1", "player2"
    )
    return matches.groupBy("match_id").agg(F.min(row).alias("_m")).select("match_id", "_m.player1", "_m.player2")


def point_log(raw_points, raw_matches, observation=None):
    """Clean raw points joined to their match's players (raw points without a match stay)."""
    players = raw_matches.select(
        "match_id",
        initial_form("player1", single="keep").alias("player1"),
        initial_form("player2", single="keep").alias("player2"),
    )
    types = {"SetNo": "int", "GameNo": "int", "PointNumber": "bigint", "PointWinner": "int", "PointServer": "int"}
    clean = cast_columns(numeric_only(drop_sentinels(raw_points), observation=observation), types)
    for old, new in _RENAMES.items():
        clean = clean.withColumnRenamed(old, new)
    return clean.join(one_per_match(players), "match_id", "left").drop("ElapsedTime")


def prepared_log(points, tiebreak_at=6, per_game=None):
    """Match state, labels, roles, rates and match facts for every point of a clean log.

    Facts read from the match id are worked out on match rows, not once per point. ``per_game`` takes the
    game rows and the match rows with their rates, and returns the game rows with more columns.
    """
    rates = player_rates(with_serve_outcome(with_roles(points)))
    matches = one_per_match(points.select("match_id", "player1", "player2").distinct())
    facts = {"best_of": best_of(), "round": round_number(), "tour": tour()}
    rated = attach_rates(matches, rates).drop("player1", "player2").withColumns(facts)
    rated = rated.withColumn("points_stake", points_stake())
    known = [c for c in rated.columns if c != "match_id"]
    extra = per_game and (lambda games: per_game(games, rated))
    log = rebuild_state(points.drop(*known), tiebreak_at, rated, extra).withColumns(score_labels())
    winner = by_code("match_winner_code", "player1", "player2")
    return with_serve_outcome(with_roles(log)).withColumn("match_winner", winner)


def scored_log(points, rules="reference", server_first=None):
    """Prepared log plus probabilities, importance and deltas, in one pass over the points.

    Match values are looked up on game rows and reach the points with the game join.
    ``server_first`` feeds the server's token as player 1's points, as the published
    numbers do; the default follows ``rules``: server-first for ``reference``, the
    players' own points for ``standard``.
    """
    if server_first is None:
        server_first = rules == "reference"
    log = prepared_log(points, per_game=lambda games, matches: with_game_values(games, rules, matches))
    if server_first:
        own = {"p1_points": token_points("server_token"), "p2_points": token_points("returner_token")}
    else:
        own = {"p1_points": F.col("p1_points_pre"), "p2_points": F.col("p2_points_pre")}
    scored = probabilities(log.withColumns(own), rules)
    return scored.withColumns(probability_deltas()).withColumn("match_winner_prob_before", match_winner_before())
