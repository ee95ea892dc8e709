"""Star schema: serving tables, notebook-style dimensions, and the parameterised star join."""

from pyspark.sql import functions as F

from rallyframe.functions.ids import tour, tournament_name
from rallyframe.functions.names import canonical_names, initial_form
from rallyframe.functions.scores import swap_for_server
from rallyframe.operators.filters import Filters
from rallyframe.operators.ordered import join_on, with_row_ids
from rallyframe.operators.players import attach_rates, player_dimension
from rallyframe.sources.facts import pruned_by

MATCH_COLUMNS = [
    "match_id", "tournament", "year", "player1", "player2", "best_of", "round", "points_stake", "match_winner",
]


def match_detail(log, key=True):
    """One row per match with tour and tournament name; ``match_key`` follows match_id order."""
    matches = log.select(*MATCH_COLUMNS).distinct().select(
        "match_id", tour().alias("tour"), tournament_name().alias("tournament_name"), "year", "player1",
        "player2", "best_of", "round", "points_stake", "match_winner",
    )
    return with_row_ids(matches, ["match_id"], "match_key") if key else matches


def point_detail(log, key=True):
    """Point attributes with a player-1-first score; ``point_id`` follows (match, point) order."""
    points = log.select(
        "match_id", "point_number", "point_winner", "point_server", "p1_sets_won", "p2_sets_won",
        "p1_games_won", "p2_games_won", F.col("server_token").alias("p1_score"),
        F.col("returner_token").alias("p2_score"), swap_for_server().alias("score"), "server_name",
        "returner_name", "is_tiebreak",
    )
    return with_row_ids(points, ["match_id", "point_number"], "point_id") if key else points


PROBABILITIES = [
    "p1_win_prob_before", "p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins", "importance", "p1_wp_delta", "p2_wp_delta",
]


def wide_facts(log):
    """Attributes and probabilities of each point in one projection, with the year (and tour) it is stored by."""
    points = log.withColumns({"p1_score": F.col("server_token"), "p2_score": F.col("returner_token"), "score": swap_for_server()})
    return points.select(
        "match_id", "point_number", "year", "point_winner", "point_server", "p1_sets_won", "p2_sets_won", "p1_games_won",
        "p2_games_won", "p1_score", "p2_score", "score", "server_name", "returner_name", "is_tiebreak", *PROBABILITIES,
        *[c for c in ["tour"] if c in log.columns],
    )


def point_probability(log, key=True):
    """Probability columns of each point."""
    points = log.select("match_id", "point_number", *PROBABILITIES)
    return with_row_ids(points, ["match_id", "point_number"], "point_id") if key else points


def player_detail(log, name_map=None, key=True):
    """Player dimension; ids follow the player name."""
    players = player_dimension(log, name_map).drop("last_year")
    return with_row_ids(players, ["player"], "player_id") if key else players


BASE = [
    "match_id", "player1", "player2", "year", "point_winner", "point_server", "server_name", "returner_name",
    "p1_win_prob_before", "p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins", "p1_wp_delta", "p2_wp_delta",
    "importance", "points_stake",
]
PROJECTIONS = {
    "consistency": BASE,
    "pressure": [*BASE, "tour"],
    "results": [
        *BASE, "tour", "tournament_name", "match_winner", "p1_sets_won", "p2_sets_won", "p1_games_won",
        "p2_games_won", "score", "point_number",
    ],
}


def star_join(points, matches, players, filters, columns, probabilities=None, name_map=None):
    """The serving join: points with their match and both players' status, filtered.

    Match filters and the player lookups work on match rows; points join the surviving
    matches once. ``probabilities`` is only needed when they live in a table of their own;
    facts that carry ``year`` are filtered by it too, which prunes a table stored by year. Of facts
    with ``year`` and ``tour`` only those of years and tours that the filtered matches hold are read.
    Names of the match side are canonicalised with ``name_map`` like those of the player
    side, since otherwise matches with a variant spelling drop out. ``columns`` is a list
    or the name of a projection.
    """
    chosen = filters.apply(matches)
    if name_map is not None:
        chosen = canonical_names(chosen, name_map, ["player1", "player2"])
    for number in (1, 2):
        side = players.select(
            F.col("player").alias(f"player{number}"), F.col("player_status").alias(f"status{number}")
        )
        chosen = chosen.join(side, f"player{number}")
    chosen = filters.by_status(chosen)
    facts = points
    if {"year", "tour"} <= set(facts.columns):
        if filters.match_predicate() is not None:
            facts = pruned_by(facts, filters.apply(matches))
        facts = facts.drop("tour")
    if "year" in facts.columns:
        facts = Filters(years=filters.years).apply(facts).drop("year")
    if probabilities is not None:
        facts = facts.join(probabilities.drop("point_id"), ["match_id", "point_number"])
    return facts.join(chosen, "match_id").select(*(PROJECTIONS[columns] if isinstance(columns, str) else columns))


def dim_player(matches):
    """Players by standardised name; of several raw spellings the first in order is kept."""
    names = matches.select(F.explode(F.array("player1", "player2")).alias("player_name")).distinct()
    return (
        names.withColumn("player_name_clean", initial_form("player_name"))
        .filter(F.col("player_name_clean").isNotNull())
        .groupBy("player_name_clean")
        .agg(F.min("player_name").alias("player_name"))
    )


def dim_event(matches):
    return matches.select("slam", "year").distinct()


def dim_match(matches, players, events):
    """Matches with event and both player ids (left joins: unknown names leave null ids)."""
    out = matches.withColumns(
        {"player1_clean": initial_form("player1"), "player2_clean": initial_form("player2")}
    ).join(events.select("event_id", "slam", "year"), ["slam", "year"], "left")
    for number in (1, 2):
        role = players.select(
            F.col("player_id").alias(f"player{number}_id"),
            F.col("player_name_clean").alias(f"player{number}_clean"),
        )
        out = out.join(role, f"player{number}_clean", "left")
    return out.select(
        "match_id", "event_id", "player1_id", "player2_id", "round",
        tour(variant="digits_first").alias("tour"),
    )


def fact_with_rates(fact, rates, server="server_id", returner="returner_id"):
    """Fact rows with both roles' rates (left joins: unknown ids get the default rates).

    Looked up once per distinct pair of ids, so that points are never dealt out by player.
    """
    pairs = fact.select(server, returner).distinct()
    rated = attach_rates(pairs, rates, {server: "server", returner: "returner"})
    return join_on(fact, rated, [server, returner])


def fact_points(points, matches):
    """Points with their match's player ids resolved to server, returner and winner ids."""
    from rallyframe.operators.players import with_roles

    keys = matches.select("match_id", "player1_id", "player2_id")
    joined = points.join(keys, "match_id")
    return with_roles(joined, "player1_id", "player2_id", suffix="id")
