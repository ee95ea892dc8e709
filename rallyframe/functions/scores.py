"""Score tokens, score labels and win-probability columns of a point."""

from pyspark.sql import functions as F

from rallyframe.constants import ROUND_STAKES, SCORE_POINTS
from rallyframe.functions.ids import literal_map


def token_points(token, unknown=0):
    """Score token -> points (0/15/30/40/AD -> 0..4); other tokens give ``unknown`` (may be None)."""
    points = literal_map(SCORE_POINTS)[F.col(token)]
    return points if unknown is None else F.coalesce(points, F.lit(unknown))


def points_stake(round_column="round"):
    """Ranking points at stake in a round; null for rounds that are not listed."""
    return literal_map(ROUND_STAKES)[F.col(round_column)]


def _side(mine, other, tiebreak):
    """Token of one side: plain below deuce, then 40 or AD; an integer inside a tiebreak."""
    return f"""CASE WHEN {tiebreak} THEN CAST({mine} AS STRING)
        WHEN {mine} >= 3 AND {other} >= 3 AND {mine} = {other} + 1 THEN 'AD'
        ELSE element_at(array('0', '15', '30', '40'), LEAST({mine}, 3) + 1) END"""


def score_labels(p1_points="p1_points_pre", p2_points="p2_points_pre", server="point_server", tiebreak="is_tiebreak"):
    """Server-first label and its two tokens, from the points in the game before each point."""
    one, two = _side(p1_points, p2_points, tiebreak), _side(p2_points, p1_points, tiebreak)
    first, second = f"IF({server} = 2, {two}, {one})", f"IF({server} = 2, {one}, {two})"
    return {
        "server_token": F.expr(first),
        "returner_token": F.expr(second),
        "score": F.expr(f"concat_ws('-', {first}, {second})"),
    }


def swap_for_server(first="server_token", second="returner_token", server="point_server"):
    """The same label turned round for server 2: player 1 comes first."""
    straight = F.concat_ws("-", F.col(first), F.col(second))
    return F.when(F.col(server) == 2, F.concat_ws("-", F.col(second), F.col(first))).otherwise(straight)


def by_code(code, if_one, if_two):
    """Value for code 1 or 2, null for any other code."""
    return F.when(F.col(code) == 1, F.col(if_one)).when(F.col(code) == 2, F.col(if_two))


def probability_deltas(winner="point_winner", other="null"):
    """Change of player 1's win probability and its mirror image for player 2.

    Codes other than 1 and 2 give null, or count as player 2 with ``other="two"``.
    """
    gain = F.col("p1_win_prob_if_p1_wins") - F.col("p1_win_prob_before")
    loss = F.col("p1_win_prob_if_p2_wins") - F.col("p1_win_prob_before")
    one = F.col(winner) == 1
    delta = F.when(one, gain)
    delta = delta.otherwise(loss) if other == "two" else delta.when(F.col(winner) == 2, loss)
    return {"p1_wp_delta": delta, "p2_wp_delta": -delta}


def match_winner_before():
    """Player-1 winners take the probability before the point, others ``if_p2_wins``."""
    return F.when(F.col("match_winner") == F.col("player1"), F.col("p1_win_prob_before")).otherwise(
        F.col("p1_win_prob_if_p2_wins")
    )


def winner_probability():
    """The later winner's probability before the point, to five digits."""
    p = F.col("p1_win_prob_before")
    return F.round(F.when(F.col("match_winner") == F.col("player1"), p).otherwise(1 - p), 5)


def weighted_importance(weight=None):
    """Importance, optionally multiplied by a round weight."""
    return F.col("importance") if weight is None else F.col("importance") * F.col(weight)
