"""Point and game win chances as plain columns."""

from pyspark.sql import functions as F


def point_win_prob(serve_pct, opponent_return_pct):
    """Server's chance to win a point: half serve rate, half what the opponent fails to return."""
    return (F.col(serve_pct) + (1 - F.col(opponent_return_pct))) * 0.5


def p1_point_chance(server="point_server", p1_serve="p1_serve_prob", p2_serve="p2_serve_prob"):
    """Player 1's chance to win the point, from both players' chances on their own serve."""
    return F.when(F.col(server) == 1, F.col(p1_serve)).when(F.col(server) == 2, 1 - F.col(p2_serve))


# Binomial coefficients C(i + j, i) for i, j in 0..3, row by row.
_PATHS = "array(1, 1, 1, 1, 1, 2, 3, 4, 1, 3, 6, 10, 1, 4, 10, 20)"


def _before_deuce(x, a, b, deuce):
    """Exact chance from (a, b), both at most 3.

    With i points to go to 3 and j for the opponent, player 1 either takes i + 1 points
    while the opponent takes at most two in total, or the game reaches 3-3.
    """
    y, i, j = f"(1 - {x})", f"(3 - ({a}))", f"(3 - ({b}))"
    direct = f"(IF({b} <= 2, 1D, 0D) + IF({b} <= 1, ({i} + 1) * {y}, 0D) + IF({b} <= 0, ({i} + 1) * ({i} + 2) * 0.5D * {y} * {y}, 0D))"
    paths = f"element_at({_PATHS}, CAST(4 * {i} + {j} + 1 AS INT))"
    return f"pow({x}, {i} + 1) * {direct} + {paths} * pow({x}, {i}) * pow({y}, {j}) * {deuce}"


def game_win_prob(x, a, b, rules="reference"):
    """Player 1's chance to win the game from points (a, b), winning each point with chance ``x``.

    Arguments are column names or short SQL texts. Only the lead matters from 3-3 on. An
    entry state that is already decided counts as decided under ``standard`` rules; under
    ``reference`` rules one more point is played before anybody looks, so a two-point
    lead can still be lost.
    """
    deuce = f"({x} * {x} / ({x} * {x} + (1 - {x}) * (1 - {x})))"
    ahead, behind = f"({x} + (1 - {x}) * {deuce})", f"({x} * {deuce})"
    lead = f"(({a}) - ({b}))"
    played_on = ""
    if rules == "reference":
        played_on = f"WHEN {lead} = 2 THEN {x} + (1 - {x}) * {ahead} WHEN {lead} = -2 THEN {x} * {behind}"
    return F.expr(f"""CASE
        WHEN {a} <= 3 AND {b} <= 3 THEN {_before_deuce(x, a, b, deuce)}
        WHEN {lead} = 0 THEN {deuce} WHEN {lead} = 1 THEN {ahead} WHEN {lead} = -1 THEN {behind}
        {played_on} WHEN {lead} >= 2 THEN 1D WHEN {lead} <= -2 THEN 0D END""")
