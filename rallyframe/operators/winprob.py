"""Match-win probabilities and importance of every point, computed exactly.

The in-game score only decides who wins the current game, so for every point

    p = h * v_win + (1 - h) * v_lose

where ``h`` is player 1's chance to win the game (a plain column) and ``v_win``/``v_lose``
are player 1's match chances once the game is won or lost. The latter depend on a handful
of small integers and on both players' chances on serve. Each distinct pair of chances is
valued once in a job, for all scores; Spark spreads the pairs, sends Arrow batches to a
vectorised helper, and games look their cells up by the pair.
"""

import numpy as np
import pyarrow
from pyspark.sql import functions as F

from rallyframe.functions.model import game_win_prob, p1_point_chance, point_win_prob

STATE = ["match_id", "best_of", "p1_sets_won", "p2_sets_won", "p1_games_won", "p2_games_won"]
RATES = [
    "player1_serve_point_win_pct", "player1_return_point_win_pct",
    "player2_serve_point_win_pct", "player2_return_point_win_pct",
]
INPUTS = [*RATES, *STATE[1:], "p1_points", "p2_points", "point_server"]
PAIR = ["pa", "pb", "need"]
LISTS = ["chances", "breaker"]
RUN = 1024  # pairs valued at a time: some 12 MB of numbers
# Match chances once the game is won or lost, when player 1 or 2 serves it.
VALUES = ["win1", "lose1", "win2", "lose2"]
GRID = 9  # tiebreak scores 0..8 per side; longer ones fold back


def _settled(up, down):
    """Chance to be the one who breaks a level score; one half when nobody ever would."""
    total = up + down
    return np.divide(up, total, out=np.full_like(total, 0.5), where=total > 0)


def _game_from_love(x):
    y = 1 - x
    return x**4 * (1 + 4 * y + 10 * y * y) + 20 * (x * y) ** 3 * x * x / (x * x + y * y)


def _tiebreak_reference(own, other):
    """Tiebreak from 0-0 when the serve changes after points 1, 5, 9, ...

    ``own``/``other`` are player 1's chances on the starter's and the other player's serve.
    """
    win = np.zeros_like(own)
    alive = {(0, 0): np.ones_like(own)}
    played = 0
    while max(float(m.max()) for m in alive.values()) > 1e-13:
        x = own if ((played + 3) // 4) % 2 == 0 else other
        following = {}
        for (i, j), mass in alive.items():
            for a, b, part in ((i + 1, j, mass * x), (i, j + 1, mass * (1 - x))):
                if max(a, b) >= 7 and abs(a - b) >= 2:
                    if a > b:
                        win = win + part
                    continue
                shift = max(min(a, b) - 6, 0)
                key = (a - shift, b - shift)
                following[key] = following.get(key, 0.0) + part
        alive, played = following, played + 1
    return win


def _tiebreak_values(own, other):
    """Tiebreak chance from any (a, b) when the serve changes after points 1, 3, 5, ...; decided states count.

    ``own``/``other`` may be vectors, one entry for each pair; every score is worked out once.
    """
    known = {}

    def serve(n):
        return own if ((n + 1) // 2) % 2 == 0 else other

    level = _settled(own * other, (1 - own) * (1 - other))

    def value(i, j):
        if max(i, j) >= 7 and abs(i - j) >= 2:
            return np.ones_like(own) if i > j else np.zeros_like(own)
        if i == j and i >= 6:
            return level
        if (i, j) not in known:
            x = serve(i + j)
            known[(i, j)] = x * value(i + 1, j) + (1 - x) * value(i, j + 1)
        return known[(i, j)]

    return value


# Slots of the value table beside the 7x7 game scores: level at 7-7 or later, one game
# ahead or behind after 6-6, and set over.
LEVEL, UP, DOWN, WON, LOST = 49, 50, 51, 52, 53


def _slot(g1, g2, rules):
    """Slot of a score that was just reached."""
    g1, g2 = np.asarray(g1), np.asarray(g2)
    lead, low = g1 - g2, np.minimum(g1, g2)
    slot = np.clip(g1, 0, 6) * 7 + np.clip(g2, 0, 6)
    slot = np.where((low >= 7) & (lead == 0), LEVEL, slot)
    slot = np.where((low >= 6) & (lead == 1), UP, slot)
    slot = np.where((low >= 6) & (lead == -1), DOWN, slot)
    won = (g1 >= 6) & (lead >= 2)
    lost = (g2 >= 6) & (lead <= -2)
    if rules == "standard":
        won, lost = won | ((g1 == 7) & (g2 == 6)), lost | ((g1 == 6) & (g2 == 7))
    return np.where(won, WON, np.where(lost, LOST, slot))


def _value_table(pa, pb, need, rules):
    """Player 1's match chance for (sets, sets, slot, server to serve next), one vector per pair."""
    game = {1: _game_from_love(pa), 2: _game_from_love(1 - pb)}
    if rules == "reference":
        breaker = {1: _tiebreak_reference(pa, 1 - pb), 2: _tiebreak_reference(1 - pb, pa)}
    else:
        breaker = {1: _tiebreak_values(pa, 1 - pb)(0, 0), 2: _tiebreak_values(1 - pb, pa)(0, 0)}
    table = np.zeros((need, need, 54, 3, len(pa)))
    ahead = _settled(game[1] * game[2], (1 - game[1]) * (1 - game[2]))
    for s1 in reversed(range(need)):
        for s2 in reversed(range(need)):
            v = table[s1, s2]
            for server in (1, 2):
                v[WON, server] = 1.0 if s1 + 1 == need else table[s1 + 1, s2, 0, server]
                v[LOST, server] = 0.0 if s2 + 1 == need else table[s1, s2 + 1, 0, server]
            for server in (1, 2):
                v[LEVEL, server] = ahead * v[WON, server] + (1 - ahead) * v[LOST, server]
            for server in (1, 2):
                h, turn = game[server], 3 - server
                v[UP, server] = h * v[WON, turn] + (1 - h) * v[LEVEL, turn]
                v[DOWN, server] = h * v[LEVEL, turn] + (1 - h) * v[LOST, turn]
            for total in range(12, -1, -1):
                for g1 in range(max(0, total - 6), min(6, total) + 1):
                    g2 = total - g1
                    for server in (1, 2):
                        h = breaker[server] if g1 == g2 == 6 else game[server]
                        up, down = int(_slot(g1 + 1, g2, rules)), int(_slot(g1, g2 + 1, rules))
                        v[g1 * 7 + g2, server] = h * v[up, 3 - server] + (1 - h) * v[down, 3 - server]
    return table, breaker


def _tiebreak_grid(pa, pb):
    """Player 1's tiebreak chance for every score, starter 1 first: 2 x 9 x 9 numbers for each pair."""
    cells = [
        value(i, j)
        for value in (_tiebreak_values(pa, 1 - pb), _tiebreak_values(1 - pb, pa))
        for i in range(GRID) for j in range(GRID)
    ]
    return np.stack(cells, axis=1)


def _rated(df):
    """Both players' chances on serve, and the sets needed; together they are the key of a pair."""
    return df.withColumns(
        {
            "pa": point_win_prob("player1_serve_point_win_pct", "player2_return_point_win_pct"),
            "pb": point_win_prob("player2_serve_point_win_pct", "player1_return_point_win_pct"),
            "need": F.expr("IF(best_of IS NULL, NULL, IF(best_of = 5, 3, 2))"),
        }
    )


def pair_values(rows, rules="reference"):
    """One row for each distinct pair (pa, pb, need) of ``rows``, valued once in the whole job.

    ``rows`` holds best_of and the four rates, one row a match, say; rows that lack one of them give no
    pair. ``chances`` lists player 1's match chance by (sets, sets, slot, server to serve next), the last
    fastest; ``breaker`` the tiebreak chances, one for each starter or, by standard rules, one for each
    starter and score. The exchange that makes the pairs distinct also deals them out.
    """
    if rules not in ("reference", "standard"):
        raise ValueError(f"unknown rules: {rules}")
    pairs = _rated(rows).select(*PAIR).filter(" AND ".join(f"{c} IS NOT NULL" for c in PAIR)).distinct()

    def value(batches):
        for batch in batches:
            pa, pb = (batch.column(c).to_numpy(zero_copy_only=False) for c in PAIR[:2])
            needs = batch.column("need").to_numpy(zero_copy_only=False)
            for need in np.unique(needs):
                same = np.flatnonzero(needs == need)
                for at in np.split(same, range(RUN, len(same), RUN)):
                    table, breaker = _value_table(pa[at], pb[at], int(need), rules)
                    chances = table[:, :, :, 1:].reshape(-1, len(at)).T
                    if rules == "reference":
                        breaker = np.stack([breaker[1], breaker[2]], axis=1)
                    else:
                        breaker = _tiebreak_grid(pa[at], pb[at])
                    columns = [pa[at], pb[at], needs[at].astype(np.int32), _lists(chances), _lists(breaker)]
                    yield pyarrow.RecordBatch.from_arrays([pyarrow.array(c) for c in columns], names=[*PAIR, *LISTS])

    schema = "pa double, pb double, need int, chances array<double>, breaker array<double>"
    return pairs.mapInArrow(value, schema)


def _lists(numbers):
    """Rows of a matrix as an Arrow list array."""
    flat = np.ascontiguousarray(numbers)
    borders = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
    return pyarrow.ListArray.from_arrays(pyarrow.array(borders), pyarrow.array(flat.ravel()))


def _slot_text(g1, g2, rules):
    """SQL text for ``_slot``."""
    won, lost = f"({g1} >= 6 AND {g1} - {g2} >= 2)", f"({g2} >= 6 AND {g2} - {g1} >= 2)"
    if rules == "standard":
        won, lost = f"({won} OR {g1} = 7 AND {g2} = 6)", f"({lost} OR {g1} = 6 AND {g2} = 7)"
    return (
        f"CASE WHEN {won} THEN {WON} WHEN {lost} THEN {LOST} "
        f"WHEN LEAST({g1}, {g2}) >= 6 AND {g1} - {g2} = -1 THEN {DOWN} "
        f"WHEN LEAST({g1}, {g2}) >= 6 AND {g1} - {g2} = 1 THEN {UP} "
        f"WHEN LEAST({g1}, {g2}) >= 7 AND {g1} = {g2} THEN {LEVEL} "
        f"ELSE LEAST({g1}, 6) * 7 + LEAST({g2}, 6) END"
    )


def with_game_values(states, rules="reference", matches=None):
    """Add the value columns to a frame with one row per match state (or per game).

    ``states`` carries the integers of STATE and the four rates. Every distinct pair of chances is valued
    once (``pair_values``); states meet it by its key and read single cells, so that only tied games keep a
    list, that of the tiebreak. ``matches`` may name a smaller frame that holds every (best_of, rates) of
    ``states``. A state with a null in its key or its integers gets null values.
    """
    tables = pair_values(states if matches is None else matches, rules)
    met = _rated(states).join(tables, PAIR, "left")
    over = "(p1_sets_won >= need OR p2_sets_won >= need)"
    result = f"CAST(p1_sets_won {'=' if rules == 'reference' else '>='} need AS DOUBLE)"
    base = "(LEAST(p1_sets_won, need - 1) * need + LEAST(p2_sets_won, need - 1)) * 54"
    slots = {
        "win": _slot_text("(p1_games_won + 1)", "p2_games_won", rules),
        "lose": _slot_text("p1_games_won", "(p2_games_won + 1)", rules),
    }
    met = met.withColumns({f"_{name}_slot": F.expr(f"({base} + {slot}) * 2") for name, slot in slots.items()})
    # The next game is served by the other player: cell 1 after a game of player 1, 0 after one of player 2.
    cells = {
        f"{name}{server}": F.expr(f"IF({over}, IF(chances IS NULL, NULL, {result}), get(chances, _{name}_slot + {2 - server}))")
        for name in slots for server in (1, 2)
    }
    tied = F.expr("IF(p1_games_won = 6 AND p2_games_won = 6, breaker, NULL)")
    return met.withColumns({**cells, "breaker": tied}).drop("chances", "need", "_win_slot", "_lose_slot")


def _tiebreak_chance(i, j, rules):
    """Lookup text for player 1's tiebreak chance at points (i, j)."""
    if rules == "reference":
        return "element_at(breaker, point_server)"
    starter = "IF((p1_points + p2_points + 1) DIV 2 % 2 = 0, point_server, 3 - point_server)"
    fold = f"GREATEST(LEAST({i}, {j}) - 6, 0) DIV 2 * 2"
    cell = f"({starter} - 1) * {GRID * GRID} + (({i}) - {fold}) * {GRID} + (({j}) - {fold}) + 1"
    over = f"GREATEST({i}, {j}) >= 7 AND ABS(({i}) - ({j})) >= 2"
    return f"CASE WHEN {over} THEN IF(({i}) > ({j}), 1D, 0D) ELSE element_at(breaker, CAST({cell} AS INT)) END"


def probabilities(df, rules="reference"):
    """The three probabilities, importance and an error reason from value columns and points.

    Every step is a projection of its own, so that shared inputs stay single columns.
    """
    complete = " AND ".join(f"{c} IS NOT NULL" for c in INPUTS)
    names = ", ".join(f"IF({c} IS NULL, '{c}', NULL)" for c in INPUTS)
    missing = F.expr(f"IF({complete}, '', concat_ws(', ', {names}))")
    in_breaker = "p1_games_won = 6 AND p2_games_won = 6"
    outcomes = {"before": (0, 0), "if_p1_wins": (1, 0), "if_p2_wins": (0, 1)}

    def hold(i, j):
        one, two = f"p1_points + {i}", f"p2_points + {j}"
        return F.when(F.expr(in_breaker), F.expr(_tiebreak_chance(one, two, rules))).otherwise(
            game_win_prob("_x", one, two, rules)
        )

    first = {
        "error": missing,
        "_x": p1_point_chance(p1_serve="pa", p2_serve="pb"),
        "_win": F.expr("IF(point_server = 1, win1, win2)"),
        "_lose": F.expr("IF(point_server = 1, lose1, lose2)"),
    }
    scored = (
        df.withColumns(first)
        .withColumns({f"_{name}": hold(*step) for name, step in outcomes.items()})
        .withColumns(
            {f"p1_win_prob_{n}": F.expr(f"IF(error = '', _{n} * _win + (1 - _{n}) * _lose, NULL)") for n in outcomes}
        )
    )
    swing = F.expr("abs(p1_win_prob_if_p1_wins - p1_win_prob_if_p2_wins)")
    used = ["_x", "_win", "_lose", *[f"_{n}" for n in outcomes], *VALUES, "breaker", "pa", "pb"]
    return scored.withColumn("importance", swing).drop(*used)


def score_points(df, rules="reference"):
    """Score any table of points: STATE, points in the game, server and the four rates.

    Rates are per player and therefore constant inside a match, so the distinct states
    are few; they are valued once and joined back. Rows with a missing input get nulls
    and a reason. ``rules="reference"`` plays on from decided entry states, lets a 7-6
    set continue, serves tiebreaks in blocks of four and ignores tiebreak points;
    ``standard`` follows the usual rules of the game. ``plans.build`` values game rows
    directly and needs no join.
    """
    ints = [*STATE[1:], "p1_points", "p2_points", "point_server"]
    base = df.withColumns({c: F.col(c).cast("int") for c in ints})
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*STATE, *RATES])
    states = base.filter(complete).groupBy(*STATE).agg(*[F.max(r).alias(r) for r in RATES])
    values = with_game_values(states, rules).drop(*RATES)
    return probabilities(base.join(values, STATE, "left"), rules)


def empirical_win_prob(log, state, won="p1_won_match"):
    """Share of points in a state whose match player 1 won, and how many there are."""
    return log.groupBy(*state).agg(
        F.avg(F.col(won).cast("double")).alias("empirical_win_prob"), F.count(F.lit(1)).alias("points")
    )
