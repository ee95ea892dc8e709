"""Score before every point, rebuilt from who won each point.

Points are shuffled once, by game. Everything above the game level is scanned on game
summaries (one row per game, produced by a combining aggregate), and the result joins
back on the same game key, so no second exchange of the points is needed.
"""

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.constants import GAME, SET
from rallyframe.operators.ordered import MAX_GROUP_ROWS, join_on, ordered_groups, previous_values, running_sums


def _before(keys, order):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _total_before(column, window):
    return F.coalesce(F.sum(column).over(window), F.lit(0)).cast("int")


def _won(mine, other):
    """A game is won at its last point with at least four points and a lead of two."""
    return ((F.col(mine) >= 4) & (F.col(mine) - F.col(other) >= 2)).cast("int")


def running_points(points, max_rows=MAX_GROUP_ROWS):
    """Points of both sides in the current game, before each point and including it."""
    return _running_points(points, max_rows).rows()


def _running_points(points, max_rows):
    flags = {
        f"p{p}_points_pre": F.coalesce((F.col("point_winner") == p).cast("int"), F.lit(0)) for p in (1, 2)
    }
    groups = running_sums(ordered_groups(points, GAME, "point_number", max_rows), ["point_number"], flags)
    typed = {n: F.col(n).cast("int") for n in flags}
    including = {n.replace("_pre", "_run"): F.col(n).cast("int") + flag for n, flag in flags.items()}
    return replace(groups, df=groups.df.withColumns({**typed, **including}))


def game_table(points):
    """One row per game: points and winner, games and sets before it, winner of its match."""
    by_number = F.col("point_number")
    # Rows without a full key match no game; leaving them out here keeps both uses of the
    # game rows below on one and the same exchange.
    keyed = points.filter(" AND ".join(f"{k} IS NOT NULL" for k in GAME))
    games = keyed.groupBy(*GAME).agg(
        F.count(F.when(F.col("point_winner") == 1, 1)).alias("_p1"),
        F.count(F.when(F.col("point_winner") == 2, 1)).alias("_p2"),
        F.max(by_number).alias("last_point"),
        F.max_by("point_winner", by_number).alias("last_winner"),
    )
    games = games.withColumns({"p1_game_won": _won("_p1", "_p2"), "p2_game_won": _won("_p2", "_p1")})
    in_set = _before(SET, "game_no")
    games = games.withColumns(
        {
            "p1_games_won": _total_before("p1_game_won", in_set),
            "p2_games_won": _total_before("p2_game_won", in_set),
        }
    )
    sets = games.groupBy(*SET).agg(
        F.sum("p1_game_won").alias("_g1"),
        F.sum("p2_game_won").alias("_g2"),
        # Ordering by both columns keeps this branch identical to the game rows, so that
        # Spark reuses their exchange instead of aggregating the points again.
        F.max_by("last_winner", F.struct("game_no", "last_point")).alias("_set_last"),
    )
    in_match = _before(["match_id"], "set_no")
    whole = Window.partitionBy("match_id").orderBy("set_no").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sets = sets.select(
        *SET,
        _total_before((F.col("_g1") > F.col("_g2")).cast("int"), in_match).alias("p1_sets_won"),
        _total_before((F.col("_g2") > F.col("_g1")).cast("int"), in_match).alias("p2_sets_won"),
        F.last("_set_last").over(whole).alias("match_winner_code"),
    )
    return games.join(sets, SET).drop("_p1", "_p2")


def rebuild_state(points, tiebreak_at=6, match_columns=None, per_game=None, max_rows=MAX_GROUP_ROWS):
    """Add running points, games, sets, tiebreak flag, game and match winner to a point log.

    ``match_columns`` (one row per match_id) and whatever ``per_game`` adds to the game
    rows ride along to the points, which saves further exchanges of the points.
    """
    groups = _running_points(points, max_rows)
    games = game_table(points)
    if match_columns is not None:
        games = games.join(match_columns, "match_id", "left")
    if per_game is not None:
        games = per_game(games)
    level = F.lit(tiebreak_at)
    tiebreak = (F.col("p1_games_won") == level) & (F.col("p2_games_won") == level)
    last_point = F.col("point_number") == F.col("last_point")
    return (
        groups.join_groups(games)
        .rows()
        .withColumn("is_tiebreak", tiebreak)
        .withColumn(
            "game_win",
            F.when(F.col("is_tiebreak"), F.col("last_winner")).when(last_point, F.col("point_winner")),
        )
        .drop("last_point", "last_winner")
    )


def set_columns(state, sets=5):
    """Wide set1_p1 .. set5_p2: games in that set up to and including the current game, else 0.0."""
    columns = {}
    for s in range(1, sets + 1):
        for p in ("p1", "p2"):
            games = (F.col(f"{p}_games_won") + F.col(f"{p}_game_won")).cast("double")
            columns[f"set{s}_{p}"] = F.when(F.col("set_no") == s, games).otherwise(0.0)
    return state.withColumns(columns)


def carried_state(points, columns=None, key="match_id", max_rows=MAX_GROUP_ROWS):
    """State the log itself carries, moved to the next point, and sets counted by set starts.

    ``columns`` maps output name to (input name, value for the first point). Where the set
    number rises, the set goes to the winner of the previous point.
    """
    lags = {**(columns or {}), "prev_set_no": ("set_no", None), "prev_point_winner": ("point_winner", None)}
    order = ["point_number"]
    groups = previous_values(ordered_groups(points, [key], "point_number", max_rows), order, lags)
    rises = F.coalesce(F.col("set_no") > F.col("prev_set_no"), F.lit(False))
    credit = {
        f"p{p}_sets_by_start": F.when(rises & (F.col("prev_point_winner") == p), 1).otherwise(0) for p in (1, 2)
    }
    out = running_sums(groups, order, credit, inclusive=True).rows()
    return out.withColumn("new_set_start", rises.cast("int"))


def match_winner_codes(points):
    """Winner code of each match: who won the last point of its last game.

    Two combining aggregates; the first, over the points, is hash-based.
    """
    games = points.groupBy(*GAME).agg(F.max_by("point_winner", "point_number").alias("_last"))
    return games.groupBy("match_id").agg(
        F.max_by("_last", F.struct("set_no", "game_no")).alias("match_winner_code")
    )


def with_match_winner(points, matches=None):
    """Attach the match winner's name; a winner recorded in ``matches`` goes first."""
    codes = match_winner_codes(points)
    names = F.when(F.col("match_winner_code") == 1, F.col("player1")).when(
        F.col("match_winner_code") == 2, F.col("player2")
    )
    out = points.drop("match_winner").join(codes, "match_id", "left")
    if matches is None:
        return out.withColumn("match_winner", names).drop("match_winner_code")
    known = matches.select("match_id", F.col("winner").alias("_recorded"))
    recorded = F.when(F.trim("_recorded") != "", F.col("_recorded"))
    return (
        out.join(known, "match_id", "left")
        .withColumn("match_winner", F.coalesce(recorded, names))
        .drop("match_winner_code", "_recorded")
    )


def last_rows(points, keys, order):
    """The row of each group with the largest ``order``, a column of integers; whole rows are fetched last.

    A hash aggregate finds the largest number of each group, and the rows join it by their keys; rows
    without a number come before all others. Of rows that tie one stays. Null keys are groups too.
    """
    largest = points.groupBy(*keys).agg(F.max(order).alias("_largest"))
    met = join_on(points, largest, keys, "inner").filter(F.col(order).eqNullSafe(F.col("_largest"))).drop("_largest")
    once = Window.partitionBy(*keys).orderBy(order)
    return met.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1").drop("_copy")
