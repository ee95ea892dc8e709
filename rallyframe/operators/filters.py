"""Filters of the serving queries: predicates, player status, thresholds and match gates."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from rallyframe.constants import SETS_NEEDED
from rallyframe.operators.ordered import exact_quantile, join_on
from rallyframe.operators.sketches import brackets, quantile_near
from rallyframe.operators.players import both_players

ALL = "All"


@dataclass(frozen=True)
class Filters:
    """Selection of a serving query; ``All`` (or no years) leaves a part unrestricted."""

    years: tuple = ()
    tour: str = ALL
    tournament: str = ALL
    status: str = ALL

    def match_predicate(self, year="year", tour="tour", tournament="tournament_name"):
        """Condition on match columns only, so it can reach the scan; None when unrestricted."""
        parts = []
        if self.years:
            parts.append(F.col(year).isin(*self.years))
        if self.tour != ALL:
            parts.append(F.col(tour) == self.tour)
        if self.tournament != ALL:
            parts.append(F.col(tournament) == self.tournament)
        condition = None
        for part in parts:
            condition = part if condition is None else condition & part
        return condition

    def apply(self, df, **columns):
        condition = self.match_predicate(**columns)
        return df if condition is None else df.filter(condition)

    def by_status(self, df, one="status1", two="status2"):
        """Keep rows where either player has the wanted status."""
        if self.status == ALL:
            return df
        return df.filter((F.col(one) == self.status) | (F.col(two) == self.status))


def active_players(df, players=("player1", "player2"), year="year"):
    """Distinct players seen in the newest year of ``df``."""
    newest = df.agg(F.max(year).alias("y")).scalar()
    return both_players(df.filter(F.col(year) == newest), players).filter(F.col("player").isNotNull())


def inactive_players(df, players=("player1", "player2"), year="year"):
    """Players of ``df`` that are not seen in its newest year."""
    everyone = both_players(df, players).filter(F.col("player").isNotNull())
    return everyone.join(active_players(df, players, year), "player", "left_anti")


def flag_matches(df, players, lookups):
    """Add flags looked up by player, worked out on match rows.

    Players are constant in a match, so the lookups join the distinct (match, players) rows;
    points take the flags from there, null-safe, and are never dealt out by player.
    ``lookups`` maps an output column to (player column, frame with a ``player`` column).
    """
    keys = [*(["match_id"] if "match_id" in df.columns else []), *players]
    matches = df.select(*keys).distinct()
    for name, (column, found) in lookups.items():
        seen = found.select(F.col("player").alias(column), F.lit(True).alias(name))
        matches = matches.join(seen, column, "left")
    return join_on(df, matches, keys)


def _active_flags(df, players, year):
    active = active_players(df, players, year)
    return flag_matches(df, players, {f"_active_{c}": (c, active) for c in players})


def mask_by_status(df, status, players=("player1", "player2"), year="year", suffix=""):
    """Null out players without the wanted status; ``suffix`` writes to new columns instead."""
    flagged = df if status == ALL else _active_flags(df, players, year)
    columns = {}
    for column in players:
        seen = F.col(f"_active_{column}").isNotNull() if status != ALL else None
        kept = F.col(column)
        if status == "Active":
            kept = F.when(seen, kept)
        elif status == "Inactive":
            kept = F.when(~seen, kept)
        columns[column + suffix] = kept
    return flagged.withColumns(columns).drop(*[f"_active_{c}" for c in players])


def keep_by_activity(df, status, players=("player1", "player2"), year="year"):
    """Rows where either player is in (Active) or not in (Inactive) the active set.

    The flag join keeps the NOT IN meaning without its null trap: an unknown (null)
    player is neither in nor out.
    """
    if status == ALL:
        return df
    flagged = _active_flags(df, players, year)
    hits = []
    for c in players:
        seen = F.col(f"_active_{c}").isNotNull()
        hits.append(seen if status == "Active" else ~seen & F.col(c).isNotNull())
    return flagged.filter(hits[0] | hits[1]).drop(*[f"_active_{c}" for c in players])


def point_totals(df, role="both", players=("player1", "player2")):
    """Points per player over both roles, or over the player-1 role only."""
    columns = players if role == "both" else players[:1]
    side = F.explode(F.array(*columns)).alias("player")
    return (
        df.select(side)
        .groupBy("player")
        .agg(F.count(F.lit(1)).alias("total_points"))
        .filter(F.col("player").isNotNull())
    )


def with_min_points(df, minimum, players=("player1", "player2")):
    """Rows where at least one player has ``minimum`` points in ``df``."""
    if not minimum:
        return df
    enough = point_totals(df, players=players).filter(F.col("total_points") >= minimum)
    df = flag_matches(df, players, {f"_enough{i}": (c, enough) for i, c in enumerate(players)})
    return df.filter(F.col("_enough0").isNotNull() | F.col("_enough1").isNotNull()).drop("_enough0", "_enough1")


def with_player1_total(df, minimum=0, player="player1"):
    """Attach each row's player-1 point total and keep totals of at least ``minimum``."""
    totals = df.groupBy(F.col(player).alias("player")).agg(F.count(F.lit(1)).alias("total_points"))
    enough = totals.filter((F.col("total_points") >= minimum) & F.col("player").isNotNull())
    # Players are constant in a match: the totals reach the points along the match rows.
    keys = [*(["match_id"] if "match_id" in df.columns else []), player]
    matches = df.select(*keys).distinct().join(enough.withColumnRenamed("player", player), player)
    return join_on(df, matches, keys, "inner")


def tour_code(tour="tour", sets_needed=None):
    """The tours that have a limit as numbers in the order of their names, others as the next number.

    A number is a fixed-width value, so its least per match is kept by a hash aggregate.
    """
    names = sorted(sets_needed or SETS_NEEDED)
    code = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        code = F.when(F.col(tour) == name, F.lit(i)).otherwise(code)
    return code


def finished(top_sets, code, sets_needed=None):
    """Whether ``top_sets`` (the most sets a side has won) already ends a match of the tour with this code."""
    limits = sets_needed or SETS_NEEDED
    over = F.lit(False)
    for i, name in enumerate(sorted(limits)):
        over = over | ((F.col(code) == i) & (F.col(top_sets) >= limits[name]))
    return F.coalesce(over, F.lit(False))


def valid_matches(df, sets_needed=None):
    """Drop matches in which a side already reached the set count that ends a match of its tour."""
    over = (
        df.groupBy("match_id")
        .agg(F.max(F.greatest("p1_sets_won", "p2_sets_won")).alias("_top"), F.min(tour_code(sets_needed=sets_needed)).alias("_tour"))
        .filter(finished("_top", "_tour", sets_needed))
        .select("match_id")
    )
    return df.join(over, "match_id", "left_anti")


def with_high_pressure(df, percent=25, column="importance", sketches=None):
    """Flag points whose importance is in the top ``percent`` of ``df``; unscored points are not.

    With ``sketches`` of about the same rows the threshold takes one scan of ``df``; it is the same.
    """
    q = 1 - percent / 100
    if sketches is None:
        threshold = exact_quantile(df, column, q)
    else:
        threshold = quantile_near(df, column, q, brackets(sketches, q))
    flag = F.col(column) >= F.lit(threshold) if threshold is not None else F.lit(False)
    return df.withColumn("is_high_pressure", F.coalesce(flag, F.lit(False)))


def default_min_points(tour, years):
    """Minimum points per player: 400 a year for ATP, 200 otherwise."""
    return (400 if tour == "ATP" else 200) * years


def default_min_pressure_points(tour, years):
    """Minimum high-pressure points per player: 50 a year for ATP, 30 otherwise."""
    return (50 if tour == "ATP" else 30) * years


def year_options(matches):
    """The years to choose from, as integers in order."""
    return matches.select(F.col("year").cast("int").alias("year")).filter("year IS NOT NULL").distinct().orderBy("year")


def filter_options(matches, players):
    """All choices of the filters as (option, value) rows; ``year_options`` has the years as numbers."""
    listing = {"tournament": "tournament_name", "tour": "tour", "year": "year"}
    options = F.explode(
        F.array(
            *[
                F.struct(F.lit(k).alias("option"), F.col(c).cast("string").alias("value"))
                for k, c in listing.items()
            ]
        )
    )
    statuses = players.select(F.lit("status").alias("option"), F.col("player_status").alias("value"))
    return matches.select(options.alias("o")).select("o.*").unionByName(statuses).distinct()
