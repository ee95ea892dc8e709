"""Player aggregates kept as partial sums per year and merged on read.

A year whose points change is computed again and replaces its own sums; points of other years are
not read. Rates, tours and status of players come from the sums, which are few.
"""

from pyspark.sql import functions as F

from rallyframe.functions.cleaning import fill_defaults
from rallyframe.operators.players import classify_tours
from rallyframe.sources import builds


def year_sums(log, server="server_name", returner="returner_name", win="server_win"):
    """(year, tour, player, serving, won, total) from one scan; unknown players have no sums."""
    roles = [
        F.struct(F.col(player).alias("player"), F.lit(serving).alias("serving"), won.cast("int").alias("won"))
        for player, serving, won in ((server, True, F.col(win)), (returner, False, ~F.col(win)))
    ]
    return (
        log.select("year", "tour", F.explode(F.array(*roles)).alias("r")).select("year", "tour", "r.*")
        .filter("player IS NOT NULL").groupBy("year", "tour", "player", "serving")
        .agg(F.sum("won").alias("won"), F.count("won").alias("total"))
    )


def build_year_sums(log, path, only=None):
    """Store the sums of a log year by year; ``only`` replaces those of the listed years."""
    return builds.build(log, path, "year", None, year_sums, only)


def players_of(sums):
    """Tour, points, rates (defaults for a missing role), last year and status of every player of the sums.

    Active are the players of the newest year.
    """
    def part(column, serving):
        return F.sum(F.when(F.col("serving") == serving, F.col(column)))

    merged = sums.groupBy("player").agg(
        F.sum("total").alias("role_points"), F.max("year").alias("last_year"),
        F.try_divide(part("won", True), part("total", True)).alias("serve_point_win_pct"),
        F.try_divide(part("won", False), part("total", False)).alias("return_point_win_pct"),
    )
    newest = sums.agg(F.max("year")).scalar()
    status = F.when(F.col("last_year") == newest, "Active").otherwise("Inactive")
    tours = classify_tours(sums.select("player", "tour").distinct()).select("player", "tour")
    return fill_defaults(merged).withColumn("player_status", status).join(tours, "player")
