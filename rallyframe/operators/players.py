"""Player roles, serve and return rates, tours and the player dimension."""

from pyspark.sql import functions as F

from rallyframe.constants import DEFAULT_RETURN_PCT, DEFAULT_SERVE_PCT
from rallyframe.functions.cleaning import fill_defaults
from rallyframe.functions.ids import tour as tour_of
from rallyframe.functions.names import canonical_names
from rallyframe.functions.scores import by_code


def with_roles(df, one="player1", two="player2", suffix="name", winner="point_winner", server="point_server"):
    """Server, returner and point winner resolved from the 1/2 codes (null for other codes)."""
    return df.withColumns(
        {
            f"server_{suffix}": by_code(server, one, two),
            f"returner_{suffix}": by_code(server, two, one),
            f"point_winner_{suffix}": by_code(winner, one, two),
        }
    )


def with_serve_outcome(df, winner="point_winner", server="point_server"):
    """Whether the server won the point, and the complement for the returner."""
    won = F.col(server) == F.col(winner)
    return df.withColumns({"server_point_win": won, "server_win": won, "returner_win": ~won})


def _role_stats(df, player, win, prefix):
    won, total = f"{prefix}_points_won", f"{prefix}_points_total"
    return (
        df.groupBy(F.col(player).alias("player"))
        .agg(F.sum(F.col(win).cast("bigint")).alias(won), F.count(F.lit(1)).alias(total))
        .withColumn(f"{prefix}_point_win_pct", F.try_divide(won, total))
    )


def serve_stats(df, player="server_name", win="server_win"):
    return _role_stats(df, player, win, "serve")


def return_stats(df, player="returner_name", win="returner_win"):
    return _role_stats(df, player, win, "return")


def combine_stats(serve, returned):
    """Serve and return stats side by side, keeping players seen in one role only."""
    return serve.join(returned, "player", "full_outer")


def player_rates(df, server="server_name", returner="returner_name"):
    """Serve and return rate per player from one scan, with defaults for a missing role."""
    served = F.col(server), F.lit(True), F.col("server_win")
    returned = F.col(returner), F.lit(False), F.col("returner_win")
    roles = [
        F.struct(player.alias("player"), serving.alias("serving"), won.cast("double").alias("won"))
        for player, serving, won in (served, returned)
    ]
    rates = (
        df.select(F.explode(F.array(*roles)).alias("r"))
        .select("r.*")
        .filter(F.col("player").isNotNull())
        .groupBy("player")
        .agg(
            F.avg(F.when(F.col("serving"), F.col("won"))).alias("serve_point_win_pct"),
            F.avg(F.when(~F.col("serving"), F.col("won"))).alias("return_point_win_pct"),
        )
    )
    return fill_defaults(rates)


def attach_rates(df, rates, roles=None):
    """Join rates once per player column; unmatched players get the default rates.

    Meant for match-level frames. Rates are constant inside a match, so points take them
    from their match rather than being shuffled by player.
    """
    roles = roles or {"player1": "player1", "player2": "player2"}
    for column, prefix in roles.items():
        side = rates.select(
            F.col("player").alias(column),
            F.col("serve_point_win_pct").alias(f"{prefix}_serve_point_win_pct"),
            F.col("return_point_win_pct").alias(f"{prefix}_return_point_win_pct"),
        )
        df = df.join(side, column, "left").na.fill(
            {
                f"{prefix}_serve_point_win_pct": DEFAULT_SERVE_PCT,
                f"{prefix}_return_point_win_pct": DEFAULT_RETURN_PCT,
            }
        )
    return df


def classify_tours(df, player="player", tour="tour"):
    """``ATP`` or ``WTA`` when that is a player's only tour, ``Both`` otherwise, null without any."""
    seen = F.array_sort(F.collect_set(tour))
    only = F.get(F.col("tours"), F.lit(0))
    return (
        df.groupBy(player)
        .agg(seen.alias("tours"))
        .withColumn(
            "tour",
            F.when(F.size("tours") == 0, None)
            .when((F.size("tours") == 1) & only.isin("ATP", "WTA"), only)
            .otherwise("Both"),
        )
    )


def both_players(df, columns=("player1", "player2"), keep=(), name="player"):
    """Distinct players over both roles (with ``keep`` columns), from a single scan."""
    role = F.explode(F.array(*columns)).alias(name)
    return df.select(role, *keep).distinct()


def player_dimension(log, name_map=None):
    """Player, tour, mean rates over distinct rows, last year and Active/Inactive status.

    The averages run over distinct (player, tour, rates, year) rows, not over points; names
    are looked up on distinct match facts.
    """
    facts = [f"{p}{c}" for p in ("player1", "player2") for c in ("", "_serve_point_win_pct", "_return_point_win_pct")]
    log = log.select(tour_of().alias("tour"), "year", *facts).distinct()
    if name_map is not None:
        log = canonical_names(log, name_map, ["player1", "player2"])
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.col(p).alias("player"),
                    F.col(f"{p}_serve_point_win_pct").alias("serve_pct"),
                    F.col(f"{p}_return_point_win_pct").alias("return_pct"),
                )
                for p in ("player1", "player2")
            ]
        )
    )
    rows = log.select("tour", "year", sides.alias("s")).select("s.*", "tour", "year").distinct()
    newest = log.agg(F.max("year").alias("y")).scalar()
    status = F.when(F.col("last_year") == newest, "Active").otherwise("Inactive")
    return (
        rows.groupBy("player")
        .agg(
            F.max("tour").alias("tour"),
            F.avg("serve_pct").alias("serve_pct"),
            F.avg("return_pct").alias("return_pct"),
            F.max("year").alias("last_year"),
        )
        .withColumn("player_status", status)
    )
