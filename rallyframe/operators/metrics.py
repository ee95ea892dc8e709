"""Player and match metrics over a scored point log.

Most start from ``per_player``: each point once per player, from a single scan. Every
aggregate after it combines before the shuffle, so a player with a large share of the
points is no heavier than any other. Players masked out (null) are left aside.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.constants import SCORE_POINTS
from rallyframe.functions.ids import id_parts
from rallyframe.functions.packing import packed, packed_number
from rallyframe.functions.scores import by_code, winner_probability
from rallyframe.operators.filters import finished, tour_code
from rallyframe.operators.ordered import average_percent_rank, with_row_ids
from rallyframe.session import materialise


def per_player(df, *keep):
    """Two rows per point: player, own probability change, own probability before, winner flag."""
    fields = []
    for number in (1, 2):
        before = F.col("p1_win_prob_before")
        values = {
            "player": F.col(f"player{number}"),
            "wp_delta": F.col(f"p{number}_wp_delta"),
            "wp_before": before if number == 1 else 1 - before,
        }
        if "match_winner" in df.columns:
            values["is_winner"] = F.col("match_winner") == F.col(f"player{number}")
        fields.append(F.struct(*[v.alias(k) for k, v in values.items()]))
    sides = F.explode(F.array(*fields)).alias("_side")
    return df.select(*keep, sides).select(*keep, "_side.*").filter(F.col("player").isNotNull())


def player_deltas(df):
    """Sum, mean and count of probability changes, overall and under pressure, and the usual tour."""
    pressure = F.when(F.col("is_high_pressure"), F.col("wp_delta"))
    # Points are hash-aggregated by player and tour; the usual tour is picked from those few rows.
    by_tour = (
        per_player(df, "is_high_pressure", "tour")
        .groupBy("player", "tour")
        .agg(
            F.sum("wp_delta").alias("d"), F.count("wp_delta").alias("n"), F.count(F.lit(1)).alias("rows"),
            F.sum(pressure).alias("dh"), F.count(pressure).alias("nh"),
        )
    )
    often = F.when(F.col("tour").isNotNull(), F.struct((-F.col("rows")).alias("rows"), "tour"))
    nothing = F.lit(0.0)
    return (
        by_tour.groupBy("player")
        .agg(
            F.sum("d").alias("d"), F.sum("n").alias("total_points"), F.min(often).alias("often"),
            F.sum("dh").alias("dh"), F.sum("nh").alias("hp_points"),
        )
        .select(
            "player", F.coalesce("d", nothing).alias("total_delta"),
            F.coalesce(F.try_divide("d", "total_points"), nothing).alias("avg_delta"), "total_points",
            F.coalesce("often.tour", F.lit("Unknown")).alias("tour"), F.coalesce("dh", nothing).alias("total_delta_hp"),
            F.coalesce(F.try_divide("dh", "hp_points"), nothing).alias("avg_delta_hp"), "hp_points",
        )
    )


def match_consistency(df):
    """Spread of a player's probability changes in a match (population) and its inverse."""
    spread = F.col("wp_delta_std")
    return (
        per_player(df, "match_id")
        .groupBy("match_id", "player")
        .agg(F.stddev_pop("wp_delta").alias("wp_delta_std"))
        .withColumns(
            {
                "consistency_score": F.when(spread > 0, F.lit(1.0) / spread),
                "tourney_code": id_parts("match_id")["tourney_code"],
            }
        )
    )


def pressure_rankings(df, min_pressure_points=200):
    """Win rate overall and under pressure per role, then the plain mean over a player's roles."""
    roles = F.explode(
        F.array(
            F.struct(F.lit("serve").alias("role"), F.col("server_name").alias("player"), F.col("server_win").alias("won")),
            F.struct(F.lit("return").alias("role"), F.col("returner_name").alias("player"), F.col("returner_win").alias("won")),
        )
    )
    won = F.col("won").cast("double")
    pressure = F.when(F.col("is_high_pressure"), won)
    # Points are hash-aggregated by player, role and tour; the tour shown is picked from those few rows.
    per_role = (
        df.select("is_high_pressure", "tour", roles.alias("r"))
        .select("is_high_pressure", "tour", "r.*")
        .filter(F.col("player").isNotNull())
        .groupBy("player", "role", "tour")
        .agg(
            F.sum(won).alias("w"), F.count(won).alias("n"), F.sum(pressure).alias("wh"), F.count(pressure).alias("nh"),
            F.count(F.lit(1)).alias("points"),
        )
        .groupBy("player", "role")
        .agg(
            F.try_divide(F.sum("w"), F.sum("n")).alias("win_all"),
            F.try_divide(F.sum("wh"), F.sum("nh")).alias("win_hp"),
            F.sum("points").alias("points"),
            F.sum("nh").alias("hp_points"),
            F.min("tour").alias("tour"),
        )
        .filter((F.col("hp_points") > 0) & (F.col("hp_points") >= min_pressure_points))
    )
    return per_role.groupBy("player").agg(
        F.avg("win_all").alias("win_pct_all"),
        F.avg("win_hp").alias("win_pct_hp"),
        F.sum("points").alias("role_points"),
        F.sum("hp_points").alias("high_pressure_points"),
        F.avg(F.col("win_hp") - F.col("win_all")).alias("clutch_delta"),
        F.min("tour").alias("tour"),
    )


def pressure_share(df, min_pressure_points=0):
    """Points, high-pressure points and their share per player."""
    players = F.explode(F.array("player1", "player2")).alias("player")
    return (
        df.select("is_high_pressure", players)
        .filter(F.col("player").isNotNull())
        .groupBy("player")
        .agg(
            F.count(F.lit(1)).alias("total_points"),
            F.count_if("is_high_pressure").alias("high_pressure_points"),
        )
        .withColumn("high_pressure_pct", F.try_divide("high_pressure_points", "total_points"))
        .filter(F.col("high_pressure_points") >= min_pressure_points)
    )


def pressure_report(df, min_points=0, min_ranking_points=200, min_share_points=0):
    """Rankings joined with pressure shares and player-1 totals, best clutch delta first."""
    shares = pressure_share(df, min_share_points).select("player", "high_pressure_pct")
    totals = df.groupBy(F.col("player1").alias("player")).agg(F.count(F.lit(1)).alias("total_points"))
    return (
        pressure_rankings(df, min_ranking_points)
        .join(shares, "player", "left")
        .join(totals, "player", "left")
        .filter(F.col("total_points") >= min_points)
        .orderBy(F.col("clutch_delta").desc_nulls_last(), "player")
    )


def ranked(df, *order, name="place"):
    """A report with its place in ``order`` from 1, sorted by it; the places are counted over range partitions."""
    columns = df.columns
    return with_row_ids(df, list(order), name).select(*columns, F.col(name).cast("int").alias(name)).orderBy(name)


def pressure_extremes(df, metric, n=10):
    """Head and tail of a pressure table: the n players with the most and the least of ``metric``.

    ``side`` tells them apart and ``place`` counts from 1 on either side; ties go by player.
    """
    sides = []
    for side, ascending in (("most", False), ("least", True)):
        first = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
        short = top_rows(df.filter(F.col(metric).isNotNull()), metric, ["player"], n, ascending)
        sides.append(ranked(short, first, "player").withColumn("side", F.lit(side)))
    return sides[0].unionByName(sides[1])


def unlikely_results(df, low=0.10, high=0.90, sets_needed=None):
    """Matches won from at most ``low``, and lost from at least ``high``, per player.

    Finished matches are recognised in the same aggregate that looks for the moments.
    """
    known = df.filter(F.col("match_winner").isNotNull())
    known = known.withColumn("top_sets", F.greatest("p1_sets_won", "p2_sets_won"))
    sides = per_player(known.withColumn("tour_code", tour_code(sets_needed=sets_needed)), "match_id", "tour_code", "top_sets")
    unlikely_win = F.col("is_winner") & (F.col("wp_before") <= low)
    unlikely_loss = ~F.col("is_winner") & (F.col("wp_before") >= high)
    per_match = (
        sides.groupBy("player", "match_id")
        .agg(
            F.max(unlikely_win.cast("int")).alias("win"),
            F.max(unlikely_loss.cast("int")).alias("loss"),
            F.max("top_sets").alias("top_sets"),
            F.min("tour_code").alias("tour_code"),
        )
        .filter(~finished("top_sets", "tour_code", sets_needed))
    )
    return (
        per_match.groupBy("player")
        .agg(F.sum("win").alias("unlikely_wins"), F.sum("loss").alias("unlikely_losses"))
        .filter((F.col("unlikely_wins") > 0) | (F.col("unlikely_losses") > 0))
    )


def extreme_points(df, low=0.10, high=0.90):
    """Per player and match, the least likely winning and the most likely losing moment."""
    sides = per_player(df.filter(F.col("match_winner").isNotNull()), "match_id", "point_number")
    win = F.when(F.col("is_winner") & (F.col("wp_before") <= low), F.col("wp_before"))
    loss = F.when(~F.col("is_winner") & (F.col("wp_before") >= high), F.col("wp_before"))
    # The least of (value, point) as one fixed-width key each; the most likely loss by its negative value.
    number = F.col("point_number")
    return (
        sides.groupBy("player", "match_id")
        .agg(
            F.min(win).alias("win_prob"), F.min(packed(win, number)).alias("_w"),
            F.max(loss).alias("loss_prob"), F.min(packed(-loss, number)).alias("_l"),
        )
        .filter(F.col("win_prob").isNotNull() | F.col("loss_prob").isNotNull())
        .select(
            "player", "match_id", "win_prob", packed_number(F.col("_w")).alias("win_point"), "loss_prob",
            packed_number(F.col("_l")).alias("loss_point"),
        )
    )


def score_summary(df):
    """Importance, server win rate and points per score; only standard tokens on both sides count."""
    tokens = list(SCORE_POINTS)
    sides = F.split("score", "-")
    standard = F.get(sides, F.lit(0)).isin(*tokens) & F.get(sides, F.lit(1)).isin(*tokens)
    served = (F.col("point_winner") == F.col("point_server")).cast("double")
    return (
        df.filter(standard)
        .groupBy("score")
        .agg(
            F.avg("importance").alias("average_importance"),
            F.avg(served).alias("win_rate"),
            F.count("importance").alias("points"),
        )
    )


def clutch_by_match(df):
    """Probability change times importance times stake, summed per match and player."""
    clutch = F.col("wp_delta") * F.col("importance") * F.col("points_stake")
    pressure = ["is_high_pressure"] if "is_high_pressure" in df.columns else []
    extra = [F.count_if("is_high_pressure").alias("high_pressure_points")] if pressure else []
    return (
        per_player(df, "match_id", "importance", "points_stake", *pressure)
        .groupBy("match_id", "player")
        .agg(F.sum(clutch).alias("total_clutch_score"), *extra)
    )


def clutch_by_player(per_match):
    """Clutch total and mean per match; pressure points too when they were counted."""
    extra = (
        [F.sum("high_pressure_points").alias("high_pressure_points")]
        if "high_pressure_points" in per_match.columns
        else []
    )
    return per_match.groupBy("player").agg(
        F.sum("total_clutch_score").alias("total_clutch_score"),
        *extra,
        F.avg("total_clutch_score").alias("avg_clutch_score"),
    )


def expected_points_added(per_match):
    """Clutch total per player."""
    return per_match.groupBy("player").agg(F.sum("total_clutch_score").alias("expected_points_added"))


def _consistency_columns():
    return [
        F.count("wp_delta").alias("total_points"),
        F.avg("wp_before").alias("avg_wp"),
        F.stddev_samp("wp_delta").alias("wp_delta_std"),
    ]


def _with_index(players, min_points):
    spread, w = F.col("wp_delta_std"), F.col("weighted_consistency")
    weighted = players.withColumn("consistency", F.when(spread > 0, F.col("avg_wp") / spread)).withColumn(
        "weighted_consistency", F.col("consistency") * F.sqrt("total_points")
    )
    # Written once: the scale must come from the very numbers it is applied to, and the
    # points need not be scanned a second time for it.
    stored = materialise(weighted)
    span = stored.agg(F.struct(F.min(w).alias("lo"), F.max(w).alias("hi")).alias("s")).scalar()
    index = F.try_divide(w - span["lo"], span["hi"] - span["lo"])
    return stored.withColumn("consistency_index", index).filter(F.col("total_points") >= min_points)


def consistency(df, min_points=0):
    """Mean probability over its spread, weighted by the root of the points, scaled to 0..1.

    The scale spans all players; ``min_points`` only removes rows afterwards.
    """
    return _with_index(per_player(df).groupBy("player").agg(*_consistency_columns()), min_points)


def consistency_and_clutch(df, min_points=0):
    """Consistency index next to expected points added and its percentile among the kept players.

    Both come from one aggregate: points added are the same clutch sums per player.
    """
    clutch = F.col("wp_delta") * F.col("importance") * F.col("points_stake")
    players = (
        per_player(df, "importance", "points_stake")
        .groupBy("player")
        .agg(*_consistency_columns(), F.sum(clutch).alias("expected_points_added"))
    )
    return average_percent_rank(_with_index(players, min_points), "expected_points_added", "clutch_percentile")


def swings(df):
    """Signed and absolute swing between the two outcomes, and the point winner's name."""
    swing = F.col("p1_win_prob_if_p1_wins") - F.col("p1_win_prob_if_p2_wins")
    return df.withColumns(
        {
            "prob_swing": swing,
            "abs_swing": F.abs(swing),
            "swing_winner": by_code("point_winner", "player1", "player2"),
        }
    )


def top_rows(df, metric, ties, n=10, ascending=False):
    """The n rows with the largest (or smallest) metric; ``ties`` makes the choice unique."""
    first = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    return df.orderBy(first, *ties).limit(n)


def top_swings(df, n=10):
    """The n points with the largest absolute swing."""
    return top_rows(swings(df), "abs_swing", ["match_id", "point_number"], n)


def swing_scenarios(top):
    """Two rows per top point, one per outcome, with labels and Actual/Predicted tags.

    ``top`` is the short result of ``top_swings``; the position label counts from 0.
    """
    place = F.row_number().over(Window.orderBy(F.desc("abs_swing"), "match_id", "point_number")) - 1
    sets, games = (
        F.concat_ws("-", *[F.col(f"p{p}_{level}_won").cast("string") for p in (1, 2)]) for level in ("sets", "games")
    )
    outcomes = ["p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins"]
    labelled = top.withColumns(
        {
            "point_label": place.cast("string"),
            "prob_min": F.least(*outcomes),
            "prob_max": F.greatest(*outcomes),
            "match_score": F.concat_ws(", ", sets, games),
            "players": F.concat_ws(" vs ", "player1", "player2"),
            "year_tournament": F.concat_ws(" - ", F.col("year").cast("string"), "tournament_name"),
        }
    ).withColumn("prob_delta", F.col("prob_max") - F.col("prob_min"))
    ids = [
        "point_label", "prob_swing", "prob_min", "prob_max", "prob_delta", "player1", "player2", "players",
        "year_tournament", "match_score", "swing_winner",
    ]
    long = labelled.unpivot(ids, outcomes, "scenario", "win_probability")
    own = (F.col("scenario") == outcomes[0]) & (F.col("swing_winner") == F.col("player1"))
    other = (F.col("scenario") == outcomes[1]) & (F.col("swing_winner") == F.col("player2"))
    return long.withColumns(
        {
            "win_probability_pct": F.col("win_probability") * 100,
            "point_outcome": F.when(own | other, "Actual").otherwise("Predicted"),
        }
    )


#: Up to so many rows are sent to all tasks when whole rows are fetched for them.
FETCHED = 10_000


def top_upsets(df, n=10, sets_needed=None):
    """The winner's lowest point of each unfinished match, and the n lowest of all.

    One hash aggregate per match keeps the least probability, the first point that has it and the sets
    reached; the n rows that are shown are fetched from ``df`` afterwards, by a second scan, so ``df`` should be
    a stored log. If a match has that point twice, one of the two rows is shown.
    """
    known = df.filter(F.col("match_winner").isNotNull()).withColumn("winner_prob_before", winner_probability())
    lowest = (
        known.groupBy("match_id")
        .agg(
            F.min("winner_prob_before").alias("winner_prob_before"),
            F.min(packed(F.col("winner_prob_before"), F.col("point_number"))).alias("_key"),
            F.max(F.greatest("p1_sets_won", "p2_sets_won")).alias("_top"),
            F.min(tour_code(sets_needed=sets_needed)).alias("_tour"),
        )
        .filter(~finished("_top", "_tour", sets_needed))
    )
    shown = top_rows(lowest, "winner_prob_before", ["match_id"], n, ascending=True).select(
        F.col("match_id").alias("_match"), F.col("winner_prob_before").alias("_p"), packed_number(F.col("_key")).alias("_point")
    )
    same = (
        (F.col("match_id") == F.col("_match"))
        & F.col("winner_prob_before").eqNullSafe(F.col("_p"))
        & (F.col("point_number").cast("bigint").eqNullSafe(F.col("_point")) | F.col("_p").isNull())
    )
    rows = known.join(F.broadcast(shown) if n <= FETCHED else shown, same).drop("_match", "_p", "_point")
    once = Window.partitionBy("match_id").orderBy("point_number")
    rest = [c for c in df.columns if c not in ("match_id", "tour")]
    picked = (
        rows.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1")
        .select("match_id", "tour", "winner_prob_before", *rest).withColumns(id_parts("match_id"))
    )
    return top_rows(picked, "winner_prob_before", ["match_id"], n, ascending=True)
