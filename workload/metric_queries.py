"""Queries on players, rates, probabilities and metrics over the event point log."""

from pyspark.sql import functions as F

from rallyframe.constants import GAME
from rallyframe.functions.ids import best_of, round_number, tour, tournament_name
from rallyframe.functions.model import game_win_prob, p1_point_chance, point_win_prob
from rallyframe.functions.scores import (
    match_winner_before,
    probability_deltas,
    score_labels,
    token_points,
    weighted_importance,
    winner_probability,
)
from rallyframe.operators import filters as flt
from rallyframe.operators import metrics as mx
from rallyframe.operators import players as pl
from rallyframe.operators.state import rebuild_state, with_match_winner
from rallyframe.operators.winprob import empirical_win_prob
from rallyframe.plans.build import prepared_log, scored_log
from rallyframe.session import scratch_path
from rallyframe.sources import readers, writers
from workload import bindings as b
from workload.importance_oracle import importance_sql

SCORES = f"WITH {b.SCORES_SQL}"
KEY = [*GAME, "point_number"]
KEY_SQL = "match_id, set_no, game_no, point_number"


def rounded(df, *columns):
    """Columns rounded half away from zero to six digits, by plain arithmetic.

    ``round`` on doubles goes through decimals row by row. Adding zero turns -0.0 into 0.0.
    """
    text = "sign({c}) * floor(abs({c}) * 1000000D + 0.5D) / 1000000D + 0D"
    return df.withColumns({c: F.expr(text.format(c=c)) for c in columns})


def _r(expression, name=None, digits=6):
    return f"round({expression}, {digits}) + 0e0 AS {name or expression}"


# ---- players ------------------------------------------------------------


def serve_return_stats(spark, sf):
    log = b.scores(spark, sf)
    stats = pl.combine_stats(pl.serve_stats(log), pl.return_stats(log))
    return rounded(stats, "serve_point_win_pct", "return_point_win_pct")


_STATS_SQL = """sv AS (SELECT server_name AS player, count(*) FILTER (WHERE server_win) AS serve_points_won, count(*) AS serve_points_total FROM s GROUP BY 1),
rt AS (SELECT returner_name AS player, count(*) FILTER (WHERE NOT server_win) AS return_points_won, count(*) AS return_points_total FROM s GROUP BY 1)"""
SERVE_RETURN_STATS = f"""{SCORES}, {_STATS_SQL}
SELECT coalesce(sv.player, rt.player) AS player, serve_points_won, serve_points_total, {_r('serve_points_won / serve_points_total', 'serve_point_win_pct')},
  return_points_won, return_points_total, {_r('return_points_won / return_points_total', 'return_point_win_pct')}
FROM sv FULL JOIN rt ON sv.player = rt.player"""


def best_servers(spark, sf):
    """Ten players with the best serve win rate."""
    stats = rounded(pl.serve_stats(b.scores(spark, sf)), "serve_point_win_pct")
    return mx.top_rows(stats, "serve_point_win_pct", ["player"])


BEST_SERVERS = f"""{SCORES}, {_STATS_SQL}
SELECT player, serve_points_won, serve_points_total, {_r('serve_points_won / serve_points_total', 'serve_point_win_pct')}
FROM sv ORDER BY 4 DESC, player LIMIT 10"""


def match_rates(spark, sf):
    log = b.scores(spark, sf)
    games = log.select("match_id", "player1", "player2").distinct()
    rated = pl.attach_rates(games, pl.player_rates(log))
    return rounded(rated, *[c for c in rated.columns if c.endswith("pct")])


# One rate row per player with the defaults for a missing role.
_RATES_SQL = f"""{_STATS_SQL},
rates AS (SELECT coalesce(sv.player, rt.player) AS player, coalesce(serve_points_won / serve_points_total, 62e-2) AS sp,
  coalesce(return_points_won / return_points_total, 38e-2) AS rp FROM sv FULL JOIN rt ON sv.player = rt.player)"""
MATCH_RATES = f"""{SCORES}, {_RATES_SQL},
mm AS (SELECT DISTINCT match_id, player1, player2 FROM s)
SELECT mm.match_id, mm.player1, mm.player2, {_r('coalesce(a.sp, 62e-2)', 'player1_serve_point_win_pct')}, {_r('coalesce(a.rp, 38e-2)', 'player1_return_point_win_pct')},
  {_r('coalesce(c.sp, 62e-2)', 'player2_serve_point_win_pct')}, {_r('coalesce(c.rp, 38e-2)', 'player2_return_point_win_pct')}
FROM mm LEFT JOIN rates a ON a.player = mm.player1 LEFT JOIN rates c ON c.player = mm.player2"""


def _rate_log(spark, sf):
    """Log with per-match rates that vary by row group, as a rate table with history would."""
    return b.scores(spark, sf).withColumns(
        {
            "player1_serve_point_win_pct": F.lit(0.5) + F.col("set_no") / F.lit(64.0),
            "player1_return_point_win_pct": F.lit(0.25) + F.col("set_no") / F.lit(64.0),
            "player2_serve_point_win_pct": F.lit(0.5) + F.col("game_no") / F.lit(64.0),
            "player2_return_point_win_pct": F.lit(0.25) + F.col("game_no") / F.lit(128.0),
        }
    )


def _variant_map(log):
    """Spelling variants of the log's own names: players called o'neil get a canonical form."""
    names = pl.both_players(log, name="variant_name")
    return names.filter(F.col("variant_name").contains("o'neil")).select(
        "variant_name", F.replace("variant_name", F.lit("o'neil"), F.lit("O'Neil")).alias("canonical_name")
    )


_MAPPED = "replace({c}, 'o''neil', 'O''Neil')"


def player_dimension(spark, sf):
    log = _rate_log(spark, sf)
    return rounded(pl.player_dimension(log, _variant_map(log)), "serve_pct", "return_pct")


_DIM_SQL = f"""sides AS (
  SELECT {_MAPPED.format(c='player1')} AS player, tour, 5e-1 + set_no / 64e0 AS serve_pct, 25e-2 + set_no / 64e0 AS return_pct, year FROM s
  UNION SELECT {_MAPPED.format(c='player2')}, tour, 5e-1 + game_no / 64e0, 25e-2 + game_no / 128e0, year FROM s),
dim AS (SELECT player, max(tour) AS tour, {_r('avg(serve_pct)', 'serve_pct')}, {_r('avg(return_pct)', 'return_pct')}, max(year) AS last_year,
  CASE WHEN max(year) = (SELECT max(year) FROM events_log) THEN 'Active' ELSE 'Inactive' END AS player_status FROM sides GROUP BY player)"""
PLAYER_DIMENSION = f"{SCORES}, events_log AS (SELECT year FROM s), {_DIM_SQL} SELECT * FROM dim"


def tour_classify(spark, sf):
    log = b.scores(spark, sf)
    sides = log.select(F.explode(F.array("player1", "player2")).alias("player"), "tour").distinct()
    labels = pl.classify_tours(sides).select("player", F.col("tour").alias("player_tour"))
    return log.select("match_id", F.col("player1").alias("player")).distinct().join(labels, "player", "left")


TOUR_CLASSIFY = f"""{SCORES},
c AS (SELECT player, CASE WHEN count(DISTINCT tour) > 1 THEN 'Both' WHEN max(tour) IN ('ATP', 'WTA') THEN max(tour) ELSE 'Both' END AS player_tour
  FROM (SELECT player1 AS player, tour FROM s UNION SELECT player2, tour FROM s) GROUP BY player)
SELECT DISTINCT s.player1 AS player, s.match_id, c.player_tour FROM s LEFT JOIN c ON c.player = s.player1"""


# ---- status and gates ---------------------------------------------------


def _status_log(spark, sf):
    """Light log with some unknown (null) second players."""
    log = b.points(spark, sf)
    return log.withColumn("player2", F.when(F.col("point_number") % 50 != 0, F.col("player2")))


_STATUS_SQL = f"""WITH {b.POINTS_SQL},
n AS (SELECT match_id, point_number, year, player1, CASE WHEN point_number % 50 <> 0 THEN player2 END AS player2 FROM p),
act AS (SELECT DISTINCT unnest([player1, player2]) AS player FROM n WHERE year = (SELECT max(year) FROM n))"""
_IN = "({c} IN (SELECT player FROM act WHERE player IS NOT NULL))"


def _status_query(status):
    def run(spark, sf):
        kept = flt.keep_by_activity(_status_log(spark, sf), status)
        return kept.select("match_id", "point_number", "player1", "player2")

    return run


def _status_oracle(negate):
    one, two = _IN.format(c="player1"), _IN.format(c="player2")
    if negate:
        one, two = f"NOT {one}", f"NOT {two}"
    return f"{_STATUS_SQL} SELECT match_id, point_number, player1, player2 FROM n WHERE {one} OR {two}"


def inactive_players(spark, sf):
    return flt.inactive_players(_status_log(spark, sf))


INACTIVE_PLAYERS = f"""{_STATUS_SQL}
SELECT DISTINCT player FROM (SELECT unnest([player1, player2]) AS player FROM n)
WHERE player IS NOT NULL AND player NOT IN (SELECT player FROM act WHERE player IS NOT NULL)"""


def mask_status(spark, sf):
    masked = flt.mask_by_status(_status_log(spark, sf), "Active", suffix="_active")
    masked = flt.mask_by_status(masked, "Inactive", suffix="_inactive")
    keep = ["player1_active", "player2_active", "player1_inactive", "player2_inactive"]
    return masked.groupBy(*keep).agg(F.count(F.lit(1)).alias("points"))


MASK_STATUS = f"""{_STATUS_SQL}
SELECT CASE WHEN {_IN.format(c='player1')} THEN player1 END AS player1_active, CASE WHEN {_IN.format(c='player2')} THEN player2 END AS player2_active,
  CASE WHEN NOT {_IN.format(c='player1')} THEN player1 END AS player1_inactive, CASE WHEN NOT {_IN.format(c='player2')} THEN player2 END AS player2_inactive,
  count(*) AS points FROM n GROUP BY 1, 2, 3, 4"""


def min_points_gate(spark, sf):
    gated = flt.with_min_points(b.points(spark, sf), 1200)
    return flt.with_player1_total(gated, 400).groupBy("player1", "player2", "total_points").agg(
        F.count(F.lit(1)).alias("points")
    )


MIN_POINTS_GATE = f"""WITH {b.POINTS_SQL},
tot AS (SELECT player FROM (SELECT player1 AS player, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT player2, count(*) FROM p GROUP BY 1) GROUP BY player HAVING sum(n) >= 1200),
k AS (SELECT * FROM p WHERE player1 IN (SELECT player FROM tot) OR player2 IN (SELECT player FROM tot)),
t AS (SELECT *, count(*) OVER (PARTITION BY player1) AS total_points FROM k)
SELECT player1, player2, total_points, count(*) AS points FROM t WHERE total_points >= 400 GROUP BY 1, 2, 3"""


def player_point_totals(spark, sf):
    return flt.point_totals(b.points(spark, sf)).filter(F.col("total_points") >= 300)


PLAYER_POINT_TOTALS = f"""WITH {b.POINTS_SQL}
SELECT player, CAST(sum(n) AS BIGINT) AS total_points FROM (SELECT player1 AS player, count(*) AS n FROM p GROUP BY 1 UNION ALL SELECT player2, count(*) FROM p GROUP BY 1)
GROUP BY player HAVING sum(n) >= 300"""


# ---- model --------------------------------------------------------------


def point_model_columns(spark, sf):
    log = prepared_log(b.points(spark, sf, "event_type"))
    scored = b.with_stand_in_scores(
        log.withColumns(
            {
                "p1_serve_prob": point_win_prob("player1_serve_point_win_pct", "player2_return_point_win_pct"),
                "p2_serve_prob": point_win_prob("player2_serve_point_win_pct", "player1_return_point_win_pct"),
                "p1_points": token_points("server_token"),
                "p2_points": token_points("returner_token"),
                "unknown_token": token_points("event_type", None),
            }
        )
    )
    x, a, c = "point_chance", "p1_points_pre", "p2_points_pre"
    out = scored.withColumn("point_chance", p1_point_chance()).withColumns(
        {
            "hold_reference": game_win_prob(x, a, c),
            "hold_if_p1": game_win_prob(x, f"{a} + 1", c),
            "hold_if_p2": game_win_prob(x, a, f"{c} + 1"),
            "hold_standard": game_win_prob(x, f"{a} + 1", c, "standard"),
            "match_winner_prob_before": match_winner_before(),
            "winner_prob_before": winner_probability(),
            "p1_wp_delta_else": probability_deltas(other="two")["p1_wp_delta"],
            "weighted_importance": weighted_importance("points_stake"),
        }
    )
    numbers = [
        "p1_serve_prob", "p2_serve_prob", "hold_reference", "hold_if_p1", "hold_if_p2", "hold_standard",
        "match_winner_prob_before", "winner_prob_before", "p1_wp_delta", "p2_wp_delta", "p1_wp_delta_else",
        "weighted_importance",
    ]
    keep = ["match_id", "point_number", "p1_points", "p2_points", "unknown_token", "points_stake", *numbers]
    return rounded(out.select(*keep), *numbers)


def _hold_sql(a, c, rules="reference"):
    """Game chance from (a, c) for chance x, from the negative-binomial form of each start."""
    deuce = "(x * x / (x * x + (1 - x) * (1 - x)))"
    cases = [
        f"WHEN {a} >= 3 AND {c} >= 3 AND {a} = {c} THEN {deuce}",
        f"WHEN {a} >= 3 AND {c} >= 3 AND {a} = {c} + 1 THEN x + (1 - x) * {deuce}",
        f"WHEN {a} >= 3 AND {c} >= 3 AND {c} = {a} + 1 THEN x * {deuce}",
    ]
    if rules == "reference":
        cases += [
            f"WHEN {a} >= 4 AND {a} - {c} = 2 THEN x + (1 - x) * (x + (1 - x) * {deuce})",
            f"WHEN {c} >= 4 AND {c} - {a} = 2 THEN x * x * {deuce}",
        ]
    cases += [f"WHEN {a} >= 4 AND {a} - {c} >= 2 THEN 1e0", f"WHEN {c} >= 4 AND {c} - {a} >= 2 THEN 0e0"]
    # Play at most up to 3-3 by summing over all short continuations of at most six points.
    win = {}
    for i in range(3, -1, -1):
        for j in range(3, -1, -1):
            if i == j == 3:
                win[i, j] = deuce
                continue
            up = "1e0" if i == 3 else win[i + 1, j]
            down = "0e0" if j == 3 else win[i, j + 1]
            win[i, j] = f"(x * {up} + (1 - x) * {down})"
            cases.append(f"WHEN {a} = {i} AND {c} = {j} THEN {win[i, j]}")
    return f"CASE {' '.join(cases)} END"


_MODEL_SQL = f"""{SCORES}, {_RATES_SQL}, {b.state_sql('s')}, {b.LABELS_SQL},
x0 AS (SELECT lb.*, (a.sp + (1 - c.rp)) * 5e-1 AS p1_serve_prob, (c.sp + (1 - a.rp)) * 5e-1 AS p2_serve_prob
  FROM lb JOIN rates a ON a.player = lb.player1 JOIN rates c ON c.player = lb.player2),
x1 AS (SELECT *, CASE WHEN point_server = 1 THEN p1_serve_prob ELSE 1 - p2_serve_prob END AS x, p1_points_pre AS i, p2_points_pre AS j FROM x0)"""
POINT_MODEL_COLUMNS = f"""{_MODEL_SQL}
SELECT match_id, point_number,
  CAST(CASE server_token WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 WHEN 'AD' THEN 4 ELSE 0 END AS INT) AS p1_points,
  CAST(CASE returner_token WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 WHEN 'AD' THEN 4 ELSE 0 END AS INT) AS p2_points,
  CAST(NULL AS INT) AS unknown_token, points_stake, {_r('p1_serve_prob')}, {_r('p2_serve_prob')},
  {_r(_hold_sql('i', 'j'), 'hold_reference')}, {_r(_hold_sql('(i + 1)', 'j'), 'hold_if_p1')}, {_r(_hold_sql('i', '(j + 1)'), 'hold_if_p2')},
  {_r(_hold_sql('(i + 1)', 'j', 'standard'), 'hold_standard')},
  {_r("CASE WHEN match_winner = player1 THEN p1_win_prob_before ELSE p1_win_prob_if_p2_wins END", 'match_winner_prob_before')},
  round(round(CASE WHEN match_winner = player1 THEN p1_win_prob_before ELSE 1 - p1_win_prob_before END, 5), 6) + 0e0 AS winner_prob_before,
  {_r('p1_wp_delta')}, {_r('p2_wp_delta')}, {_r('p1_wp_delta', 'p1_wp_delta_else')}, {_r('importance * points_stake', 'weighted_importance')}
FROM x1"""


def empirical(spark, sf):
    log = rebuild_state(b.points(spark, sf)).withColumn("p1_won_match", F.col("match_winner_code") == 1)
    state = ["p1_sets_won", "p2_sets_won", "p1_games_won", "p2_games_won"]
    return rounded(empirical_win_prob(log, state), "empirical_win_prob")


EMPIRICAL = f"""WITH {b.POINTS_SQL}, {b.state_sql('p')}
SELECT p1_sets_won, p2_sets_won, p1_games_won, p2_games_won, {_r('avg(CASE WHEN match_winner_code = 1 THEN 1e0 ELSE 0e0 END)', 'empirical_win_prob')}, count(*) AS points
FROM st GROUP BY 1, 2, 3, 4"""


def _importance(rules):
    def run(spark, sf):
        scored = scored_log(b.points(spark, sf), rules)
        keep = [
            "p1_win_prob_before", "p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins", "importance", "p1_wp_delta",
            "p2_wp_delta", "match_winner_prob_before",
        ]
        return rounded(scored.select(*KEY, *keep, "error"), *keep)

    return run


# ---- metrics ------------------------------------------------------------


def clutch_by_match(spark, sf):
    return rounded(mx.clutch_by_match(b.scores(spark, sf)), "total_clutch_score")


_FLAT_SQL = """f AS (SELECT match_id, player1 AS player, p1_wp_delta AS d, p1_win_prob_before AS wp, importance, points_stake, tour, point_number, match_id AS mid FROM s
  UNION ALL SELECT match_id, player2, p2_wp_delta, 1 - p1_win_prob_before, importance, points_stake, tour, point_number, match_id FROM s)"""
CLUTCH_BY_MATCH = f"""{SCORES}, {_FLAT_SQL}
SELECT match_id, player, {_r('sum(d * importance * points_stake)', 'total_clutch_score')} FROM f GROUP BY 1, 2"""


def clutch_by_player(spark, sf):
    log = flt.with_high_pressure(b.scores(spark, sf))
    return rounded(mx.clutch_by_player(mx.clutch_by_match(log)), "total_clutch_score", "avg_clutch_score")


_QUANTILE = "(SELECT quantile_cont(importance, 0.75) FROM s)"
CLUTCH_BY_PLAYER = f"""{SCORES}, {_FLAT_SQL},
c AS (SELECT match_id, player, sum(d * importance * points_stake) AS x, count(*) FILTER (WHERE importance >= {_QUANTILE}) AS hp FROM f GROUP BY 1, 2)
SELECT player, {_r('sum(x)', 'total_clutch_score')}, CAST(sum(hp) AS BIGINT) AS high_pressure_points, {_r('avg(x)', 'avg_clutch_score')} FROM c GROUP BY 1"""


def _epa(ascending):
    def run(spark, sf):
        added = rounded(mx.expected_points_added(mx.clutch_by_match(b.scores(spark, sf))), "expected_points_added")
        return mx.top_rows(added, "expected_points_added", ["player"], 10, ascending)

    return run


def _epa_sql(direction):
    return f"""{SCORES}, {_FLAT_SQL}
SELECT player, {_r('sum(d * importance * points_stake)', 'expected_points_added')} FROM f GROUP BY 1 ORDER BY 2 {direction}, 1 LIMIT 10"""


_CONSISTENCY_NUMBERS = ["avg_wp", "wp_delta_std", "consistency", "weighted_consistency", "consistency_index"]


def consistency_index(spark, sf):
    return rounded(mx.consistency(b.scores(spark, sf), 300), *_CONSISTENCY_NUMBERS)


_CONSISTENCY_SQL = f"""{_FLAT_SQL},
c0 AS (SELECT player, count(d) AS total_points, avg(wp) AS avg_wp, stddev_samp(d) AS wp_delta_std FROM f GROUP BY 1),
c1 AS (SELECT *, CASE WHEN wp_delta_std > 0 THEN avg_wp / wp_delta_std END AS consistency FROM c0),
c2 AS (SELECT *, consistency * sqrt(total_points) AS weighted_consistency FROM c1),
c3 AS (SELECT *, (weighted_consistency - min(weighted_consistency) OVER ()) / (max(weighted_consistency) OVER () - min(weighted_consistency) OVER ()) AS consistency_index FROM c2)"""
_CONSISTENCY_PICK = ", ".join(_r(f"c3.{c}", c) for c in _CONSISTENCY_NUMBERS)
CONSISTENCY_INDEX = f"{SCORES}, {_CONSISTENCY_SQL} SELECT player, total_points, {_CONSISTENCY_PICK} FROM c3 WHERE total_points >= 300"


def consistency_and_clutch(spark, sf):
    joined = mx.consistency_and_clutch(b.scores(spark, sf), 300)
    return rounded(joined, *_CONSISTENCY_NUMBERS, "expected_points_added", "clutch_percentile")


CONSISTENCY_AND_CLUTCH = f"""{SCORES}, {_CONSISTENCY_SQL},
epa AS (SELECT player, sum(d * importance * points_stake) AS epa FROM f GROUP BY 1),
j AS (SELECT c3.*, epa FROM c3 JOIN epa USING (player) WHERE total_points >= 300)
SELECT player, total_points, {_CONSISTENCY_PICK.replace('c3.', 'j.')}, {_r('epa', 'expected_points_added')},
  {_r('(rank() OVER (ORDER BY epa) + (count(*) OVER (PARTITION BY epa) - 1) / 2e0) / count(*) OVER ()', 'clutch_percentile')} FROM j"""


def match_consistency(spark, sf):
    return rounded(mx.match_consistency(b.scores(spark, sf)), "wp_delta_std", "consistency_score")


MATCH_CONSISTENCY = f"""{SCORES}, {_FLAT_SQL}
SELECT match_id, player, {_r('stddev_pop(d)', 'wp_delta_std')}, {_r('CASE WHEN stddev_pop(d) > 0 THEN 1 / stddev_pop(d) END', 'consistency_score')},
  split_part(match_id, '-', 2) AS tourney_code FROM f GROUP BY match_id, player"""


def pressure_rankings(spark, sf):
    log = flt.with_high_pressure(b.scores(spark, sf))
    report = mx.pressure_report(
        log, min_points=flt.default_min_points("WTA", 1), min_ranking_points=40,
        min_share_points=flt.default_min_pressure_points("WTA", 1),
    )
    return rounded(report, "win_pct_all", "win_pct_hp", "clutch_delta", "high_pressure_pct")


_HP_SQL = f"hp AS (SELECT *, importance >= {_QUANTILE} AS is_hp FROM s)"
PRESSURE_RANKINGS = f"""{SCORES}, {_HP_SQL},
r AS (SELECT server_name AS player, 'serve' AS role, CASE WHEN server_win THEN 1e0 ELSE 0e0 END AS won, is_hp, tour FROM hp
  UNION ALL SELECT returner_name, 'return', CASE WHEN server_win THEN 0e0 ELSE 1e0 END, is_hp, tour FROM hp),
g AS (SELECT player, role, avg(won) AS a, avg(won) FILTER (WHERE is_hp) AS h, count(*) AS n, count(*) FILTER (WHERE is_hp) AS hn, min(tour) AS tour FROM r GROUP BY 1, 2),
k AS (SELECT player, avg(a) AS a, avg(h) AS h, sum(n) AS n, sum(hn) AS hn, avg(h - a) AS d, min(tour) AS tour FROM g WHERE hn >= 40 GROUP BY 1),
sh AS (SELECT player, sum(CASE WHEN is_hp THEN 1 ELSE 0 END) AS hn, count(*) AS n FROM (SELECT player1 AS player, is_hp FROM hp UNION ALL SELECT player2, is_hp FROM hp) GROUP BY 1),
t AS (SELECT player1 AS player, count(*) AS total_points FROM s GROUP BY 1)
SELECT k.player, {_r('k.a', 'win_pct_all')}, {_r('k.h', 'win_pct_hp')}, CAST(k.n AS BIGINT) AS role_points, CAST(k.hn AS BIGINT) AS high_pressure_points,
  {_r('k.d', 'clutch_delta')}, k.tour, CASE WHEN sh.hn >= 30 THEN round(sh.hn / sh.n, 6) + 0e0 END AS high_pressure_pct, t.total_points
FROM k LEFT JOIN sh ON sh.player = k.player JOIN t ON t.player = k.player WHERE t.total_points >= 200"""


def pressure_share(spark, sf):
    log = flt.with_high_pressure(b.scores(spark, sf), percent=20)
    return rounded(mx.pressure_share(log, 30), "high_pressure_pct")


PRESSURE_SHARE = f"""{SCORES}, hp AS (SELECT *, importance >= (SELECT quantile_cont(importance, 0.8) FROM s) AS is_hp FROM s),
f AS (SELECT player1 AS player, is_hp FROM hp UNION ALL SELECT player2, is_hp FROM hp)
SELECT player, count(*) AS total_points, count(*) FILTER (WHERE is_hp) AS high_pressure_points, {_r('count(*) FILTER (WHERE is_hp) / count(*)', 'high_pressure_pct')}
FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE is_hp) >= 30"""


def player_deltas(spark, sf):
    log = flt.with_high_pressure(b.scores(spark, sf))
    return rounded(mx.player_deltas(log), "total_delta", "avg_delta", "total_delta_hp", "avg_delta_hp")


PLAYER_DELTAS = f"""{SCORES}, {_FLAT_SQL},
f2 AS (SELECT *, importance >= {_QUANTILE} AS is_hp FROM f),
md AS (SELECT player, tour, row_number() OVER (PARTITION BY player ORDER BY count(*) DESC, tour) AS rn FROM f2 GROUP BY player, tour)
SELECT f2.player, {_r('sum(d)', 'total_delta')}, {_r('avg(d)', 'avg_delta')}, count(d) AS total_points, min(md.tour) AS tour,
  {_r('coalesce(sum(d) FILTER (WHERE is_hp), 0)', 'total_delta_hp')}, {_r('coalesce(avg(d) FILTER (WHERE is_hp), 0)', 'avg_delta_hp')}, count(d) FILTER (WHERE is_hp) AS hp_points
FROM f2 JOIN md ON md.player = f2.player AND md.rn = 1 GROUP BY f2.player"""


_LIMITS = {"ATP": 3, "WTA": 3}


def _results_log(spark, sf):
    """Stand-in scores plus state and match winner."""
    log = rebuild_state(b.scores(spark, sf)).withColumns(score_labels())
    winner = F.when(F.col("match_winner_code") == 1, F.col("player1")).otherwise(F.col("player2"))
    return log.withColumn("match_winner", winner)


def _stored_results(spark, sf):
    """The results log, written by year and read back, as serving queries find it."""
    path = scratch_path(spark, "results")
    writers.write_parquet(_results_log(spark, sf), path)
    return readers.read_parquet(spark, path)


_RESULTS_SQL = f"""{SCORES}, {b.state_sql('s')}, {b.LABELS_SQL}"""
_VALID_SQL = """vm AS (SELECT match_id FROM st GROUP BY 1 HAVING max(greatest(p1_sets_won, p2_sets_won)) < 3)"""


def unlikely_results(spark, sf):
    return mx.unlikely_results(_results_log(spark, sf), sets_needed=_LIMITS)


UNLIKELY_RESULTS = f"""{_RESULTS_SQL}, {_VALID_SQL},
f AS (SELECT match_id, player1 AS player, p1_win_prob_before AS wp, match_winner = player1 AS won FROM st UNION ALL SELECT match_id, player2, 1 - p1_win_prob_before, match_winner = player2 FROM st),
g AS (SELECT * FROM f WHERE match_id IN (SELECT match_id FROM vm))
SELECT player, count(DISTINCT match_id) FILTER (WHERE won AND wp <= 1e-1) AS unlikely_wins, count(DISTINCT match_id) FILTER (WHERE NOT won AND wp >= 9e-1) AS unlikely_losses
FROM g GROUP BY 1 HAVING unlikely_wins > 0 OR unlikely_losses > 0"""


def extreme_points(spark, sf):
    log = with_match_winner(b.scores(spark, sf))
    return rounded(mx.extreme_points(log), "win_prob", "loss_prob")


EXTREME_POINTS = f"""{SCORES}, {b.state_sql('s')},
f AS (SELECT match_id, point_number, player1 AS player, p1_win_prob_before AS wp, match_winner = player1 AS won FROM st UNION ALL SELECT match_id, point_number, player2, 1 - p1_win_prob_before, match_winner = player2 FROM st),
w AS (SELECT *, row_number() OVER (PARTITION BY player, match_id ORDER BY wp, point_number) AS rn FROM f WHERE won AND wp <= 1e-1),
l AS (SELECT *, row_number() OVER (PARTITION BY player, match_id ORDER BY wp DESC, point_number) AS rn FROM f WHERE NOT won AND wp >= 9e-1)
SELECT coalesce(w.player, l.player) AS player, coalesce(w.match_id, l.match_id) AS match_id, {_r('w.wp', 'win_prob')}, w.point_number AS win_point, {_r('l.wp', 'loss_prob')}, l.point_number AS loss_point
FROM (SELECT * FROM w WHERE rn = 1) w FULL JOIN (SELECT * FROM l WHERE rn = 1) l ON w.player = l.player AND w.match_id = l.match_id"""


def score_summary(spark, sf):
    log = rebuild_state(b.scores(spark, sf), tiebreak_at=3).withColumns(score_labels())
    return rounded(mx.score_summary(log), "average_importance", "win_rate")


SCORE_SUMMARY = f"""{SCORES}, {b.state_sql('s', 3)}, {b.LABELS_SQL}
SELECT score, {_r('avg(importance)', 'average_importance')}, {_r('avg(CASE WHEN server_win THEN 1e0 ELSE 0e0 END)', 'win_rate')}, count(*) AS points
FROM lb WHERE server_token IN ('0', '15', '30', '40', 'AD') AND returner_token IN ('0', '15', '30', '40', 'AD') GROUP BY 1"""

_SCENARIO_NUMBERS = ["prob_swing", "prob_min", "prob_max", "prob_delta", "win_probability", "win_probability_pct"]


def top_swings(spark, sf):
    top = mx.top_swings(_results_log(spark, sf))
    return rounded(mx.swing_scenarios(top), *_SCENARIO_NUMBERS)


TOP_SWINGS = f"""{_RESULTS_SQL},
t AS (SELECT *, p1_win_prob_if_p1_wins AS up, p1_win_prob_if_p2_wins AS dn FROM lb ORDER BY abs(p1_win_prob_if_p1_wins - p1_win_prob_if_p2_wins) DESC, match_id, point_number LIMIT 10),
k AS (SELECT *, CAST(row_number() OVER (ORDER BY abs(up - dn) DESC, match_id, point_number) - 1 AS VARCHAR) AS point_label,
  CASE WHEN point_winner = 1 THEN player1 ELSE player2 END AS swing_winner FROM t),
l AS (SELECT *, 'p1_win_prob_if_p1_wins' AS scenario, up AS win_probability FROM k UNION ALL SELECT *, 'p1_win_prob_if_p2_wins', dn FROM k)
SELECT point_label, {_r('up - dn', 'prob_swing')}, {_r('least(up, dn)', 'prob_min')}, {_r('greatest(up, dn)', 'prob_max')}, {_r('greatest(up, dn) - least(up, dn)', 'prob_delta')},
  player1, player2, player1 || ' vs ' || player2 AS players, CAST(year AS VARCHAR) || ' - ' || tournament_name AS year_tournament,
  p1_sets_won || '-' || p2_sets_won || ', ' || p1_games_won || '-' || p2_games_won AS match_score, swing_winner, scenario,
  {_r('win_probability')}, {_r('win_probability * 100', 'win_probability_pct')},
  CASE WHEN (scenario = 'p1_win_prob_if_p1_wins' AND swing_winner = player1) OR (scenario = 'p1_win_prob_if_p2_wins' AND swing_winner = player2) THEN 'Actual' ELSE 'Predicted' END AS point_outcome
FROM l"""

_UPSET_COLUMNS = [
    "match_id", "id_year", "tourney_code", "match_num", "tour", "tournament_name", "player1", "player2",
    "match_winner", "winner_prob_before", "point_number", "p1_sets_won", "p2_sets_won", "p1_games_won",
    "p2_games_won", "score", "point_server",
]


def top_upsets(spark, sf):
    return mx.top_upsets(_stored_results(spark, sf), sets_needed=_LIMITS).select(*_UPSET_COLUMNS)


TOP_UPSETS = f"""{_RESULTS_SQL}, {_VALID_SQL},
v AS (SELECT *, round(CASE WHEN match_winner = player1 THEN p1_win_prob_before ELSE 1 - p1_win_prob_before END, 5) AS winner_prob_before FROM lb WHERE match_id IN (SELECT match_id FROM vm)),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY winner_prob_before, point_number) AS rn FROM v)
SELECT match_id, split_part(match_id, '-', 1) AS id_year, split_part(match_id, '-', 2) AS tourney_code, split_part(match_id, '-', 3) AS match_num, tour, tournament_name,
  player1, player2, match_winner, winner_prob_before, point_number, p1_sets_won, p2_sets_won, p1_games_won, p2_games_won, score, point_server
FROM r WHERE rn = 1 ORDER BY winner_prob_before, match_id LIMIT 10"""


QUERIES = {
    "serve_return_stats": (serve_return_stats, SERVE_RETURN_STATS),
    "best_servers": (best_servers, BEST_SERVERS),
    "match_rates": (match_rates, MATCH_RATES),
    "player_dimension": (player_dimension, PLAYER_DIMENSION),
    "tour_classify": (tour_classify, TOUR_CLASSIFY),
    "status_keep_active": (_status_query("Active"), _status_oracle(False)),
    "status_keep_inactive": (_status_query("Inactive"), _status_oracle(True)),
    "status_inactive_players": (inactive_players, INACTIVE_PLAYERS),
    "status_mask": (mask_status, MASK_STATUS),
    "min_points_gate": (min_points_gate, MIN_POINTS_GATE),
    "player_point_totals": (player_point_totals, PLAYER_POINT_TOTALS),
    "point_model_columns": (point_model_columns, POINT_MODEL_COLUMNS),
    "empirical_win_prob": (empirical, EMPIRICAL),
    "point_importance": (_importance("reference"), importance_sql(_MODEL_SQL, _hold_sql, "reference")),
    "point_importance_standard": (_importance("standard"), importance_sql(_MODEL_SQL, _hold_sql, "standard")),
    "clutch_by_match": (clutch_by_match, CLUTCH_BY_MATCH),
    "clutch_by_player": (clutch_by_player, CLUTCH_BY_PLAYER),
    "epa_by_player": (_epa(False), _epa_sql("DESC")),
    "epa_by_player_lowest": (_epa(True), _epa_sql("ASC")),
    "consistency_index": (consistency_index, CONSISTENCY_INDEX),
    "consistency_and_clutch": (consistency_and_clutch, CONSISTENCY_AND_CLUTCH),
    "match_consistency": (match_consistency, MATCH_CONSISTENCY),
    "pressure_rankings": (pressure_rankings, PRESSURE_RANKINGS),
    "pressure_share": (pressure_share, PRESSURE_SHARE),
    "player_deltas": (player_deltas, PLAYER_DELTAS),
    "unlikely_results": (unlikely_results, UNLIKELY_RESULTS),
    "extreme_points": (extreme_points, EXTREME_POINTS),
    "score_summary": (score_summary, SCORE_SUMMARY),
    "top_swings": (top_swings, TOP_SWINGS),
    "top_upsets": (top_upsets, TOP_UPSETS),
}


def flagship(spark, sf):
    """Clutch per match and player over a log whose match state was rebuilt."""
    return rounded(mx.clutch_by_match(_results_log(spark, sf)), "total_clutch_score")
