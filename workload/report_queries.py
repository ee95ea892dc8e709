"""Composed serving reports over the event point log, and metrics on really scored points."""

from rallyframe.constants import DEFAULT_RETURN_PCT, DEFAULT_SERVE_PCT
from rallyframe.operators import metrics as mx
from rallyframe.operators import rollups, sketches
from rallyframe.operators.filters import Filters
from rallyframe.plans import reports
from rallyframe.plans.build import scored_log
from rallyframe.session import scratch_path
from rallyframe.sources import writers
from workload import bindings as b
from workload import metric_queries as mq
from workload.importance_oracle import importance_sql
from workload.metric_queries import SCORES, _r, rounded

CHOSEN = Filters(years=(2021, 2023, 2024), tour="ATP", status="Active")

# z: chosen points with players outside the newest chosen year masked
_CHOSEN_SQL = """z0 AS (SELECT * FROM {source} WHERE year IN (2021, 2023, 2024) AND tour = 'ATP'),
act AS (SELECT DISTINCT unnest([player1, player2]) AS player FROM z0 WHERE year = (SELECT max(year) FROM z0)),
z AS (SELECT * REPLACE (CASE WHEN player1 IN (SELECT player FROM act) THEN player1 END AS player1, CASE WHEN player2 IN (SELECT player FROM act) THEN player2 END AS player2) FROM z0)"""


def consistency_tab(spark, sf):
    report = reports.consistency_tab(b.scores(spark, sf), CHOSEN, 50)
    return rounded(report, *mq._CONSISTENCY_NUMBERS, "expected_points_added", "clutch_percentile")


_FLAT_Z = mq._FLAT_SQL.replace("FROM s", "FROM z").replace("f AS (", "f0 AS (", 1) + ", f AS (SELECT * FROM f0 WHERE player IS NOT NULL)"
CONSISTENCY_TAB = f"""{SCORES}, {_CHOSEN_SQL.format(source='s')}, {mq._CONSISTENCY_SQL.replace(mq._FLAT_SQL, _FLAT_Z)},
epa AS (SELECT player, sum(d * importance * points_stake) AS epa FROM f GROUP BY 1),
j AS (SELECT c3.*, epa FROM c3 JOIN epa USING (player) WHERE total_points >= 50)
SELECT player, total_points, {mq._CONSISTENCY_PICK.replace('c3.', 'j.')}, {_r('epa', 'expected_points_added')},
  {_r('(rank() OVER (ORDER BY epa) + (count(*) OVER (PARTITION BY epa) - 1) / 2e0) / count(*) OVER ()', 'clutch_percentile')},
  CAST(row_number() OVER (ORDER BY epa DESC, player) AS INT) AS place FROM j"""


def pressure_tab(spark, sf):
    report = reports.pressure_tab(b.scores(spark, sf), CHOSEN, min_points=100, min_ranking_points=20, min_share_points=30)
    return rounded(report, "win_pct_all", "win_pct_hp", "clutch_delta", "high_pressure_pct")


_GATED_SQL = """t AS (SELECT player1 AS player, count(*) AS total_points FROM z WHERE player1 IS NOT NULL GROUP BY 1 HAVING count(*) >= 100),
w AS (SELECT z.* FROM z WHERE player1 IN (SELECT player FROM t)),
hp AS (SELECT *, coalesce(importance >= (SELECT quantile_cont(importance, 0.75) FROM w), false) AS is_hp FROM w)"""
PRESSURE_TAB = f"""{SCORES}, {_CHOSEN_SQL.format(source='s')}, {_GATED_SQL},
r AS (SELECT server_name AS player, 'serve' AS role, CASE WHEN server_win THEN 1e0 ELSE 0e0 END AS won, is_hp, tour FROM hp
  UNION ALL SELECT returner_name, 'return', CASE WHEN server_win THEN 0e0 ELSE 1e0 END, is_hp, tour FROM hp),
g AS (SELECT player, role, avg(won) AS a, avg(won) FILTER (WHERE is_hp) AS h, count(*) AS n, count(*) FILTER (WHERE is_hp) AS hn, min(tour) AS tour FROM r GROUP BY 1, 2),
k AS (SELECT player, avg(a) AS a, avg(h) AS h, sum(n) AS n, sum(hn) AS hn, avg(h - a) AS d, min(tour) AS tour FROM g WHERE hn >= 20 GROUP BY 1),
sh AS (SELECT player, sum(CASE WHEN is_hp THEN 1 ELSE 0 END) AS hn, count(*) AS n FROM (SELECT player1 AS player, is_hp FROM hp UNION ALL SELECT player2, is_hp FROM hp) WHERE player IS NOT NULL GROUP BY 1)
SELECT k.player, {_r('k.a', 'win_pct_all')}, {_r('k.h', 'win_pct_hp')}, CAST(k.n AS BIGINT) AS role_points, CAST(k.hn AS BIGINT) AS high_pressure_points,
  {_r('k.d', 'clutch_delta')}, k.tour, CASE WHEN sh.hn >= 30 THEN round(sh.hn / sh.n, 6) + 0e0 END AS high_pressure_pct, t.total_points,
  CAST(row_number() OVER (ORDER BY k.d DESC NULLS LAST, k.player) AS INT) AS place
FROM k LEFT JOIN sh ON sh.player = k.player JOIN t ON t.player = k.player"""


def _stored_scores(spark, sf):
    """The scored log written by year, and read from there."""
    path = scratch_path(spark, "scores")
    writers.write_parquet(b.scores(spark, sf), path)
    return spark.read.parquet(path)


def pressure_tab_sketched(spark, sf):
    """The pressure tab over a stored log, its threshold bracketed by stored sketches."""
    log = _stored_scores(spark, sf)
    kept = sketches.build_sketches(log, scratch_path(spark, "sketches"), ["year", "tour", "tournament_name"], "importance")
    report = reports.pressure_tab(
        log, CHOSEN, min_points=100, min_ranking_points=20, min_share_points=30, sketches=kept
    )
    return rounded(report, "win_pct_all", "win_pct_hp", "clutch_delta", "high_pressure_pct")


def player_rollup(spark, sf):
    """Players from stored sums per year, one year of which was first built from half its points and then replaced."""
    log, path = _stored_scores(spark, sf), scratch_path(spark, "sums")
    rollups.build_year_sums(log.filter("year <> 2024 OR point_number % 2 = 0"), path)
    players = rollups.players_of(rollups.build_year_sums(log, path, only=[2024]))
    return rounded(players, "serve_point_win_pct", "return_point_win_pct")


PLAYER_ROLLUP = f"""{SCORES},
r AS (SELECT server_name AS player, year, tour, server_win AS won, true AS serving FROM s
  UNION ALL SELECT returner_name, year, tour, NOT server_win, false FROM s)
SELECT player, count(won) AS role_points, max(year) AS last_year,
  {_r('coalesce(avg(CASE WHEN serving THEN CASE WHEN won THEN 1e0 ELSE 0e0 END END), @serve)', 'serve_point_win_pct')},
  {_r('coalesce(avg(CASE WHEN NOT serving THEN CASE WHEN won THEN 1e0 ELSE 0e0 END END), @return)', 'return_point_win_pct')},
  CASE WHEN max(year) = (SELECT max(year) FROM r) THEN 'Active' ELSE 'Inactive' END AS player_status,
  CASE WHEN count(DISTINCT tour) = 1 AND min(tour) IN ('ATP', 'WTA') THEN min(tour) ELSE 'Both' END AS tour
FROM r WHERE player IS NOT NULL GROUP BY 1""".replace("@serve", str(DEFAULT_SERVE_PCT)).replace("@return", str(DEFAULT_RETURN_PCT))


def pressure_extremes(spark, sf):
    """Head and tail ten of the pressure share of the chosen points."""
    points = reports.pressure_points(b.scores(spark, sf).select(*reports.PRESSURE_COLUMNS), CHOSEN, 100)
    return rounded(mx.pressure_extremes(mx.pressure_share(points, 5), "high_pressure_pct"), "high_pressure_pct")


PRESSURE_EXTREMES = f"""{SCORES}, {_CHOSEN_SQL.format(source='s')}, {_GATED_SQL},
sh AS (SELECT player, count(*) AS total_points, count(*) FILTER (WHERE is_hp) AS high_pressure_points, count(*) FILTER (WHERE is_hp) / count(*) AS p
  FROM (SELECT player1 AS player, is_hp FROM hp UNION ALL SELECT player2, is_hp FROM hp) WHERE player IS NOT NULL GROUP BY 1 HAVING high_pressure_points >= 5),
o AS (SELECT *, 'most' AS side, row_number() OVER (ORDER BY p DESC, player) AS place FROM sh
  UNION ALL SELECT *, 'least', row_number() OVER (ORDER BY p, player) FROM sh)
SELECT player, total_points, high_pressure_points, {_r('p', 'high_pressure_pct')}, side, CAST(place AS INT) AS place FROM o WHERE place <= 10"""


def results_tab(spark, sf):
    report = reports.results_tab(mq._stored_results(spark, sf), CHOSEN, sets_needed=mq._LIMITS)
    return report.select("place", "match_id", "player1", "player2", "match_winner", "winner_prob_before", "point_number", "score")


RESULTS_TAB = f"""{mq._RESULTS_SQL}, {_CHOSEN_SQL.format(source='lb')},
vm AS (SELECT match_id FROM z GROUP BY 1 HAVING max(greatest(p1_sets_won, p2_sets_won)) < 3),
v AS (SELECT *, round(CASE WHEN match_winner = player1 THEN p1_win_prob_before ELSE 1 - p1_win_prob_before END, 5) AS winner_prob_before FROM z WHERE match_id IN (SELECT match_id FROM vm)),
r AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY winner_prob_before, point_number) AS rn FROM v)
SELECT CAST(row_number() OVER (ORDER BY winner_prob_before, match_id) AS INT) AS place, match_id, player1, player2, match_winner, winner_prob_before, point_number, score
FROM r WHERE rn = 1 ORDER BY winner_prob_before, match_id LIMIT 10"""


def scored_clutch(spark, sf):
    """Clutch score per match and player, on points scored by the exact model."""
    return rounded(mx.clutch_by_match(scored_log(b.points(spark, sf))), "total_clutch_score")


_SCORED = importance_sql(mq._MODEL_SQL, mq._hold_sql, "reference").rsplit("\nSELECT match_id, set_no", 1)[0]
_DELTA = "CASE WHEN point_winner = 1 THEN p1_win_prob_if_p1_wins ELSE p1_win_prob_if_p2_wins END - p1_win_prob_before"
SCORED_CLUTCH = f"""{_SCORED},
sc AS (SELECT match_id, player1, player2, round, {_DELTA} AS d, abs(p1_win_prob_if_p1_wins - p1_win_prob_if_p2_wins) AS imp FROM y2),
sq AS (SELECT *, CASE round WHEN 1 THEN 10 WHEN 2 THEN 45 WHEN 3 THEN 90 WHEN 4 THEN 180 WHEN 5 THEN 360 WHEN 6 THEN 720 WHEN 7 THEN 1200 ELSE 2000 END AS stake FROM sc),
sl AS (SELECT match_id, player1 AS player, d * imp * stake AS x FROM sq UNION ALL SELECT match_id, player2, -d * imp * stake FROM sq)
SELECT match_id, player, {_r('sum(x)', 'total_clutch_score')} FROM sl GROUP BY 1, 2"""


QUERIES = {
    "consistency_tab": (consistency_tab, CONSISTENCY_TAB),
    "pressure_tab": (pressure_tab, PRESSURE_TAB),
    "pressure_tab_sketched": (pressure_tab_sketched, PRESSURE_TAB),
    "player_rollup": (player_rollup, PLAYER_ROLLUP),
    "pressure_extremes": (pressure_extremes, PRESSURE_EXTREMES),
    "results_tab": (results_tab, RESULTS_TAB),
    "scored_clutch": (scored_clutch, SCORED_CLUTCH),
}
