"""Queries on match state, match facts and raw-log cleaning over the event point log."""

from pyspark.sql import functions as F

from rallyframe.constants import GAME
from rallyframe.functions.cleaning import cast_columns, census, clean, drop_sentinels, fill_defaults, numeric_only
from rallyframe.functions.ids import best_of, id_parts, is_best_of_five, round_number, tour, tournament_name
from rallyframe.functions.scores import by_code, score_labels, swap_for_server
from rallyframe.operators.filters import valid_matches
from rallyframe.operators.state import (
    carried_state,
    last_rows,
    rebuild_state,
    running_points,
    set_columns,
    with_match_winner,
)
from workload import bindings as b

KEY = [*GAME, "point_number"]
KEY_SQL = "match_id, set_no, game_no, point_number"


def state_game_points(spark, sf):
    run = running_points(b.points(spark, sf))
    return run.select(*KEY, "p1_points_pre", "p2_points_pre", "p1_points_run", "p2_points_run")


STATE_GAME_POINTS = f"""WITH {b.POINTS_SQL}, {b.state_sql('p')}
SELECT {KEY_SQL}, p1_points_pre, p2_points_pre, a AS p1_points_run, b AS p2_points_run FROM st"""


def state_games_sets(spark, sf):
    state = set_columns(rebuild_state(b.points(spark, sf)))
    return state.select(
        *KEY, "p1_game_won", "p2_game_won", "p1_games_won", "p2_games_won", "p1_sets_won", "p2_sets_won",
        *[f"set{s}_p{p}" for s in range(1, 6) for p in (1, 2)],
    )


_SET_COLUMNS_SQL = ", ".join(
    f"CAST(CASE WHEN set_no = {s} THEN p{p}_games_won + max(f{p}) OVER (PARTITION BY match_id, set_no, game_no) ELSE 0 END AS DOUBLE) AS set{s}_p{p}"
    for s in range(1, 6)
    for p in (1, 2)
)
# The game-won flag belongs to the whole game here; the set columns use it the same way.
STATE_GAMES_SETS = f"""WITH {b.POINTS_SQL}, {b.state_sql('p')}
SELECT {KEY_SQL}, max(f1) OVER (PARTITION BY match_id, set_no, game_no) AS p1_game_won,
  max(f2) OVER (PARTITION BY match_id, set_no, game_no) AS p2_game_won,
  p1_games_won, p2_games_won, p1_sets_won, p2_sets_won, {_SET_COLUMNS_SQL} FROM st"""


def state_tiebreak_scores(spark, sf):
    state = rebuild_state(b.points(spark, sf), tiebreak_at=3).withColumns(score_labels())
    return state.withColumn("score_p1_first", swap_for_server()).select(
        *KEY, "is_tiebreak", "server_token", "returner_token", "score", "score_p1_first"
    )


STATE_TIEBREAK_SCORES = f"""WITH {b.POINTS_SQL}, {b.state_sql('p', 3)}, {b.LABELS_SQL}
SELECT {KEY_SQL}, is_tiebreak, server_token, returner_token, score, one || '-' || two AS score_p1_first FROM lb"""


def state_lag_set_start(spark, sf):
    log = b.points(spark, sf, "event_type")
    lags = {
        "set_no_pre": ("set_no", 1), "game_no_pre": ("game_no", 0), "token_pre": ("event_type", "0"),
    }
    out = carried_state(log, lags)
    return out.select(*KEY, *lags, "new_set_start", "p1_sets_by_start", "p2_sets_by_start")


STATE_LAG_SET_START = f"""WITH {b.POINTS_SQL},
a AS (SELECT *, lag(set_no) OVER w AS ps, lag(point_winner) OVER w AS pw,
   coalesce(lag(set_no) OVER w, 1) AS set_no_pre, coalesce(lag(game_no) OVER w, 0) AS game_no_pre,
   coalesce(lag(event_type) OVER w, '0') AS token_pre
   FROM p WINDOW w AS (PARTITION BY match_id ORDER BY point_number)),
c AS (SELECT *, CASE WHEN set_no > ps THEN 1 ELSE 0 END AS new_set_start FROM a)
SELECT {KEY_SQL}, set_no_pre, game_no_pre, token_pre, new_set_start,
  CAST(sum(CASE WHEN new_set_start = 1 AND pw = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS p1_sets_by_start,
  CAST(sum(CASE WHEN new_set_start = 1 AND pw = 2 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS p2_sets_by_start
FROM c WINDOW w AS (PARTITION BY match_id ORDER BY point_number)"""


def game_match_winner(spark, sf):
    state = rebuild_state(b.points(spark, sf), tiebreak_at=3)
    winner = by_code("match_winner_code", "player1", "player2")
    return state.select(*KEY, "game_win", winner.alias("match_winner"))


GAME_MATCH_WINNER = f"""WITH {b.POINTS_SQL}, {b.state_sql('p', 3)}
SELECT {KEY_SQL}, CASE WHEN is_tiebreak THEN game_last WHEN coalesce(game_no <> lead(game_no) OVER (PARTITION BY match_id, set_no ORDER BY game_no, point_number), true) THEN point_winner END AS game_win,
  match_winner FROM st"""


def recorded_match_winner(spark, sf):
    log = b.points(spark, sf)
    won = with_match_winner(log, b.matches(spark, sf))
    return won.groupBy("match_id", "match_winner").agg(F.count(F.lit(1)).alias("points"))


RECORDED_MATCH_WINNER = f"""WITH {b.POINTS_SQL}, {b.MATCHES_SQL.replace('m0 AS', 'mm0 AS').replace('FROM m0', 'FROM mm0')},
lastrow AS (SELECT match_id, CASE WHEN point_winner = 1 THEN player1 ELSE player2 END AS by_point,
   row_number() OVER (PARTITION BY match_id ORDER BY set_no DESC, game_no DESC, point_number DESC) AS rn FROM p)
SELECT p.match_id, coalesce(nullif(trim(mt.winner), ''), by_point) AS match_winner, count(*) AS points
FROM p JOIN lastrow l ON l.match_id = p.match_id AND l.rn = 1 JOIN mt ON mt.match_id = p.match_id GROUP BY 1, 2"""


def last_game_rows(spark, sf):
    log = b.points(spark, sf).select(*KEY, "point_winner", "point_server")
    return last_rows(log, GAME, "point_number")


LAST_GAME_ROWS = f"""WITH {b.POINTS_SQL}
SELECT {KEY_SQL}, point_winner, point_server FROM (SELECT *, row_number() OVER (PARTITION BY match_id, set_no, game_no ORDER BY point_number DESC) AS rn FROM p) WHERE rn = 1"""


def tour_round_parse(spark, sf):
    odd = b.table(spark, sf, "events").select(
        F.concat_ws("-", F.col("event_type"), F.col("user_id").cast("string")).alias("match_id"), F.lit("other").alias("tournament")
    )
    ids = b.points(spark, sf).select("match_id", "tournament").unionByName(odd).distinct()
    return (
        ids.withColumns(
            {
                "tour": tour(),
                "tour_suffix": tour(variant="suffix"),
                "tour_digits_first": tour(variant="digits_first"),
                "best_of": best_of(),
                "round": round_number(),
                "tournament_name": tournament_name(),
                **id_parts(),
            }
        )
        .withColumn("best_of_five", is_best_of_five())
    )


TOUR_ROUND_PARSE = f"""WITH {b.POINTS_SQL},
ids AS (SELECT match_id, tournament FROM p UNION SELECT event_type || '-' || CAST(user_id AS VARCHAR), 'other' FROM events),
t AS (SELECT *, {b.TOUR_SQL} AS tour, {b.TOUR_SUFFIX_SQL} AS tour_suffix,
  {b.TOUR_DIGITS_SQL} AS tour_digits_first,
  CAST(CASE WHEN regexp_matches(match_id, '-MS[0-9]+$') THEN 5 WHEN regexp_matches(match_id, '-WS[0-9]+$') THEN 3
       WHEN regexp_matches(match_id, '[0-9]{{4}}$') THEN CASE WHEN substr(match_id, -4, 1) = '1' THEN 5 ELSE 3 END END AS INT) AS best_of,
  CAST(CASE WHEN regexp_matches(match_id, '-(MS|WS)[0-9]+$') THEN regexp_extract(match_id, '-(MS|WS)([0-9])', 2)
       WHEN regexp_matches(match_id, '[0-9]{{4}}$') THEN substr(match_id, -3, 1) END AS INT) AS round,
  {b.TOURNAMENT_SQL} AS tournament_name,
  string_split(match_id, '-')[1] AS id_year, string_split(match_id, '-')[2] AS tourney_code,
  string_split(match_id, '-')[3] AS match_num FROM ids)
SELECT *, tour IN ('ATP', 'Both') AS best_of_five FROM t"""


def _dirty(spark, sf):
    """Raw text log with the kinds of dirt real files have."""
    e, n = F.col("event_id"), F.col("event_id").cast("string")
    return b.table(spark, sf, "events").select(
        F.concat_ws("-", F.lit("m"), F.col("user_id").cast("string")).alias("match_id"),
        F.when(e % 17 == 0, F.concat(n, F.lit("X"))).when(e % 19 == 0, None).otherwise(n).alias("PointNumber"),
        F.when(e % 23 == 0, "0").when(e % 29 == 0, "").otherwise((1 + e % 2).cast("string")).alias("PointWinner"),
        F.when(e % 31 == 0, "0").otherwise((1 + e % 3 % 2).cast("string")).alias("PointServer"),
        F.when(e % 5 == 0, F.concat(F.lit("  "), F.col("event_type"))).when(e % 7 == 0, "nan").alias("player1"),
        F.when(e % 11 == 0, None).otherwise(F.lit("15-0")).alias("score"),
        F.when(e % 13 == 0, None).otherwise(F.col("value")).alias("serve_point_win_pct"),
        F.when(e % 37 == 0, F.lit("Both")).alias("tour"),
    )


_DIRTY_SQL = """d AS (SELECT 'm-' || CAST(user_id AS VARCHAR) AS match_id,
  CASE WHEN event_id % 17 = 0 THEN CAST(event_id AS VARCHAR) || 'X' WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS "PointNumber",
  CASE WHEN event_id % 23 = 0 THEN '0' WHEN event_id % 29 = 0 THEN '' ELSE CAST(1 + event_id % 2 AS VARCHAR) END AS "PointWinner",
  CASE WHEN event_id % 31 = 0 THEN '0' ELSE CAST(1 + event_id % 3 % 2 AS VARCHAR) END AS "PointServer",
  CASE WHEN event_id % 5 = 0 THEN '  ' || event_type WHEN event_id % 7 = 0 THEN 'nan' END AS player1,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE '15-0' END AS score,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE value END AS serve_point_win_pct,
  CASE WHEN event_id % 37 = 0 THEN 'Both' END AS tour FROM events)"""


def clean_cast_filter(spark, sf):
    kept = numeric_only(drop_sentinels(_dirty(spark, sf)))
    typed = cast_columns(kept, {"PointNumber": "bigint", "PointWinner": "int", "PointServer": "int"})
    return clean(fill_defaults(typed))


CLEAN_CAST_FILTER = f"""WITH {_DIRTY_SQL}
SELECT match_id, CAST("PointNumber" AS BIGINT) AS "PointNumber", CAST("PointWinner" AS INT) AS "PointWinner",
  CAST("PointServer" AS INT) AS "PointServer",
  CASE WHEN player1 IS NULL OR trim(player1) IN ('', 'nan') THEN 'UNKNOWN' ELSE trim(player1) END AS player1,
  coalesce(score, '0-0') AS score, coalesce(serve_point_win_pct, 62e-2) AS serve_point_win_pct, coalesce(tour, 'Unknown') AS tour
FROM d WHERE try_cast("PointWinner" AS INT) <> 0 AND try_cast("PointServer" AS INT) <> 0
  AND regexp_full_match("PointNumber", '[0-9]+')"""


def null_census(spark, sf):
    return census(_dirty(spark, sf))


NULL_CENSUS = f"WITH {_DIRTY_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count(*) - count("{c}") AS null_count FROM d"""
    for c, t in {
        "match_id": "string", "PointNumber": "string", "PointWinner": "string", "PointServer": "string",
        "player1": "string", "score": "string", "serve_point_win_pct": "double", "tour": "string",
    }.items()
)


def valid_matches_query(spark, sf):
    state = rebuild_state(b.points(spark, sf)).withColumn("tour", tour())
    kept = valid_matches(state, {"ATP": 2, "WTA": 3})
    return kept.groupBy("match_id", "tour").agg(F.count(F.lit(1)).alias("points"))


VALID_MATCHES = f"""WITH {b.POINTS_SQL}, {b.state_sql('p')},
t AS (SELECT *, {b.TOUR_SQL} AS tour FROM st)
SELECT match_id, tour, count(*) AS points FROM t GROUP BY match_id, tour
HAVING NOT (tour = 'ATP' AND max(greatest(p1_sets_won, p2_sets_won)) >= 2) AND NOT (tour = 'WTA' AND max(greatest(p1_sets_won, p2_sets_won)) >= 3)"""


QUERIES = {
    "state_game_points": (state_game_points, STATE_GAME_POINTS),
    "state_games_sets": (state_games_sets, STATE_GAMES_SETS),
    "state_tiebreak_scores": (state_tiebreak_scores, STATE_TIEBREAK_SCORES),
    "state_lag_set_start": (state_lag_set_start, STATE_LAG_SET_START),
    "game_match_winner": (game_match_winner, GAME_MATCH_WINNER),
    "recorded_match_winner": (recorded_match_winner, RECORDED_MATCH_WINNER),
    "last_game_rows": (last_game_rows, LAST_GAME_ROWS),
    "tour_round_parse": (tour_round_parse, TOUR_ROUND_PARSE),
    "clean_cast_filter": (clean_cast_filter, CLEAN_CAST_FILTER),
    "null_census": (null_census, NULL_CENSUS),
    "valid_matches": (valid_matches_query, VALID_MATCHES),
}
