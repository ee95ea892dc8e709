"""Tennis-shaped inputs derived from the driver tables, and the same derivations as DuckDB CTEs.

Events become points: four users make a match, ten days a set, eighteen hours a game. All
of it is computed row by row, so the log needs no shuffle and grows with ``events``. The
SQL is written independently of the DataFrame code, since it serves as the oracle.
"""

from pyspark.sql import functions as F

from rallyframe.constants import TOURNAMENT_NAMES
from rallyframe.functions.ids import round_number, tour, tournament_name
from rallyframe.functions.scores import points_stake, probability_deltas
from rallyframe.operators.players import with_roles, with_serve_outcome


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(column, n):
    return F.floor(column / F.lit(float(n))).cast("bigint")


def _pick(index, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


FIRST = ["Ana", "Bo", "Chris", "Dana", "Eli"]
LAST = ["van dam", "o'neil", "riske-amritraj", "Okafor"]
SLAMS = ["ausopen", "frenchopen", "wimbledon", "usopen"]


def full_name(key):
    return F.concat_ws(" ", _pick(key % 5, FIRST), _pick(key % 4, LAST), key.cast("string"))


def short_name(key):
    initials = [f"{n[0]}." for n in FIRST]
    return F.concat_ws(" ", _pick(key % 5, initials), _pick(key % 4, LAST), key.cast("string"))


def match_columns(m):
    """Match attributes as expressions of the match number."""
    women = m % 2 == 1
    number = _div(m, 280)
    tail = F.concat(F.when(number < 10, F.lit("0")).otherwise(F.lit("")), number.cast("string"))
    draw = F.concat((1 + m % 7).cast("string"), tail)
    letters = (m % 3 == 0) | (m >= 28000)
    code = F.when(letters, F.when(women, "WS").otherwise("MS")).otherwise(F.when(women, "2").otherwise("1"))
    year, slam = (2020 + m % 5).cast("int"), _pick(_div(m % 8, 2), SLAMS)
    fixed, wide = 3 * _div(m, 8) + m % 2, 3 * _div(m, 16) + 2
    swapped = _div(m, 2) % 2 == 1
    return {
        "match_id": F.concat_ws("-", year.cast("string"), slam, F.concat(code, draw)),
        "year": year,
        "tournament": slam,
        "key1": F.when(swapped, wide).otherwise(fixed),
        "key2": F.when(swapped, fixed).otherwise(wide),
    }


def points(spark, sf_dir, *extra):
    """Clean point log; ``extra`` keeps further event columns."""
    hours = (F.dayofmonth("ts") - 1) * 24 + F.hour("ts")
    game = (1 + F.floor((hours % 240) / F.lit(18.0))).cast("int")
    server = (1 + F.col("game_no") % 2).cast("int")
    holds = F.col("event_type").isin("click", "view", "purchase")
    return (
        table(spark, sf_dir, "events")
        .withColumn("m", _div(F.col("user_id"), 4))
        .withColumns(match_columns(F.col("m")))
        .withColumns(
            {
                "set_no": (1 + F.floor(hours / F.lit(240.0))).cast("int"),
                "game_no": game,
                "point_number": F.col("event_id") + 1,
                "player1": short_name(F.col("key1")),
                "player2": short_name(F.col("key2")),
            }
        )
        .withColumn("point_server", server)
        .withColumn("point_winner", F.when(holds, F.col("point_server")).otherwise(3 - F.col("point_server")))
        .select(
            "match_id", "year", "tournament", "set_no", "game_no", "point_number", "point_server",
            "point_winner", "player1", "player2", "value", *extra,
        )
    )


def with_stand_in_scores(log):
    """Probabilities made up from the event, so that metrics can be checked in SQL."""
    before = F.lit(0.05) + F.lit(0.9) * (((F.col("point_number") - 1) * 7919) % 1000) / F.lit(1000.0)
    w = F.col("value") / (F.col("value") + F.lit(100.0))
    u = F.col("p1_win_prob_before")
    scored = log.withColumn("p1_win_prob_before", before).withColumns(
        {"p1_win_prob_if_p1_wins": u + (1 - u) * w, "p1_win_prob_if_p2_wins": u * (1 - w), "importance": w}
    )
    return scored.withColumns(probability_deltas())


def with_match_facts(log):
    out = log.withColumns(
        {"tour": tour(), "tournament_name": tournament_name(), "round": round_number()}
    ).withColumn("points_stake", points_stake())
    return with_serve_outcome(with_roles(out))


def scores(spark, sf_dir, *extra):
    """Point log with stand-in scores and match facts; no state, no shuffle."""
    return with_match_facts(with_stand_in_scores(points(spark, sf_dir, *extra)))


def matches(spark, sf_dir):
    """Raw matches of the log, with full player names."""
    m = F.col("m")
    return (
        table(spark, sf_dir, "events")
        .select(_div(F.col("user_id"), 4).alias("m"))
        .distinct()
        .withColumns(match_columns(m))
        .select(
            "m", "match_id", "year", F.col("tournament").alias("slam"),
            full_name(F.col("key1")).alias("player1"), full_name(F.col("key2")).alias("player2"),
            F.when(m % 5 == 0, short_name(F.col("key2"))).otherwise(F.lit("")).alias("winner"),
            F.concat(F.lit("R"), (1 + m % 7).cast("string")).alias("round"),
        )
    )


_CASE_FIRST = "CASE {k} % 5 WHEN 0 THEN 'Ana' WHEN 1 THEN 'Bo' WHEN 2 THEN 'Chris' WHEN 3 THEN 'Dana' ELSE 'Eli' END"
_CASE_LAST = "CASE {k} % 4 WHEN 0 THEN 'van dam' WHEN 1 THEN 'o''neil' WHEN 2 THEN 'riske-amritraj' ELSE 'Okafor' END"


def _sql_full(k):
    return f"{_CASE_FIRST.format(k=k)} || ' ' || {_CASE_LAST.format(k=k)} || ' ' || CAST({k} AS VARCHAR)"


def _sql_short(k):
    return f"substr({_CASE_FIRST.format(k=k)}, 1, 1) || '. ' || {_CASE_LAST.format(k=k)} || ' ' || CAST({k} AS VARCHAR)"


_MATCH_SQL = """
  CAST(2020 + m % 5 AS VARCHAR) || '-' ||
  CASE (m % 8) // 2 WHEN 0 THEN 'ausopen' WHEN 1 THEN 'frenchopen' WHEN 2 THEN 'wimbledon' ELSE 'usopen' END || '-' ||
  CASE WHEN m % 3 = 0 OR m >= 28000 THEN CASE WHEN m % 2 = 1 THEN 'WS' ELSE 'MS' END
       ELSE CASE WHEN m % 2 = 1 THEN '2' ELSE '1' END END ||
  CAST(1 + m % 7 AS VARCHAR) || CASE WHEN m // 280 < 10 THEN '0' ELSE '' END || CAST(m // 280 AS VARCHAR) AS match_id,
  CAST(2020 + m % 5 AS INT) AS year,
  CASE (m % 8) // 2 WHEN 0 THEN 'ausopen' WHEN 1 THEN 'frenchopen' WHEN 2 THEN 'wimbledon' ELSE 'usopen' END AS tournament,
  CASE WHEN (m // 2) % 2 = 1 THEN 3 * (m // 16) + 2 ELSE 3 * (m // 8) + m % 2 END AS key1,
  CASE WHEN (m // 2) % 2 = 1 THEN 3 * (m // 8) + m % 2 ELSE 3 * (m // 16) + 2 END AS key2
"""

# p: the clean point log
POINTS_SQL = f"""
e0 AS (SELECT *, user_id // 4 AS m, (extract(day FROM ts) - 1) * 24 + extract(hour FROM ts) AS hh FROM events),
e1 AS (SELECT e0.*, {_MATCH_SQL}, CAST(1 + hh // 240 AS INT) AS set_no, CAST(1 + (hh % 240) // 18 AS INT) AS game_no FROM e0),
p AS (SELECT match_id, year, tournament, set_no, game_no, event_id + 1 AS point_number,
        CAST(1 + game_no % 2 AS INT) AS point_server,
        CAST(CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 1 + game_no % 2 ELSE 2 - game_no % 2 END AS INT) AS point_winner,
        {_sql_short('key1')} AS player1, {_sql_short('key2')} AS player2, value, m, event_type, user_id, event_id, props
      FROM e1)
"""

# The draw letter or first digit that follows year and event, looked up in a map; and names from the fixed values.
TOUR_SQL = """coalesce(map {'M': 'ATP', '1': 'ATP', 'W': 'WTA', '2': 'WTA'}[regexp_extract(match_id, '^[^-]*-[^-]*-(?:([MW])S|([12]))', 1)
  || regexp_extract(match_id, '^[^-]*-[^-]*-(?:([MW])S|([12]))', 2)], 'Unknown')"""
_LETTER = "map {'M': 'ATP', 'W': 'WTA'}[regexp_extract(match_id, '-([MW])S', 1)]"
_DIGIT = "map {'1': 'ATP', '2': 'WTA'}[left(right(match_id, 4), 1)]"
TOUR_SUFFIX_SQL = f"coalesce({_LETTER}, {_DIGIT}, 'Unknown')"
_LETTER_AT = "map {'M': 'ATP', 'W': 'WTA'}[regexp_extract(match_id, '([MW])S...$', 1)]"
TOUR_DIGITS_SQL = f"coalesce({_DIGIT}, {_LETTER_AT}, 'UNKNOWN')"
TOURNAMENT_SQL = f"coalesce(map {{{', '.join(f'{k!r}: {v!r}' for k, v in TOURNAMENT_NAMES.items())}}}[tournament], tournament)"

# s: the log with stand-in scores and match facts
SCORES_SQL = f"""
{POINTS_SQL},
s0 AS (SELECT *, 5e-2 + 9e-1 * ((event_id * 7919) % 1000) / 1e3 AS u, value / (value + 1e2) AS w, CAST(1 + m % 7 AS INT) AS round FROM p),
s1 AS (SELECT *, u AS p1_win_prob_before, u + (1 - u) * w AS p1_win_prob_if_p1_wins, u * (1 - w) AS p1_win_prob_if_p2_wins, w AS importance FROM s0),
s AS (SELECT *,
   CASE WHEN point_winner = 1 THEN p1_win_prob_if_p1_wins - p1_win_prob_before ELSE p1_win_prob_if_p2_wins - p1_win_prob_before END AS p1_wp_delta,
   -(CASE WHEN point_winner = 1 THEN p1_win_prob_if_p1_wins - p1_win_prob_before ELSE p1_win_prob_if_p2_wins - p1_win_prob_before END) AS p2_wp_delta,
   {TOUR_SQL} AS tour, {TOURNAMENT_SQL} AS tournament_name,
   CASE round WHEN 1 THEN 10 WHEN 2 THEN 45 WHEN 3 THEN 90 WHEN 4 THEN 180 WHEN 5 THEN 360 WHEN 6 THEN 720 WHEN 7 THEN 1200 ELSE 2000 END AS points_stake,
   CASE WHEN point_server = 1 THEN player1 ELSE player2 END AS server_name,
   CASE WHEN point_server = 1 THEN player2 ELSE player1 END AS returner_name,
   point_server = point_winner AS server_win FROM s1)
"""

# mt: raw matches
MATCHES_SQL = f"""
m0 AS (SELECT DISTINCT user_id // 4 AS m FROM events),
m1 AS (SELECT m, {_MATCH_SQL} FROM m0),
mt AS (SELECT m, match_id, year, tournament AS slam, {_sql_full('key1')} AS player1, {_sql_full('key2')} AS player2,
   CASE WHEN m % 5 = 0 THEN {_sql_short('key2')} ELSE '' END AS winner, 'R' || CAST(1 + m % 7 AS VARCHAR) AS round FROM m1)
"""


def state_sql(source, tiebreak_at=6):
    """CTEs ending in ``st``: ``source`` with the rebuilt match state, by plain windows."""
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
w1 AS (SELECT *,
   CAST(coalesce(sum(CASE WHEN point_winner = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, set_no, game_no ORDER BY point_number {upto}), 0) AS INT) AS p1_points_pre,
   CAST(coalesce(sum(CASE WHEN point_winner = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, set_no, game_no ORDER BY point_number {upto}), 0) AS INT) AS p2_points_pre,
   row_number() OVER (PARTITION BY match_id, set_no, game_no ORDER BY point_number DESC) = 1 AS ends_game,
   row_number() OVER (PARTITION BY match_id, set_no ORDER BY game_no DESC, point_number DESC) = 1 AS ends_set,
   first_value(point_winner) OVER (PARTITION BY match_id, set_no, game_no ORDER BY point_number DESC) AS game_last,
   first_value(point_winner) OVER (PARTITION BY match_id ORDER BY set_no DESC, game_no DESC, point_number DESC) AS match_winner_code
  FROM {source}),
w2 AS (SELECT *, p1_points_pre + CASE WHEN point_winner = 1 THEN 1 ELSE 0 END AS a, p2_points_pre + CASE WHEN point_winner = 2 THEN 1 ELSE 0 END AS b FROM w1),
w3 AS (SELECT *, CASE WHEN ends_game AND a >= 4 AND a - b >= 2 THEN 1 ELSE 0 END AS f1, CASE WHEN ends_game AND b >= 4 AND b - a >= 2 THEN 1 ELSE 0 END AS f2 FROM w2),
w4 AS (SELECT *,
   CAST(coalesce(sum(f1) OVER (PARTITION BY match_id, set_no ORDER BY game_no, point_number {upto}), 0) AS INT) AS p1_games_won,
   CAST(coalesce(sum(f2) OVER (PARTITION BY match_id, set_no ORDER BY game_no, point_number {upto}), 0) AS INT) AS p2_games_won FROM w3),
w5 AS (SELECT *, CASE WHEN ends_set AND p1_games_won + f1 > p2_games_won + f2 THEN 1 ELSE 0 END AS q1, CASE WHEN ends_set AND p2_games_won + f2 > p1_games_won + f1 THEN 1 ELSE 0 END AS q2 FROM w4),
st AS (SELECT *,
   CAST(coalesce(sum(q1) OVER (PARTITION BY match_id ORDER BY set_no, game_no, point_number {upto}), 0) AS INT) AS p1_sets_won,
   CAST(coalesce(sum(q2) OVER (PARTITION BY match_id ORDER BY set_no, game_no, point_number {upto}), 0) AS INT) AS p2_sets_won,
   p1_games_won = {tiebreak_at} AND p2_games_won = {tiebreak_at} AS is_tiebreak,
   CASE WHEN match_winner_code = 1 THEN player1 ELSE player2 END AS match_winner FROM w5)
"""


# Labels of a point from state columns; ``first``/``second`` are server and returner tokens.
LABELS_SQL = """
l1 AS (SELECT *,
   CASE WHEN is_tiebreak THEN CAST(p1_points_pre AS VARCHAR)
        WHEN p1_points_pre >= 3 AND p2_points_pre >= 3 THEN CASE WHEN p1_points_pre = p2_points_pre + 1 THEN 'AD' ELSE '40' END
        WHEN p1_points_pre = 0 THEN '0' WHEN p1_points_pre = 1 THEN '15' WHEN p1_points_pre = 2 THEN '30' ELSE '40' END AS one,
   CASE WHEN is_tiebreak THEN CAST(p2_points_pre AS VARCHAR)
        WHEN p1_points_pre >= 3 AND p2_points_pre >= 3 THEN CASE WHEN p2_points_pre = p1_points_pre + 1 THEN 'AD' ELSE '40' END
        WHEN p2_points_pre = 0 THEN '0' WHEN p2_points_pre = 1 THEN '15' WHEN p2_points_pre = 2 THEN '30' ELSE '40' END AS two
  FROM st),
lb AS (SELECT *, CASE WHEN point_server = 2 THEN two ELSE one END AS server_token, CASE WHEN point_server = 2 THEN one ELSE two END AS returner_token,
   CASE WHEN point_server = 2 THEN two || '-' || one ELSE one || '-' || two END AS score FROM l1)
"""
