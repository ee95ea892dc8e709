"""Queries on sources, sinks, dimensions, star joins and column tools."""

import uuid

from pyspark.sql import functions as F

from rallyframe.functions import cleaning
from rallyframe.functions.ids import best_of, literal_map, tour
from rallyframe.functions.names import (
    canonical_names,
    initial_form,
    iso2,
    latest_countries,
    recapitalise,
    winner_name,
    with_flags,
)
from rallyframe.functions.scores import by_code, score_labels, token_points
from rallyframe.operators import players as pl
from rallyframe.operators.filters import Filters, filter_options
from rallyframe.operators.ordered import with_row_ids
from rallyframe.operators.state import match_winner_codes, rebuild_state
from rallyframe.plans import star
from rallyframe.session import materialise, scratch_path
from rallyframe.sources import readers, writers
from rallyframe.sources.facts import save_facts
from workload import bindings as b
from workload.metric_queries import _DIM_SQL, _r, _rate_log, _variant_map, rounded

# ---- names and countries ------------------------------------------------


def _part_names(spark, sf):
    parts = b.table(spark, sf, "part").select(
        F.concat(
            "p_name", F.lit(" "), F.lower("p_brand"), F.lit("-"), "p_type",
            F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" o'"), F.lower("p_type"))).otherwise(""),
        ).alias("name")
    )
    return parts.unionByName(b.table(spark, sf, "customer").select(F.col("c_name").alias("name"))).distinct()


_PART_NAMES_SQL = """n AS (SELECT p_name || ' ' || lower(p_brand) || '-' || p_type || CASE WHEN p_partkey % 3 = 0 THEN ' o''' || lower(p_type) ELSE '' END AS name FROM part
  UNION SELECT c_name FROM customer)"""


def name_standardise(spark, sf):
    return _part_names(spark, sf).select(
        "name",
        initial_form("name").alias("short_or_null"),
        initial_form("name", single="keep").alias("short_or_same"),
        recapitalise("name").alias("recapitalised"),
        winner_name("name").alias("winner"),
    )


_CAP = "upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"
_SHORT = "substr(name, 1, 1) || '. ' || substr(name, position(' ' IN name) + 1)"
NAME_STANDARDISE = f"""WITH {_PART_NAMES_SQL}
SELECT name, CASE WHEN name LIKE '% %' THEN {_SHORT} END AS short_or_null, CASE WHEN name LIKE '% %' THEN {_SHORT} ELSE name END AS short_or_same,
 array_to_string(list_transform(string_split(name, ' '), lambda w, i: CASE WHEN i = 1 THEN w
   WHEN contains(w, '''') THEN array_to_string(list_transform(string_split(w, ''''), lambda v: {_CAP.format(w='v')}), '''')
   ELSE array_to_string(list_transform(string_split(w, '-'), lambda v: {_CAP.format(w='v')}), '-') END), ' ') AS recapitalised,
 array_to_string(list_transform(string_split(name, ' '), lambda w, i: CASE WHEN i = 1 AND name LIKE '% %' THEN w ELSE {_CAP.format(w='w')} END), ' ') AS winner
FROM n"""


def canonical_players(spark, sf):
    """Canonical names of all players, with the variant map read back from a JSON object file."""
    path = scratch_path(spark, "name-map")
    nation = b.table(spark, sf, "nation")
    # A name map is one JSON object in one file; this one has an entry per nation.
    pairs = F.collect_list(F.struct("n_name", F.concat(F.lit("Country "), F.col("n_nationkey").cast("string"))))
    nation.agg(F.to_json(F.map_from_entries(pairs)).alias("value")).write.text(path)
    name_map = readers.read_name_map(spark, path)
    customers = b.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    named = customers.join(nation, customers["c_nationkey"] == nation["n_nationkey"]).select(
        "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("Nowhere")).alias("player")
    )
    return canonical_names(named, name_map, ["player"])


CANONICAL_PLAYERS = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Country ' || CAST(n_nationkey AS VARCHAR) ELSE 'Nowhere' END AS player
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

_CODES = ["SUI", "GER", "ESP", "USA", "SRB", "POL", "FRA", "CHN", ""]


def country_enrich(spark, sf):
    m = F.col("m")
    rows = b.matches(spark, sf).select(
        tour().alias("tour"), "year", F.col("m").alias("row_no"), F.col("player1").alias("winner_name"),
        F.col("player2").alias("loser_name"), b._pick(m % 9, _CODES).alias("winner_ioc"),
        b._pick((m + 4) % 9, _CODES).alias("loser_ioc"),
    )
    stored = scratch_path(spark, "countries")
    writers.write_csv(latest_countries(rows, ["ATP", "WTA"]), stored)
    countries = readers.read_player_countries(spark, stored)
    names = pl.both_players(b.points(spark, sf))
    shown = names.withColumn("shown", F.col("player"))
    return with_flags(shown, countries, "shown").join(countries, "player", "left").withColumn("iso2", iso2("country"))


_PICK_CODE = "(['SUI', 'GER', 'ESP', 'USA', 'SRB', 'POL', 'FRA', 'CHN', ''])[CAST({i} % 9 AS INT) + 1]"
COUNTRY_ENRICH = f"""WITH {b.POINTS_SQL}, {b.MATCHES_SQL},
r AS (SELECT CASE WHEN {b.TOUR_SQL} = 'ATP' THEN 0 ELSE 1 END AS t, year, m, 0 AS side, player1 AS name, {_PICK_CODE.format(i='m')} AS ioc FROM mt
  UNION ALL SELECT CASE WHEN {b.TOUR_SQL} = 'ATP' THEN 0 ELSE 1 END, year, m, 1, player2, {_PICK_CODE.format(i='(m + 4)')} FROM mt),
o AS (SELECT substr(name, 1, 1) || '. ' || substr(name, position(' ' IN name) + 1) AS player, ioc, row_number() OVER (PARTITION BY substr(name, 1, 1) || '. ' || substr(name, position(' ' IN name) + 1) ORDER BY t DESC, year DESC, m DESC, side DESC) AS rn FROM r),
c AS (SELECT player, nullif(ioc, '') AS country FROM o WHERE rn = 1),
i AS (SELECT *, CASE country WHEN 'SUI' THEN 'CH' WHEN 'GER' THEN 'DE' WHEN 'SRB' THEN 'RS' WHEN 'POL' THEN 'PL' WHEN 'CHN' THEN 'CN' ELSE upper(substr(country, 1, 2)) END AS iso2 FROM c),
pl AS (SELECT DISTINCT unnest([player1, player2]) AS player FROM p)
SELECT pl.player, CASE WHEN country IS NOT NULL THEN chr(ascii(substr(iso2, 1, 1)) + 127397) || chr(ascii(substr(iso2, 2, 1)) + 127397) || ' ' || pl.player ELSE pl.player END AS shown,
  country, iso2 FROM pl LEFT JOIN i ON i.player = pl.player"""


# ---- dimensions and star tables ----------------------------------------


def _dimensions(spark, sf):
    """Matches, players and events; the latter two are written once, since each is read for several roles."""
    games = b.matches(spark, sf)
    players = materialise(with_row_ids(star.dim_player(games), ["player_name_clean"], "player_id"))
    events = materialise(with_row_ids(star.dim_event(games), ["slam", "year"], "event_id"))
    return games, players, events


def event_match_dims(spark, sf):
    games, players, events = _dimensions(spark, sf)
    return with_row_ids(star.dim_match(games, players, events), ["match_id"], "match_key")


_SHORT_OF = "substr({c}, 1, 1) || '. ' || substr({c}, position(' ' IN {c}) + 1)"
_DIMS_SQL = f"""pn AS (SELECT DISTINCT {_SHORT_OF.format(c='nm')} AS clean FROM (SELECT unnest([player1, player2]) AS nm FROM mt)),
dp AS (SELECT clean, row_number() OVER (ORDER BY clean) AS player_id FROM pn),
de AS (SELECT slam, year, row_number() OVER (ORDER BY slam, year) AS event_id FROM (SELECT DISTINCT slam, year FROM mt)),
dm AS (SELECT row_number() OVER (ORDER BY match_id) AS match_key, match_id, event_id, a.player_id AS player1_id, c.player_id AS player2_id, round, {b.TOUR_DIGITS_SQL} AS tour
  FROM mt LEFT JOIN de USING (slam, year) LEFT JOIN dp a ON a.clean = {_SHORT_OF.format(c='mt.player1')} LEFT JOIN dp c ON c.clean = {_SHORT_OF.format(c='mt.player2')})"""
EVENT_MATCH_DIMS = f"WITH {b.MATCHES_SQL}, {_DIMS_SQL} SELECT * FROM dm"


def fact_points(spark, sf):
    games, players, events = _dimensions(spark, sf)
    dims = star.dim_match(games, players, events)
    log = b.points(spark, sf).select("match_id", "point_number", "point_server", "point_winner")
    facts = star.fact_points(log, dims)
    return facts.select("match_id", "point_number", "server_id", "returner_id", "point_winner_id")


FACT_POINTS = f"""WITH {b.POINTS_SQL}, {b.MATCHES_SQL}, {_DIMS_SQL}
SELECT p.match_id, point_number, CASE point_server WHEN 1 THEN player1_id ELSE player2_id END AS server_id,
  CASE point_server WHEN 1 THEN player2_id ELSE player1_id END AS returner_id, CASE point_winner WHEN 1 THEN player1_id ELSE player2_id END AS point_winner_id
FROM p JOIN dm ON dm.match_id = p.match_id"""


def fact_rates(spark, sf):
    """Fact points joined with the rates of server and returner by their ids."""
    games, players, events = _dimensions(spark, sf)
    log = b.points(spark, sf).select("match_id", "point_number", "point_server", "point_winner")
    fact = star.fact_points(pl.with_serve_outcome(log), materialise(star.dim_match(games, players, events)))
    # A rate of fewer than 40 points is not used, so some ids have none.
    known = fact.groupBy(F.col("server_id").alias("player")).count().filter("count >= 40").select("player")
    rates = pl.player_rates(fact, "server_id", "returner_id").join(known, "player")
    rated = star.fact_with_rates(fact, rates)
    columns = [f"{r}_{k}_point_win_pct" for r in ("server", "returner") for k in ("serve", "return")]
    return rounded(rated.select("match_id", "point_number", "server_id", "returner_id", *columns), *columns)


FACT_RATES = f"""WITH {b.POINTS_SQL}, {b.MATCHES_SQL}, {_DIMS_SQL},
fp AS (SELECT p.match_id, point_number, CASE point_server WHEN 1 THEN player1_id ELSE player2_id END AS server_id,
  CASE point_server WHEN 1 THEN player2_id ELSE player1_id END AS returner_id, CASE WHEN point_server = point_winner THEN 1e0 ELSE 0e0 END AS w FROM p JOIN dm ON dm.match_id = p.match_id),
sv AS (SELECT server_id AS id, avg(w) AS s FROM fp GROUP BY 1 HAVING count(*) >= 40), rv AS (SELECT returner_id AS id, avg(1 - w) AS r FROM fp GROUP BY 1)
SELECT fp.match_id, point_number, server_id, returner_id, {_r('coalesce(a.s, 62e-2)', 'server_serve_point_win_pct')}, {_r('CASE WHEN a.id IS NULL THEN 38e-2 ELSE coalesce(ar.r, 38e-2) END', 'server_return_point_win_pct')},
  {_r('coalesce(c.s, 62e-2)', 'returner_serve_point_win_pct')}, {_r('CASE WHEN c.id IS NULL THEN 38e-2 ELSE coalesce(cr.r, 38e-2) END', 'returner_return_point_win_pct')}
FROM fp LEFT JOIN sv a ON a.id = server_id LEFT JOIN rv ar ON ar.id = server_id LEFT JOIN sv c ON c.id = returner_id LEFT JOIN rv cr ON cr.id = returner_id"""


def points_with_matches(spark, sf):
    """Points with their match's attributes; matches of one tournament only, so some points have none."""
    games = b.matches(spark, sf).filter(F.col("slam") != "usopen")
    log = b.points(spark, sf).select("match_id", "point_number")
    picked = games.select("match_id", F.col("player1").alias("full1"), F.col("round").alias("event_round"))
    return log.join(picked, "match_id", "left")


POINTS_WITH_MATCHES = f"""WITH {b.POINTS_SQL}, {b.MATCHES_SQL}
SELECT p.match_id, p.point_number, mt.player1 AS full1, mt.round AS event_round FROM p LEFT JOIN mt ON mt.match_id = p.match_id AND mt.slam <> 'usopen'"""


def _star_log(spark, sf):
    log = rebuild_state(_rate_log(spark, sf)).withColumns(score_labels())
    winner = F.when(F.col("match_winner_code") == 1, F.col("player1")).otherwise(F.col("player2"))
    return log.withColumns({"match_winner": winner, "best_of": best_of()})


_STAR_SQL = f"""WITH {b.SCORES_SQL}, {b.state_sql('s')}, {b.LABELS_SQL},
sl AS (SELECT lb.*, CASE tour WHEN 'ATP' THEN 5 ELSE 3 END AS best_of FROM lb),
md AS (SELECT row_number() OVER (ORDER BY match_id) AS match_key, * FROM (SELECT DISTINCT match_id, tour, tournament_name, year, player1, player2, best_of, round, points_stake, match_winner FROM sl)),
pd AS (SELECT row_number() OVER (ORDER BY match_id, point_number) AS point_id, match_id, point_number, point_winner, point_server, p1_sets_won, p2_sets_won, p1_games_won, p2_games_won,
  server_token AS p1_score, returner_token AS p2_score, one || '-' || two AS score, server_name, returner_name, is_tiebreak FROM sl),
pp AS (SELECT row_number() OVER (ORDER BY match_id, point_number) AS point_id, match_id, point_number, p1_win_prob_before, p1_win_prob_if_p1_wins, p1_win_prob_if_p2_wins, importance, p1_wp_delta, p2_wp_delta FROM sl),
events_log AS (SELECT year FROM sl)"""
_PROBS = ["p1_win_prob_before", "p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins", "importance", "p1_wp_delta", "p2_wp_delta"]
_PROBS_SQL = ", ".join(_r(c) for c in _PROBS)


def match_detail(spark, sf):
    return star.match_detail(_star_log(spark, sf))


def point_detail(spark, sf):
    return star.point_detail(_star_log(spark, sf))


def point_probability(spark, sf):
    return rounded(star.point_probability(b.scores(spark, sf)), *_PROBS)


def player_detail(spark, sf):
    log = _rate_log(spark, sf)
    return rounded(star.player_detail(log, _variant_map(log)), "serve_pct", "return_pct")


PLAYER_DETAIL = f"""{_STAR_SQL}, {_DIM_SQL}
SELECT row_number() OVER (ORDER BY player) AS player_id, player, tour, serve_pct, return_pct, player_status FROM dim"""


def star_join_results(spark, sf):
    # The scored log is written once, by year and tour; its matches and players once from there.
    stored = scratch_path(spark, "scored")
    writers.write_parquet(_star_log(spark, sf), stored, ("year", "tour"))
    log = readers.read_parquet(spark, stored)
    matches = materialise(star.match_detail(log, key=False))
    names = _variant_map(matches)
    players = materialise(pl.player_dimension(log, names))
    chosen = Filters(years=(2021, 2023, 2024), tour="ATP", tournament="All", status="Active")
    joined = star.star_join(star.wide_facts(log), matches, players, chosen, "results", name_map=names)
    return rounded(joined, *_PROBS)


_STAR_RESULTS = f"""{_STAR_SQL}, {_DIM_SQL},
mc AS (SELECT md.* REPLACE (replace(player1, 'o''neil', 'O''Neil') AS player1, replace(player2, 'o''neil', 'O''Neil') AS player2) FROM md)
SELECT pd.match_id, mc.player1, mc.player2, mc.year, pd.point_winner, pd.point_server, pd.server_name, pd.returner_name, {_PROBS_SQL}, mc.points_stake, mc.tour, mc.tournament_name, mc.match_winner,
  pd.p1_sets_won, pd.p2_sets_won, pd.p1_games_won, pd.p2_games_won, pd.score, pd.point_number
FROM pd JOIN mc USING (match_id) JOIN pp USING (match_id, point_number) JOIN dim d1 ON d1.player = mc.player1 JOIN dim d2 ON d2.player = mc.player2
WHERE mc.year IN (2021, 2023, 2024) AND (d1.player_status = 'Active' OR d2.player_status = 'Active')"""
STAR_JOIN_RESULTS = f"{_STAR_RESULTS} AND mc.tour = 'ATP'"
STORED_STAR_JOIN = f"{_STAR_RESULTS} AND mc.tournament_name = 'US Open'"


ORDER = ["set_no", "game_no", "point_number"]


def stored_star_join(spark, sf):
    """The star join over facts and matches bucketed by match; the choice of a tournament prunes years and tours."""
    facts = save_facts(
        star.wide_facts(_star_log(spark, sf)), f"facts_{uuid.uuid4().hex}", 8, ["point_number"], path=scratch_path(spark, "facts")
    )
    log = _rate_log(spark, sf)
    codes = match_winner_codes(log)
    games = log.select("match_id", "year", "tour", "tournament_name", "player1", "player2", "round", "points_stake").distinct()
    winner = by_code("match_winner_code", "player1", "player2")
    matches = save_facts(
        games.join(codes, "match_id", "left").withColumn("match_winner", winner).drop("match_winner_code"),
        f"matches_{uuid.uuid4().hex}", 8, partition_by=(), path=scratch_path(spark, "matches"),
    )
    names = _variant_map(matches)
    players = materialise(pl.player_dimension(log, names))
    chosen = Filters(years=(2021, 2023, 2024), tournament="US Open", status="Active")
    return rounded(star.star_join(facts, matches, players, chosen, "results", name_map=names), *_PROBS)


def stored_state(spark, sf):
    """Games, sets and match winner rebuilt over points bucketed by match: no point moves."""
    points = save_facts(
        b.points(spark, sf).withColumn("tour", tour()), f"points_{uuid.uuid4().hex}", 8, ORDER, path=scratch_path(spark, "points")
    )
    state = rebuild_state(points)
    return state.select(
        "match_id", "set_no", "game_no", "point_number", "p1_games_won", "p2_games_won", "p1_sets_won", "p2_sets_won",
        by_code("match_winner_code", "player1", "player2").alias("match_winner"),
    )


STORED_STATE = f"""WITH {b.POINTS_SQL}, {b.state_sql('p')}
SELECT match_id, set_no, game_no, point_number, p1_games_won, p2_games_won, p1_sets_won, p2_sets_won, match_winner FROM st"""


def star_join_filtered(spark, sf):
    """The star join on order lines, orders and customers, summed per year and segment."""
    orders, customers = b.table(spark, sf, "orders"), b.table(spark, sf, "customer")
    # The years as a range of dates, which the scan can use.
    games = orders.filter("o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'").select(
        F.col("o_orderkey").alias("match_id"), F.year("o_orderdate").alias("year"),
        F.col("o_orderpriority").alias("tour"), F.col("o_orderstatus").alias("tournament_name"),
        F.col("o_custkey").alias("player1"), (F.col("o_custkey") + 1).alias("player2"),
    )
    status = F.when(F.col("c_acctbal") > 4000, "Active").otherwise("Inactive")
    people = customers.select(F.col("c_custkey").alias("player"), status.alias("player_status"))
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), "l_quantity", "l_extendedprice", "l_returnflag"
    )
    chosen = Filters(years=(1996, 1997, 1998), tour="1-URGENT", tournament="F", status="Active")
    joined = star.star_join(
        lines, games, people, chosen, ["year", "l_returnflag", "l_quantity", "l_extendedprice"]
    )
    return joined.groupBy("year", "l_returnflag").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("price"),
    )


STAR_JOIN_FILTERED = """SELECT CAST(extract(year FROM o_orderdate) AS INT) AS year, l_returnflag, count(*) AS lines, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer a ON a.c_custkey = o_custkey JOIN customer c ON c.c_custkey = o_custkey + 1
WHERE extract(year FROM o_orderdate) IN (1996, 1997, 1998) AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND (a.c_acctbal > 4000 OR c.c_acctbal > 4000) GROUP BY 1, 2"""


def supplier_part_rates(spark, sf):
    """Serve and return rates with suppliers serving to parts; a line counts as won when not returned."""
    won = F.col("l_returnflag") == "N"
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("server_name"), F.col("l_partkey").alias("returner_name"),
        won.alias("server_win"), (~won).alias("returner_win"),
    )
    return rounded(
        pl.combine_stats(pl.serve_stats(lines), pl.return_stats(lines)), "serve_point_win_pct", "return_point_win_pct"
    )


SUPPLIER_PART_RATES = f"""WITH a AS (SELECT l_suppkey AS player, count(*) FILTER (WHERE l_returnflag = 'N') AS w, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT l_partkey AS player, count(*) FILTER (WHERE l_returnflag <> 'N') AS w, count(*) AS n FROM lineitem GROUP BY 1)
SELECT coalesce(a.player, c.player) AS player, a.w AS serve_points_won, a.n AS serve_points_total, {_r('a.w / a.n', 'serve_point_win_pct')},
  c.w AS return_points_won, c.n AS return_points_total, {_r('c.w / c.n', 'return_point_win_pct')} FROM a FULL JOIN c ON a.player = c.player"""


def filter_options_query(spark, sf):
    log = _rate_log(spark, sf)
    games = log.select("match_id", "year", "tour", "tournament_name").distinct()
    return filter_options(games, pl.player_dimension(log, _variant_map(log)))


FILTER_OPTIONS = f"""WITH {b.SCORES_SQL}, events_log AS (SELECT year FROM s), {_DIM_SQL}
SELECT 'tournament' AS option, tournament_name AS value FROM s UNION SELECT 'tour', tour FROM s UNION SELECT 'year', CAST(year AS VARCHAR) FROM s UNION SELECT 'status', player_status FROM dim"""


# ---- column tools -------------------------------------------------------


def column_tools(spark, sf):
    lines = cleaning.drop_present(b.table(spark, sf, "lineitem"), "l_shipdate", "ElapsedTime")
    packed = cleaning.pack(lines, "money", ["l_extendedprice", "l_discount", "l_tax"]).drop(
        "l_extendedprice", "l_discount", "l_tax"
    )
    opened = cleaning.unpack(packed, "money")
    groups = {"base": ["l_orderkey", "l_linenumber"], "money": ["l_extendedprice", "l_discount"]}
    return cleaning.select_ordered(opened, groups["base"], groups["money"], ["l_orderkey", "l_tax", "l_quantity"])


COLUMN_TOOLS = "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_quantity FROM lineitem"


def native_udf_twins(spark, sf):
    """Expressions standing in for per-row functions: short name, tour class, score points."""
    customers = b.table(spark, sf, "customer").select(
        "c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("name"), "c_nationkey"
    )
    orders = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderpriority") < "3", "ATP").otherwise("WTA").alias("tour")
    )
    classes = pl.classify_tours(orders, "c_custkey").select("c_custkey", F.col("tour").alias("tour_class"))
    token = literal_map({0: "0", 1: "15", 2: "30", 3: "40", 4: "AD", 5: "7"})[(F.col("c_nationkey") % 6)]
    return (
        customers.join(classes, "c_custkey", "left")
        .withColumn("token", token)
        .select(
            "c_custkey", initial_form("name").alias("short_name"), "tour_class",
            token_points("token").alias("token_points"), token_points("token", None).alias("known_points"),
        )
    )


NATIVE_UDF_TWINS = """WITH t AS (SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority < '3') > 1 THEN 'Both' WHEN bool_and(o_orderpriority < '3') THEN 'ATP' ELSE 'WTA' END AS tour_class FROM orders GROUP BY 1)
SELECT c_custkey, substr(c_mktsegment, 1, 1) || '. ' || c_name AS short_name, tour_class,
  CAST(CASE WHEN c_nationkey % 6 = 5 THEN 0 ELSE c_nationkey % 6 END AS INT) AS token_points, CAST(CASE WHEN c_nationkey % 6 < 5 THEN c_nationkey % 6 END AS INT) AS known_points
FROM customer LEFT JOIN t ON o_custkey = c_custkey"""


# ---- sources and sinks --------------------------------------------------

_LOG_DDL = "match_id string, year int, set_no int, game_no int, point_number bigint, point_server int, point_winner int, player1 string, player2 string, value double"
_LOG = [part.split()[0] for part in _LOG_DDL.split(", ")]
_LOG_SQL = f"WITH {b.POINTS_SQL} SELECT {', '.join(_LOG)} FROM p"


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "log-csv")
    writers.write_sorted_csv(b.points(spark, sf).select(*_LOG), path, ["match_id", "set_no", "point_number"])
    return readers.read_parts(spark, path, _LOG_DDL)


def parquet_roundtrip(spark, sf):
    path = scratch_path(spark, "log-parquet")
    writers.write_parquet(b.points(spark, sf).select(*_LOG), path)
    view = f"log_{uuid.uuid4().hex}"
    writers.register(readers.read_parquet(spark, path), view)
    back = spark.sql(f"SELECT {', '.join(_LOG)} FROM {view}")
    spark.catalog.dropTempView(view)
    return back


PARQUET_ROUNDTRIP = _LOG_SQL


def parquet_pruned(spark, sf):
    """The years from 2021 of the stored log: the filter reaches the partition folders."""
    path = scratch_path(spark, "log-parquet")
    writers.write_parquet(b.points(spark, sf).select(*_LOG), path)
    return readers.read_parquet(spark, path).select(*_LOG).filter("year >= 2021")


PARQUET_PRUNED = f"{_LOG_SQL} WHERE year >= 2021"


def union_sources(spark, sf):
    """One raw file per year, written and read back as one log; 2019 has no file."""
    folder = scratch_path(spark, "raw")
    log = b.points(spark, sf)
    columns = ["match_id", "set_no", "game_no", "point_number", "point_winner", "point_server"]
    # One pass over the log, then one file per year from its partition.
    by_year = f"{folder}-years"
    writers.write_parquet(log.select("year", *columns), by_year)
    for year in range(2020, 2025):
        own = readers.read_parquet(spark, by_year).filter(F.col("year") == year).select(*columns)
        writers.write_csv(own, f"{folder}/{year}-slam-points.csv")
    ddl = "match_id string, set_no int, game_no int, point_number bigint, point_winner int, point_server int"
    return readers.read_raw(spark, f"{folder}/*-points.csv", ddl, years=list(range(2019, 2025)))


UNION_SOURCES = f"""WITH {b.POINTS_SQL} SELECT match_id, set_no, game_no, point_number, point_winner, point_server, 'slam' AS tournament, year
FROM p"""


def table_lifecycle(spark, sf):
    """Create a table, add columns, append rows with them, and read a key range back."""
    name = f"customers_{uuid.uuid4().hex}"
    source = b.table(spark, sf, "customer")
    base = source.select("c_custkey", "c_name")
    writers.save_table(base, name, scratch_path(spark, "table"))
    writers.add_columns(spark, name, {"points_won": "bigint", "rate": "double"})
    later = source.select(
        "c_custkey", "c_name", F.col("c_nationkey").cast("bigint").alias("points_won"), F.col("c_acctbal").alias("rate")
    ).filter(F.col("c_nationkey") > 20)
    later.write.mode("append").insertInto(name)
    merged = spark.table(name)
    earlier = merged.filter(F.col("points_won").isNull()).select("c_custkey", "c_name")
    return writers.key_range(earlier.unionByName(merged.filter("points_won IS NOT NULL"), allowMissingColumns=True), "c_custkey", 100, 900)


TABLE_LIFECYCLE = """SELECT c_custkey, c_name, CAST(NULL AS BIGINT) AS points_won, CAST(NULL AS DOUBLE) AS rate FROM customer WHERE c_custkey BETWEEN 100 AND 900
UNION ALL SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT), c_acctbal FROM customer WHERE c_nationkey > 20 AND c_custkey BETWEEN 100 AND 900"""


def schema_generations(spark, sf):
    """One folder written three times, each time with more columns or wider types, read as one table."""
    path = scratch_path(spark, "generations")
    source = b.table(spark, sf, "customer").withColumn("third", F.col("c_custkey") % 3)
    first = source.filter("third = 0").select(
        F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", F.struct(F.col("c_nationkey").cast("smallint").alias("nation")).alias("home")
    )
    second = source.filter("third = 1").select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("points_won"),
        F.struct(F.col("c_nationkey").cast("int").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("home"),
    )
    third = source.filter("third = 2").select(
        F.col("c_custkey").cast("int").alias("c_custkey"), (F.col("c_nationkey") / 4).alias("points_won"), F.col("c_acctbal").alias("rate")
    )
    for part in (first, second, third):
        part.write.mode("append").parquet(path)
    return readers.read_merged(spark, path).select(
        "c_custkey", "c_name", F.col("home.nation").alias("nation"), F.col("home.segment").alias("segment"), "points_won", "rate"
    )


SCHEMA_GENERATIONS = """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE WHEN c_custkey % 3 < 2 THEN c_name END AS c_name,
  CASE WHEN c_custkey % 3 < 2 THEN CAST(c_nationkey AS INT) END AS nation, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS segment,
  CASE c_custkey % 3 WHEN 1 THEN CAST(c_nationkey AS DOUBLE) WHEN 2 THEN c_nationkey / 4 END AS points_won,
  CASE WHEN c_custkey % 3 = 2 THEN c_acctbal END AS rate FROM customer"""


def table_preview(spark, sf):
    """First rows by key of two stored tables."""
    out = None
    for source, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        name = f"{source}_{uuid.uuid4().hex}"
        keys = b.table(spark, sf, source).select(F.lit(source).alias("source"), F.col(key).alias("row_key"))
        writers.save_table(keys.orderBy("row_key").limit(10), name, scratch_path(spark, "preview"))
        rows = writers.preview(spark, [name])[name]
        out = rows if out is None else out.unionByName(rows)
    return out


TABLE_PREVIEW = """SELECT * FROM (SELECT 'orders' AS source, o_orderkey AS row_key FROM orders ORDER BY 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'part', p_partkey FROM part ORDER BY 2 LIMIT 10)"""


def _game_totals(log):
    return log.groupBy("match_id", "set_no", "game_no").agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("point_winner") == 1).alias("p1_points")
    )


def chunked_build(spark, sf):
    """A result built in eight match buckets; one bucket is computed again afterwards."""
    path = scratch_path(spark, "chunks")
    log = b.points(spark, sf)
    writers.build_by_bucket(log, path, "match_id", 8, _game_totals)
    again = writers.build_by_bucket(log, path, "match_id", 8, _game_totals, only=[3])
    return again.drop("bucket")


CHUNKED_BUILD = f"""WITH {b.POINTS_SQL} SELECT match_id, set_no, game_no, count(*) AS points, count(*) FILTER (WHERE point_winner = 1) AS p1_points FROM p GROUP BY 1, 2, 3"""


QUERIES = {
    "name_standardise": (name_standardise, NAME_STANDARDISE),
    "canonical_players": (canonical_players, CANONICAL_PLAYERS),
    "country_enrich": (country_enrich, COUNTRY_ENRICH),
    "event_match_dims": (event_match_dims, EVENT_MATCH_DIMS),
    "fact_points": (fact_points, FACT_POINTS),
    "fact_rates": (fact_rates, FACT_RATES),
    "points_with_matches": (points_with_matches, POINTS_WITH_MATCHES),
    "match_detail": (match_detail, f"{_STAR_SQL} SELECT * FROM md"),
    "point_detail": (point_detail, f"{_STAR_SQL} SELECT * FROM pd"),
    "point_probability": (point_probability, f"{_STAR_SQL} SELECT point_id, match_id, point_number, {_PROBS_SQL} FROM pp"),
    "player_detail": (player_detail, PLAYER_DETAIL),
    "star_join_results": (star_join_results, STAR_JOIN_RESULTS),
    "star_join_filtered": (star_join_filtered, STAR_JOIN_FILTERED),
    "stored_star_join": (stored_star_join, STORED_STAR_JOIN),
    "stored_state": (stored_state, STORED_STATE),
    "supplier_part_rates": (supplier_part_rates, SUPPLIER_PART_RATES),
    "filter_options": (filter_options_query, FILTER_OPTIONS),
    "column_tools": (column_tools, COLUMN_TOOLS),
    "native_udf_twins": (native_udf_twins, NATIVE_UDF_TWINS),
    "csv_roundtrip": (csv_roundtrip, _LOG_SQL),
    "parquet_roundtrip": (parquet_roundtrip, PARQUET_ROUNDTRIP),
    "parquet_pruned": (parquet_pruned, PARQUET_PRUNED),
    "union_sources": (union_sources, UNION_SOURCES),
    "table_lifecycle": (table_lifecycle, TABLE_LIFECYCLE),
    "schema_generations": (schema_generations, SCHEMA_GENERATIONS),
    "table_preview": (table_preview, TABLE_PREVIEW),
    "chunked_build": (chunked_build, CHUNKED_BUILD),
}
