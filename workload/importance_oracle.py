"""DuckDB oracle for exact match-win probabilities: forward propagation of probability mass.

The Spark side works backwards over a table of states per pair of players. Here every
state reached after a game spreads its mass over all continuations, game by game, until
only finished matches are left; tiebreaks likewise point by point.
"""


def _settle(rules):
    """Set and game columns after a game brought the score to (x, y), server ``t`` next."""
    won, lost = "(x >= 6 AND x - y >= 2)", "(y >= 6 AND y - x >= 2)"
    if rules == "standard":
        won, lost = f"({won} OR (x = 7 AND y = 6))", f"({lost} OR (y = 7 AND x = 6))"
    over = f"({won} OR {lost})"
    cut = "greatest(least(x, y) - 7, 0)"
    return f"""CASE WHEN {won} THEN s1 + 1 ELSE s1 END AS s1, CASE WHEN {lost} THEN s2 + 1 ELSE s2 END AS s2,
      CASE WHEN {over} THEN 0 WHEN least(x, y) >= 6 AND x = y + 1 THEN 8 WHEN least(x, y) >= 6 AND y = x + 1 THEN 7 ELSE x - {cut} END AS g1,
      CASE WHEN {over} THEN 0 WHEN least(x, y) >= 6 AND x = y + 1 THEN 7 WHEN least(x, y) >= 6 AND y = x + 1 THEN 8 ELSE y - {cut} END AS g2, t"""


def importance_sql(prefix, hold, rules):
    """``prefix`` ends with x1: points with x, pa/pb columns, state and labels; ``hold(a, b)`` gives game chances."""
    standard = rules == "standard"
    a, b = ("p1_points_pre", "p2_points_pre") if standard else ("tok1", "tok2")
    serve = "((n + 1) // 2) % 2 = 0" if standard else "((n + 3) // 4) % 2 = 0"
    before, up, down = (a, b), (f"({a} + 1)", b), (a, f"({b} + 1)")
    starter = f"CASE WHEN (({a} + {b} + 1) // 2) % 2 = 0 THEN point_server ELSE 3 - point_server END"
    entries = ["SELECT match_id, pa, pb, 1 AS starter, 0 AS a0, 0 AS b0 FROM pr", "SELECT match_id, pa, pb, 2, 0, 0 FROM pr"]
    if standard:
        entries += [
            f"SELECT match_id, p1_serve_prob, p2_serve_prob, {starter}, {i}, {j} FROM x2 WHERE six" for i, j in (before, up, down)
        ]
    key = "t{k}.match_id = x2.match_id AND t{k}.starter = {starter} AND t{k}.a0 = {i} AND t{k}.b0 = {j}"
    joins = []
    for k, (i, j) in enumerate((before, up, down)):
        at = dict(k=k, starter=starter, i=i, j=j) if standard else dict(k=k, starter="point_server", i=0, j=0)
        joins.append(f"LEFT JOIN tb t{k} ON six AND {key.format(**at)}")
    chances = [f"CASE WHEN six THEN t{k}.p ELSE {hold(i, j, rules)} END AS h{k}" for k, (i, j) in enumerate((before, up, down))]
    result = lambda h: f"{h} * vw.p + (1 - {h}) * vl.p"
    names = ["p1_win_prob_before", "p1_win_prob_if_p1_wins", "p1_win_prob_if_p2_wins"]
    columns = ", ".join(f"{result(f'h{k}')} AS {n}" for k, n in enumerate(names))
    done = "s1 >= need" if standard else "s1 = need"
    delta = f"CASE WHEN point_winner = 1 THEN {names[1]} - {names[0]} ELSE {names[2]} - {names[0]} END"
    return f"""{prefix.replace('WITH ', 'WITH RECURSIVE ', 1)},
x2 AS (SELECT x1.*, CAST(CASE server_token WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 WHEN 'AD' THEN 4 ELSE 0 END AS INT) AS tok1,
  CAST(CASE returner_token WHEN '15' THEN 1 WHEN '30' THEN 2 WHEN '40' THEN 3 WHEN 'AD' THEN 4 ELSE 0 END AS INT) AS tok2,
  CASE tour WHEN 'ATP' THEN 3 ELSE 2 END AS need, p1_games_won = 6 AND p2_games_won = 6 AS six FROM x1),
pr AS (SELECT DISTINCT match_id, need, p1_serve_prob AS pa, p2_serve_prob AS pb FROM x2),
hold1 AS (SELECT match_id, {hold('0', '0', rules)} AS u FROM (SELECT match_id, pa AS x FROM pr)),
hold2 AS (SELECT match_id, {hold('0', '0', rules)} AS l FROM (SELECT match_id, 1 - pb AS x FROM pr)),
te AS (SELECT DISTINCT * FROM ({' UNION ALL '.join(entries)})),
tw AS (SELECT *, a0 AS i, b0 AS j, a0 + b0 AS n, 1e0 AS mass FROM te
  UNION ALL
  SELECT match_id, pa, pb, starter, a0, b0, i - greatest(least(i, j) - 6, 0) AS i, j - greatest(least(i, j) - 6, 0) AS j, n, sum(mass) FROM (
    SELECT match_id, pa, pb, starter, a0, b0, i + d AS i, j + 1 - d AS j, n + 1 AS n,
      mass * CASE WHEN d = 1 THEN q ELSE 1 - q END AS mass
    FROM (SELECT *, CASE WHEN ({serve}) = (starter = 1) THEN pa ELSE 1 - pb END AS q FROM tw) w, (SELECT unnest([0, 1]) AS d) two
    WHERE NOT (greatest(i, j) >= 7 AND abs(i - j) >= 2) AND mass > 1e-14) e GROUP BY ALL),
tb AS (SELECT match_id, starter, a0, b0, sum(CASE WHEN i > j THEN mass ELSE 0 END) AS p FROM tw WHERE greatest(i, j) >= 7 AND abs(i - j) >= 2 GROUP BY ALL),
cp AS (SELECT pr.match_id, need, u, l, ta.p AS t1, tc.p AS t2 FROM pr JOIN hold1 USING (match_id) JOIN hold2 USING (match_id)
  JOIN tb ta ON ta.match_id = pr.match_id AND ta.starter = 1 AND ta.a0 = 0 AND ta.b0 = 0
  JOIN tb tc ON tc.match_id = pr.match_id AND tc.starter = 2 AND tc.a0 = 0 AND tc.b0 = 0),
go AS (SELECT DISTINCT match_id, p1_sets_won AS s1, p2_sets_won AS s2, p1_games_won AS g1, p2_games_won AS g2, 3 - point_server AS t FROM x2),
gs AS (SELECT match_id, o, {_settle(rules)} FROM (
   SELECT match_id, s1, s2, g1 + d AS x, g2 + 1 - d AS y, t, struct_pack(s1 := s1, s2 := s2, g1 := g1, g2 := g2, t := t, d := d) AS o FROM go, (SELECT unnest([0, 1]) AS d) two)),
ge AS (SELECT DISTINCT match_id, s1, s2, g1, g2, t FROM gs),
gw AS (SELECT match_id, row(s1, s2, g1, g2, t) AS k, s1, s2, g1, g2, t, need, u, l, t1, t2, 1e0 AS mass FROM ge JOIN cp USING (match_id)
  UNION ALL
  SELECT match_id, k, s1, s2, g1, g2, t, need, u, l, t1, t2, sum(mass) FROM (
    SELECT match_id, k, {_settle(rules)}, need, u, l, t1, t2, mass FROM (
      SELECT match_id, k, s1, s2, need, u, l, t1, t2,
        CASE WHEN g1 = 7 AND g2 = 7 THEN 8 * d ELSE g1 + d END AS x, CASE WHEN g1 = 7 AND g2 = 7 THEN 8 - 8 * d ELSE g2 + 1 - d END AS y,
        CASE WHEN g1 = 7 AND g2 = 7 THEN t ELSE 3 - t END AS t, mass * CASE WHEN d = 1 THEN q ELSE 1 - q END AS mass
      FROM (SELECT *, CASE WHEN g1 = 7 AND g2 = 7 THEN u * l / (u * l + (1 - u) * (1 - l)) WHEN g1 = 6 AND g2 = 6 THEN CASE t WHEN 1 THEN t1 ELSE t2 END WHEN t = 1 THEN u ELSE l END AS q
            FROM gw WHERE s1 < need AND s2 < need) w, (SELECT unnest([0, 1]) AS d) two) e) f GROUP BY ALL),
mv AS (SELECT match_id, k, sum(CASE WHEN s1 >= need THEN mass ELSE 0 END) AS p FROM gw WHERE s1 >= need OR s2 >= need GROUP BY ALL),
ov AS (SELECT gs.match_id, gs.o, mv.p FROM gs JOIN mv ON mv.match_id = gs.match_id AND mv.k = row(gs.s1, gs.s2, gs.g1, gs.g2, gs.t)),
y0 AS (SELECT x2.*, {', '.join(chances)} FROM x2 {' '.join(joins)}),
y1 AS (SELECT y0.*, CASE WHEN p1_sets_won >= need OR p2_sets_won >= need THEN CASE WHEN {done.replace('s1', 'p1_sets_won')} THEN 1e0 ELSE 0e0 END END AS over,
  struct_pack(s1 := p1_sets_won, s2 := p2_sets_won, g1 := p1_games_won, g2 := p2_games_won, t := 3 - point_server, d := 1) AS ow,
  struct_pack(s1 := p1_sets_won, s2 := p2_sets_won, g1 := p1_games_won, g2 := p2_games_won, t := 3 - point_server, d := 0) AS ol FROM y0),
y2 AS (SELECT y1.* EXCLUDE (p1_win_prob_before, p1_win_prob_if_p1_wins, p1_win_prob_if_p2_wins, importance), {columns.replace('vw.p', 'coalesce(over, vw.p)').replace('vl.p', 'coalesce(over, vl.p)')}
  FROM y1 JOIN ov vw ON vw.match_id = y1.match_id AND vw.o = y1.ow JOIN ov vl ON vl.match_id = y1.match_id AND vl.o = y1.ol)
SELECT match_id, set_no, game_no, point_number, {', '.join(f'round({n}, 6) + 0e0 AS {n}' for n in names)},
  round(abs({names[1]} - {names[2]}), 6) + 0e0 AS importance, round({delta}, 6) + 0e0 AS p1_wp_delta, round(-({delta}), 6) + 0e0 AS p2_wp_delta,
  round(CASE WHEN match_winner = player1 THEN {names[0]} ELSE {names[2]} END, 6) + 0e0 AS match_winner_prob_before, '' AS error FROM y2"""
