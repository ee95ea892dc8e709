"""Tables bucketed by match and pruned by year and tour: plans without an exchange of points, equal results."""

import pytest
from pyspark.sql import functions as F

from rallyframe.operators.filters import Filters
from rallyframe.operators.state import carried_state, rebuild_state, with_match_winner
from rallyframe.plans import star
from rallyframe.sources.facts import bucketable, pruned_by, save_facts

ORDER = ["set_no", "game_no", "point_number"]
DDL = (
    "match_id string, year int, tour string, set_no int, game_no int, point_number bigint, point_server int, "
    "point_winner int, player1 string, player2 string"
)


def points(spark):
    rows = [
        (f"{2020 + m % 3}-usopen-{1 + m % 2}1{m:02}", 2020 + m % 3, ("ATP", "WTA")[m % 2], 1 + g // 5, g, m * 100 + g * 6 + p,
         1 + g % 2, 1 + (m * g + p) % 2, f"A. {m % 5}", f"B. {m % 7}")
        for m in range(24) for g in range(1, 9) for p in range(6)
    ]
    rows += [(None, 2021, "ATP", 1, 1, 1, 1, 1, "A. 1", "B. 1"), ("odd", None, None, 1, 1, 1, 1, 2, None, "B. 2")]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def stored(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield save_facts(points(spark), "facts_points", 4, ORDER)
    spark.sql("DROP TABLE facts_points")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    """Exchanges whose input is the points themselves (they still have their server)."""
    lines = text.split("== Initial Plan ==")[0].splitlines()
    return [line for line, source in zip(lines, lines[1:]) if "Exchange hash" in line and "point_server" in source]


def test_a_bucket_is_one_file_of_a_partition(stored, spark):
    files = stored.select("year", "tour", F.input_file_name().alias("f")).distinct().groupBy("year", "tour").count()
    assert files.agg(F.max("count")).first()[0] <= 4
    assert stored.count() == points(spark).count()


def test_state_over_buckets_exchanges_no_points(stored, spark, rows):
    state = rebuild_state(stored)
    text = plan(state)
    assert not exchanges(text) and "Bucketed: true" in text
    # Not even the game rows move: they are grouped, scanned and joined by keys that begin with the match.
    assert "Exchange hash" not in text
    assert rows(state, *sorted(state.columns)) == rows(rebuild_state(points(spark)), *sorted(state.columns))


def test_carried_state_and_winners_over_buckets_exchange_nothing(stored, spark, rows):
    for build in (carried_state, with_match_winner):
        out = build(stored)
        assert "Exchange" not in plan(out)
        assert rows(out, *sorted(out.columns)) == rows(build(points(spark)), *sorted(out.columns))


def star_parts(spark, facts, chosen):
    matches = points(spark).select(
        "match_id", "year", "player1", "player2", "tour",
        F.when(F.col("match_id").contains("usopen"), "US Open").otherwise("Other").alias("tournament_name"),
    ).distinct()
    people = points(spark).selectExpr("explode(array(player1, player2)) AS player").distinct()
    players = people.withColumn("player_status", F.lit("Active"))
    columns = ["match_id", "year", "tour", "point_number", "point_server", "player1"]
    return star.star_join(facts, matches, players, chosen, columns)


@pytest.mark.parametrize(
    "chosen", [Filters(tour="ATP"), Filters(years=(2021,), tour="WTA"), Filters(tournament="US Open"), Filters()], ids=str
)
def test_star_join_reads_the_chosen_partitions_without_an_exchange_of_points(stored, spark, rows, chosen):
    facts = stored.select("match_id", "point_number", "point_server", "year", "tour")
    joined = star_parts(spark, facts, chosen)
    plain = star_parts(spark, points(spark).select("match_id", "point_number", "point_server"), chosen)
    assert rows(joined) == rows(plain) and joined.count() > 0
    text = plan(star_parts(spark, facts, chosen))
    assert not exchanges(text)
    if chosen.match_predicate() is not None:
        assert text.count("dynamicpruning") >= 2  # year and tour


def test_pruning_skips_files(stored, spark):
    chosen = spark.createDataFrame([(2021, "ATP")], "year int, tour string").filter("tour = 'ATP'")
    kept = pruned_by(stored, chosen)
    assert {(r["year"], r["tour"]) for r in kept.select("year", "tour").distinct().collect()} == {(2021, "ATP")}
    assert kept.count() == points(spark).filter("year = 2021 AND tour = 'ATP'").count()


def test_null_partitions_meet_null_choices_only(stored, spark):
    nulls = spark.createDataFrame([(None, None)], "year int, tour string")
    assert [r["match_id"] for r in pruned_by(stored, nulls).collect()] == ["odd"]
    filler = spark.createDataFrame([(-1, "")], "year int, tour string")
    assert pruned_by(stored, filler).count() == 0


def test_a_match_that_outgrows_a_task_is_not_put_in_one_bucket(spark, rows):
    df = points(spark)
    assert bucketable(df, max_rows=48) and not bucketable(df, max_rows=47)
    table = save_facts(df, "facts_large", 4, ORDER, max_rows=47)
    assert "Bucketed: true" not in plan(rebuild_state(table))
    assert rows(table, *df.columns) == rows(df, *df.columns)
    state = rebuild_state(table)
    assert rows(state, *sorted(state.columns)) == rows(rebuild_state(df), *sorted(state.columns))
    spark.sql("DROP TABLE facts_large")


def test_empty_facts(spark):
    table = save_facts(points(spark).limit(0), "facts_empty", 2, ORDER)
    assert rebuild_state(table).count() == 0
    spark.sql("DROP TABLE facts_empty")
