import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.operators import filters, metrics
from rallyframe.plans.build import point_log, scored_log
from rallyframe.session import scratch_path
from rallyframe.sources import builds, generations, readers, writers

POINTS_HEADER = "match_id,ElapsedTime,SetNo,GameNo,PointNumber,PointWinner,PointServer,P1Score,P2Score,P1GamesWon,P2GamesWon,SetWinner,P1PointsWon,P2PointsWon"
MATCHES_HEADER = "match_id,year,slam,match_num,player1,player2,status,winner,event_name,round,court_name,court_id,player1id,player2id,nation1,nation2"


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    points = [
        "2020-usopen-1101,0:00:01,1,1,1,1,1,15,0,0,0,0,1,0",
        "2020-usopen-1101,0:00:09,1,1,2,1,1,30,0,0,0,0,2,0",
        "2020-usopen-1101,0:00:15,1,1,3,1,1,40,0,0,0,0,3,0",
        "2020-usopen-1101,0:00:20,1,1,4,1,1,0,0,1,0,0,4,0",
        "2020-usopen-1101,0:00:25,1,2,0X,0,2,0,0,1,0,0,4,0",
        "2020-usopen-1101,0:00:29,1,2,5,2,2,0,15,1,0,0,4,1",
        "2020-usopen-1101,0:00:29,1,2,6,0,2,0,15,1,0,0,4,1",
    ]
    (folder / "2020-usopen-points.csv").write_text("\n".join([POINTS_HEADER, *points]) + "\n")
    (folder / "2021-wimbledon-points.csv").write_text(
        POINTS_HEADER + "\n2021-wimbledon-WS101,0,1,1,1,2,1,0,15,0,0,0,0,1\n"
    )
    (folder / "2020-usopen-matches.csv").write_text(
        MATCHES_HEADER + "\n2020-usopen-1101,2020,usopen,1101,Novak Djokovic,Pele,,,,,,,,,SRB,BRA\n"
    )
    return str(folder)


def test_raw_scan_takes_provenance_from_the_file_name(spark, raw):
    df = readers.read_raw_points(spark, raw)
    assert {tuple(r) for r in df.select("tournament", "year").distinct().collect()} == {("usopen", 2020), ("wimbledon", 2021)}
    assert readers.read_raw_points(spark, raw, years=[2021]).count() == 1
    assert readers.read_raw_points(spark, raw, years=[2022], slams=["usopen"]).count() == 0


def test_raw_files_to_scored_log(spark, raw):
    log = point_log(readers.read_raw_points(spark, raw), readers.read_raw_matches(spark, raw))
    assert "ElapsedTime" not in log.columns
    got = scored_log(log).orderBy("match_id", "point_number").collect()
    assert [(r["match_id"][:4], r["point_number"]) for r in got] == [("2020", n) for n in (1, 2, 3, 4, 5)] + [("2021", 1)]
    assert {r["player1"] for r in got[:5]} == {"N. Djokovic"} and {r["player2"] for r in got[:5]} == {"Pele"}
    assert got[4]["p1_games_won"] == 1 and got[4]["points_stake"] == 10
    assert all(0 <= r["p1_win_prob_before"] <= 1 for r in got)
    assert got[5]["player1"] is None and got[5]["best_of"] == 3


def test_metrics_run_on_a_stored_scored_log(spark, raw):
    log = point_log(readers.read_raw_points(spark, raw), readers.read_raw_matches(spark, raw))
    path = scratch_path(spark, "scored-log")
    writers.write_parquet(scored_log(log), path)
    scored = filters.with_high_pressure(readers.read_parquet(spark, path))
    assert metrics.top_upsets(scored).count() == 1  # the other match has no known players
    assert {r["player"] for r in metrics.clutch_by_match(scored).collect()} == {"N. Djokovic", "Pele"}
    assert metrics.consistency_and_clutch(scored).count() == 2
    assert metrics.pressure_report(scored, min_ranking_points=1).count() >= 1
    assert metrics.unlikely_results(scored, 1.0, 0.0).count() == 2


def test_stored_logs_have_typed_readers(spark, tmp_path):
    from rallyframe import constants

    assert len(constants.SCORED_LOG.split(", ")) == len(constants.PREPARED_LOG.split(", ")) + 10
    row = spark.range(1).select(*[F.lit("1").alias(c.split()[0]) for c in constants.PREPARED_LOG.split(", ")])
    writers.write_csv(row, str(tmp_path / "prepared"))
    back = readers.read_stored_log(spark, str(tmp_path / "prepared"))
    assert back.first()["P1_Sets_Won"] == 1 and dict(back.dtypes)["set5_p2"] == "double"


def test_name_map_object(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"C. Oconnell": "C. O'Connell", "A. de Minaur": "A. De Minaur"}, indent=2))
    assert {tuple(r) for r in readers.read_name_map(spark, str(path)).collect()} == {
        ("C. Oconnell", "C. O'Connell"), ("A. de Minaur", "A. De Minaur"),
    }


def test_sorted_export_is_sorted_across_parts(spark):
    path = scratch_path(spark, "sorted")
    writers.write_sorted_csv(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), path, ["k"])
    rows = readers.read_parts(spark, path, "k bigint").withColumn("file", F.col("_metadata.file_name")).collect()
    spans = {}
    for r in rows:
        spans.setdefault(r["file"], []).append(r["k"])
    assert all(v == sorted(v) for v in spans.values())
    ordered = [v for _, v in sorted(spans.items())]
    assert all(a[-1] < b[0] for a, b in zip(ordered, ordered[1:])) and sum(map(len, ordered)) == 1000


def test_bucketed_build_reruns_one_bucket(spark, rows):
    path = scratch_path(spark, "buckets")
    df = spark.range(200).select((F.col("id") % 20).alias("k"), "id")
    total = lambda f: f.groupBy("k").agg(F.sum("id").alias("s"))
    first = rows(writers.build_by_bucket(df, path, "k", 4, total))
    doubled = lambda f: f.groupBy("k").agg((F.sum("id") * 2).alias("s"))
    again = writers.build_by_bucket(df, path, "k", 4, doubled, only=[1])
    changed = {r["bucket"] for r in again.collect() if (r["k"], r["s"], r["bucket"]) not in set(first)}
    assert changed == {1} and again.count() == 20
    # A bucket that has lost its rows must not keep its old ones.
    emptied = writers.build_by_bucket(df.filter(F.lit(False)), path, "k", 4, total, only=[1])
    assert {r["bucket"] for r in emptied.collect()} == {0, 2, 3}


def _totals(factor=1):
    return lambda f: f.groupBy("k").agg((F.sum("id") * factor).alias("s"))


def test_a_failed_run_leaves_the_build_as_it_was(spark, rows):
    path = scratch_path(spark, "crash")
    df = spark.range(200).select((F.col("id") % 20).alias("k"), "id")
    before = rows(writers.build_by_bucket(df, path, "k", 4, _totals()))

    def breaks_in_a_task(f):
        wrong = F.when(F.col("k") > 17, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
        return f.groupBy("k").agg(F.sum(wrong).alias("s"))

    def breaks_at_once(f):
        raise RuntimeError("no plan")

    for broken in (breaks_in_a_task, breaks_at_once):
        for only in (None, [0, 1, 2, 3], [2]):
            try:
                writers.build_by_bucket(df, path, "k", 4, broken, only)
            except Exception:
                pass
            else:
                assert only == [2]  # no key above 17 lies there
                writers.build_by_bucket(df, path, "k", 4, _totals(), only)
            assert rows(builds.read(spark, path)) == before
    # The retry replaces what it is asked for.
    again = rows(writers.build_by_bucket(df, path, "k", 4, _totals(3), [1]))
    assert {r[2] for r in set(again) - set(before)} == {1} and len(again) == len(before)


def test_files_that_no_commit_lists_are_ignored(spark, rows):
    path = scratch_path(spark, "unlisted")
    df = spark.range(40).select((F.col("id") % 8).alias("k"), "id")
    before = rows(writers.build_by_bucket(df, path, "k", 2, _totals()))
    stray = spark.range(3).selectExpr("id AS k", "id AS s", "0 AS bucket")
    stray.write.partitionBy("bucket").parquet(f"{path}/run=stray")
    store = builds._Store(spark, path)
    store.create("_commits/00000007.json", '{"buckets": {"0": "stray"')  # cut off while it was written
    assert rows(builds.read(spark, path)) == before
    # The next commit goes after the broken one, and a number is given once.
    doubled = rows(writers.build_by_bucket(df, path, "k", 2, _totals(2), [0, 1]))
    assert sorted(s for _, s, _ in doubled) == sorted(2 * s for _, s, _ in before)
    assert not store.create("_commits/00000008.json", "{}")
    assert "run=stray" in builds.remove_stale(spark, path) and rows(builds.read(spark, path)) == doubled


def test_runs_that_end_together_both_keep_their_buckets(spark, rows, monkeypatch):
    path = scratch_path(spark, "both")
    df = spark.range(200).select((F.col("id") % 20).alias("k"), "id")
    writers.build_by_bucket(df, path, "k", 4, _totals())
    create, other = builds._Store.create, []

    def late(store, name, text):
        if not other:  # another run commits first
            other.append(1)
            writers.build_by_bucket(df, path, "k", 4, _totals(5), [0])
        return create(store, name, text)

    monkeypatch.setattr(builds._Store, "create", late)
    writers.build_by_bucket(df, path, "k", 4, _totals(7), [1])
    plain = {r["k"]: r["s"] for r in _totals()(df).collect()}
    factor = {0: 5, 1: 7, 2: 1, 3: 1}
    assert all(r["s"] == plain[r["k"]] * factor[r["bucket"]] for r in builds.read(spark, path).collect())


def test_an_empty_build_has_its_schema(spark):
    path = scratch_path(spark, "none")
    df = spark.range(0).select(F.col("id").alias("k"), "id")
    built = writers.build_by_bucket(df, path, "k", 4, _totals())
    assert built.columns == ["k", "s", "bucket"] and built.count() == 0
    with pytest.raises(FileNotFoundError):
        builds.read(spark, scratch_path(spark, "nowhere"))


def test_generations_are_read_with_all_columns_and_widest_types(spark):
    path = scratch_path(spark, "ages")
    spark.sql("SELECT 1 AS id, CAST(1.5 AS FLOAT) AS x, array(1, 2) AS many, 2020 AS year").write.partitionBy("year").parquet(path)
    spark.sql("SELECT 5000000000 AS id, 3 AS x, CAST(7 AS DECIMAL(9,2)) AS paid, 2021 AS year").write.mode("append").partitionBy("year").parquet(path)
    spark.sql("SELECT CAST(3 AS SMALLINT) AS id, array(CAST(9 AS BIGINT)) AS many, 12 AS paid, 'n' AS note, 2021 AS year").write.mode("append").partitionBy("year").parquet(path)
    df = readers.read_merged(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "x": "double", "many": "array<bigint>", "paid": "decimal(12,2)", "note": "string", "year": "int"}
    got = {r["id"]: r.asDict() for r in df.collect()}
    assert got[1] == {"id": 1, "x": 1.5, "many": [1, 2], "paid": None, "note": None, "year": 2020}
    assert got[5000000000]["x"] == 3.0 and got[5000000000]["many"] is None and str(got[5000000000]["paid"]) == "7.00"
    assert got[3]["many"] == [9] and str(got[3]["paid"]) == "12.00" and got[3]["note"] == "n"
    plan = df.filter("year = 2021 AND id > 3").select("paid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,3)]" in plan and "PartitionFilters: [isnotnull(year" in plan and "note" not in plan


@pytest.mark.parametrize("one,two,both", [
    ("tinyint", "int", "int"), ("int", "float", "double"), ("bigint", "decimal(5,2)", "decimal(22,2)"), ("date", "timestamp_ntz", "timestamp_ntz"),
    ("map<string,int>", "map<string,double>", "map<string,double>"), ("bigint", "double", None), ("string", "int", None), ("decimal(38,0)", "decimal(3,2)", None),
])
def test_types_are_widened_only_without_loss(one, two, both):
    a, b = (T.StructType.fromDDL(f"c {t}")["c"].dataType for t in (one, two))
    if both is None:
        with pytest.raises(ValueError, match="c"):
            generations.wider(a, b, "c")
    else:
        assert generations.wider(a, b).simpleString() == generations.wider(b, a).simpleString() == both


def test_one_part_of_each_write_is_looked_at(spark):
    path = scratch_path(spark, "writes")
    for _ in range(3):
        spark.range(40).repartition(5).write.mode("append").parquet(path)
    assert len(generations.generations(spark, path)) == 3
    with pytest.raises(ValueError, match="no type holds both"):
        spark.range(3).selectExpr("cast(id as string) AS id").write.mode("append").parquet(path)
        readers.read_merged(spark, path)


def test_repeated_matches_do_not_multiply_points(spark):
    points = spark.createDataFrame(
        [("m", "1", "1", str(n), "1", "1") for n in range(1, 5)],
        "match_id string, SetNo string, GameNo string, PointNumber string, PointWinner string, PointServer string",
    )
    matches = spark.createDataFrame(
        [("m", "Novak Djokovic", None), ("m", "Novak Djokovic", "Rafael Nadal"), ("m", "N Djokovic", "R. Nadal")],
        "match_id string, player1 string, player2 string",
    )
    log = point_log(points, matches)
    assert log.count() == 4 and {(r["player1"], r["player2"]) for r in log.collect()} == {("N. Djokovic", "R. Nadal")}


def test_table_columns_can_be_added(spark):
    name = "people_for_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writers.save_table(spark.createDataFrame([(1, "a")], "id int, n string"), name, scratch_path(spark, "t"))
    wider = writers.add_columns(spark, name, {"rate": "double"})
    assert wider.collect() == [(1, "a", None)]
    assert writers.preview(spark, [name], 1)[name].count() == 1
    spark.sql(f"DROP TABLE {name}")


def test_parquet_is_partitioned_for_pruning(spark):
    path = scratch_path(spark, "years")
    writers.write_parquet(spark.createDataFrame([(1, 2020), (2, 2021)], "id int, year int"), path)
    picked = writers.register(readers.read_parquet(spark, path), "years_view").filter("year = 2021")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and picked.count() == 1
