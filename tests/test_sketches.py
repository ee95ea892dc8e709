"""Quantiles from stored sketches and player sums kept by year."""

import math
import random

import pytest

from rallyframe.operators import ordered, rollups, sketches


def frame(spark, values):
    rows = [(2020 + i % 3, "ATP" if i % 2 else "WTA", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "year int, tour string, v double")


def some(kind):
    pick = random.Random(3)
    return {
        "spread": [pick.gauss(0, 1) for _ in range(4000)],
        "ties": [float(pick.randint(0, 3)) for _ in range(3000)],
        "skewed": [math.exp(20 * pick.random()) for _ in range(3000)] + [0.0] * 1500,
        "odd": [math.inf, -math.inf, math.nan, None, 1.0, 1.0, 2.0] * 30,
        "one": [5.0], "nothing": [None, math.nan],
    }[kind]


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed", "odd", "one", "nothing"])
def test_equal_to_the_exact_quantile(spark, kind, tmp_path):
    df = frame(spark, some(kind))
    kept = sketches.build_sketches(df, str(tmp_path / "s"), ["year", "tour"], "v", size=200)
    for choice in ("true", "year = 2020 AND tour = 'ATP'"):
        for q in (0.0, 0.75, 1.0):
            found = sketches.quantile_near(df.filter(choice), "v", q, sketches.brackets(kept.filter(choice), q))
            assert found == ordered.exact_quantile(df.filter(choice), "v", q)


def test_wrong_brackets_do_not_matter(spark):
    df = frame(spark, some("spread"))
    wanted = ordered.exact_quantile(df, "v", 0.75)
    for guesses in ([], [(5.0, 6.0)], [(-9.0, -8.0), (0.67, 0.671), (0.0, 2.0)], [(1.0, 0.0)]):
        assert sketches.quantile_near(df, "v", 0.75, guesses) == wanted


def test_a_good_bracket_takes_one_scan(spark, monkeypatch):
    df = frame(spark, some("spread"))
    guesses = sketches.brackets(sketches.sketched(df, ["year"], "v"), 0.75)
    seen = []
    monkeypatch.setattr(sketches, "materialise", lambda x: seen.append(x) or ordered.materialise(x))
    sketches.quantile_near(df, "v", 0.75, guesses)
    assert len(seen) == 1


POINT = "year int, tour string, server_name string, returner_name string, server_win boolean"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def test_a_year_is_replaced_without_reading_others(spark, rows, tmp_path):
    old = [(2020, "ATP", "A", "B", True), (2021, "ATP", "B", "A", False), (2021, "WTA", "C", None, True)]
    new = [(2021, "ATP", "B", "A", True), (2021, "ATP", "D", "B", None), (None, "ATP", "E", "A", True)]
    fact, path = str(tmp_path / "fact"), str(tmp_path / "sums")
    points(spark, old).write.partitionBy("year").parquet(fact)
    rollups.build_year_sums(spark.read.parquet(fact), path)
    # Only the new year is there now: a scan of 2020 would lose its sums.
    again = rollups.build_year_sums(points(spark, new), path, only=[2021, -1])
    full = rollups.year_sums(points(spark, old[:1] + new))
    assert rows(again.drop("bucket")) == rows(full)
    assert rows(rollups.players_of(again)) == rows(rollups.players_of(full))
    found = {r["player"]: r for r in rollups.players_of(again).collect()}
    assert "C" not in found and found["A"]["player_status"] == "Active" and found["D"]["serve_point_win_pct"] is not None
    gone = rollups.build_year_sums(points(spark, []), path, only=[2021, -1])
    assert {r["player"]: r["player_status"] for r in rollups.players_of(gone).collect()} == {"A": "Active", "B": "Active"}


def test_a_rerun_opens_only_its_year(spark, tmp_path):
    fact = str(tmp_path / "fact")
    points(spark, [(y, "ATP", "A", "B", True) for y in (2020, 2021, 2022)]).write.partitionBy("year").parquet(fact)
    files = []
    rollups.build_year_sums(spark.read.parquet(fact), str(tmp_path / "sums"))

    from rallyframe.sources import builds

    def compute(df):
        files.extend(r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect())
        return rollups.year_sums(df)

    builds.build(spark.read.parquet(fact), str(tmp_path / "sums"), "year", None, compute, [2021])
    assert len(files) == 1 and "year=2021" in files[0]
