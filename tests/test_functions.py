from pyspark.sql import functions as F

from rallyframe.functions import cleaning, ids, names, scores


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_match_id_facts(spark, rows):
    df = spark.createDataFrame(
        [("2020-usopen-1101",), ("2020-usopen-2701",), ("2021-ausopen-MS101",), ("2021-ausopen-WS701",), ("x",)],
        "match_id string",
    )
    facts = df.select("match_id", ids.best_of().alias("b"), ids.round_number().alias("r"), ids.tour().alias("t"))
    assert rows(facts) == [
        ("2020-usopen-1101", 5, 1, "ATP"),
        ("2020-usopen-2701", 3, 7, "WTA"),
        ("2021-ausopen-MS101", 5, 1, "ATP"),
        ("2021-ausopen-WS701", 3, 7, "WTA"),
        ("x", None, None, "Unknown"),
    ]


def test_tour_variants_differ_where_they_should(spark):
    df = spark.createDataFrame([("2020-usopen-12101",)], "match_id string")
    assert df.select(ids.tour()).first()[0] == "ATP"
    assert df.select(ids.tour(variant="suffix")).first()[0] == "WTA"
    odd = spark.createDataFrame([("2021-ausopen-MS101",)], "match_id string")
    assert odd.select(ids.tour(variant="digits_first")).first()[0] == "ATP"


def test_id_parts_keep_the_rest_together(spark):
    df = spark.createDataFrame([("2020-usopen-1-2",), ("x",)], "match_id string").select(*ids.id_parts().values())
    assert [tuple(r) for r in df.collect()] == [("2020", "usopen", "1-2"), ("x", None, None)]


def test_initial_form(spark):
    for text, null, keep in [
        ("Novak Djokovic", "N. Djokovic", "N. Djokovic"),
        ("N Djokovic", "N. Djokovic", "N. Djokovic"),
        ("  Juan  Del Potro ", "J. Del Potro", "J. Del Potro"),
        ("Pele", None, "Pele"),
        (None, None, None),
    ]:
        assert one(spark, names.initial_form("x"), text) == null
        assert one(spark, names.initial_form("x", single="keep"), text) == keep


def test_recapitalise(spark):
    for text, expected in [
        ("C. o'connell", "C. O'Connell"),
        ("A. riske-amritraj", "A. Riske-Amritraj"),
        ("T. van RIJTHOVEN", "T. Van Rijthoven"),
        ("", ""),
        (None, None),
    ]:
        assert one(spark, names.recapitalise("x"), text) == expected


def test_winner_name_uses_plain_capitals_and_the_fixed_spelling(spark):
    assert one(spark, names.winner_name("x"), "C. O'CONNELL") == "C. O'Connell"
    assert one(spark, names.winner_name("x"), "A. riske-amritraj") == "A. Riske-amritraj"
    assert one(spark, names.winner_name("x"), "pele") == "Pele"


def test_flags(spark):
    assert one(spark, names.flag("x"), "SUI") == "\U0001F1E8\U0001F1ED"
    assert one(spark, names.iso2("x"), "usa") == "US"


def test_latest_country_wins(spark, rows):
    results = spark.createDataFrame(
        [("ATP", 2020, 1, "Ann A", "Bob B", "X1", "X2"), ("ATP", 2021, 1, "Bob B", "Ann A", "X3", "X4"),
         ("WTA", 2020, 1, "Ann A", "Ann A", "X5", "X6")],
        "tour string, year int, row_no int, winner_name string, loser_name string, winner_ioc string, loser_ioc string",
    )
    assert rows(names.latest_countries(results, ["ATP", "WTA"])) == [("A. A", "X6"), ("B. B", "X3")]


def test_tokens_and_stakes(spark):
    assert one(spark, scores.token_points("x"), "AD") == 4
    assert one(spark, scores.token_points("x"), "7") == 0
    assert one(spark, scores.token_points("x", None), "7") is None
    assert one(spark, scores.points_stake("x"), 7, "int") == 1200
    assert one(spark, scores.points_stake("x"), 9, "int") is None


def test_deltas_of_unknown_winner_codes(spark):
    df = spark.createDataFrame(
        [(0, 0.5, 0.75, 0.25)],
        "point_winner int, p1_win_prob_before double, p1_win_prob_if_p1_wins double, p1_win_prob_if_p2_wins double",
    )
    assert df.select(scores.probability_deltas()["p1_wp_delta"]).first()[0] is None
    assert df.select(scores.probability_deltas(other="two")["p2_wp_delta"]).first()[0] == 0.25


def test_match_winner_before_takes_if_p2_wins_for_player_two(spark):
    df = spark.createDataFrame(
        [("a", "a", 0.6, 0.2), ("b", "a", 0.6, 0.2)],
        "match_winner string, player1 string, p1_win_prob_before double, p1_win_prob_if_p2_wins double",
    )
    assert [r[0] for r in df.select(scores.match_winner_before()).collect()] == [0.6, 0.2]
    assert [r[0] for r in df.select(scores.winner_probability()).collect()] == [0.6, 0.4]


def test_cleaning_of_dirty_rows(spark, rows):
    raw = spark.createDataFrame(
        [("1", "1", "1"), ("0X", "1", "1"), (None, "1", "2"), ("4", "0", "1"), ("5", "1", "0"), ("6", "", "1"), ("7", "2", "1")],
        "PointNumber string, PointWinner string, PointServer string",
    )
    kept = cleaning.cast_columns(cleaning.numeric_only(cleaning.drop_sentinels(raw)), {"PointNumber": "int"})
    assert rows(kept, "PointNumber") == [(1,), (7,)]


def test_observed_drop_count(spark):
    from pyspark.sql import Observation

    seen = Observation("numbers")
    df = spark.createDataFrame([("1",), ("x",), (None,)], "PointNumber string")
    assert cleaning.numeric_only(df, observation=seen).count() == 1
    assert seen.get == {"dropped": 2, "seen": 3}


def test_clean_fills_by_type(spark):
    df = spark.createDataFrame(
        [(" a ", None, None, None, float("nan"))], "name string, n int, score string, other string, f double"
    )
    assert tuple(cleaning.clean(df).first()) == ("a", 0, "0-0", "UNKNOWN", 0.0)


def test_defaults_fill_text_and_numbers(spark):
    df = spark.createDataFrame([(None, None)], "tour string, serve_point_win_pct double")
    assert tuple(cleaning.fill_defaults(df).first()) == ("Unknown", 0.62)


def test_column_tools(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert cleaning.select_ordered(df, ["b", "a"], ["a", "c"]).columns == ["b", "a", "c"]
    assert cleaning.drop_present(df, "c", "zzz").columns == ["a", "b"]
    packed = cleaning.pack(df, "s", ["a", "b"]).drop("a", "b")
    assert cleaning.unpack(packed, "s").columns == ["c", "a", "b"]
    assert cleaning.census(df.withColumn("b", F.lit(None).cast("int"))).filter("column_name = 'b'").first()["null_count"] == 1
