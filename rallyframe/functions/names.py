"""Player-name expressions, name lookup and country flags."""

from pyspark.sql import functions as F

from rallyframe.constants import IOC_TO_ISO2, WINNER_NAME_FIXES
from rallyframe.functions.ids import literal_map


def _words(name):
    return F.split(F.trim(F.regexp_replace(F.col(name), r"\s+", " ")), " ")


def initial_form(name, single="null"):
    """``Novak Djokovic`` -> ``N. Djokovic``; one-word names become null or stay (``keep``)."""
    words = _words(name)
    count = F.size(words)
    rest = F.array_join(F.slice(words, F.lit(2), F.greatest(count - 1, F.lit(0))), " ")
    short = F.concat(F.substring(words[0], 1, 1), F.lit(". "), rest)
    fallback = F.lit(None).cast("string") if single == "null" else F.col(name)
    return F.when(count > 1, short).otherwise(fallback)


def _capital(word):
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1_000_000)))


def _capital_parts(word, mark):
    return F.array_join(F.transform(F.split(word, mark), _capital), mark)


def _capital_word(word):
    """Capitalise a word; around hyphens first, then around apostrophes, where it has any."""
    hyphen, quote = F.contains(word, F.lit("-")), F.contains(word, F.lit("'"))
    step = F.when(hyphen, _capital_parts(word, "-")).otherwise(word)
    step = F.when(quote, _capital_parts(step, "'")).otherwise(step)
    return F.when(hyphen | quote, step).otherwise(_capital(word))


def recapitalise(name):
    """Capitalise every word after the first, honouring ``-`` and ``'``; blank names stay."""
    fixed = F.transform(_words(name), lambda w, i: F.when(i == 0, w).otherwise(_capital_word(w)))
    return F.when(F.trim(F.col(name)) == "", F.col(name)).otherwise(F.array_join(fixed, " "))


def winner_name(name):
    """Winner name for repaired matches: each further word plainly capitalised, plus fixed spellings.

    A one-word name is capitalised itself.
    """
    words = _words(name)
    plain = F.transform(
        words, lambda w, i: F.when((i == 0) & (F.size(words) > 1), w).otherwise(_capital(w))
    )
    text = F.when(F.trim(F.col(name)) == "", F.col(name)).otherwise(F.array_join(plain, " "))
    return F.coalesce(literal_map(WINNER_NAME_FIXES)[text], text)


def canonical_names(df, name_map, columns):
    """Replace names by their canonical form where ``name_map`` lists them.

    ``name_map`` holds one row per spelling variant; Spark picks the join by its size.
    """
    for column in columns:
        lookup = name_map.select(
            F.col("variant_name").alias("_variant"), F.col("canonical_name").alias("_canonical")
        )
        df = (
            df.join(lookup, F.col(column) == F.col("_variant"), "left")
            .withColumn(column, F.coalesce("_canonical", column))
            .drop("_variant", "_canonical")
        )
    return df


def iso2(country):
    """ISO-2 code of an IOC code; unlisted codes keep their first two letters."""
    c = F.col(country)
    return F.coalesce(literal_map(IOC_TO_ISO2)[c], F.upper(F.substring(c, 1, 2)))


def flag(country):
    """Flag of a country as a pair of regional-indicator letters (``A`` is U+1F1E6)."""
    letters = F.filter(F.split(iso2(country), ""), lambda ch: ch != "")

    def indicator(ch):
        tail = F.hex((F.ascii(ch) + 101).cast("bigint"))
        return F.decode(F.unhex(F.concat(F.lit("F09F87"), tail)), "UTF-8")

    return F.array_join(F.transform(letters, indicator), "")


def with_flags(df, countries, player="player"):
    """Prefix players of known country with its flag; others keep the bare name."""
    lookup = countries.select(F.col("player").alias("_p"), F.col("country").alias("_country"))
    known = F.col("_country").isNotNull() & (F.col("_country") != "")
    return (
        df.join(lookup, F.col(player) == F.col("_p"), "left")
        .withColumn(player, F.when(known, F.concat_ws(" ", flag("_country"), F.col(player))).otherwise(F.col(player)))
        .drop("_p", "_country")
    )


def latest_countries(results, tour_order):
    """Country per player: the last row that names the player wins.

    ``results`` has tour, year, row_no, winner_name, loser_name, winner_ioc, loser_ioc.
    Later tours, years and rows win; inside a row the loser is written after the winner.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit(0).alias("side"), F.col("winner_name").alias("name"), F.col("winner_ioc").alias("ioc")),
            F.struct(F.lit(1).alias("side"), F.col("loser_name").alias("name"), F.col("loser_ioc").alias("ioc")),
        )
    )
    rank = literal_map({t: i for i, t in enumerate(tour_order)})[F.col("tour")]
    return (
        results.select(rank.alias("tour_rank"), "year", "row_no", sides.alias("s"))
        .select("tour_rank", "year", "row_no", "s.*")
        .withColumn("player", initial_form("name", single="keep"))
        .groupBy("player")
        .agg(F.max_by("ioc", F.struct("tour_rank", "year", "row_no", "side")).alias("country"))
    )
