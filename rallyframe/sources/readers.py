"""Scans: raw CSV logs, lookups and directories of exported parts."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.constants import PLAYER_COUNTRIES, PREPARED_LOG, RAW_MATCHES, RAW_POINTS, SCORED_LOG
from rallyframe.sources import generations

_PAIR = r"(\d{4})-([a-z]+)-(?:points|matches)\.csv"


def read_csv(spark, path, schema, header=True):
    """Typed CSV scan; columns are matched by position, so the schema lists them in file order."""
    return spark.read.schema(schema).option("header", header).csv(path)


def read_parts(spark, folder, schema):
    """A directory of exported CSV parts as one frame."""
    return read_csv(spark, f"{folder}/part-*.csv", schema)


def read_raw(spark, glob, schema, years=None, slams=None):
    """All ``YYYY-slam-points.csv`` style files of a glob, with year and tournament from their names.

    Pairs that have no file are simply absent; ``years`` and ``slams`` narrow the scan.
    """
    path = F.col("_metadata.file_path")
    df = read_csv(spark, glob, schema).withColumns(
        {
            "tournament": F.regexp_extract(path, _PAIR, 2),
            "year": F.regexp_extract(path, _PAIR, 1).try_cast("int"),
        }
    )
    if years:
        df = df.filter(F.col("year").isin(*years))
    if slams:
        df = df.filter(F.col("tournament").isin(*slams))
    return df


def read_raw_points(spark, folder, **narrow):
    return read_raw(spark, f"{folder}/*-points.csv", RAW_POINTS, **narrow)


def read_raw_matches(spark, folder, **narrow):
    return read_raw(spark, f"{folder}/*-matches.csv", RAW_MATCHES, **narrow)


def read_stored_log(spark, folder, scored=False):
    """The exported CSV parts of a prepared or scored log, typed, in the order of its columns."""
    return read_parts(spark, folder, SCORED_LOG if scored else PREPARED_LOG)


def read_player_countries(spark, path):
    return read_csv(spark, path, PLAYER_COUNTRIES)


def read_name_map(spark, path):
    """A JSON object ``{variant: canonical}`` as (variant_name, canonical_name) rows."""
    mapping = T.MapType(T.StringType(), T.StringType())
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", mapping)).alias("variant_name", "canonical_name"))
    )


def read_merged(spark, folder):
    """Parquet parts written at different times, with all their columns and their widest types."""
    return generations.read_generations(spark, folder)


def read_parquet(spark, path):
    return spark.read.parquet(path)
