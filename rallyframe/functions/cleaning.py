"""Row filters, casts and null handling for raw logs, and small column tools."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.constants import DEFAULT_RETURN_PCT, DEFAULT_SERVE_PCT, UNKNOWN


def drop_sentinels(df, winner="PointWinner", server="PointServer"):
    """Drop rows whose winner or server is 0, null or not a number."""
    return df.filter(
        (F.expr(f"try_cast({winner} AS INT)") != 0) & (F.expr(f"try_cast({server} AS INT)") != 0)
    )


def numeric_only(df, column="PointNumber", observation=None):
    """Keep rows whose ``column`` is all digits; an Observation also counts the dropped rows."""
    good = F.coalesce(F.col(column).cast("string").rlike("^[0-9]+$"), F.lit(False))
    if observation is not None:
        df = df.observe(
            observation, F.count_if(~good).alias("dropped"), F.count(F.lit(1)).alias("seen")
        )
    return df.filter(good)


def cast_columns(df, types):
    """Cast several columns; text that does not fit becomes null instead of an error."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS {t})") for c, t in types.items() if c in df.columns})


def clean(df, score_columns=("score", "P1Score_Pre", "P2Score_Pre")):
    """Trim text, name blanks UNKNOWN, and fill null numbers with 0 and null scores with 0-0."""
    columns = {}
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            if field.name in score_columns:
                c = F.coalesce(c, F.lit("0-0"))
            text = F.trim(c)
            blank = text.isin("", "nan", "NaN", "None")
            columns[field.name] = F.when(text.isNull() | blank, F.lit(UNKNOWN)).otherwise(text)
        elif isinstance(field.dataType, T.IntegralType):
            columns[field.name] = F.coalesce(c, F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.FractionalType):
            columns[field.name] = F.coalesce(F.nanvl(c, F.lit(None).cast(field.dataType)), F.lit(0.0))
    return df.withColumns(columns)


def fill_defaults(df, values=None):
    """Fill the given columns where present; the default set covers rates and tour."""
    if values is None:
        values = {
            "serve_point_win_pct": DEFAULT_SERVE_PCT,
            "return_point_win_pct": DEFAULT_RETURN_PCT,
            "tour": "Unknown",
        }
    return df.na.fill({c: v for c, v in values.items() if c in df.columns})


def census(df):
    """One row per column: type, row count and null count, from a single pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    report = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.col("_rows").alias("row_count"),
                F.col(f.name).alias("null_count"),
            )
            for f in df.schema.fields
        ]
    )
    return counts.select(F.explode(report).alias("r")).select("r.*")


def select_ordered(df, *groups):
    """Select the columns of several groups once each, in first-seen order."""
    return df.select(*dict.fromkeys(c for group in groups for c in group))


def drop_present(df, *columns):
    """Drop columns that exist and ignore the others."""
    return df.drop(*columns)


def pack(df, name, columns):
    """Pack columns into one struct column."""
    return df.withColumn(name, F.struct(*columns))


def unpack(df, name):
    """Expand a struct column next to the others."""
    return df.select("*", f"{name}.*").drop(name)
