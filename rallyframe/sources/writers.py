"""Sinks: parquet, CSV, tables, and key-range builds that can be re-run piece by piece."""

from pyspark.sql import functions as F

from rallyframe.sources import builds


def write_parquet(df, path, partition_by=("year",)):
    """Overwrite a parquet directory, partitioned by columns queries filter on."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df, path):
    """Unsorted CSV export with header, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sorted_csv(df, path, keys):
    """CSV export in global key order: parts are key ranges, each sorted inside."""
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").option("header", True).csv(path)


def save_table(df, name, path=None):
    """Create or replace a parquet table from a query."""
    writer = df.write.mode("overwrite").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def add_columns(spark, name, columns):
    """Add columns to a table; existing rows read null there."""
    listing = ", ".join(f"{c} {t}" for c, t in columns.items())
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({listing})")
    return spark.table(name)


def register(df, name):
    """Make a frame visible to SQL under ``name``."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def preview(spark, names, n=10):
    """The first n rows of several tables."""
    return {name: spark.table(name).limit(n) for name in names}


def key_range(df, key, low, high):
    """Rows whose key lies in [low, high]."""
    return df.filter(F.col(key).between(low, high))


def build_by_bucket(df, path, key, buckets, compute, only=None):
    """A build in key buckets that can be re-run piece by piece; see ``builds``."""
    return builds.build(df, path, key, buckets, compute, only)
