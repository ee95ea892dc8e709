"""Facts stored so that scans, joins and ordered scans by match need no exchange.

A fact table is partitioned by year and tour, which filters prune, and bucketed by match inside. Two
tables with the same number of buckets join by match where they lie. A bucket is read by one task, so
a match that outgrows a task must not be put in one: the rows of each match are counted first, and a
table with a larger match is stored without buckets. Results are the same; joins then exchange the
points, and adaptive execution splits the large match.
"""

from pyspark.sql import functions as F

KEY = "match_id"
PARTITIONS = ("year", "tour")
MATCH_ROWS = 2_000_000  # rows of one match that a task may read


def bucketable(df, key=KEY, max_rows=MATCH_ROWS):
    """Whether no key (null is one, too) of ``df`` has more than ``max_rows`` rows: one combining aggregate."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return (sizes.agg(F.max("_n").alias("n")).first()["n"] or 0) <= max_rows


def save_facts(df, name, buckets, order=(), partition_by=PARTITIONS, key=KEY, path=None, max_rows=MATCH_ROWS):
    """Create or replace table ``name`` from ``df``, bucketed by ``key`` and sorted by key and ``order`` inside.

    Rows are dealt out by key first, in the table's own buckets, so that every task writes one bucket and
    a partition holds one file a bucket. Tables to be joined need the same ``buckets``; choose it for
    buckets of a few hundred MB in the largest partitions that are read together. ``df`` is scanned twice.
    An empty frame gives an empty table.
    """
    fits = bucketable(df, key, max_rows)
    writer = (df.repartition(buckets, key) if fits else df).write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fits:
        writer = writer.bucketBy(buckets, key).sortBy(key, *order)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def pruned_by(facts, chosen, columns=PARTITIONS):
    """Facts of the partitions that occur in ``chosen``, e.g. the filtered matches; nulls are values, too.

    The partitions of a table are few by its layout (a directory each), so their list is broadcast, and
    the scan reads the listed directories only (dynamic partition pruning). ``chosen`` should be cheap
    to derive, since it is read once more for the list.
    """
    listed = chosen.select(*[F.col(c).alias(f"_in_{c}") for c in columns]).distinct()
    kinds, same = dict(facts.dtypes), F.lit(True)
    for c in columns:
        filler = F.lit("" if kinds[c] == "string" else -1)
        same &= F.coalesce(F.col(c), filler) == F.coalesce(F.col(f"_in_{c}"), filler)
        same &= F.isnull(c) == F.isnull(f"_in_{c}")
    return facts.join(F.broadcast(listed), same, "left_semi")
