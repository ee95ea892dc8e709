"""Shared-folder files written and read inside tasks."""

import re

from pyarrow import fs
from pyspark.sql import functions as F

from rallyframe.session import scratch_path


def open_store(uri):
    """(file system, path) of a URI; a bare path or ``file:/x`` is a local or mounted folder."""
    if re.match(r"^file:/[^/]", uri):
        uri = "file://" + uri[5:]
    if "://" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri)


def stored(df, label="step"):
    """Write ``df`` once below the shared folder and continue from the files.

    Cuts lineage, and survives the loss of executors: the files belong to no machine.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.stored_at = path
    return read


def dropped(*frames):
    """Delete the files of ``stored`` frames; only for those that nothing reads again, later steps being stored too."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Words of 64 bits in the filters below; they bound what is broadcast and only save work.
WORDS = 1 << 18


def narrowed(df, column, wanted):
    """Rows of ``df`` whose ``column`` may be among the values of the one-column frame ``wanted``.

    A filter before a shuffle: it sends at most WORDS pairs of small numbers to every task and passes
    all rows that match, and by chance some more.
    """
    def word(name):
        return F.xxhash64(F.col(name)).bitwiseAND(F.lit(WORDS - 1))

    def bit(name):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(F.xxhash64(F.col(name)), 58).cast("int"))

    some = wanted.select(word(wanted.columns[0]).alias("_word"), bit(wanted.columns[0]).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return df.join(F.broadcast(some), (word(column) == F.col("_word")) & (bit(column).bitwiseAND(F.col("_bits")) != 0), "left_semi")
