"""Key-range builds that survive a crash: staged folders and a log of commits.

A build is a folder with

    run=<id>/bucket=<b>/part-*.parquet   what a run has written, never changed afterwards
    _commits/00000001.json, ...          which run holds each bucket, one file per commit

A run writes into a folder of its own; readers see it only once a commit names it. A commit is a new
numbered file, created only if no other run took the number, so a run that fails while it computes
or writes leaves the build as it was, and two runs that end together both keep their buckets. Readers
take the newest complete commit and open just the folders it lists.
"""

import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMITS = "_commits"


class _Store:
    """Files of a build through Hadoop's file systems, whatever they are."""

    def __init__(self, spark, path):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder):
        place = self._path(f"{self.path}/{folder}" if folder else self.path)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(place)) if self.fs.exists(place) else []

    def read(self, name):
        stream = self.fs.open(self._path(f"{self.path}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name, text):
        """Write a new file; False if it is there already."""
        place = self._path(f"{self.path}/{name}")
        try:
            stream = self.fs.create(place, False)
        except Exception:
            if self.fs.exists(place):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def remove(self, name):
        self.fs.delete(self._path(f"{self.path}/{name}"), True)


def _commits(store):
    return [n for n in store.names(COMMITS) if n.endswith(".json")]


def _newest(store):
    """The newest complete commit, or None. A commit that was cut off while it was written does not count."""
    for name in reversed(_commits(store)):
        try:
            found = json.loads(store.read(f"{COMMITS}/{name}"))
        except ValueError:
            continue
        if found.get("complete"):
            return found
    return None


def _commit(store, run, schema, written, replaced):
    """Point the ``replaced`` buckets (None: all) to ``run`` where it wrote any, and keep the others."""
    while True:
        taken = _commits(store)
        before = _newest(store) or {"buckets": {}}
        kept = {b: r for b, r in before["buckets"].items() if replaced is not None and int(b) not in replaced}
        text = json.dumps({"buckets": {**kept, **{str(b): run for b in written}}, "schema": schema, "complete": True})
        number = int(taken[-1].split(".")[0]) + 1 if taken else 1
        if store.create(f"{COMMITS}/{number:08d}.json", text):
            return


def build(df, path, key, buckets, compute, only=None):
    """Compute and write a result in key buckets, one job for all of them, and commit it.

    ``compute`` maps a frame to a frame that keeps ``key``. ``only`` re-runs the listed buckets; they
    are replaced when the run has been written, also by nothing if their rows are gone, and the others stay
    as they are. Without ``buckets`` the key is a whole number, such as a year, and every value a bucket of its
    own (null: -1); where the source is partitioned by it, a re-run opens no other files. If anything fails before the commit, all buckets read as before.
    """
    spark = df.sparkSession
    store, run = _Store(spark, path), uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)) if buckets else F.coalesce(F.col(key), F.lit(-1))
    bucket = bucket.cast("int")
    source = df if only is None else df.filter(bucket.isin(*only))
    result = compute(source).withColumn("bucket", bucket)
    result.write.partitionBy("bucket").parquet(f"{path}/run={run}")
    written = [int(n.split("=")[1]) for n in store.names(f"run={run}") if n.startswith("bucket=")]
    _commit(store, run, result.drop("bucket").schema.json(), written, None if only is None else set(only))
    return read(spark, path)


def read(spark, path):
    """The committed buckets of a build; files that no commit lists are not opened."""
    found = _newest(_Store(spark, path))
    if found is None:
        raise FileNotFoundError(f"no committed build in {path}")
    schema = T.StructType.fromJson(json.loads(found["schema"])).add("bucket", T.IntegerType())
    folders = [f"{path}/run={r}/bucket={b}" for b, r in sorted(found["buckets"].items())]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def remove_stale(spark, path):
    """Delete the folders of runs that the newest commit does not use; for when no run is under way."""
    store = _Store(spark, path)
    used = set((_newest(store) or {"buckets": {}})["buckets"].values())
    stale = [n for n in store.names("") if n.startswith("run=") and n.split("=")[1] not in used]
    for name in stale:
        store.remove(name)
    return stale
