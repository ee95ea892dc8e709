"""Connected components by star contraction, with DataFrame functions only."""

import gc

from pyspark.sql import functions as F

from rallyframe.llm.files import dropped, stored


def release(spark):
    """Let Spark's cleaner drop the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _min_neighbour(edges):
    """(u, v, m): every edge with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


#: Edges for each file of a round; small graphs are not spread over all shuffle partitions.
FILE_EDGES = 500_000


def connected_components(edges, max_rounds=60):
    """(id, component) for every id of ``edges`` (columns a, b): component is the least id reachable.

    Alternates large-star (all larger neighbours go to the least neighbour) and small-star (the
    same towards smaller ones) until nothing changes; a round halves the depth of the trees or
    better. Ids are any ordered type without nulls. A node with very many neighbours is only
    ever aggregated or a key of a join that Spark may split. Every round is written to the
    shared folder, so lineage stays short. No edges give no rows.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    listed = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    # Contraction never adds edges, so the first count bounds all rounds.
    files = max(1, -(-listed.count() // FILE_EDGES))
    current = stored(listed.distinct().coalesce(files), "edges")
    seen = None
    for _ in range(max_rounds):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _min_neighbour(large.filter("u > v"))
        step = small.select(F.col("v").alias("x"), "m").union(small.select(F.col("u").alias("x"), "m"))
        last, current = current, stored(
            step.filter("x <> m").distinct().select(F.col("x").cast(kind).alias("u"), F.col("m").cast(kind).alias("v")).coalesce(files),
            "star",
        )
        dropped(last)
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("id")).distinct()
    labels = stored(
        current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
            roots.select("id", F.col("id").alias("component"))
        ).coalesce(files),
        "components",
    )
    dropped(current)
    return labels
