"""Nearest neighbours by inner product: stable projections in kd-trees with a chi-square stop.

Inner products become distances of unit vectors: a row x turns into (x, sqrt(M^2 - |x|^2)) / M with M
the largest norm of all rows, a query q into (q, 0) / |q|. A few 2-stable (Gaussian) projections
map both to DIMENSIONS numbers; if two points are at distance d, their squared projected
distance is d^2 times a chi-square variable. So a query walks the leaves of a kd-tree over
projected rows, nearest first, verifies the true inner products of what it meets, and stops
once the next leaf is so far that a better row would lie there with probability 1 - CONFIDENCE
at most.

Rows are dealt to cells of a kd-tree fitted on a bounded sample, large cells to several shards,
queries to blocks of those that visit the same cell. A query first searches its own cell, and with the distance found there only
the cells that the same test does not rule out.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rallyframe.llm.files import stored

DIMENSIONS = 8
CONFIDENCE = 0.97
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
LEAF = 32
#: Rows the cells are fitted on, at most (least hashes of the key).
SAMPLE = 20_000


def chi_square(x, degrees=DIMENSIONS):
    """Distribution function for an even number of degrees of freedom."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(degrees // 2))


def stopping_point(confidence=CONFIDENCE, degrees=DIMENSIONS):
    """The x at which the distribution function reaches ``confidence``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, degrees) < confidence else (low, mid)
    return high


def projections(size, dimensions=DIMENSIONS, seed=11):
    return np.random.default_rng(seed).standard_normal((size + 1, dimensions))


def lift_rows(x, largest):
    """Rows as unit vectors with one more component."""
    x = x / largest
    rest = np.sqrt(np.maximum(1 - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def lift_queries(q):
    q = q / np.abs(q).max(1, keepdims=True)  # squares of large components stay finite
    return np.hstack([q, np.zeros((len(q), 1))]) / np.sqrt((q * q).sum(1))[:, None]


def split_cells(points, cells):
    """Boxes (low, high) of about equally filled cells, as two arrays, by median cuts of the widest side."""
    size = points.shape[1]
    todo = [(np.arange(len(points)), np.full(size, -np.inf), np.full(size, np.inf), cells)]
    lows, highs = [], []
    while todo:
        rows, low, high, n = todo.pop()
        p = points[rows]
        spread = p.max(0) - p.min(0) if len(rows) > 1 else np.zeros(size)
        axis = int(spread.argmax())
        if n <= 1 or spread[axis] <= 0:
            lows.append(low)
            highs.append(high)
            continue
        left = n // 2
        cut = float(np.quantile(p[:, axis], left / n))
        if not (p[:, axis] < cut).any():
            cut = float(p[p[:, axis] > cut, axis].min())
        below = p[:, axis] < cut
        high_left, low_right = high.copy(), low.copy()
        high_left[axis], low_right[axis] = cut, cut
        todo += [(rows[below], low, high_left, left), (rows[~below], low_right, high, n - left)]
    return np.array(lows), np.array(highs)


def cell_of(points, lows, highs):
    """The box of every point (boxes are half open and cover everything)."""
    out = np.zeros(len(points), np.int32)
    for low in range(0, len(points), 2048):
        p = points[low : low + 2048]
        inside = np.ones((len(p), len(lows)), bool)
        for axis in range(points.shape[1]):
            inside &= (p[:, axis : axis + 1] >= lows[:, axis]) & (p[:, axis : axis + 1] < highs[:, axis])
        out[low : low + 2048] = inside.argmax(1)
    return out


def box_distance(points, lows, highs):
    """Squared distance of every point to every box."""
    total = np.zeros((len(points), len(lows)))
    for axis in range(points.shape[1]):
        p = points[:, axis : axis + 1]
        gap = np.maximum(np.maximum(lows[:, axis] - p, p - highs[:, axis]), 0)
        total += gap * gap
    return total


def leaves(points, leaf=LEAF):
    """(row order, leaf starts) of a kd-tree over points: rows of a leaf stand together."""
    order, starts = np.arange(len(points)), []
    todo = [(0, len(points))]
    while todo:
        a, b = todo.pop()
        rows = order[a:b]
        p = points[rows]
        spread = p.max(0) - p.min(0)
        if b - a <= leaf or spread.max() <= 0:
            # Equal points may be many: they are cut to leaves as they stand.
            starts += list(range(a, b, leaf))
            continue
        axis = int(spread.argmax())
        half = (b - a) // 2
        order[a:b] = rows[np.argpartition(p[:, axis], half)]
        todo += [(a, a + half), (a + half, b)]
    return order, np.array(sorted(starts) + [len(points)])


def search(ids, rows_, x, queries, own, largest, k, bound, project, stop):
    """The k best rows of one shard for each query: (query index, row id, score) arrays.

    ``rows_`` numbers the rows and ``own`` the queries' rows: a query does not find itself.
    ``bound`` is the squared distance of the k-th best that a query knows already (inf: none).
    """
    lifted = lift_rows(x, largest) @ project
    asked = lift_queries(queries) @ project
    scale = 1 / (largest * np.sqrt((queries * queries).sum(1)))
    order, starts = leaves(lifted)
    lifted, x, ids, rows_ = lifted[order], x[order], ids[order], rows_[order]
    lows = np.minimum.reduceat(lifted, starts[:-1], axis=0)
    highs = np.maximum.reduceat(lifted, starts[:-1], axis=0)
    far = box_distance(asked, lows, highs)
    sizes = np.diff(starts)
    found_q, found_id, found_score = [], [], []
    for i in range(len(queries)):
        near = np.argsort(far[i], kind="stable")
        distance = far[i][near]
        best_score, best_id = np.zeros(0), np.zeros(0, np.int64)
        limit, at, step = bound[i], 0, 4
        while at < len(near):
            # Leaves beyond the stopping distance are no longer opened.
            reach = np.searchsorted(distance, stop * limit, side="right") if np.isfinite(limit) else len(near)
            if at >= reach:
                break
            opened = near[at : min(at + step, reach)]
            at, step = at + len(opened), step * 4
            n = sizes[opened]
            rows = np.repeat(starts[opened] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            rows = rows[rows_[rows] != own[i]]
            score = np.concatenate([best_score, x[rows] @ queries[i]])
            name = np.concatenate([best_id, ids[rows]])
            keep = np.lexsort((name, -score))[:k]
            best_score, best_id = score[keep], name[keep]
            if len(best_score) == k:
                limit = min(bound[i], max(2 - 2 * best_score[-1] * scale[i], 0.0))
        found_q.append(np.full(len(best_id), i))
        found_id.append(best_id)
        found_score.append(best_score)
    return np.concatenate(found_q), np.concatenate(found_id), np.concatenate(found_score)


def _matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def component(rows, vector):
    """The type components are kept in: float as stored, double for all others."""
    return "float" if rows.schema[vector].dataType == T.ArrayType(T.FloatType(), rows.schema[vector].dataType.containsNull) else "double"


def norm(v):
    """Length of a vector that is not zero, from components over the largest so that squares stay finite."""
    most = F.array_max(F.transform(v, lambda e: F.abs(e.cast("double"))))
    return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, e: a + F.pow(e.cast("double") / most, 2)))


def usable(rows, key, vector):
    """(key, v) of the rows that can be compared: finite, not zero, of the commonest length, with a key."""
    v = F.col(vector).cast(f"array<{component(rows, vector)}>")
    fit = rows.select(F.col(key).cast("long").alias("key"), v.alias("v")).filter(
        F.col("key").isNotNull()
        & F.col("v").isNotNull()
        & F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
        & F.exists("v", lambda e: e != 0)
    )
    return fit


#: Columns of what a cell's search finds.
FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def meetings(index, asked, per_cell, block_queries=BLOCK_QUERIES):
    """Rows and queries dealt to the (cell, shard, block) groups in which they meet.

    Blocks are cut among the queries that visit the same cell, so a row is copied once for
    ``block_queries`` visitors of its cell, however many queries there are elsewhere. One row per
    cell is broadcast: no more cells than rows of the sample.
    """
    visitors = asked.groupBy(F.col("cell").alias("_cell")).agg(
        F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks")
    )
    dealt = index.join(F.broadcast(visitors), F.col("cell") == F.col("_cell")).select(
        "key", "row", "v", "cell", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    )
    # Renamed, so that the two sides of the cogroup share no column.
    plan = visitors.join(F.broadcast(per_cell), F.col("_cell") == per_cell["cell"]).select(
        F.col("_cell").alias("_at"), F.col("blocks").alias("_blocks"), F.col("shards").alias("_shards")
    )
    each = asked.select([F.col(c).alias(c) for c in asked.columns]).join(F.broadcast(plan), F.col("cell") == F.col("_at")).withColumns(
        {
            "block": F.pmod(F.xxhash64("key", "row", F.lit(7)), F.col("_blocks")).cast("int"),
            "shard": F.explode(F.sequence(F.lit(0), F.col("_shards") - 1)),
        }
    ).select("key", "row", "v", "known", "cell", "shard", "block")
    return dealt, each


def nearest(rows, key="vec_id", vector="embedding", every=20, k=20, shard_rows=SHARD_ROWS, confidence=CONFIDENCE, block_queries=BLOCK_QUERIES):
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product for each query.

    Queries are the rows whose key is divisible by ``every``; candidates all rows but the query's
    own, so another row with its key is one, and two rows with one key are two queries. Ties go to the smaller key. Vectors that are null, zero, hold null or non-finite components
    or differ from the commonest length take no part, nor do rows without key; a repeated row
    is a candidate as often as it stands. Fewer candidates than k are all returned; an empty
    table gives no rows. Scores are double-precision products of the stored vectors.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fit = usable(rows, key, vector)
    lengths = fit.groupBy(F.size("v").alias("n")).agg(
        F.count(F.lit(1)).alias("c"), F.max(norm("v")).alias("m")
    ).orderBy(F.desc("c"), "n").first()
    if lengths is None:
        return empty
    size, count, largest = lengths["n"], lengths["c"], lengths["m"] * (1 + 1e-9)
    fit = fit.filter(F.size("v") == size)
    project, stop = projections(size), stopping_point(confidence)
    sample = fit.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("v").toArrow()
    points = lift_rows(_matrix(sample.column(0)), largest) @ project
    lows, highs = split_cells(points, max(1, round(count / shard_rows)))

    kind = component(rows, vector)

    def place(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            cell = cell_of(lift_rows(x, largest) @ project, lows, highs) if len(x) else np.zeros(0, np.int32)
            yield batch.append_column("cell", pa.array(cell, pa.int32()))

    # Rows are numbered as they are written; a row is the query's own by this number.
    placed = stored(
        fit.mapInArrow(place, f"key long, v array<{kind}>, cell int").withColumn("row", F.monotonically_increasing_id()), "placed"
    )
    per_cell = stored(
        placed.groupBy("cell").agg(
            F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / (2 * shard_rows))).cast("int").alias("shards")
        ), "cells",
    )
    index = placed.join(F.broadcast(per_cell), "cell").withColumn("shard", F.pmod(F.xxhash64("key", "row"), F.col("shards")).cast("int"))

    def ask(batches):
        for batch in batches:
            q = _matrix(batch.column("v"))
            home = cell_of(lift_queries(q) @ project, lows, highs) if len(q) else np.zeros(0, np.int32)
            yield batch.append_column("cell", pa.array(home, pa.int32()))

    queries = stored(
        placed.filter(F.col("key") % every == 0).select("key", "v", "row")
        .mapInArrow(ask, f"key long, v array<{kind}>, row long, cell int").withColumn("known", F.lit(float("inf"))), "queries",
    )

    def look(left, right):
        if not left.num_rows or not right.num_rows:
            return FOUND.empty_table()
        own = right.column("row").to_numpy()
        q, name, score = search(
            left.column("key").to_numpy(), left.column("row").to_numpy(), _matrix(left.column("v")), _matrix(right.column("v")),
            own, largest, k, right.column("known").to_numpy(), project, stop,
        )
        return pa.table([own[q], right.column("key").to_numpy()[q], name, score], schema=FOUND)

    def visit(asked):
        """Search the cells that ``asked`` (key, row, v, known, cell) names, in (shard, block) pairs."""
        dealt, each = meetings(index, asked, per_cell, block_queries)
        by = ["cell", "shard", "block"]
        return dealt.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(look, "query_row long, query_id long, vec_id long, score double")

    first = stored(visit(queries), "home")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(
        F.col("query_row").alias("_q"), F.col("score").alias("_kth")
    )
    known = queries.drop("known").join(kth, F.col("row") == F.col("_q"), "left").drop("_q")

    def onward(batches):
        for batch in batches:
            q = _matrix(batch.column("v"))
            kth_score = np.array([s if s is not None else -np.inf for s in batch.column("_kth").to_pylist()], float)
            limit = np.maximum(2 - 2 * kth_score / (largest * np.sqrt((q * q).sum(1))), 0) if len(q) else kth_score
            gaps = box_distance(lift_queries(q) @ project, lows, highs) if len(q) else np.zeros((0, len(lows)))
            goes = gaps <= stop * limit[:, None]
            goes[np.arange(len(q)), batch.column("cell").to_numpy()] = False
            at, cell = np.nonzero(goes)
            rows_ = batch.select(["key", "v", "row"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [*rows_.columns, pa.array(cell, pa.int32()), pa.array(limit[at], pa.float64())], ["key", "v", "row", "cell", "known"]
            )

    rest = stored(known.mapInArrow(onward, f"key long, v array<{kind}>, row long, cell int, known double"), "onward")
    everything = first.union(visit(rest))
    return everything.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
