"""Ordered computations that never need a whole group, or a whole table, in one task.

A window over a key is fine while the key is small. Two things break it at scale: a key
that owns a large share of the rows, and a window without any key. Both are handled by
cutting the ordered rows into blocks, scanning each block on its own, and adding what
the blocks before it contributed. Results are exact whatever the cut is.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.session import materialise

MAX_GROUP_ROWS = 1_000_000


def same_keys(left, right, pairs):
    """Null-safe equality of (left column, right column) pairs, so that null keys are groups too."""
    condition = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        condition = one if condition is None else condition & one
    return condition


def _renamed(table, columns):
    return table.withColumnsRenamed({c: f"_r_{c}" for c in columns})


def join_on(left, right, columns, how="left"):
    """Join on ``columns`` of both sides, null-safe, keeping the left side's columns."""
    other = _renamed(right, columns)
    joined = left.join(other, same_keys(left, other, [(c, f"_r_{c}") for c in columns]), how)
    return joined if how == "left_semi" else joined.drop(*[f"_r_{c}" for c in columns])


@dataclass(frozen=True)
class Groups:
    """A frame to be scanned in order per ``keys``, with its too-large groups cut in chunks.

    ``hot`` is None while every group fits one task; then the scans are plain windows.
    Otherwise it has one row per too-large group with its number of chunks, and ``df``
    carries ``chunk`` (0 outside hot groups, monotone in the position inside) and ``is_hot``.
    """

    df: DataFrame
    keys: tuple
    hot: DataFrame | None = None

    @property
    def part(self):
        return [*self.keys] if self.hot is None else [*self.keys, "chunk"]

    def rows(self):
        return self.df if self.hot is None else self.df.drop("chunk", "is_hot")

    def join_groups(self, table):
        """Join a table with one row per group, along the exchange the scans already used."""
        if self.hot is None:
            return replace(self, df=self.df.join(table, [*self.keys], "left"))
        parts = F.coalesce(F.col("_parts"), F.lit(1))
        repeated = (
            join_on(table, self.hot.select(*self.keys, "_parts"), self.keys)
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), parts - 1)))
            .drop("_parts")
        )
        return replace(self, df=self.df.join(repeated, self.part, "left"))


def ordered_groups(df, keys, position, max_rows=MAX_GROUP_ROWS):
    """Look at the group sizes (one combining aggregate) and cut every group above ``max_rows``.

    Borders are found by counting rows, not by the spread of positions: the rows of hot
    groups are counted per position, positions are ranked over range partitions, and a chunk
    ends where its count is full. A chunk holds at most ``max_rows`` rows and those of one
    more position. Null keys form groups like any other; rows without a position come first.
    ``position`` is a column that follows the order inside a group.
    """
    keys = tuple(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n").alias("n")).first()["n"] or 0) <= max_rows:
        return Groups(df, keys)
    large = sizes.filter(F.col("_n") > max_rows).select(*keys)
    counts = (
        join_on(df.select(*keys, F.col(position).alias("_at")), large, keys, "left_semi")
        .filter(F.col("_at").isNotNull()).groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n"))
    )
    blocks = _range_blocks(counts, [*keys, "_at"])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy(*keys, "_block").agg(F.sum("_n").alias("_w")).select(
        *keys, "_block", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = join_on(
        blocks.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))), offsets, [*keys, "_block"]
    ).withColumn("_chunk", F.floor((F.col("_before") + F.col("_offset")) / max_rows))
    # One row per chunk, then per hot group; the first chunk needs no border.
    borders = ranked.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_from")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_from")).alias("_borders")
    )
    hot = materialise(borders.withColumn("_borders", F.expr("slice(_borders, 2, greatest(size(_borders) - 1, 0))")))
    hot = hot.withColumn("_parts", F.size("_borders") + 1)
    passed = F.size(F.filter("_borders", lambda b: b <= F.col(position)))
    cut = (
        join_on(df, hot.drop("_parts"), keys)
        .withColumns({"chunk": F.coalesce(F.when(F.col("_borders").isNotNull(), passed), F.lit(0)), "is_hot": F.col("_borders").isNotNull()})
        .drop("_borders")
    )
    return Groups(cut, keys, hot)


def running_sums(groups, order, sums, inclusive=False):
    """Running totals per group in ``order``; ``sums`` maps output name to the column added up.

    Totals of earlier chunks come from an aggregate over hot rows only, one row per chunk.
    """
    zero = F.lit(0).cast("bigint")
    window = (
        Window.partitionBy(*groups.part)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    flags = {f"_f_{name}": column.cast("bigint") for name, column in sums.items()}
    df = groups.df.withColumns(flags)
    extra = {name: zero for name in sums}
    if groups.hot is not None:
        before = Window.partitionBy(*groups.keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = (
            df.filter("is_hot")
            .groupBy(*groups.part)
            .agg(*[F.sum(f"_f_{n}").alias(f"_t_{n}") for n in sums])
            .select(*groups.part, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums])
            .filter(F.col("chunk") > 0)
        )
        df = join_on(df, carried, groups.part)
        extra = {name: F.coalesce(f"_c_{name}", zero) for name in sums}
    totals = {n: F.coalesce(F.sum(f"_f_{n}").over(window), zero) + extra[n] for n in sums}
    return replace(groups, df=df.withColumns(totals).drop(*flags, *[f"_c_{n}" for n in sums]))


def previous_values(groups, order, columns):
    """Value of the previous row per group: ``columns`` maps output to (input, default)."""
    window = Window.partitionBy(*groups.part).orderBy(*order)
    lags = {name: F.lag(src, 1, default).over(window) for name, (src, default) in columns.items()}
    if groups.hot is None:
        return replace(groups, df=groups.df.withColumns(lags))
    sources = list(dict.fromkeys(src for src, _ in columns.values()))
    tails = (
        groups.df.filter("is_hot")
        .groupBy(*groups.part)
        .agg(F.max_by(F.struct(*sources), F.struct(*order)).alias("_tail"))
        .select(
            *groups.part, F.lag("_tail").over(Window.partitionBy(*groups.keys).orderBy("chunk")).alias("_tail")
        )
        .filter(F.col("_tail").isNotNull())
    )
    # The first row of a later chunk follows the last row of the chunk before it.
    continues = (F.row_number().over(window) == 1) & F.col("_tail").isNotNull()
    joined = join_on(groups.df, tails, groups.part).withColumn("_continues", continues)
    values = {
        name: F.when(F.col("_continues"), F.col(f"_tail.{src}")).otherwise(lags[name])
        for name, (src, _) in columns.items()
    }
    return replace(groups, df=joined.withColumns(values).drop("_tail", "_continues"))


def _range_blocks(df, order):
    """Range-partition by ``order`` and tag each row with its partition.

    The tag is only stable once written, hence the checkpoint.
    """
    return materialise(
        df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id())
    )


def _block_offsets(blocks, weight):
    """Total weight of all earlier blocks: one row per block, at most one per partition."""
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.groupBy("_block")
        .agg(F.sum(weight).alias("_w"))
        .select("_block", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_offset"))
    )


def with_row_ids(df, order, name="row_id"):
    """Dense 1-based ids in a total ``order`` over the whole table, without a single-task sort.

    Rows are range-partitioned and sorted once and numbered where they lie; that is written, and
    the number of rows before each partition is added. ``name`` comes first.
    """
    placed = materialise(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_block", F.shiftright("_at", 33))
    offsets = _block_offsets(placed, F.lit(1).cast("bigint"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_block").select(
        (inside + F.col("_offset") + 1).cast("bigint").alias(name), *df.columns
    )


def average_percent_rank(df, value, name):
    """Rank / row count with ties sharing their average rank; null values stay unranked.

    Ranks are worked out per distinct value. ``df`` is written first: its value may be a
    floating-point sum, and both sides of the join must see the same bits.
    """
    stored = materialise(df)
    counts = (
        stored.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    blocks = _range_blocks(counts, ["_v"])
    offsets = _block_offsets(blocks, F.col("_n"))
    total = blocks.agg(F.sum("_n").alias("n")).scalar()
    before = (
        Window.partitionBy("_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = (
        blocks.withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(F.broadcast(offsets), "_block")
        .select(
            "_v",
            ((F.col("_below") + F.col("_offset") + (F.col("_n") + 1) / F.lit(2.0)) / total).alias(name),
        )
    )
    return stored.join(ranks, stored[value] == ranks["_v"], "left").drop("_v")


def between(low, high, weight):
    """The point ``weight`` of the way from ``low`` to ``high``, infinities included."""
    if low == high or not weight or low == float("-inf"):
        return low
    step = high - low
    return low + step * weight if step < float("inf") else low * (1 - weight) + high * weight


#: Relative rank error of the quantile sketch is 1 / ACCURACY.
ACCURACY = 10_000


def exact_quantile(df, column, q, levels=2):
    """Exact quantile with linear interpolation, as a Python float (None on no rows).

    The column is stored once. Every level asks the engine's quantile sketch for a bracket
    around the wanted rank and counts exactly what lies below and inside it, so each level
    narrows the rows some thousandfold whatever their spread; then the distinct values still
    inside are counted and read. The number of passes is fixed. Infinities are ordered like
    other values, nulls and NaN are left out.
    """
    values = materialise(
        df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    )
    total = values.count()
    if not total:
        return None
    rank = q * (total - 1)
    lower, weight = int(rank), rank - int(rank)
    low, high, below, inside = float("-inf"), float("inf"), 0, total
    for _ in range(levels):
        within = values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        share = (lower - below) / inside
        shares = [max(0.0, share - 3 / ACCURACY), min(1.0, share + 3 / ACCURACY + 2 / inside)]
        lo, hi = within.agg(F.percentile_approx("v", shares, ACCURACY).alias("p")).first()["p"]
        seen = within.agg(
            F.count(F.when(F.col("v") < lo, 1)).alias("under"), F.count(F.when(F.col("v").between(lo, hi), 1)).alias("n")
        ).first()
        # The bracket must hold the wanted row and the next one, if there is one.
        if below + seen["under"] <= lower and min(lower + 1, total - 1) < below + seen["under"] + seen["n"]:
            low, high, below, inside = lo, hi, below + seen["under"], seen["n"]
    found = (
        values.filter((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        .groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
    )
    picked = []
    for wanted in (lower, min(lower + 1, total - 1)):
        at = below
        for row in found:
            at += row["n"]
            if wanted < at:
                picked.append(row["v"])
                break
    return between(*picked, weight)
