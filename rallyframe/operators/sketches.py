"""Quantile sketches stored beside a fact and merged for a choice of its keys.

A sketch brackets the wanted rank. One scan of the chosen rows then counts what lies below, inside and
above the bracket, and the exact value is found among the distinct values inside. A bracket that misses
the rank (rows were masked or gated since, or the sketch is off) is followed by a wider one, at last
by all values, so results never depend on the sketch.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.operators.ordered import _block_offsets, _range_blocks, between
from rallyframe.session import materialise
from rallyframe.sources import builds

#: Items a sketch keeps at its top level; its rank error is about one in this many.
SIZE = 2000
#: Half widths of the brackets that are tried, as shares of the rows.
SLACKS = (0.004, 0.04)


def sketched(df, keys, column, size=SIZE):
    """(keys, sketch, n): one sketch of ``column`` per key and the number of its values; null and NaN are none."""
    value = F.col(column).cast("double")
    known = F.when(~F.isnan(value), value)
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(known, size).alias("sketch"), F.count(known).alias("n"))


def build_sketches(fact, path, keys, column, only=None, size=SIZE):
    """Store the sketches of a fact by the years of its rows; ``only`` replaces those of the listed years."""
    return builds.build(fact, path, "year", None, lambda df: sketched(df, keys, column, size), only)


def brackets(sketches, q, slacks=SLACKS):
    """(low, high) around the ``q`` quantile of the merged sketches, one pair for each slack; none without rows."""
    ends = [max(q - s, 0.0) for s in slacks] + [min(q + s, 1.0) for s in slacks]
    whole = sketches.filter("n > 0").agg(F.kll_merge_agg_double("sketch").alias("all"), F.sum("n").alias("n"))
    row = whole.select(
        *[F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("all", F.lit(e))).alias(f"e{i}") for i, e in enumerate(ends)]
    ).first()
    return [] if row["e0"] is None else list(zip(row[: len(slacks)], row[len(slacks) :]))


def _values_at(counts, below, ranks):
    """The values at ``ranks`` of (v, n) rows in the order of v, ``below`` rows lying before them all."""
    blocks = _range_blocks(counts.select("v", "n"), ["v"])
    before = Window.partitionBy("_block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.join(F.broadcast(_block_offsets(blocks, F.col("n"))), "_block").select(
        "v", "n", (F.lit(below) + F.col("_offset") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("at")
    )
    wanted = [(F.col("at") <= r) & (F.col("at") + F.col("n") > r) for r in ranks]
    rows = placed.filter(wanted[0] | wanted[1]).collect()  # one row or two
    return [next(x["v"] for x in rows if x["at"] <= r < x["at"] + x["n"]) for r in ranks]


def quantile_near(df, column, q, guesses=()):
    """Exact quantile with linear interpolation (None on no rows): one scan if the first guess holds the rank.

    Equal to ``exact_quantile`` whatever the guesses. Null and NaN are left out, infinities are values.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    for low, high in [*guesses, (float("-inf"), float("inf"))]:
        side = F.when(F.col("v") < F.lit(low), -1).when(F.col("v") > F.lit(high), 1).otherwise(0)
        counts = materialise(
            values.groupBy(side.alias("side"), F.when(side == 0, F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        )
        sizes = {r["side"]: r["n"] for r in counts.groupBy("side").agg(F.sum("n").alias("n")).collect()}
        total, below = sum(sizes.values()), sizes.get(-1, 0)
        if not total:
            return None
        rank = q * (total - 1)
        lower = int(rank)
        upper = min(lower + 1, total - 1)
        if below <= lower and upper < below + sizes.get(0, 0):
            return between(*_values_at(counts.filter("side = 0"), below, (lower, upper)), rank - lower)
