"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Rows of a source, in order, form blocks. With weight w, block i of a source may start at slot
floor(i / w) and must be done by slot ceil((i + 1) / w); the earliest deadline among the blocks
that may start goes first. At every slot each source has then had its share of the slots to
within less than one block. Weights are whole numbers of slots in a cycle, so the schedule
repeats: it is worked out for one cycle, and a block's slot follows from its number by
arithmetic. When a source runs out, the weights of the rest are scaled up and a new phase with
a cycle of its own begins; no row is dropped or repeated.
"""

import heapq
import re
from fractions import Fraction

from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.llm.files import stored

PLAN = "source string, first_block long, last_block long, slot0 long, cycle int, picks array<int>"


def shares(weights, cycle):
    """Slots of a cycle for each source: largest remainders, one at least for each."""
    total = sum(weights.values())
    exact = {s: Fraction(w) * cycle / Fraction(total) for s, w in weights.items()}
    slots = {s: max(1, int(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))
    i = 0
    while sum(slots.values()) < cycle:
        slots[by_rest[i % len(by_rest)]] += 1
        i += 1
    while sum(slots.values()) > cycle:
        largest = max(slots, key=lambda s: (slots[s], s))
        slots[largest] -= 1
    return slots


def cycle_schedule(slots):
    """One cycle, earliest deadline first among released blocks; ties by source. source -> slot numbers."""
    cycle = sum(slots.values())
    ready, later = [], []
    for s, c in slots.items():
        heapq.heappush(later, (0, -(-cycle // c), s, 0))
    picks = {s: [] for s in slots}
    for t in range(cycle):
        while later and later[0][0] <= t:
            _, deadline, s, i = heapq.heappop(later)
            heapq.heappush(ready, (deadline, s, i))
        deadline, s, i = heapq.heappop(ready)
        picks[s].append(t)
        i += 1
        if i < slots[s]:
            heapq.heappush(later, (i * cycle // slots[s], -(-(i + 1) * cycle // slots[s]), s, i))
    return picks


def plan(blocks, weights, cycle=1000):
    """Phases of the schedule: rows of PLAN from blocks per source and target weights.

    Work and result grow with the number of sources, not with rows.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    slot0, rows = 0, []
    while left:
        size = max(cycle, 16 * len(left))
        slots = shares({s: weights[s] for s in left}, size)
        picks = cycle_schedule(slots)
        # The slot after the last block of the source that runs out first.
        end = min((n - 1) // slots[s] * size + picks[s][(n - 1) % slots[s]] + 1 for s, n in left.items())
        for s in sorted(left):
            full, rest = divmod(end, size)
            taken = full * slots[s] + sum(1 for p in picks[s] if p < rest)
            if taken:
                rows.append((s, done[s], done[s] + taken - 1, slot0, size, picks[s]))
            done[s] += taken
            left[s] -= taken
        slot0 += end
        left = {s: n for s, n in left.items() if n}
    return rows


def default_weights(blocks, power=0.5):
    """Target weights that flatten the sources' sizes: blocks to the given power."""
    return {s: max(1, round(1000 * n**power)) for s, n in blocks.items()}


def row_keys(docs, source, key):
    """Columns that tell rows apart: source (null: empty), key and a hash of the whole row."""
    return {
        "_source": F.coalesce(F.col(source).cast("string"), F.lit("")),
        "_key": F.col(key),
        "_hash": F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]),
    }


def source_ranks(docs, source="source", key="doc_id"):
    """(_source, _key, _hash, copies, start): where each distinct row starts inside its source.

    Sources may be of any size: light keys are range-partitioned by (source, key, hash), rows
    are counted by source and partition, and a running sum inside a partition is added to the
    total of the source's earlier partitions.
    """
    keys = docs.select([c.alias(n) for n, c in row_keys(docs, source, key).items()])
    counted = keys.groupBy("_source", "_key", "_hash").agg(F.count(F.lit(1)).alias("copies"))
    # The partition number is only fixed once written.
    ranged = stored(
        counted.repartitionByRange("_source", "_key", "_hash").withColumn("_part", F.spark_partition_id()), "ranked"
    )
    over_parts = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy("_source", "_part").agg(F.sum("copies").alias("_n")).select(
        "_source", "_part", F.coalesce(F.sum("_n").over(over_parts), F.lit(0)).alias("_base")
    )
    inside = (
        Window.partitionBy("_source", "_part").orderBy("_key", "_hash").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.withColumn("_before", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(earlier, ["_source", "_part"])
        .select("_source", "_key", "_hash", "copies", (F.col("_base") + F.col("_before")).alias("start"))
    )


def schedule(docs, source="source", key="doc_id", weights=None, block_rows=64, cycle=1000):
    """One row per distinct row of ``docs``: its source, copies, block, slot and place in the source.

    ``weights`` maps every source to its target (default: ``default_weights``). A null source is
    the source ''. Equal rows share one entry, which lies in the block of its first copy.
    The number of sources is bounded by the table of weights, which is a parameter, and only
    that many counts reach the driver.
    """
    ranks = stored(source_ranks(docs, source, key), "ranks")
    sizes = {r["_source"]: r["n"] for r in ranks.groupBy("_source").agg(F.sum("copies").alias("n")).collect()}
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    targets = weights or default_weights(blocks)
    missing = sorted(set(blocks) - set(targets))
    if missing:
        raise ValueError(f"no target weight for {missing[:5]}")
    phases = docs.sparkSession.createDataFrame(plan(blocks, targets, cycle), PLAN)
    block = F.floor(F.col("start") / block_rows)
    numbered = ranks.withColumn("block", block)
    # One row per source and phase: as many as sources squared at most, usually far fewer.
    placed = numbered.join(
        F.broadcast(phases),
        (F.col("_source") == F.col("source")) & F.col("block").between(F.col("first_block"), F.col("last_block")),
    )
    i = F.col("block") - F.col("first_block")
    c = F.size("picks")
    slot = F.col("slot0") + F.floor(i / c) * F.col("cycle") + F.element_at("picks", (i % c + 1).cast("int"))
    return placed.select("_source", "_key", "_hash", "copies", "start", "block", slot.alias("slot"))


def mixed(docs, source="source", key="doc_id", **options):
    """``docs`` in mixed order: sorted by slot, then by place inside the source.

    Columns stay as they are and may have any names; every row is kept. The order is that of
    the partitions and of the rows in them, so files written from it hold it.
    """
    marks = row_keys(docs, source, key)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    marked = docs.select(whole, *[c.alias(n) for n, c in marks.items()])
    places = schedule(docs, source, key, **options).select(
        *[F.col(n).alias(f"{n}_") for n in marks], F.col("slot").alias("_slot"), F.col("start").alias("_start")
    )
    same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in marks]
    return (
        marked.join(places, same[0] & same[1] & same[2])
        .repartitionByRange("_slot", "_start")
        .sortWithinPartitions("_slot", "_start")
        .select("_doc.*")
    )


def with_places(docs, name="place"):
    """``docs``, read from Parquet files that hold an order, with each row's place in it from 0.

    A scan sorts and packs its splits by size, so the order of a frame read from several files is
    not that of the files; it is taken from the number of each file and of the row in it. One
    row per file reaches the driver.
    """
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row_index"))
    counts = marked.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).collect()
    start, rows = 0, []
    for r in sorted(counts, key=lambda r: (int(re.match(r"part-(\d+)", r["_file"])[1]), r["_file"])):
        rows.append((r["_file"], start))
        start += r["n"]
    starts = docs.sparkSession.createDataFrame(rows, "_of string, _start long")
    return marked.join(F.broadcast(starts), F.col("_file") == F.col("_of")).select(
        *[F.col(f"`{c}`") for c in docs.columns], (F.col("_start") + F.col("_row_index")).alias(name)
    )
