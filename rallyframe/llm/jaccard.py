"""Near-duplicate documents: an exact Jaccard join of word shingles by grouped prefixes.

Every document becomes the set of its 5-word shingles, as 64-bit hashes. Two sets with Jaccard
similarity of t or more share a shingle among the first ``n - ceil(t n) + 1`` of each in any
common order. The order here puts the most frequent shingles last (a bounded list of them is
counted over all documents, those full of frequent shingles being counted whole) and the rest by
hash, so that shared passages rarely meet in a prefix.

1. Equal sets collapse to one class, classes with equal prefix and size to one group.
2. Rows (shingle, group) are range-partitioned, so a frequent shingle may span many tasks.
3. Star pairs (least group of a shingle, group) and (least class of a group, class) are
   verified. This links most of every large group of copies at linear cost.
4. Once more, each shingle whose groups still lie in several components is led by the group that
   has it earliest, which has the fewest shingles of its own, and that is paired with those outside
   its component.
5. All pairs of groups that share a prefix shingle, are not yet in one component and pass the
   size and position filters are expanded to their classes and verified. This finds
   whatever the stars missed, so the result is exact. Shared shingles have one order in both
   sets, so what follows the first of them bounds the overlap. A row whose overlap would need
   earlier shared shingles is left out: the row of the first one stands for the pair.

Verification first bounds the overlap from small bit maps of the sets (a bit that only one set
has stands for a shingle that the other lacks) and then compares the whole sets of what is left.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from rallyframe.llm import text as bytes_
from rallyframe.llm.components import connected_components, release
from rallyframe.llm.files import dropped, narrowed, stored

WORDS = 5
#: Share of a set, from its least hashes, that is counted to find frequent shingles.
COUNTED = 0.36
#: The list of frequent shingles: at most so many (8 bytes each reach every task).
FREQUENT = 1 << 17
LEAST_FREQUENT = 24
#: Sets with this share of frequent shingles in their counted part are counted whole.
FULL_OF_FREQUENT = 0.1


def shingle_sets(array, words=WORDS):
    """The sorted distinct shingle hashes of every text of an Arrow string array, in order.

    Lower-cases A-Z; words are runs of bytes other than blank and ``\\t`` to ``\\r``; a text of
    fewer words has them all as its one shingle, one without words an empty set.
    """
    data, bounds = bytes_.flat(array)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    visible = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = ~visible[:-1][: len(data) - 1] if len(data) else True
    edge[bounds] = True
    starts = np.flatnonzero(visible & edge[:-1])
    after = np.ones(len(data), bool)
    if len(data):
        after[:-1] = ~visible[1:]
        after[bounds[1:][bounds[1:] > 0] - 1] = True
    stops = np.flatnonzero(visible & after) + 1
    hashes = bytes_.segment_hashes(data, starts, stops)
    rows = np.searchsorted(starts, bounds)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        joined = joined * bytes_.BASE + hashes[j : j + len(joined)]
    joined = bytes_.mix(joined)
    sets = []
    for a, b in zip(rows[:-1], rows[1:]):
        if b - a >= words:
            sets.append(np.unique(joined[a : b - words + 1]))
        elif b > a:
            total = np.array([b - a], np.uint64)
            for i in range(a, b):
                total = total * bytes_.BASE + hashes[i : i + 1]
            sets.append(bytes_.mix(total))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def bit_map(s):
    """A set as bits: a power of two of them, 1024 at least and twice the set's size or more."""
    size = max(1024, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 1024
    bits = np.zeros(size, np.uint8)
    bits[(bytes_.mix(s + np.uint64(7)) & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_overlap(n1, bits1, n2, bits2):
    """An upper bound of the overlap of two sets from their sizes and bit maps."""
    a, b = np.frombuffer(bits1, "<u8"), np.frombuffer(bits2, "<u8")
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(n1 - int(np.bitwise_count(a & ~b).sum()), n2 - int(np.bitwise_count(b & ~a).sum()))


def prefix_length(n, percent):
    """How many first shingles of a set of n must be looked at."""
    return n - -(-n * percent // 100) + 1


def _signed(values):
    return values.view(np.int64)


def _each(batches, column=1, max_bytes=1 << 20):
    for whole in batches:
        yield from bytes_.slices(whole, column, max_bytes)


def _counted(rows, part, words):
    """The FREQUENT most frequent values of what ``part`` takes of every set, as (values, counts) arrays."""

    def count(batches):
        for batch in _each(batches, max_bytes=8 << 20):
            found = [part(s) for piece in bytes_.slices(batch, 1, 1 << 20) for s in shingle_sets(piece.column(1), words)]
            values, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(values)), pa.array(n, pa.int64())], ["token", "n"])

    top = (
        rows.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST_FREQUENT).orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    )
    return np.array([r["token"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64)


def frequent_shingles(rows, words=WORDS):
    """The most frequent shingles (by document), most frequent last, as unsigned integers.

    Counts the first COUNTED of every set, in the order of hashes, over all documents, and then the whole
    sets of those that this shows to be full of frequent ones: their prefixes would otherwise go on to
    shingles not counted. At most FREQUENT reach the driver; any choice gives a valid order.
    """
    values, n = _counted(rows, lambda s: s[: int(len(s) * COUNTED) + 1], words)
    if not len(values):
        return values
    first = np.sort(values)

    def whole(s):
        head = s[: int(len(s) * COUNTED) + 1]
        at = np.minimum(np.searchsorted(first, head), len(first) - 1)
        return s if (first[at] == head).sum() >= max(1, FULL_OF_FREQUENT * len(head)) else s[:0]

    more, m = _counted(rows, whole, words)
    both, place = np.unique(np.concatenate([values, more]), return_inverse=True)
    most = np.zeros(len(both), np.int64)
    np.maximum.at(most, place, np.concatenate([n, m]))
    return both[np.lexsort((both, most))][-FREQUENT:]


def _profiles(rows, frequent, words, percent):
    """Per document: size, two hashes of its set, hash of its prefix with its size, the prefix."""
    by_value = np.argsort(frequent)
    sorted_frequent = frequent[by_value]

    def profile(batches):
        for batch in _each(batches):
            n, one, two, group, prefixes, maps = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                size = len(s)
                if size and len(sorted_frequent):
                    at = np.minimum(np.searchsorted(sorted_frequent, s), len(sorted_frequent) - 1)
                    hot = sorted_frequent[at] == s
                    if hot.any():
                        s = np.concatenate([s[~hot], s[hot][np.argsort(by_value[at[hot]], kind="stable")]])
                head = s[: prefix_length(size, percent)] if size else s
                n.append(size)
                maps.append(bit_map(s))
                one.append(int(bytes_.mix(s + np.uint64(size)).sum(dtype=np.uint64)))
                two.append(int(bytes_.mix(s * bytes_.BASE + np.uint64(1)).sum(dtype=np.uint64)))
                mark = (head * bytes_.powers(len(head))).sum(dtype=np.uint64) + np.uint64(size)
                group.append(int(bytes_.mix(np.array([mark]))[0]))
                prefixes.append(_signed(head))
            cuts = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int32()), *[pa.array(_signed(np.array(x, np.uint64))) for x in (one, two, group)],
                    pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]))),
                    pa.array(maps, pa.binary()),
                ],
                ["id", "n", "one", "two", "grp", "prefix", "bits"],
            )

    return rows.mapInArrow(profile, "id long, n int, one long, two long, grp long, prefix array<long>, bits binary")


def _stars(rows, percent):
    """Keep rows whose shingle others share, each with the leader of its run.

    ``rows`` are sorted by (token, n, gid) inside partitions. A run's first row leads it, and a row
    too large for the leader leads from there on. Rows at the ends of a partition stay.
    """

    def mark(batches):
        held = None
        leader = None  # (token, n, gid) that leads at present

        def emit(token, gid, n, pos, first, final):
            nonlocal leader
            run = np.concatenate([[True], token[1:] != token[:-1]])
            shared = np.zeros(len(token), bool)
            shared[1:] |= ~run[1:]
            shared[:-1] |= ~run[1:]
            shared[0] |= first
            shared[-1] |= final
            if leader is not None and leader[0] == token[0]:
                shared[0] = True
            token, gid, n, pos = token[shared], gid[shared], n[shared], pos[shared]
            lead = np.zeros(len(token), np.int64)
            for i, (t, g, size) in enumerate(zip(token.tolist(), gid.tolist(), n.tolist())):
                if leader is None or leader[0] != t or leader[1] * 100 < size * percent:
                    leader = (t, size, g)
                lead[i] = leader[2]
            return pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(gid), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.array(lead)],
                ["token", "gid", "n", "pos", "lead"],
            )

        first = True
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            last = np.flatnonzero(columns[0] != columns[0][-1]) if len(columns[0]) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if len(columns[0]) - cut > 200_000:  # a run longer than a batch goes on in the next
                cut = len(columns[0]) - 1
            if cut:
                yield emit(*[c[:cut] for c in columns], first, False)
                first = False
            held = [c[cut:] for c in columns]
        if held is not None and len(held[0]):
            yield emit(*held, first, True)

    return rows.mapInArrow(mark, "token long, gid long, n int, pos int, lead long")


def _needed(percent):
    """SQL for the least overlap of sizes n1, n2."""
    return f"ceil({percent}D * (n1 + n2) / {100 + percent})"


def _may_link(percent):
    """SQL: rows 1 and 2 of a shingle lie in different components and may reach the similarity from here on."""
    return (
        f"component1 <> component2 AND least(n1, n2) * 100 >= greatest(n1, n2) * {percent} "
        f"AND least(n1 - pos1, n2 - pos2) >= {_needed(percent)}"
    )


def _members(classes, parts):
    """The classes of every group with their components so far."""
    named = classes.select("gid", "cid", "n").distinct().join(parts, F.col("cid") == F.col("id"), "left")
    return stored(named.select("gid", "cid", "n", F.coalesce("component", "cid").alias("component")), "members")


def _open(shared, members):
    """Rows of the shingles whose groups lie in several components, once per component of a group."""
    spread = shared.select("token", "gid", "n", "pos").join(members.select("gid", "component").distinct(), "gid")
    mixed = (
        spread.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        .filter("_lo <> _hi").select(F.col("token").alias("_t"))
    )
    return stored(spread.join(mixed, F.col("token") == F.col("_t"), "left_semi"), "open")


def _ids(pairs):
    return pairs.select(F.col("a").alias("_id")).union(pairs.select(F.col("b").alias("_id"))).distinct()


def _possible(profiles, pairs, percent):
    """The pairs (a, b) of ids whose bit maps leave the similarity possible."""
    maps = narrowed(profiles.select("id", "n", "bits"), "id", _ids(pairs))
    left = maps.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("m1"))
    right = maps.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("m2"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "n1", "m1", "n2", "m2")

    def check(batches):
        for batch in batches:
            rows = zip(*[batch.column(i).to_pylist() for i in range(2, 6)])
            keep = [(100 + percent) * most_overlap(n1, m1, n2, m2) >= percent * (n1 + n2) for n1, m1, n2, m2 in rows]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stored(met.mapInArrow(check, "a long, b long").distinct(), "possible")


def _verify(docs, profiles, pairs, words, percent):
    """The pairs (a, b) of ids whose whole sets reach the similarity.

    Sets are made anew from the texts of the ids that occur; a pair meets its two sets in two
    joins, whose frequent keys Spark may split.
    """
    pairs = _possible(profiles, pairs, percent)
    ids = _ids(pairs)

    def sets(batches):
        for batch in _each(batches):
            found = [_signed(s) for s in shingle_sets(batch.column(1), words)]
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*found, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "tokens"])

    whole = stored(
        narrowed(docs, "id", ids).join(ids, F.col("id") == F.col("_id"), "left_semi").mapInArrow(sets, "id long, tokens array<long>"), "sets"
    )
    left = whole.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = whole.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def check(batches):
        for batch in batches:
            keep = []
            one, two = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x = one[i].values.to_numpy(zero_copy_only=False)
                y = two[i].values.to_numpy(zero_copy_only=False)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    links = stored(met.mapInArrow(check, "a long, b long"), "links")
    dropped(pairs, whole)
    return links


def near_duplicates(docs, key="doc_id", text="text", percent=75, words=WORDS):
    """(key, n_shingles, component_id) per row: the least key reachable by links of similarity.

    Documents link if 100 * overlap >= ``percent`` * union of their shingle sets. Null texts are
    empty; empty sets link with nothing and stand for themselves. Rows without a key keep a null
    component and take no part; rows that share a key count as one document. Repeated rows
    stay repeated. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    frequent = frequent_shingles(rows, words)
    release(spark)
    profiles = stored(_profiles(rows, frequent, words, percent), "profiles")

    sets = profiles.filter("n > 0 AND id IS NOT NULL")
    classes = stored(
        sets.groupBy("grp", "n", "one", "two").agg(F.min("id").alias("cid")).withColumn(
            "gid", F.min("cid").over(Window.partitionBy("grp", "n"))
        ), "classes",
    )
    heads = classes.filter("cid = gid").select(F.col("gid").alias("_gid"), F.col("grp").alias("_grp"), F.col("n").alias("_n")).distinct()
    groups = stored(
        sets.join(heads, (F.col("id") == F.col("_gid")) & (F.col("grp") == F.col("_grp")) & (F.col("n") == F.col("_n")))
        .select(F.col("id").alias("gid"), "n", "grp", "prefix").dropDuplicates(["gid", "grp", "n"]), "groups",
    )
    release(spark)
    shared = stored(
        _stars(
            groups.select("gid", "n", F.posexplode("prefix").alias("pos", "token"))
            .select("token", "gid", "n", "pos").repartitionByRange("token", "n", "gid").sortWithinPartitions("token", "n", "gid"),
            percent,
        ), "shared",
    )
    dropped(groups)
    release(spark)
    counted = shared.filter("lead <> gid").select(F.col("lead").alias("a"), F.col("gid").alias("b"))
    inner = classes.filter("cid <> gid").select(F.col("gid").alias("a"), F.col("cid").alias("b"))
    star_pairs = stored(counted.union(inner).distinct(), "pairs")
    links = _verify(rows, profiles, star_pairs, words, percent)
    dropped(star_pairs)
    release(spark)
    parts = connected_components(links)
    release(spark)

    members = _members(classes, parts)
    open_rows = _open(shared, members)
    earliest = F.min(F.struct("pos", "gid", "n", "component")).alias("_lead")
    leaders = open_rows.groupBy("token").agg(earliest).select("token", *[F.col(f"_lead.{c}").alias(c + "1") for c in ("gid", "n", "pos", "component")])
    others = open_rows.select("token", *[F.col(c).alias(c + "2") for c in ("gid", "n", "pos", "component")])
    met = leaders.join(others, "token").filter(f"gid1 <> gid2 AND {_may_link(percent)}")
    found = stored(met.select(F.col("gid1").alias("a"), F.col("gid2").alias("b")).distinct(), "pairs")
    dropped(members, open_rows, parts)
    release(spark)
    more, last = _verify(rows, profiles, found, words, percent), links
    links = stored(last.union(more), "links")
    dropped(found, more, last)
    release(spark)
    parts = connected_components(links)
    release(spark)

    # Exact step: groups of several components that share a shingle.
    members = _members(classes, parts)
    open_rows = _open(shared, members)
    x = open_rows.select("token", *[F.col(c).alias(c + "1") for c in ("gid", "n", "pos", "component")])
    y = open_rows.select("token", *[F.col(c).alias(c + "2") for c in ("gid", "n", "pos", "component")])
    met = x.join(y, "token").filter(f"gid1 < gid2 AND {_may_link(percent)}")
    near = (
        met.groupBy("gid1", "gid2", "component1", "component2")
        .agg(F.count(F.lit(1)).alias("c"), F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("pos1").alias("i"), F.max("pos2").alias("j"))
        .filter(f"c + least(n1 - i - 1, n2 - j - 1) >= {_needed(percent)}")
    )
    m1 = members.select(F.col("gid").alias("gid1"), F.col("component").alias("component1"), F.col("cid").alias("a"))
    m2 = members.select(F.col("gid").alias("gid2"), F.col("component").alias("component2"), F.col("cid").alias("b"))
    across = near.select("gid1", "gid2", "component1", "component2").join(m1, ["gid1", "component1"]).join(m2, ["gid2", "component2"]).select("a", "b")
    # Inside a group, every pair of classes of different components is a candidate.
    w1, w2 = (
        members.filter("cid IS NOT NULL").select("gid", F.col("component").alias(f"component{i}"), F.col("cid").alias(c))
        for i, c in ((1, "a"), (2, "b"))
    )
    within = w1.join(w2, "gid").filter("a < b AND component1 <> component2").select("a", "b")
    rest = stored(across.union(within).distinct(), "pairs")
    dropped(shared, members, open_rows, parts)
    release(spark)
    more = _verify(rows, profiles, rest, words, percent)
    # Prefixes and bit maps are not needed any more.
    sizes = stored(profiles.select("id", "n", "grp", "one", "two"), "sizes")
    dropped(profiles, rest)
    release(spark)
    labels = connected_components(links.union(more))
    dropped(links, more)

    named = classes.join(labels, F.col("cid") == F.col("id"), "left").select(
        F.col("grp").alias("_grp"), F.col("n").alias("_n"), F.col("one").alias("_one"), F.col("two").alias("_two"),
        F.coalesce("component", "cid").alias("component_id"),
    )
    same = (F.col("grp") == F.col("_grp")) & (F.col("n") == F.col("_n")) & (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))
    return sizes.join(named, same, "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def first_of_each(docs, key="doc_id", text="text", percent=75):
    """One row of each component of ``docs``; columns stay as they are.

    Rows are decided by themselves, whatever their keys: every distinct row stands for its copies under a
    hash of all its columns, and of a component the row with the least key stays (nulls last, then by
    that hash). Of rows equal in all columns one stays. Rows without words always stay, all copies.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("_doc"), F.col(f"`{key}`").alias("_id"), F.col(f"`{text}`").alias("_text"), F.xxhash64(*names).alias("_row"))
    found = stored(near_duplicates(whole.select("_row", "_text"), "_row", "_text", percent), "rows")
    sized = found.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"), F.max("n_shingles").alias("_words"), F.min("component_id").alias("_part"))
    keyed = whole.select("_row", "_id").groupBy("_row").agg(F.min("_id").alias("_id"))
    named = stored(sized.filter("_words > 0").join(keyed, "_row"), "named")
    first = named.groupBy("_part").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_row")).alias("_first"))
    kept = named.join(first, "_part").filter("_row = _first._row").select(F.col("_row").alias("_kept"), "_n")
    silent = sized.filter("_words = 0").select(F.col("_row").alias("_kept"), F.lit(1).cast("long").alias("_n"))
    chosen = stored(kept.union(silent), "kept")
    stays = whole.join(chosen, F.col("_row") == F.col("_kept"))
    once = stays.filter("_n > 1").dropDuplicates(["_row"])
    return stays.filter("_n = 1").select("_doc.*").union(once.select("_doc.*"))
