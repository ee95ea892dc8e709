"""The trie of conversation prefixes, by digests of fixed-length blocks of turns.

A conversation is cut into blocks of BLOCK turns. Every block has a digest of its turns, and the
chained digests of a conversation's blocks (position-salted sums, 128 bits) say which conversations agree
up to the end of a block. Conversations are grouped by these first: equal blocks after equal
blocks count once, however many conversations share them. Single turns are looked at only
inside distinct blocks, and grouped only where the block before has several continuations;
elsewhere every turn of a block has the members of the block.

A node is known by its smallest member, its owner, and its depth. Once a conversation owns a
node it owns all further nodes of its path, so each has one depth from which on it owns, and sums
over subtrees become sums over members: a subtree has one owned leaf for each of its leaves, and its
repeated turns are the turns that members have before they own. So nothing walks the trie
level by level, and depth costs no rounds.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from rallyframe.llm.files import stored
from rallyframe.operators.ordered import ordered_groups, running_sums

BLOCK = 4
#: Conversation ids that are joined to one piece of text before they are hashed.
IDS = 1 << 15
#: A depth beyond all others.
NEVER = (1 << 62) - 1
NODE = ["one", "two"]


def numbered_turns(conversations, key="conv_id", order="turn", role="role", text="text"):
    """(conv, place, one, two, chars): every turn's place from 0, two digests of role and text, code points of its text.

    Turns are in the order of ``order`` (null first), then role and text; null roles and texts are
    empty; rows without a key are left out. Very long conversations are numbered in parts.
    """
    rows = conversations.select(
        F.col(key).cast("long").alias("conv"), F.col(order).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).filter("conv IS NOT NULL")
    placed = running_sums(
        ordered_groups(rows, ["conv"], "turn"), [F.asc_nulls_first("turn"), "role", "text"], {"place": F.lit(1)}
    ).rows()
    return placed.select(
        "conv", "place", F.xxhash64(F.lit(1), "role", "text").alias("one"), F.xxhash64(F.lit(2), "text", "role").alias("two"),
        F.length("text").cast("long").alias("chars"),
    )


def _halves(prefix, hashed):
    """Two 32-bit numbers of a hash, so that very many add up without overflow."""
    return {f"{prefix}0": hashed.bitwiseAND((1 << 32) - 1), f"{prefix}1": F.shiftrightunsigned(hashed, 32)}


def _chain(b, parts):
    """The two hashes of the blocks up to ``b`` from four running sums."""
    return F.xxhash64(b, *parts[:2]), F.xxhash64(b, *parts[2:])


def _root():
    """The digest above the first block."""
    none = F.lit(0).cast("long")
    return _chain(F.lit(-1).cast("long"), [none] * 4)


def _blocks(turns, block):
    """One row per block of a conversation: its turns, its chained digest and that of the blocks before it."""
    cut = (
        turns.withColumn("b", F.floor((F.col("depth") - 1) / block).cast("long")).groupBy("conv", "b")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "one", "two", "chars"))).alias("turns"))
        .withColumn("chars", F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["chars"]))
    )
    salted = cut.withColumns(
        {**_halves("x", F.xxhash64("b", "turns.one")), **_halves("y", F.xxhash64("turns.two", "b"))}
    )
    sums = {f"s{n}": F.col(n) for n in ("x0", "x1", "y0", "y1")} | {"before": F.col("chars")}
    run = running_sums(ordered_groups(salted, ["conv"], "b"), ["b"], sums).rows()
    parts = [F.col(f"s{n}") for n in ("x0", "x1", "y0", "y1")]
    after = [F.col(f"s{n}") + F.col(n) for n in ("x0", "x1", "y0", "y1")]
    up, own = _chain(F.col("b") - 1, parts), _chain(F.col("b"), after)
    last = F.element_at("turns", -1)["depth"]
    return run.select(
        "conv", "b", "turns", "before", (F.col("before") + F.col("chars")).alias("after"), last.alias("end"),
        up[0].alias("up1"), up[1].alias("up2"), own[0].alias("key1"), own[1].alias("key2"),
    )


def _node(j, block):
    """The node (two hashes) at turn ``j`` (from 1; 0: the node above the block) of a block row."""
    full = (F.size("turns") == block) & (j == block)
    hashes = [
        F.xxhash64(F.col(f"up{i}"), F.transform(F.slice("turns", F.lit(1), F.greatest(j, F.lit(1))), lambda t: t[n]))
        for i, n in ((1, "one"), (2, "two"))
    ]
    return [
        F.when(j == 0, F.col(f"up{i}")).when(full, F.col(f"key{i}")).otherwise(h) for i, h in zip((1, 2), hashes)
    ]


def _spread(blocks, block):
    """One row per turn of distinct blocks: its node, the node above, its depth and the characters before it."""
    turn = F.posexplode("turns")
    rows = blocks.select("*", turn.alias("at", "t")).withColumn("j", F.col("at") + 1)
    node, above = _node(F.col("j"), block), _node(F.col("at"), block)
    earlier = F.aggregate(F.slice("turns", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda a, t: a + t["chars"])
    kept = [c for c in blocks.columns if c not in ("turns", "before")]
    return rows.select(
        *kept, node[0].alias("one"), node[1].alias("two"), above[0].alias("above1"), above[1].alias("above2"),
        F.col("t.depth").alias("depth"), (F.col("before") + earlier).alias("chars_before"),
    )


def _digests(ends):
    """(one, two, ends_sha256) from (one, two, conv): the sorted ids of every node, hashed in order.

    Ids become pieces of text in range partitions, so a node with very many ends is gathered by
    many tasks; its pieces then stream through one hash.
    """

    def pieces(batches):
        node, held = None, []  # the node at hand and its ids not yet handed on

        def table(rows):
            return pa.RecordBatch.from_pylist(rows, pa.schema([("one", pa.int64()), ("two", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

        def piece():
            return {"one": node[0], "two": node[1], "first": held[0], "ids": ",".join(map(str, held))}

        for batch in batches:
            out = []
            for one, two, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (node != (one, two) or len(held) >= IDS):
                    out.append(piece())
                    held = []
                node = (one, two)
                held.append(conv)
            yield table(out)
        if held:
            yield table([piece()])

    def digest(batches):
        node = state = None
        schema = pa.schema([("one", pa.int64()), ("two", pa.int64()), ("sha", pa.string())])

        def done():
            return {"one": node[0], "two": node[1], "sha": state.hexdigest()}

        for batch in batches:
            out = []
            for one, two, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if node == (one, two):
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    out.append(done())
                node, state = (one, two), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if node:
            yield pa.RecordBatch.from_pylist([done()], schema)

    cut = (
        ends.repartitionByRange("one", "two", "conv").sortWithinPartitions("one", "two", "conv")
        .mapInArrow(pieces, "one long, two long, first long, ids string")
    )
    return (
        cut.repartition("one", "two").sortWithinPartitions("one", "two", "first").select("one", "two", "ids")
        .mapInArrow(digest, "one long, two long, sha string")
    )


def prefix_nodes(turns, ids, block=BLOCK):
    """One row per node of the trie of the conversations ``ids`` (conv), the root included.

    ``turns`` has (conv, depth from 1 without gaps, one, two, chars); a conversation without turns belongs to the
    root alone. Columns, all long but the last: conv_id, depth (together they say where the
    node's turns are to be found: the first ``depth`` turns of that conversation), parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (characters of turns that conversations of the subtree need not hold again)
    and ends_sha256 (of the ids that end there). No conversations give no rows.
    """
    blocks = stored(_blocks(turns, block), "blocks")
    narrow = blocks.select("conv", "b", "end", "after", "key1", "key2")
    key = ["key1", "key2"]
    groups = narrow.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"))
    # Distinct blocks, each by its least conversation, and how many continue the block before.
    distinct = blocks.join(groups.select("n", F.col("conv").alias("_c"), F.col("key1").alias("_k1"), F.col("key2").alias("_k2")),
                           (F.col("conv") == F.col("_c")) & (F.col("key1") == F.col("_k1")) & (F.col("key2") == F.col("_k2"))).drop("_c", "_k1", "_k2")
    distinct = stored(distinct, "distinct")
    forks = distinct.groupBy("up1", "up2").agg(F.count(F.lit(1)).alias("_w")).filter("_w > 1").select(F.col("up1").alias("_u1"), F.col("up2").alias("_u2"))
    marked = distinct.join(forks, (F.col("up1") == F.col("_u1")) & (F.col("up2") == F.col("_u2")), "left").withColumn("fork", F.col("_u1").isNotNull()).drop("_u1", "_u2")
    spread = stored(_spread(marked, block), "turns")

    # Owners: at forks, the least of the conversations that lead the blocks there.
    at_forks = spread.filter("fork").groupBy(*NODE, "above1", "above2", "depth", "chars_before").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"))
    columns = [*NODE, "above1", "above2", "depth", "chars_before", "conv", "n"]
    nodes = stored(at_forks.select(*columns).union(spread.filter("NOT fork").select(*columns)), "nodes")
    children = nodes.groupBy(F.col("above1").alias("_a1"), F.col("above2").alias("_a2")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = stored(
        nodes.join(children, (F.col("one") == F.col("_a1")) & (F.col("two") == F.col("_a2")), "left").drop("_a1", "_a2")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "tree",
    )

    # From which depth each conversation owns, the characters before it, and whether it owns a leaf.
    owned = tree.groupBy(F.col("conv").alias("_conv")).agg(
        F.min("depth").alias("own"), F.min("chars_before").alias("repeated"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    size = narrow.groupBy("conv").agg(F.max("after").alias("total"), F.max("end").alias("turns"))
    facts = stored(
        size.join(owned, F.col("conv") == F.col("_conv"), "left").select(
            "conv", "turns", F.coalesce("own", F.lit(NEVER)).alias("own"), F.coalesce("repeated", "total").alias("repeated"),
            F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf"),
        ), "facts",
    )

    # Sums over the members of every distinct block. At most one of them owns the block's end, and none
    # does where the block is short and another conversation owns the turn at which it ends.
    named = narrow.join(facts.withColumnRenamed("conv", "_conv"), F.col("conv") == F.col("_conv"))
    leads = F.col("own") <= F.col("end")
    sums = named.groupBy(*key).agg(
        F.sum("leaf").alias("leaves"), F.count(F.when(~leads, 1)).alias("m"), F.sum(F.when(leads, F.lit(0)).otherwise(F.col("repeated"))).alias("others"),
        F.sum(F.when(leads, F.col("own")).otherwise(F.lit(0))).alias("own"), F.sum(F.when(leads, F.col("repeated")).otherwise(F.lit(0))).alias("repeated"),
    ).select(*[F.col(c).alias(f"_{c}") for c in key], "leaves", "m", "others", "own", "repeated")
    summed = spread.join(sums, (F.col("key1") == F.col("_key1")) & (F.col("key2") == F.col("_key2")))
    at = F.col("chars_before")
    # The others repeat all that they have from here to where they own; so does the one, if it owns later.
    saved = F.col("others") - F.col("m") * at + F.when(F.col("own") > F.col("depth"), F.col("repeated") - at).otherwise(F.lit(0))
    part = summed.select(*NODE, "fork", "leaves", saved.alias("saved"))
    merged = part.filter("fork").groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = merged.union(part.filter("NOT fork").select(*NODE, "leaves", "saved")).select(
        F.col("one").alias("_one"), F.col("two").alias("_two"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )
    inner = tree.join(totals, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two"))).drop("_one", "_two")

    # The root, and parents: where a conversation begins to own, the node above has another owner.
    everyone = ids.select("conv").distinct()
    top = everyone.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv")).filter("n > 0")
    none = F.lit(0).cast("long")
    root = top.select(
        *[r.alias(c) for r, c in zip(_root(), NODE)], none.alias("depth"), "conv", "n",
        tree.filter("depth = 1").agg(F.count(F.lit(1))).scalar().alias("n_children"),
        F.greatest(facts.agg(F.coalesce(F.sum("leaf"), none)).scalar(), none + 1).alias("n_leaves"),
        facts.agg(F.coalesce(F.sum("repeated"), none)).scalar().alias("saved_tokens"), F.lit(None).cast("long").alias("parent_conv_id"),
    )
    owners = tree.select(F.col("one").alias("_p1"), F.col("two").alias("_p2"), F.col("conv").alias("_parent")).union(root.select(*NODE, "conv"))
    starts = facts.filter(F.col("own") < NEVER).select(F.col("conv").alias("_conv"), "own")
    begun = inner.join(starts, F.col("conv") == F.col("_conv")).drop("_conv")
    first = begun.filter("depth = own").join(owners, (F.col("above1") == F.col("_p1")) & (F.col("above2") == F.col("_p2")))
    shape = [*NODE, "depth", "conv", "n", "n_children", "n_leaves", "saved_tokens"]
    rows = (
        first.select(*shape, F.col("_parent").alias("parent_conv_id"))
        .union(begun.filter("depth > own").select(*shape, F.col("conv").alias("parent_conv_id")))
        .union(root.select(*shape, "parent_conv_id"))
    )

    tail = blocks.select("conv", "end", *[n.alias(f"t{i}") for i, n in enumerate(_node(F.size("turns"), block))])
    last = tail.join(facts.select(F.col("conv").alias("_conv"), "turns"), (F.col("conv") == F.col("_conv")) & (F.col("end") == F.col("turns")))
    silent = everyone.join(facts.select(F.col("conv").alias("_conv")), F.col("conv") == F.col("_conv"), "left_anti")
    ends = last.select(F.col("t0").alias("one"), F.col("t1").alias("two"), "conv").union(silent.select(*[r.alias(n) for r, n in zip(_root(), NODE)], "conv"))
    digests = _digests(ends).select(F.col("one").alias("_one"), F.col("two").alias("_two"), "sha")
    return rows.join(digests, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").cast("long").alias("n_convs"),
        "n_children", F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(conversations, key="conv_id", order="turn", role="role", text="text"):
    """(turns, ids) of the conversations that the query looks at, for ``prefix_nodes``.

    Conversation c becomes the first h turns of conversation ``c - c mod 100`` and its own turns after its first
    h; h is the crc32 of its decimal id modulo 6.
    """
    placed = stored(numbered_turns(conversations, key, order, role, text), "numbered")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("size"))
    plan = sizes.select("conv", "size", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(100))).alias("base"))
    bases = sizes.select(F.col("conv").alias("_base"), F.col("size").alias("_size"))
    plan = stored(
        plan.join(bases, F.col("base") == F.col("_base"), "left")
        .select("conv", "h", "base", F.least("h", F.coalesce("_size", F.lit(0))).alias("had")), "plan",
    )
    heads = placed.filter("place < 5").select(F.col("conv").alias("_from"), "place", "one", "two", "chars")
    borrowed = plan.join(heads, (F.col("base") == F.col("_from")) & (F.col("place") < F.col("h"))).select(
        "conv", (F.col("place") + 1).alias("depth"), "one", "two", "chars"
    )
    own = placed.join(plan.select(F.col("conv").alias("_conv"), "h", "had"), F.col("conv") == F.col("_conv")).filter("place >= h").select(
        "conv", (F.col("place") - F.col("h") + F.col("had") + 1).alias("depth"), "one", "two", "chars"
    )
    return borrowed.union(own), plan.select("conv")
