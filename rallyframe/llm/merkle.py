"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions only.

Sections are what ``\\n\\n`` separates, paragraphs what ``\\n`` separates inside them, and leaves
the sentences of a paragraph (cut after 32 code points at the latest). A paragraph's node is
the SHA-256 of its text, a section's that of its paragraphs' nodes, the root that of the
sections' nodes; both splits can be undone, so equal roots mean equal texts. The fingerprint
is written ``root|section:paragraph=leaf.leaf,paragraph=...;section:...`` with nodes below the
root shortened to 16 and leaves to 8 hex digits.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

LEAF = "[^.!?]{1,32}[.!?]*|[.!?]+"
#: Ranges of the key for each shuffle partition, so that ranges spread evenly.
RANGES = 4


def fingerprint(text):
    """The fingerprint of a text column; null counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def paragraph(p):
        leaves = F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.substring(F.md5(x), 1, 8))
        node = F.sha2(p, 256)
        return F.struct(node.alias("node"), F.concat(F.substring(node, 1, 16), F.lit("="), F.array_join(leaves, ".")).alias("shown"))

    def section(s):
        return F.transform(F.split(s, "\n", -1), paragraph)

    def shown(ps):
        node = F.sha2(F.array_join(F.transform(ps, lambda p: p["node"]), ""), 256)
        return F.struct(
            node.alias("node"),
            F.concat(
                F.substring(node, 1, 16), F.lit(":"), F.array_join(F.transform(ps, lambda p: p["shown"]), ",")
            ).alias("shown"),
        )

    sections = F.transform(F.transform(F.split(text, "\n\n", -1), section), shown)

    def whole(all_sections):
        root = F.sha2(F.array_join(F.transform(all_sections, lambda s: s["node"]), ""), 256)
        return F.concat(root, F.lit("|"), F.array_join(F.transform(all_sections, lambda s: s["shown"]), ";"))

    # One-element list: the sections are worked out once and used twice.
    return F.element_at(F.transform(F.array(sections), whole), 1)


def root(print_):
    return F.substring(print_, 1, 64)


def _leaves(print_):
    return F.array_distinct(F.regexp_extract_all(print_, F.lit("[=.]([0-9a-f]{8})"), F.lit(1)))


def likeness(a, b):
    """How alike two fingerprints are, 0 to 1: 1 for equal roots, else the Dice share of equal leaves.

    Null if a fingerprint is null; texts without leaves are like nothing but their equals.
    """
    def share(p):
        both = F.size(F.array_intersect(p["a"], p["b"]))
        return F.when(
            F.size(p["a"]) + F.size(p["b"]) > 0, 2.0 * both / (F.size(p["a"]) + F.size(p["b"]))
        ).otherwise(F.lit(0.0))

    pair = F.array(F.struct(_leaves(a).alias("a"), _leaves(b).alias("b")))
    return F.when(root(a) == root(b), F.lit(1.0)).when(
        a.isNotNull() & b.isNotNull(), F.element_at(F.transform(pair, share), 1)
    )


def changed_paragraphs(a, b):
    """Where two fingerprints differ: (section, paragraph) from 1, in order of the first one.

    Sections with equal nodes are skipped whole; a paragraph counts as changed if the other
    text's fingerprint holds no such node.
    """
    def sections(p):
        return F.split(F.substr(p, F.lit(66), F.length(p)), ";", -1)

    def node(s):
        return F.substring(s, 1, 16)

    there = F.transform(sections(b), node)
    known = F.regexp_extract_all(b, F.lit("([0-9a-f]{16})="), F.lit(1))

    def inside(s, i):
        ps = F.split(F.substr(s, F.lit(18), F.length(s)), ",", -1)
        marked = F.transform(
            ps,
            lambda p, j: F.when(
                ~F.array_contains(known, node(p)),
                F.struct((i + 1).alias("section"), (j + 1).alias("paragraph")),
            ),
        )
        return F.when(
            F.array_contains(there, node(s)), F.array().cast("array<struct<section:int,paragraph:int>>")
        ).otherwise(F.filter(marked, lambda m: m.isNotNull()))

    return F.flatten(F.transform(sections(a), inside))


def with_next(docs, key, text, name="next_text"):
    """Add the text of the next row in descending ``key`` order; after the last comes the first.

    Rows are cut into key ranges (bounds from an approximate quantile of the keys, as many as
    four per shuffle partition), one exchange deals them out, and a window inside the range finds the
    neighbour; the last row of a range takes the first of the next from a table with one row
    per range. Null keys come last, equal keys in the order of their texts; a lone row is its
    own neighbour. Null texts are empty.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    wanted = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / wanted for i in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx(key, steps, 10 * wanted).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    ranged = rows.withColumn("_range", _range_of(F.col(key), bounds))
    inside = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), text)
    tops = rows.select(_range_of(F.col(key), bounds).alias("_range"), key).groupBy("_range").agg(F.max(key).alias("_top"))
    # At most one row per range: RANGES times the shuffle partitions.
    heads = (
        ranged.join(
            F.broadcast(tops.withColumnRenamed("_range", "_r")),
            (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_top")),
        )
        .groupBy("_range")
        .agg(F.min(text).alias("_head"))
    )
    down = Window.orderBy(F.col("_range").desc())
    all_ranges = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    borders = heads.select(
        F.col("_range").alias("_r"), F.coalesce(F.lead("_head").over(down), F.first("_head").over(all_ranges)).alias("_border")
    )
    return (
        ranged.withColumn("_lead", F.lead(text).over(inside))
        .join(borders, F.col("_range") == F.col("_r"), "left")
        .select(key, text, "_range", F.coalesce("_lead", "_border").alias(name))
    )


def _range_of(key, bounds):
    """How many bounds lie below ``key`` (null: none), by bisection."""
    if not bounds:
        return F.lit(0)
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    table = F.array(*[F.lit(int(b)) for b in bounds])

    def halve(at, step):
        to = at + step
        below = (to <= len(bounds)) & (F.coalesce(F.try_element_at(table, F.least(to, F.lit(len(bounds)))), F.lit(0)) < key)
        return F.when(F.coalesce(below, F.lit(False)), to).otherwise(at)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def edited(text, following):
    """The last third of a text replaced by as many first code points of the following one."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - third), F.substr(following, F.lit(1), third))


def edit_report(docs, key="doc_id", text="text"):
    """Fingerprint every text and its edited form, and compare both with the original.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next (likeness to the next document in descending key order).
    """
    inside = Window.partitionBy("_range").orderBy(F.col(key).desc_nulls_last(), text)
    rows = with_next(docs, key, text)
    marked = (
        rows.withColumn("edited", edited(F.col(text), F.col("next_text")))
        .withColumns({"fingerprint": fingerprint(F.col(text)), "edited_fingerprint": fingerprint(F.col("edited"))})
    )
    compared = marked.withColumn("_next", F.lead("fingerprint").over(inside))
    following = F.coalesce(F.col("_next"), fingerprint(F.col("next_text")))
    return compared.select(
        key,
        F.length(text).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), following).alias("near_next"),
    )
