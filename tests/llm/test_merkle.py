import hashlib
import re

from pyspark.sql import functions as F

from rallyframe.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def direct(text):
    sections = []
    for s in (text or "").split("\n\n"):
        paragraphs = []
        for p in s.split("\n"):
            leaves = [hashlib.md5(x.encode()).hexdigest()[:8] for x in re.findall(merkle.LEAF, p)]
            paragraphs.append((sha(p), sha(p)[:16] + "=" + ".".join(leaves)))
        node = sha("".join(n for n, _ in paragraphs))
        sections.append((node, node[:16] + ":" + ",".join(x for _, x in paragraphs)))
    return sha("".join(n for n, _ in sections)) + "|" + ";".join(x for _, x in sections)


def test_report_matches_direct_computation(spark, small):
    got = {}
    for r in merkle.edit_report(small).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(((r.doc_id, r.text or "") for r in small.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sum(map(len, got.values())) == len(rows)
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        ed = text[: len(text) - third] + following[:third]
        options = [r for r in got[key] if r.edited_sha256 == sha(ed)]
        assert options and options[0].n_chars == len(text)
        assert options[0].fingerprint == direct(text) and options[0].edited_fingerprint == direct(ed)


def test_many_ranges_give_the_same_neighbours(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 1000).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    texts = {r.doc_id: r.text for r in rows.collect()}
    order = sorted(texts, reverse=True)
    after = {a: texts[b] for a, b in zip(order, order[1:] + order[:1])}
    assert {r.doc_id: r.next_text for r in merkle.with_next(rows, "doc_id", "text").collect()} == after


def test_likeness_and_places(spark):
    a = "First line here. And more.\nSecond line stays.\n\nNew section. It is long enough to have leaves."
    b = a.replace("Second line stays.", "Second line went.")
    rows = spark.createDataFrame([(a, a), (a, b), (a, ""), ("", ""), (a, "Nothing alike at all?")], "a string, b string")
    fa, fb = merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))
    got = rows.select(merkle.likeness(fa, fb).alias("l"), merkle.changed_paragraphs(fa, fb).alias("c")).collect()
    assert got[0].l == 1 and got[0].c == []
    assert 0.7 < got[1].l < 1 and [tuple(x) for x in got[1].c] == [(1, 2)]
    assert got[2].l == 0 and got[3].l == 1 and got[4].l < 0.2


def test_lone_row_and_empty_table(spark, small):
    one = merkle.edit_report(small.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert merkle.edit_report(small.filter("false")).count() == 0
