import os

from rallyframe.llm import jaccard, lines
from rallyframe.llm.files import narrowed
from rallyframe.session import checkpoint_dir

TEXTS = [
    "one long line of words that a few documents share with each other\nand a second line of its own here",
    "one long line of words that a few documents share with every other\nsomething else is said in this one",
]


def left(spark, work):
    """What ``work`` returns, and the labels of the steps that it leaves in the shared folder."""
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    return work(), {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}


def test_finished_steps_of_the_line_stage_leave_no_files(spark):
    docs = spark.createDataFrame([(i, TEXTS[i % 2]) for i in range(3)] + [(0, TEXTS[0])], "doc_id long, text string")
    got, names = left(spark, lambda: lines.without_repeats(docs).collect())
    assert sorted(r.dropped for r in got) == [0, 1, 2, 2]
    assert names <= {"again", "drops", "copies", "every"}


def test_finished_steps_of_the_jaccard_join_leave_no_files(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (2, text + " more"), (3, "another text")], "doc_id long, text string")
    got, names = left(spark, lambda: jaccard.near_duplicates(docs).collect())
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 3)]
    assert names <= {"classes", "sizes", "components"}


def test_narrowed_passes_all_that_match_and_few_others(spark):
    """A million wanted values passed three others of five before."""
    wanted, other = spark.range(1_000_000), spark.range(1_000_000, 1_100_000)
    assert narrowed(spark.range(50_000).union(spark.range(0)), "id", wanted).count() == 50_000
    assert narrowed(other, "id", wanted).count() < 10_000
    odd = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "k long, v string")
    assert {r.k for r in narrowed(odd, "k", odd.select("k").filter("k = 2")).collect()} >= {2}
    assert narrowed(odd, "k", odd.select("k").filter("false")).count() == 0
