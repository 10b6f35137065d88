"""Splits by linked writers and label rules against plain Python."""

import random
from collections import defaultdict

import pytest

from gradeloom.operators import evaluation


def test_linked_writers_stay_together_and_targets_are_met(spark):
    random.seed(2)
    rows = [(i, f"w{random.randint(0, 40)}", f"d{i}", str(i % 10)) for i in range(600)]
    rows += [(1000 + k, f"w{k}", f"d{k + 1}x", "1") for k in range(5)] + [(2000 + k, f"w{k + 1}", f"d{k + 1}x", "1") for k in range(5)]
    df = spark.createDataFrame(rows, "crop int, writer string, digest string, label string")
    got = evaluation.linked_holdout(df, 100, 51).collect()
    split, group = defaultdict(set), {}
    for r in got:
        split[r.writer].add(r.split)
        group[r.writer] = r.group
    assert len(got) == len(rows) and all(len(s) == 1 for s in split.values())
    assert len({group[f"w{k}"] for k in range(6)}) == 1
    sizes = {s: sum(r.split == s for r in got) for s in ("train", "val", "test")}
    assert sizes["test"] == 100 and sizes["val"] == 51
    again = {(r.crop, r.split) for r in evaluation.linked_holdout(df.repartition(5), 100, 51).collect()}
    assert again == {(r.crop, r.split) for r in got}


def test_targets_that_leave_nothing_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", "x", "1"), (2, "b", "y", "1")], "crop int, writer string, digest string, label string")
    with pytest.raises(ValueError):
        evaluation.linked_holdout(df, 1, 1)


def nearest(sizes, target):
    """The reachable sum next to the target, the lesser of two, by all subsets' sums."""
    sums = {0}
    for n in sizes.values():
        sums |= {s + n for s in sums}
    return min((s for s in sums if 0 < s < sum(sizes.values())), key=lambda s: (abs(s - target), s), default=None)


def test_sums_of_groups_are_the_nearest_there_are():
    random.seed(8)
    for _ in range(200):
        sizes = {f"g{i}": random.randint(1, 30) for i in range(random.randint(1, 12))}
        target = random.randint(1, 80)
        want = nearest(sizes, target)
        if want is None:
            with pytest.raises(ValueError):
                evaluation._chosen(sizes, target, 3)
            continue
        got = evaluation._chosen(sizes, target, 3)
        assert sum(sizes[g] for g in got) == want
        assert got == evaluation._chosen(dict(reversed(sizes.items())), target, 3)
    many = {f"g{i}": 1 + i % 7 for i in range(20_000)}
    assert sum(many[g] for g in evaluation._chosen(many, 30_011, 1)) == 30_011


def test_reasons_by_plain_rules(spark):
    from pyspark.sql import functions as F

    from gradeloom.operators import review

    rows = [
        (["Low confidence", "DUPLICATE page-1"], 1, "BTECH", "2000001", "duplicate_claim", "duplicate_claim"),
        (["cells did not produce a valid roll"], 2, None, "x", "no_literal_roll", "unreadable_roll"),
        (["requires manual confirmation"], 2, None, "x", "low_identity_confidence", "other"),
        (["program selector is blank"], 1, "BTECH", "x", "blank_selector_btech", "program_selector_btech"),
        (["continuation program selector is ambiguous", "program selector is blank"], 2, None, "x", "other_page_2", "program_selector_postgraduate"),
        (["orientation marker missing"], 0, None, "x", "other_page_unknown", "inspection_or_alignment_failure"),
        (None, None, None, None, "no_literal_roll", "other"),
    ]
    df = spark.createDataFrame(rows, "flags array<string>, page int, program string, roll string, want string, tally string")
    got = df.select("want", review.page_rejection(F.col("flags"), F.col("page"), F.col("program"), F.col("roll")).alias("reason"), "tally", review.unmatched_reason(F.col("flags"), F.col("program")).alias("cause")).collect()
    assert [(r.reason, r.cause) for r in got] == [(r.want, r.tally) for r in got]
