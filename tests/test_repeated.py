"""Rolls that come round, and joins that no size of a file tells."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import ownership as O
from gradeloom.operators import release as K
from gradeloom.operators import results as R
from gradeloom.plans import catalogue as Q
from gradeloom.sources import files


def test_crowded_points_are_never_sent_to_the_driver(spark):
    points = spark.createDataFrame([(1, i, float(i), 0.0) for i in range(20)], "page int, id int, x double, y double")
    plan = K.crowded(points, 1.0, 1.0)
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 19 + 18


def test_rows_of_one_roll_are_one_neighbour_with_their_number(spark):
    roster = spark.createDataFrame([(r, "BTECH") for r in ("2000001", "2000002", "2000099") for _ in range(3)], "roll_no string, program string")
    lists = O.neighbour_lists(roster)
    got = {r.roll: [(n.place, n.digit, n.other, n["rows"]) for n in r.neighbours] for r in lists.collect()}
    assert got == {"2000001": [(7, "1", "2", 9)], "2000002": [(7, "2", "1", 9)]}
    sure, unsure = [None] * 6 + [{"1": 0.9}], [None] * 6 + [{"1": 0.2}]
    pages = spark.createDataFrame([(1, "2000001", sure), (2, "2000001", unsure), (3, "2000001", [None] * 7)], "source_index long, roll string, probs array<map<string,double>>")
    told = {r.source_index: (r.neighbours, r.code) for r in O.neighbour_guard(pages, lists).collect()}
    assert told == {1: (9, None), 2: (9, "NEAR_NEIGHBOUR_HOLD"), 3: (9, "NEAR_NEIGHBOUR_EVIDENCE_MISSING")}


def test_what_was_sent_is_told_by_a_key_where_rolls_come_round(spark):
    queue = spark.createDataFrame([(1, "2000001"), (2, "2000001"), (3, "2000002")], "student long, roll_no string").withColumns({"email": F.lit("a@b.c"), "digest": F.lit("d"), "file_digest": F.lit("d")})
    log = spark.createDataFrame([(1, "SENT"), (3, "FAILED")], "student long, status string")
    assert [r.student for r in R.to_send(queue, log, 20, None, key="student").collect()] == [2, 3]


def test_a_roster_whose_rolls_come_round_is_read_whole_if_it_may(spark, tmp_path):
    (tmp_path / "roster.csv").write_text("roll,name,email,program\n2000001,A,a@x.org,BTECH\n2000001,B,b@x.org,BTECH\n")
    got = files.read_roster(spark, str(tmp_path / "roster.csv"), unique=False)
    assert sorted((r.roll_no, r.name) for r in got.collect()) == [("2000001", "A"), ("2000001", "B")]
    with pytest.raises(ValueError, match="duplicate"):
        files.read_roster(spark, str(tmp_path / "roster.csv"))


def folder(spark):
    listed = spark.createDataFrame([("1", "a@b.c"), ("1", "A@b.c"), ("2", "")], "roll_no string, email string")
    filed = spark.createDataFrame([("1", 5, 3), ("1", 2000, 1), ("3", 5, 1)], "roll_no string, length long, pages int")
    return filed, listed, spark.createDataFrame([("1",), ("3",)], "roll_no string")


def test_rows_of_one_roll_all_meet_in_a_folder(spark):
    got = sorted(tuple(r) for r in R.folder_errors(*folder(spark), 1000, 2).collect())
    assert got == [*[("1", "too_large")] * 2, *[("1", "too_many_pages")] * 2, ("2", "no_address"), ("2", "no_file"), ("2", "no_marks"), ("3", "not_on_roster")]


def test_a_release_still_tells_several_files_and_shared_addresses(spark):
    got = {tuple(r) for r in R.folder_release(*folder(spark), 1000, 2).collect()}
    assert {("1", "several_files"), ("1", "shared_address")} <= got


def test_a_query_tells_all_that_stands_against_a_release(spark, sf):
    rules = {r.rule for r in Q.QUERIES["folder_release_whole"](spark, sf).select("rule").distinct().collect()}
    assert {"several_files", "shared_address", "no_file", "not_on_roster", "no_marks", "no_address", "too_large", "too_many_pages"} == rules
