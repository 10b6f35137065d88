"""Reassessment against plain sets, and approvals that are all or none."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import reassess as X

FLAGS = "array<struct<code:string,severity:string,message:string,metadata:map<string,string>>>"


def made(spark, **change):
    students = change.get("students", [("a", "needs_review", False, [], ["old"]), ("b", "verified", False, [], []), ("c", "needs_review", True, [], ["x"]), ("d", "auto_matched", False, None, []), ("e", "auto_matched", False, [], []), ("f", "needs_review", False, [], [])])
    held = change.get("held", [("a", 1, 1, False), ("b", 3, 1, False), ("b", 4, 2, True), ("c", 5, 1, False), ("f", 11, 1, True)])
    owned = [(i, (i - 1) % 2 + 1, [("X", "block", "", {})] if i == 13 else []) for i in range(1, 15)]
    groups = change.get("groups", [("a", [1, 2], "auto_matched"), ("b", [3, 4], "auto_matched"), ("d", [7, 8], "auto_matched"), ("e", [9], "missing_pages"), ("g", [5, 6], "auto_matched"), ("h", [13, 14], "auto_matched"), ("i", [11, 12], "auto_matched")])
    return {
        "students": spark.createDataFrame(students, "roll string, status string, decided boolean, answer_flags array<string>, flags array<string>"),
        "held": spark.createDataFrame(held, "roll string, source long, slot int, manual boolean"),
        "unmatched": spark.createDataFrame([(10, "needs_review", True, None), (14, "ignored", False, None), (2, "needs_review", False, None)], "source long, status string, decided boolean, owner string"),
        "owned": spark.createDataFrame(owned, f"source_index long, sheet_page int, flags {FLAGS}"),
        "groups": spark.createDataFrame(groups, "roll string, sources array<long>, status string"),
        "ledger": spark.createDataFrame([(i, i not in change.get("lost", ())) for i in range(1, 15)], "source long, has_image boolean"),
    }


def test_protected_students_and_pages_stay(spark):
    after, held, pages = X.reassess(**made(spark), grouping_only=False)
    got = {r.roll: (r.protected, r.status, list(r.flags)) for r in after.collect()}
    # b is verified, c decided, f has a page put there by hand; g's page is c's, h's was ignored, i's is f's
    assert got == {
        "a": (False, "auto_matched", []), "b": (True, "verified", []), "c": (True, "needs_review", ["x"]), "d": (False, "needs_review", [X.LEGACY, X.UNCERTAIN]),
        "e": (False, "needs_review", [X.UNCERTAIN]), "f": (True, "needs_review", []),
    }
    assert sorted(map(tuple, held.collect())) == [("a", 1, 1, False), ("a", 2, 2, False), ("b", 3, 1, False), ("b", 4, 2, True), ("c", 5, 1, False), ("d", 7, 1, False), ("d", 8, 2, False), ("e", 9, 1, False), ("f", 11, 1, True)]
    told = {r.source: (r.status, r.owner, r.slot) for r in pages.collect()}
    assert told[1] == ("assigned", "a", 1) and told[2] == ("assigned", "a", 2) and told[6] == ("needs_review", None, None)
    assert told[10] == ("needs_review", None, None) and told[14] == ("ignored", None, None)
    assert not {3, 4, 5, 11} & set(told)
    assert {r.source: r.why for r in pages.collect()}[13] == ["X"]
    only = {r.roll: r.status for r in X.reassess(**made(spark), grouping_only=True)[0].collect()}
    assert only["d"] == "auto_matched"


def test_new_students_and_lost_images(spark):
    review = made(spark, groups=[("new", [7, 8], "auto_matched")])
    after, held, _ = X.reassess(**review, grouping_only=True)
    assert {r.roll: r.status for r in after.collect()}["new"] == "auto_matched"
    assert held.where("roll = 'new'").count() == 2 and held.where("roll = 'a'").count() == 0
    with pytest.raises(Exception, match="canonical pages are missing for a"):
        X.reassess(**made(spark, lost=(2,)), grouping_only=False)[1].collect()


def test_one_failure_stops_all_approvals(spark, tmp_path):
    review = made(spark)
    after, held, _ = X.reassess(**review, grouping_only=True)
    assert X.unproved(after, held, review["groups"], 2).collect() == []
    clean = sorted(r.roll for r in after.where("status = 'auto_matched'").collect())
    assert clean == ["a", "d"]
    with pytest.raises(ValueError, match="2 clean matches, 3 confirmed"):
        X.approve(after, held, review["groups"], 2, 3)
    done = {r.roll: r.status for r in X.approve(after, held, review["groups"], 2, 2).collect()}
    assert done["a"] == done["d"] == "approved" and done["e"] == "needs_review"
    broken = [
        ("group", held, review["groups"].where("roll <> 'd'"), after),
        ("certificate", held, review["groups"], after.withColumn("certificate", F.when(F.col("roll") != "d", F.col("certificate")))),
        ("by_hand", held.withColumn("manual", F.col("manual") | (F.col("roll") == "d")), review["groups"], after),
        ("flags", held, review["groups"], after.withColumn("flags", F.when(F.col("roll") == "d", F.array(F.lit("x"))).otherwise(F.col("flags")))),
        ("claims", held.unionByName(spark.createDataFrame([("z", 7, 1, False)], held.schema)), review["groups"], after),
    ]
    for why, h, g, students in broken:
        with pytest.raises(ValueError, match=rf"changed for d \({why}\)"):
            X.approve(students, h, g, 2, 2)
    with pytest.raises(ValueError, match=r"\(pages\)"):
        X.approve(after, held, review["groups"], 3, 2)
    home = f"{tmp_path}/approved"
    assert X.committed(spark, home) is None
    assert X.commit(after.select("roll", "status"), home) == 1
    assert X.commit(X.approve(after, held, review["groups"], 2, 2).select("roll", "status"), home) == 2
    # a version that was not finished is not seen
    after.select("roll", "status").limit(1).write.parquet(f"{home}/version=3")
    assert X.committed(spark, home).where("status = 'approved'").count() == 2
    assert X.commit(after.select("roll", "status"), home) == 3
