"""Preflight: a sound sheet passes, and each of nine defects is found alone."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import preflight as L
from gradeloom.plans import q_scans as Q

DPI = 100.0


def issues(spark, keys, change=lambda key, gray: None, marks=None):
    told = spark.createDataFrame(pd.concat([Q.sheet_marks(k) if marks is None else marks(k) for k in keys]), L.MARKS)
    pages = []
    for r in L.printed(told, DPI).collect():
        gray = np.frombuffer(bytes(r.data), dtype=np.uint8).reshape(r.height, r.width).copy()
        Q.spoiled(r.sheet, gray, DPI / 25.4)
        change(r.sheet, gray)
        pages.append((r.sheet, r.page, r.height, r.width, bytearray(gray.tobytes())))
    frame = spark.createDataFrame(pages, "sheet long, page int, height int, width int, data binary")
    return {(r.sheet, r.check): (r.severity, r.name, r.value) for r in L.preflight(told, frame, DPI).collect()}


def test_each_defect_alone(spark):
    keys = range(30, 60)
    got = issues(spark, keys)
    errors = {k: sorted(c for (s, c), v in got.items() if s == k and v[0] == "error") for k in keys}
    assert errors == {k: [x for x in [Q.DEFECTS[k % 10]] if x] for k in keys}
    assert got[31, "bubbles print empty"][1] == "Q0-A"
    assert got[34, "orientation"][1] == "TL" and got[34, "orientation"][2] == 1.0
    assert got[33, "marker solid"][1] == "BL"
    assert got[35, "bubble spacing"][1].startswith(("Q0-A/Q9-A", "Q9-A/Q0-A"))
    assert got[36, "safe margin"][1] == "left"
    assert got[38, "answer box blank"][1] == "Q7" and got[39, "page bounds"][1] == "Q8"


def test_warnings_and_pages_without_marks(spark):
    def near(key):
        m = Q.sheet_marks(key)
        m.loc[m.kind == "orientation", "x_mm"] = 95.0
        m.loc[m["name"] == "Q1-A", "y_mm"] = 50.0 + 3.5
        return m[~((m.kind == "bar") & (key == 20))]

    got = issues(spark, [10, 20], marks=near)
    assert got[10, "orientation"][0] == "warning" and got[10, "bubble spacing"][0] == "warning"
    assert (20, "page index") not in got

    def grey(key, gray):
        k = DPI / 25.4
        for x in (74.0, 88.0, 102.0):
            part = gray[round(12 * k) : round(16 * k), round((x - 4) * k) : round((x + 4) * k)]
            part[part > 200] = 150
            part[part < 50] = 40

    severity, _, lead = issues(spark, [10], change=grey)[10, "page index"]
    assert severity == "warning" and lead == pytest.approx((150 - 40) / 255, abs=0.02)
    without = issues(spark, [10], marks=lambda k: Q.sheet_marks(k)[lambda m: m.kind != "orientation"])
    assert without[10, "orientation"][2] == 0.0


def test_no_sheets(spark):
    empty = spark.createDataFrame([], L.MARKS)
    assert L.preflight(empty, L.printed(empty, DPI), DPI).where(F.lit(True)).collect() == []


def test_pages_are_dealt_by_number_and_none_is_joined(spark):
    told = spark.createDataFrame(pd.concat([Q.sheet_marks(k) for k in range(150)]), L.MARKS)
    assert L.printed(told, 20.0).rdd.getNumPartitions() == 3
    assert "Join" not in L.orientation_issues(told)._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.sheet, r.name, r.value) for r in L.orientation_issues(told).collect()}
    assert got == {(k, "TL", 1.0) for k in range(4, 150, 10)}
    # without its mark a page has no nearest corner; two marks are an error too
    some = told.where("sheet < 3 AND kind IN ('orientation', 'fiducial')")
    bare = some.where("kind = 'fiducial' OR sheet > 0").unionByName(some.where("sheet = 1 AND kind = 'orientation'"))
    assert {(r.sheet, r.severity, r.name, r.value) for r in L.orientation_issues(bare).collect()} == {(0, "error", None, 0.0), (1, "error", "TL", 2.0)}
