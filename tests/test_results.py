"""Results, states, layout and streams: rules that the queries' tables don't reach."""

import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import layout as L
from gradeloom.operators import results as R
from gradeloom.streaming import logs


def test_canonical_json_is_that_of_sorted_keys(spark):
    df = spark.createDataFrame([((2, [("x", None), ("y", 1)], None),)], "p struct<b:int,a:array<struct<n:string,m:int>>,c:string>")
    got = df.select(R.canonical_json(F.col("p"), df.schema["p"].dataType).alias("j")).first().j
    assert got == json.dumps({"b": 2, "a": [{"n": "x", "m": None}, {"n": "y", "m": 1}], "c": None}, sort_keys=True, separators=(",", ":"))


def test_changed_evidence_is_an_error(spark):
    rows = spark.createDataFrame([(1, (5,)), (2, (6,))], "k int, payload struct<a:int>")
    saved = rows.select("k", R.json_digest(F.col("payload"), rows.schema["payload"].dataType).alias("digest"))
    assert R.replayed(rows, saved.where("k = 1"), "k").count() == 2
    with pytest.raises(Exception, match="changed"):
        R.replayed(rows, saved.withColumn("digest", F.lit("x")), "k").collect()


def test_assets_outside_the_run_are_an_error(spark):
    df = spark.createDataFrame([((["/runs/2/a.png"],),)], "e struct<crop_paths:array<string>>")
    with pytest.raises(Exception, match="outside"):
        df.select(R.relative_paths(F.col("e"), df.schema["e"].dataType, "/runs/1")).collect()


def test_a_real_send_needs_its_number(spark):
    queue = spark.createDataFrame([("1", "a", "d", "d"), ("2", "b", "d", "d")], "roll_no string, email string, digest string, file_digest string")
    log = spark.createDataFrame([("1", "SENT")], "roll_no string, status string")
    with pytest.raises(ValueError):
        R.to_send(queue, log, None, 2, dry=False)
    assert [(r.roll_no, r.status) for r in R.to_send(queue, log, None, 1, dry=False).collect()] == [("2", "SENT")]


def test_exam_rules():
    assert L.exam_errors(L.Exam("e", 10, written=[L.Written(11, 5, 3)])) == []
    bad = L.Exam("e", 10, 9, written=[L.Written(5, 5, 3), L.Written(5, 5, 3)], numerical=[L.Numerical(12, 1, 9)], sections=["mcq", "mcq"])
    assert set(L.exam_errors(bad)) == {"mcq_options", "numerical_fields", "written_unique", "written_after_mcq", "written_after_numerical", "sections"}
    assert "some_question" in L.exam_errors(L.Exam("e", 0))


def test_flow_takes_the_fewest_pages_then_columns():
    pages, columns, places = L.laid_out(L.Exam("e", 30))
    assert (pages, columns) == (1, 2) and [p[1] for p in places] == list(range(1, 31))
    first = [p for p in places if p[3] == L.Sheet().margin]
    assert [p[1] for p in first] == list(range(1, len(first) + 1)) and len({p[4] for p in first}) == len(first)
    many = L.laid_out(L.Exam("e", 200))
    wide = min((L.laid_out(L.Exam("e", 200), L.Sheet(columns=(c,)))[0], c) for c in (2, 3, 4))
    assert many[:2] == wide
    assert L.laid_out(L.Exam("e", 40, 6))[1] in (2, 3) and L.laid_out(L.Exam("e", 0, written=[L.Written(1, 1, 2)]))[1] == 0
    with pytest.raises(L.TooTight):
        L.laid_out(L.Exam("e", 0, written=[L.Written(1, 1, 90)]))


def test_boxes_of_a_page_do_not_meet():
    e = L.Exam("e", 25, written=[L.Written(40 + i, 5, 5) for i in range(6)], numerical=[L.Numerical(26 + i, 1, 3) for i in range(6)])
    s, (_, _, places) = L.Sheet(), L.laid_out(e)
    lines = {q.q_no: q.lines for q in e.written}
    boxes = [(p[2], p[4], p[4] + (lines[p[1]] * s.line if p[0] == "written" else s.number_height)) for p in places if p[0] != "mcq"]
    rows = sorted(set(boxes))
    assert all(a[0] != b[0] or a[2] <= b[1] + 1e-6 for a, b in zip(rows, rows[1:])) and all(b[2] <= s.bottom + 1e-6 for b in boxes)


def test_best_lines_accept_a_sure_reader_early(spark):
    rows = [(1, 1, 1, "The answer is forty two", 0.95), (1, 1, 2, "A much longer and even better answer", 0.99), (1, 2, 1, "##", 0.2), (1, 2, 2, "second", 0.6)]
    got = L.best_lines(spark.createDataFrame(rows, "doc int, line int, reader int, text string, confidence double"), ["doc"], "line").first()
    assert got.text == "The answer is forty two\nsecond"


def test_sink_sends_once_over_runs_and_repeated_batches(spark, tmp_path):
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "a long")
    rows(1, 2, 2).write.parquet(folder)
    stream = lambda: spark.readStream.schema("a long").parquet(folder)
    assert sorted(r.a for r in logs.send_once(stream(), ["a"], log, put_again=True).collect()) == [1, 2]
    rows(2, 3).write.mode("append").parquet(folder)
    assert sorted(r.a for r in logs.send_once(stream(), ["a"], log, put_again=True).collect()) == [1, 2, 3]


def test_progress_is_told(spark, tmp_path):
    told, folder = [], str(tmp_path / "in")
    spark.range(5).write.parquet(folder)
    listener = logs.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        query = spark.readStream.schema("id long").parquet(folder).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert told[0] == {"state": "started"} and {"state": "running", "rows": 5} in told
