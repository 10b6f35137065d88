"""Queries that write the domain's files from the driver's tables and read them by their readers."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from gradeloom.plans import adapters as A
from gradeloom.session import dealt, shared_dir
from gradeloom.sources import files as S_
from gradeloom.sources import sheets

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


def home(spark, name: str) -> str:
    return f"{shared_dir(spark)}/gradeloom-files-{uuid.uuid4().hex}/{name}"


def as_csv(df, name: str) -> str:
    path = home(df.sparkSession, name)
    df.write.csv(path, header=True, quoteAll=True)
    return path


@query("roster_file", A.sql("roster", "SELECT roll_no, name, email, program, CAST(centre AS VARCHAR) AS centre FROM roster"))
def _(spark, d):
    r = A.roster(spark, d)
    bare = F.regexp_replace("roll_no", "^(MT|PHD)", "")
    rows = r.select(F.lower(bare).alias("Student Roll"), F.col("name").alias("Student_Name"), F.lit("").alias("e-mail"), F.col("email").alias("contact"), F.when(F.col("program") == "PHD", "Doctor of Philosophy").when(F.col("program") == "MTECH", "M.Tech").otherwise("B. Tech").alias("Degree"), F.col("centre").alias("centre"))
    return S_.read_roster(spark, as_csv(rows, "roster"), unique=False).select("roll_no", "name", "email", "program", F.col("extra")["centre"].alias("centre"))


@query("answer_key_file", "SELECT CAST(p_partkey AS INTEGER) AS q_no, CASE WHEN p_partkey % 50 = 0 THEN 'VOID' ELSE substr('ABCD', CAST(p_partkey % 4 + 1 AS INTEGER), 1) END AS answer, CASE WHEN p_partkey % 3 = 0 THEN 2.5::DOUBLE ELSE CAST(p_size % 4 AS DOUBLE) END AS marks, p_partkey % 50 = 0 OR (p_partkey % 3 <> 0 AND p_size % 4 = 0) AS dropped FROM part")
def _(spark, d):
    k = F.col("p_partkey")
    rows = A.table(spark, d, "part").select(k.alias("Question No"), F.when(k % 50 == 0, " void ").otherwise(F.lower(F.substring(F.lit("ABCD"), (k % 4 + 1).cast("int"), F.lit(1)))).alias("correct_option"), F.when(k % 3 == 0, "").otherwise((F.col("p_size") % 4).cast("string")).alias("Mark"))
    return S_.read_answer_key(spark, as_csv(rows, "key"), default_marks=2.5)


@query("rubric_file", "SELECT CAST(p_partkey AS INTEGER) AS q_no, p_name AS question_text, 'look for ' || p_brand AS rubric, '' AS model_answer, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS max_marks, p_type AS kind FROM part")
def _(spark, d):
    rows = A.table(spark, d, "part").select(F.col("p_partkey").alias("question_number"), F.col("p_name").alias("Prompt"), F.concat(F.lit("look for "), "p_brand").alias("Marking Guideline"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("").alias("marks_possible"), F.col("p_type").alias("kind"))
    return S_.read_rubric(spark, as_csv(rows, "rubric")).select("q_no", "question_text", "rubric", "model_answer", "max_marks", F.col("extra")["kind"].alias("kind"))


@query("table_file", "SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def _(spark, d):
    rows = A.table(spark, d, "nation").select(F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Region"))
    return S_.read_table(spark, as_csv(rows, "table") + "/*.csv").select(F.col("cells")["Name"].alias("name"), F.col("cells")["Region"].alias("region"))


@query("workbook_file", "SELECT p_partkey, p_name FROM part")
def _(spark, d):
    """A workbook of the parts of each size, written in tasks and read back by ranges of its rows."""
    path = home(spark, "workbooks")

    def put(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = sheets.workbook([["Key", "Name "], *([str(k), n] for k, n in zip(rows.p_partkey, rows.p_name, strict=True))])
        store, place = sheets.store_of(path)
        store.create_dir(place, recursive=True)
        own = f"{place}/.{key[0]}-{uuid.uuid4().hex}"
        with store.open_output_stream(own) as out:
            out.write(data)
        store.move(own, f"{place}/{key[0]}.xlsx")
        return pd.DataFrame({"path": [f"{path}/{key[0]}.xlsx"]})

    parts = A.table(spark, d, "part").select("p_partkey", "p_name", F.coalesce("p_size", F.lit(0)).alias("size"))
    # few bytes, much work: workbooks go to tasks of their own
    written = sorted(r.path for r in dealt(parts, "size", each=4096).groupBy("size").applyInPandas(put, "path string").collect())
    cells = sheets.read_workbooks(spark, written, rows=100).select(F.col("cells")["Key"].cast("long").alias("p_partkey"), F.col("cells")["Name"].alias("p_name"))
    return cells


@query("template_file", "SELECT 'exam' || (r_regionkey + 1) AS exam_id, CAST(s_suppkey AS INTEGER) AS q_no, CAST(s_suppkey % 2 + 1 AS INTEGER) AS page, 10.0::DOUBLE + s_suppkey % 7 AS x_mm, len(['A', 'B', 'C', 'D']) AS options FROM region, supplier WHERE s_nationkey % 5 = r_regionkey")
def _(spark, d):
    s = A.table(spark, d, "supplier").withColumn("exam", F.concat(F.lit("exam"), (F.col("s_nationkey") % 5 + 1).cast("string")))
    k = F.col("s_suppkey")
    mcq = F.struct((k % 2 + 1).cast("int").alias("page"), k.cast("int").alias("q_no"), (10.0 + k % 7).alias("x_mm"), F.lit(20.0).alias("y_mm"), F.array(*map(F.lit, "ABCD")).alias("options"))
    exams = s.groupBy(F.col("exam").alias("exam_id")).agg(F.collect_list(mcq).alias("mcq_block"))
    rows = exams.select("exam_id", F.lit(6).alias("schema_version"), F.lit(2).alias("num_pages"), F.struct(F.lit(210.0).alias("width_mm"), F.lit(297.0).alias("height_mm")).alias("page"), F.lit(2.5).alias("bubble_radius_mm"), "mcq_block")
    path = home(spark, "template")
    rows.write.option("maxRecordsPerFile", 1).json(path)
    return S_.read_manifest(spark, path)["mcq"].select("exam_id", "q_no", "page", "x_mm", F.size("options").cast("long").alias("options"))


@query("labels_file", "SELECT CAST(o_orderkey AS INTEGER) AS source_index, CAST(o_orderkey % 3 + 1 AS INTEGER) AS true_sheet_page, CAST(o_custkey AS VARCHAR) AS true_owner_roll FROM orders WHERE o_orderkey % 4 = 1")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = A.table(spark, d, "orders").select(k.alias("source_index"), (k % 3 + 1).alias("true_sheet_page"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("true_owner_roll"), F.when(k % 4 == 1, "test").otherwise("train").alias("split"))
    return S_.read_labels(spark, as_csv(rows, "labels"), "test")


@query("features_file", "SELECT vec_id AS crop_id, CAST(label AS VARCHAR) AS label, embedding[1] AS f0 FROM embeddings WHERE embedding IS NOT NULL AND label < 5")
def _(spark, d):
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    features = e.select(F.col("vec_id").alias("crop_id"), F.get("embedding", F.lit(0)).alias("f0"))
    path = as_csv(e.select(F.col("vec_id").alias("crop_id"), "label"), "labels")
    labels = S_.read_csv(spark, path).select(F.col("crop_id").cast("long").alias("crop_id"), "label")
    return S_.join_features(features, labels, ("0", "1", "2", "3", "4")).select("crop_id", "label", "f0")


@query("digits_file", "SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, sum(CAST(floor(abs(embedding[1]) * 100) AS BIGINT) + CAST(floor(abs(embedding[2]) * 100) AS BIGINT)) AS ink FROM embeddings WHERE embedding IS NOT NULL AND label IN (1, 2, 3) GROUP BY 1")
def _(spark, d):
    e = A.table(spark, d, "embeddings").where("embedding IS NOT NULL")
    pixel = lambda i: F.floor(F.abs(F.get("embedding", F.lit(i))) * 100)
    path = as_csv(e.select("label", pixel(0).alias("pixel0"), pixel(1).alias("pixel1")), "digits")
    rows = S_.read_digits(spark, path, ("1", "2", "3"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.get("pixels", F.lit(0)) + F.get("pixels", F.lit(1))).alias("ink"))


@query("scans_listed", "SELECT count(*) AS files, sum(n_nationkey % 3 + 1) AS pages, max(n_nationkey % 3 + 1) AS longest, count(*) AS digests FROM nation")
def _(spark, d):
    """A file of one to three pages for each nation, written, listed, counted and digested."""
    path = home(spark, "scans")
    one = F.concat(F.lit(" "), (F.col("i") + 2).cast("string"), F.lit(" 0 obj << /Type /Page /Parent 1 0 R /Contents ("), "n_name", F.lit(") >> endobj"))
    pages = A.table(spark, d, "nation").select("n_nationkey", "n_name", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("n_nationkey") % 3).cast("long"))).alias("i"))
    files = pages.groupBy("n_nationkey").agg(F.concat(F.lit("%PDF-1.4 1 0 obj << /Type /Pages >> endobj"), F.array_join(F.collect_list(one), ""), F.lit(" trailer %%EOF")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    listed, n = S_.list_scans(spark, path, ("txt",)), S_.count_pages(spark, path + "/*.txt")
    return listed.join(n, "path").agg(F.count("*").alias("files"), F.sum("pages").alias("pages"), F.max("pages").alias("longest"), F.count_distinct("digest").alias("digests"))


STATE = "exam_id string, students array<struct<roll_no:string,status:string,pages:array<struct<page:int,source_index:long>>>>"


@query("state_file", A.sql("pages", "SELECT student_key, sheet_page AS page, source_index FROM pages WHERE student_key % 5 = 0"))
def _(spark, d):
    """A run's state as JSON documents, a document for each centre, read back as rows."""
    p = A.pages(spark, d).where("student_key % 5 = 0")
    students = p.groupBy("student_key").agg(F.collect_list(F.struct(F.col("sheet_page").alias("page"), "source_index")).alias("pages"))
    docs = students.groupBy((F.col("student_key") % 25).cast("string").alias("exam_id")).agg(F.collect_list(F.struct(F.col("student_key").cast("string").alias("roll_no"), F.lit("verified").alias("status"), "pages")).alias("students"))
    path = home(spark, "state")
    docs.write.option("maxRecordsPerFile", 1).json(path)
    s = S_.read_state(spark, path, STATE).select(F.explode("students").alias("s"))
    return s.select(F.col("s.roll_no").cast("long").alias("student_key"), F.explode("s.pages").alias("p")).select("student_key", "p.page", "p.source_index")


@query("results_file", A.sql("responses", "SELECT CAST(sheet AS VARCHAR) AS sheet, CAST(count(*) AS VARCHAR) AS n, '' AS roll_no FROM responses GROUP BY sheet"))
def _(spark, d):
    """K1: results written with empty cells for nulls, and read back."""
    rows = A.responses(spark, d).groupBy("sheet").agg(F.count("*").alias("n")).withColumn("roll_no", F.lit(None).cast("string"))
    path = home(spark, "results")
    S_.write_results(rows, path)
    return S_.read_csv(spark, path).select("sheet", "n", F.coalesce("roll_no", F.lit("")).alias("roll_no"))


@query("feedback_appended", "SELECT c_custkey AS student_key, CAST(1 AS INTEGER) AS round FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 3 = 0")
def _(spark, d):
    """Rows appended twice to one table."""
    c, path = A.table(spark, d, "customer").select(F.col("c_custkey").alias("student_key")), home(spark, "feedback")
    S_.append(c.withColumn("round", F.lit(1)), path)
    S_.append(c.where("student_key % 3 = 0").withColumn("round", F.lit(2)), path)
    return spark.read.parquet(path)
