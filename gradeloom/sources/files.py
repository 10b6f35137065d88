"""Readers and writers of the domain's files.

CSV, JSON, images and whole files go through Spark's readers; a spreadsheet is unpacked by the
standard library in the task that holds its bytes.
"""

from __future__ import annotations

import hashlib
import hmac
import io
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom import schemas
from gradeloom.functions.scalars import infer_program, normalize_roll, strip
from gradeloom.operators.release import require, violations
from gradeloom.session import need

# Fixed aliases of headers, in order of precedence, and answers that drop a question.
ALIASES = {
    "roll_no": ("roll_no", "roll", "roll_number", "student_roll", "student_id", "rollno"),
    "name": ("name", "student_name", "studentname"),
    "email": ("email", "mail", "student_email", "email_id", "emailid"),
    "program": ("program", "degree", "class_type", "classtype"),
    "key_q_no": ("q_no", "question", "question_no"),
    "answer": ("answer", "correct", "correct_option"),
    "marks": ("marks", "mark"),
    "q_no": ("q_no", "question_no", "question_number", "q"),
    "question_text": ("question_text", "question", "prompt"),
    "rubric": ("rubric", "marking_guideline", "marking_guidelines", "guideline", "guidelines"),
    "model_answer": ("model_answer", "expected_answer", "sample_answer"),
    "max_marks": ("max_marks", "marks", "marks_possible"),
}
DROPPED = ("DROP", "DROPPED", "CANCELLED", "CANCELED", "BONUS", "VOID")
ADDRESS = r"^[^\s@,]+@[^\s@,]+\.[^\s@,]+$"


def canonical(header: str) -> str:
    return "".join(c for c in header.lower() if c.isascii() and c.isalnum())


def _columns(df: DataFrame) -> dict[str, list[str]]:
    """For each canonical field the columns whose header is an alias of it, in order of aliases."""
    keys = {c: canonical(c) for c in df.columns}
    return {field: list(dict.fromkeys(c for alias in aliases for c, k in keys.items() if k == canonical(alias))) for field, aliases in ALIASES.items()}


def _first(df: DataFrame, field: str, found: dict[str, list[str]]) -> Column:
    filled = [F.when(strip(F.col(f"`{c}`")) != "", strip(F.col(f"`{c}`"))) for c in found[field]]
    return F.coalesce(*filled, F.lit("")) if filled else F.lit("")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text; rows without any cell are left out."""
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    some = F.concat_ws("", *[F.col(f"`{c}`") for c in df.columns])
    return df.where(strip(some) != "")


def _lacking(found: dict[str, list[str]], field: str, what: str) -> None:
    if not found[field]:
        raise ValueError(f"{what}: one of these columns is needed: {', '.join(ALIASES[field])}")


def read_roster(spark: SparkSession, path: str, unique: bool = True) -> DataFrame:
    """Aliases, programs, rolls and addresses resolved, other filled columns in extra.

    Empty or repeated rolls, no or several addresses in a row, and a file without students are errors.
    unique: if not, rolls may repeat, as they do in a file of so many years that they come round.
    """
    df = read_csv(spark, path)
    found = _columns(df)
    _lacking(found, "roll_no", "roster")
    known = {canonical(a) for f in ("roll_no", "name", "email", "program") for a in ALIASES[f]}
    context = F.concat_ws(" ", *[F.col(f"`{c}`") for c in df.columns])
    raw = _first(df, "roll_no", found)
    program = infer_program(_first(df, "program", found), raw, context)
    shaped = F.array_distinct(F.filter(F.array(*[strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in df.columns]), lambda x: x.rlike(ADDRESS)))
    given = _first(df, "email", found)
    email = F.when(given != "", given).when(F.size(shaped) == 1, F.get(shaped, F.lit(0)))
    extra = [x for c in df.columns if canonical(c) not in known for x in (F.lit(c), F.col(f"`{c}`"))]
    filled = F.map_filter(F.create_map(*extra), lambda _, v: strip(F.coalesce(v, F.lit(""))) != "") if extra else F.expr("cast(map() as map<string,string>)")
    out = df.select(normalize_roll(raw, program).alias("roll_no"), F.regexp_replace(_first(df, "name", found), r"\s+", " ").alias("name"), email.alias("email"), program.alias("program"), filled.alias("extra"))
    by = out.groupBy("roll_no").agg(F.count("*").alias("n"), F.bool_and(F.col("email").isNotNull()).alias("mail"))
    require(violations(by, "roll_no", {"empty": F.col("roll_no") != "", "duplicate": (F.col("n") == 1) | F.lit(not unique), "email": F.col("mail")}), "roster")
    some(out, "roster")
    return out


def some(rows: DataFrame, what: str) -> None:
    """An error if there is no row."""
    if rows.isEmpty():
        raise ValueError(f"{what}: nothing in the file")


def read_answer_key(spark: SparkSession, path: str, default_marks: float = 1.0) -> DataFrame:
    """Answers in upper case, blank marks by default; dropped if so named or worth nothing.

    Questions that are no number or occur twice, empty answers and marks that are no number are errors.
    """
    df = read_csv(spark, path)
    found = _columns(df)
    _lacking(found, "key_q_no", "answer key")
    _lacking(found, "answer", "answer key")
    q, marks = _first(df, "key_q_no", found), _first(df, "marks", found)
    value = F.when(marks == "", F.lit(default_marks)).otherwise(marks.try_cast("double"))
    out = df.select(F.when(q.rlike(r"^[+-]?\d+$"), q.try_cast("int")).alias("q_no"), F.upper(_first(df, "answer", found)).alias("answer"), value.alias("marks"))
    out = out.withColumn("dropped", F.col("answer").isin(*DROPPED) | (F.col("marks") == 0))
    by = out.groupBy("q_no").agg(F.count("*").alias("n"), F.bool_and(F.col("marks").isNotNull()).alias("fine"), F.bool_and(F.col("answer") != "").alias("told"))
    require(violations(by, "q_no", {"question": F.col("q_no").isNotNull(), "duplicate": F.col("n") == 1, "marks": F.col("fine"), "answer": F.col("told")}), "answer key")
    some(out, "answer key")
    return out


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """S3: a rubric's questions, other filled columns in extra; maximum marks must be above 0, a row must say something."""
    df = read_csv(spark, path)
    found = _columns(df)
    _lacking(found, "q_no", "rubric")
    fields = ("q_no", "question_text", "rubric", "model_answer", "max_marks")
    used = {found[f][0] for f in fields if found[f]}
    text = {f: _first(df, f, found) for f in ("question_text", "rubric", "model_answer")}
    most, q = _first(df, "max_marks", found), _first(df, "q_no", found)
    extra = [x for c in df.columns if c not in used for x in (F.lit(c), F.col(f"`{c}`"))]
    filled = F.map_filter(F.create_map(*extra), lambda _, v: strip(F.coalesce(v, F.lit(""))) != "") if extra else F.expr("cast(map() as map<string,string>)")
    out = df.select(F.when(q.rlike(r"^[+-]?\d+$"), q.try_cast("int")).alias("q_no"), *[c.alias(f) for f, c in text.items()], F.when(most != "", most.try_cast("double")).alias("max_marks"), filled.alias("extra"), (most != "").alias("given"))
    each = out.groupBy("q_no").agg(
        F.count("*").alias("n"), F.bool_and(~F.col("given") | F.coalesce(F.col("max_marks") > 0, F.lit(False))).alias("most"),
        F.bool_and(F.col("given") | (F.concat_ws("", "question_text", "rubric", "model_answer") != "")).alias("told"),
    )
    require(violations(each, "q_no", {"question": F.col("q_no").isNotNull(), "duplicate": F.col("n") == 1, "max_marks": F.col("most"), "empty": F.col("told")}), "rubric")
    some(out, "rubric")
    return out.drop("given")


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(data: bytes) -> list[list[str]]:
    """The first sheet of a workbook as rows of text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{_NS}t")) for item in root.iter(f"{_NS}si")]
        first = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/sheet"))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: dict[int, str] = {}
            for cell in row.iter(f"{_NS}c"):
                column = 0
                for letter in "".join(x for x in cell.get("r", "A1") if x.isalpha()):
                    column = column * 26 + ord(letter) - 64
                value, kind = cell.find(f"{_NS}v"), cell.get("t")
                text = "".join(t.text or "" for t in cell.iter(f"{_NS}t")) if kind == "inlineStr" else (value.text or "" if value is not None else "")
                cells[column - 1] = shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return [r for r in rows if any(x.strip() for x in r)]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Path, row and cells (header -> text) of CSV or spreadsheet files; repeated headers are an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for part in parts:
            for name, data in zip(part["path"], part["content"], strict=True):
                rows = sheet_rows(data) if name.lower().endswith(".xlsx") else [r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"))) if any(x.strip() for x in r)]
                head = [x.strip() for x in rows[0]] if rows else []
                keys = [k for k in map(canonical, head) if k]
                if len(keys) != len(set(keys)):
                    raise ValueError(f"{name}: repeated headers")
                cells = [{h: (r[i] if i < len(r) else "") for i, h in enumerate(head) if h} for r in rows[1:]]
                yield pd.DataFrame({"path": name, "row": range(1, len(cells) + 1), "cells": cells}) if cells else pd.DataFrame({"path": [], "row": [], "cells": []})

    return files.mapInPandas(run, "path string, row int, cells map<string,string>")


def read_manifest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A template's blocks as dimension tables; what breaks its rules is one error."""
    m = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True)
    questions = m.select("exam_id", F.explode(F.concat(*[F.transform(F.coalesce(F.col(f"{b}_block"), F.expr("array()")), lambda x: x["q_no"]) for b in ("mcq", "numerical", "written")])).alias("q_no"))
    require(violations(m, "exam_id", {"version": F.col("schema_version").isin(4, 5, 6), "pages": F.col("num_pages") >= 1, "radius": F.col("bubble_radius_mm") > 0, "size": (F.col("page.width_mm") > 0) & (F.col("page.height_mm") > 0)}), "manifest")
    require(violations(questions.groupBy("q_no").count(), "q_no", {"duplicate": F.col("count") == 1}), "manifest questions")
    tables = {b: m.select("exam_id", F.explode(f"{b}_block").alias("x")).select("exam_id", "x.*") for b in ("mcq", "numerical", "written")}
    return tables | {"exam": m.select("exam_id", "schema_version", "num_pages", "page.*", "bubble_radius_mm")}


def list_scans(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("pdf", "png", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """Files of a folder in order of path, with size and digest; none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    some(files.select("path"), f"scans in {path}")
    return files.select("path", "length", F.sha2("content", 256).alias("digest")).orderBy("path")


def pdf_objects(data: bytes) -> dict[int, bytes]:
    """A PDF's objects by number, as far as they are no streams' contents; the last definition counts.

    Objects in compressed object streams are read out of them.
    """
    out: dict[int, bytes] = {}
    for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.DOTALL):
        head, stream, rest = m.group(2).partition(b"stream")
        out[int(m.group(1))] = head
        if not stream or not re.search(rb"/Type\s*/ObjStm\b", head):
            continue
        n, first = (int(re.search(rb"/" + key + rb"\s+(\d+)", head).group(1)) for key in (b"N", b"First"))
        raw = rest.removeprefix(b"\r\n") if rest.startswith(b"\r\n") else rest.removeprefix(b"\n")
        content = zlib.decompressobj().decompress(raw) if b"/FlateDecode" in head else raw
        table = list(map(int, content[:first].split()[: 2 * n]))
        places = [first + at for at in table[1::2]]
        for number, begin, end in zip(table[::2], places, [*places[1:], len(content)], strict=True):
            out[number] = content[begin:end]
    return out


def pages_of(name: str, data: bytes) -> int:
    """A PDF's pages by its page objects, 1 for an image. Encrypted PDFs and images of several frames are errors."""
    if name.lower().endswith(".pdf") or data.startswith(b"%PDF-"):
        if b"/Encrypt" in data:
            raise ValueError(f"{name}: encrypted")
        # a file without numbered objects is taken as it is
        found = sum(len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", x)) for x in (pdf_objects(data).values() or [data]))
        if not found:
            raise ValueError(f"{name}: no readable page objects")
        return found
    if data[:4] in (b"II*\0", b"MM\0*"):
        order, frames = ("<" if data[:2] == b"II" else ">"), 0
        at = struct.unpack_from(order + "I", data, 4)[0]
        while at and frames < 2:
            frames += 1
            entries = struct.unpack_from(order + "H", data, at)[0]
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * entries)[0]
        if frames > 1:
            raise ValueError(f"{name}: several frames")
    return 1


def count_pages(spark: SparkSession, path: str) -> DataFrame:
    """Path and pages of every file of a folder."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"path": part["path"], "pages": [pages_of(n, d) for n, d in zip(part["path"], part["content"], strict=True)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, pages int")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Page images with height, width and pixels; one that can't be read is an error. PDF pages need render_pdf."""
    files = spark.read.format("image").option("dropInvalid", False).load(path)
    require(violations(files.select("image.origin", (F.col("image.height") > 0).alias("fine")), "origin", {"unreadable": F.col("fine")}), "scans")
    some(files.select("image.origin"), f"scans in {path}")
    return files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A run's JSON state, one row for each document; a file that isn't such a document is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read_digits(spark: SparkSession, path: str, labels: tuple[str, ...], holdout: float = 0.1, seed: int = 557) -> DataFrame:
    """A dataset of labelled digit images as CSV (label, then a column for each pixel): label, pixels and a seeded split.

    Rows of other labels are left out. The split goes by a seeded hash of the row, so it is the same in any order.
    """
    df = read_csv(spark, path)
    pixels = F.array(*[F.col(f"`{c}`").try_cast("int") for c in df.columns if canonical(c) != "label"])
    rows = df.select(strip(F.col("label")).alias("label"), pixels.alias("pixels")).where(F.col("label").isin(*labels))
    share = F.pmod(F.xxhash64(F.lit(seed), "label", "pixels"), F.lit(10_000)) / 10_000
    return rows.withColumn("split", F.when(share < holdout, "val").otherwise("train"))


def render_pdf(*_, **__):
    """Pages of a PDF; only with a PDF library."""
    return need("fitz", "rendering a PDF")


def read_labels(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Labelled pages; numbers must be numbers, owners present, sources unique."""
    df = read_csv(spark, path)
    df = df if split is None else df.where(F.col("split") == split)
    out = df.select(F.col("source_index").try_cast("int").alias("source_index"), F.col("true_sheet_page").try_cast("int").alias("true_sheet_page"), strip(F.col("true_owner_roll")).alias("true_owner_roll"))
    by = out.groupBy("source_index").agg(F.count("*").alias("n"), F.bool_and(F.col("true_sheet_page").isNotNull()).alias("page"), F.bool_and(F.coalesce(F.col("true_owner_roll") != "", F.lit(False))).alias("owner"))
    require(violations(by, "source_index", {"source": F.col("source_index").isNotNull(), "duplicate": F.col("n") == 1, "page": F.col("page"), "owner": F.col("owner")}), "labels")
    return out


def join_features(features: DataFrame, labels: DataFrame, legal: tuple[str, ...]) -> DataFrame:
    """Features with their labels, legal ones only."""
    return features.join(labels.where(F.col("label").isin(*legal)).select("crop_id", "label"), "crop_id")


def write_results(df: DataFrame, path: str) -> None:
    """K1: results as CSV with a header; nulls are empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True)


def write_json(payload: dict, path: str) -> None:
    """K4: a small document, written beside and then put in place of the old one."""
    own = f"{path}.{os.getpid()}.{uuid.uuid4().hex}.tmp"
    with open(own, "w", encoding="utf-8") as f:
        json.dump(payload, f, sort_keys=True)
    os.replace(own, path)


def append(df: DataFrame, path: str) -> None:
    """Rows added to a table."""
    df.write.mode("append").parquet(path)


def pseudonymised(df: DataFrame, column: str, key: bytes) -> DataFrame:
    """Ids as HMAC-SHA256 under a key that is made for one export (no such function in Spark)."""

    @F.pandas_udf("string")
    def hide(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else hmac.new(key, str(x).encode(), hashlib.sha256).hexdigest()[:16])

    return df.withColumn(column, hide(F.col(column).cast("string")))
