"""Queries on drawn scans: alignment, ink, digit features and round trips, held to what was drawn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import images as M
from gradeloom.functions import pixels
from gradeloom.operators import evaluation as E
from gradeloom.operators import preflight as L
from gradeloom.operators import release as K
from gradeloom.operators import scans as P
from gradeloom.plans import adapters as A
from gradeloom.session import dealt

Q: dict = {}
S: dict = {}
DPI = 60.0
TEMPLATE = P.Template()


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return put


def photographed(key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """A page as it lay askew under a camera, turned by quarters; its corner markers there; every thirteenth is blank.

    Of every eleventh the marker at the lower right is hidden.
    """
    random = np.random.default_rng(key)
    page = P.drawn(TEMPLATE, key % 3 + 1, DPI) if key % 13 else np.full(TEMPLATE.size(DPI), 255, dtype=np.uint8)
    h, w = page.shape
    if key % 11 == 0:
        page[h - 60 :, w - 60 :] = 255
    frame = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], dtype=float)
    askew = 15 if key % 11 else 5
    matrix = M.homography(frame, frame + 40 + random.uniform(-askew, askew, (4, 2)))
    scan = M.warped(page, matrix, (h + 80, w + 80), fill=230)
    scan = np.clip(scan.astype(int) + random.integers(-12, 12, scan.shape), 0, 255).astype(np.uint8)
    at = M.moved(TEMPLATE.corners(DPI), matrix)
    for _ in range(key % 4):
        at = np.column_stack([at[:, 1], scan.shape[1] - 1 - at[:, 0]])
        scan = np.rot90(scan)
    return np.ascontiguousarray(scan), at


def photos(spark: SparkSession, d: str) -> DataFrame:
    """A photo of a page for each supplier: id, height, width, data, and where its markers are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key in part["id"]:
                scan, at = photographed(int(key))
                yield pd.DataFrame({"id": [key], "height": [scan.shape[0]], "width": [scan.shape[1]], "data": [scan.tobytes()], "truth": [at.tolist()]})

    ids = dealt(A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), "id")
    return ids.mapInPandas(run, "id long, height int, width int, data binary, truth array<array<double>>")


@query("page_alignment", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey % 3 + 1 AS INTEGER) END AS page_index, CASE WHEN s_suppkey % 13 <> 0 THEN CAST(s_suppkey % 4 AS INTEGER) END AS turn, CASE WHEN s_suppkey % 13 <> 0 THEN TRUE END AS near, s_suppkey % 13 = 0 AS refused FROM supplier")
def _(spark, d):
    # a photo is drawn and looked at once: none is kept, shuffled or met again
    found = P.align(photos(spark, d), TEMPLATE, DPI, image=False, beside=("truth",))
    # the hidden corner of a page is inferred, its others are found
    far = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.hypot(*(F.get(F.get("corners", i), F.lit(c)) - F.get(F.get("truth", i), F.lit(c)) for c in (0, 1))))
    shown = F.when(F.col("id") % 11 == 0, F.concat(F.slice(far, 1, 2), F.slice(far, 4, 1))).otherwise(far)
    return found.select("id", "page_index", "turn", (F.array_max(shown) <= 1.5).alias("near"), F.col("problem").isNotNull().alias("refused"))


SEGMENTS = {0: "abcdef", 1: "bc", 2: "abged", 3: "abgcd", 4: "fgbc", 5: "afgcd", 6: "afgedc", 7: "abc", 8: "abcdefg", 9: "abcdfg"}
PLACES = {"a": ((0, 0), (1, 0)), "b": ((1, 0), (1, 1)), "c": ((1, 1), (1, 2)), "d": ((0, 2), (1, 2)), "e": ((0, 1), (0, 2)), "f": ((0, 0), (0, 1)), "g": ((0, 1), (1, 1))}


def stroke(gray: np.ndarray, x0: float, y0: float, x1: float, y1: float, thick: float, shade: int) -> None:
    """A line with round ends."""
    top, left = max(0, int(min(y0, y1) - thick)), max(0, int(min(x0, x1) - thick))
    part = gray[top : int(max(y0, y1) + thick) + 2, left : int(max(x0, x1) + thick) + 2]
    y, x = np.ogrid[top : top + part.shape[0], left : left + part.shape[1]]
    dx, dy = x1 - x0, y1 - y0
    along = np.clip(((x - x0) * dx + (y - y0) * dy) / max(1e-9, dx * dx + dy * dy), 0, 1)
    part[np.hypot(x - x0 - along * dx, y - y0 - along * dy) <= thick / 2] = shade


def digit_cell(key: int) -> np.ndarray:
    """A framed cell with the digit key % 10, slanted and shifted a little, on paper that darkens to one side."""
    random = np.random.default_rng(key)
    gray = np.tile(np.linspace(250, 200, 48), (56, 1)).astype(np.uint8)
    left, top, slant = 16 + random.uniform(-2, 2), 14 + random.uniform(-2, 2), random.uniform(-0.15, 0.15)
    wide, tall = 15 + random.uniform(-1, 1), 14 + random.uniform(-1, 1)
    for s in SEGMENTS[key % 10]:
        (ax, ay), (bx, by) = PLACES[s]
        at = lambda px, py: (left + px * wide + slant * (2 - py) * tall, top + py * tall)
        stroke(gray, *at(ax, ay), *at(bx, by), 3 + random.uniform(-0.5, 0.5), 40)
    gray[:2], gray[-2:], gray[:, :2], gray[:, -2:] = 60, 60, 60, 60
    return gray


@F.pandas_udf(T.BinaryType())
def drawn_digit(keys: pd.Series) -> pd.Series:
    return pd.Series([digit_cell(int(k)).tobytes() for k in keys])


@query("digit_features", "SELECT CAST((s_suppkey * 12 + j) % 10 AS BIGINT) AS label, count(*) AS cells, TRUE AS most_right, 0 AS blank FROM supplier, range(12) t(j) GROUP BY 1")
def _(spark, d):
    """Twelve cells for each supplier; each one's digit as most of its three nearest cells have it: by digit, whether nine of ten are right."""
    each = dealt(A.table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    k = F.col("s_suppkey") * 12 + F.col("j")
    cells = each.select(k.alias("id"), (k % 10).alias("label"), drawn_digit(k).alias("data"))
    told = cells.select("id", "label", P.measure_digit("data", F.lit(56), F.lit(48)).alias("m")).persist()
    vectors = told.select("id", "label", F.transform("m.feature", lambda x: F.floor(x * 255).cast("int")).alias("v"))
    voted = told.select("id", "label", "m.ink").join(E.knn_vote_all(vectors).select("id", F.col("label").alias("voted")), "id", "left")
    right = F.count_if(F.coalesce(F.col("voted") == F.col("label"), F.lit(False)))
    return voted.groupBy("label").agg(F.count("*").alias("cells"), (right >= 0.9 * F.count("*")).alias("most_right"), F.count_if(F.col("ink") < 0.02).alias("blank"))


def answer(key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ruled answer box with some strokes, and where strokes and rules are."""
    random = np.random.default_rng(key)
    h, w = 120, 400
    base = np.add.outer(np.linspace(0, -25, h), np.linspace(245, 215, w)).astype(np.uint8)
    rules = base.copy()
    for y in (30, 60, 90):
        rules[y : y + 2] = 120
    rules[:, :2] = rules[:, -2:] = 100
    gray, ink = rules.copy(), np.full((h, w), 255, dtype=np.uint8)
    for _ in range(12):
        x, y = random.uniform(20, w - 40), random.uniform(12, h - 30)
        for a, b in ((8, 14), (16, 2), (22, 15)):
            for image in (gray, ink):
                stroke(image, x, y, x + a, y + b, 3, 50)
            x, y = x + a / 3, y + b / 4
    return gray, ink < 255, rules != base


@query("answer_ink", "SELECT count(*) AS answers, TRUE AS strokes_kept, TRUE AS rules_gone FROM supplier")
def _(spark, d):
    """What is left of answers' strokes and of their rules, as mean shares of their pixels away from each other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key in part["id"]:
                gray, ink, rules = answer(int(key))
                found = P.student_ink(gray)
                out.append((float(found[ink & ~M.dilated(rules, 9, 9)].mean()), float(found[rules & ~M.dilated(ink, 5, 5)].mean())))
            yield pd.DataFrame(out, columns=["kept", "left"])

    ids = dealt(A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), "id")
    shares = ids.mapInPandas(run, "kept double, left double")
    return shares.agg(F.count("*").alias("answers"), (F.avg("kept") >= 0.75).alias("strokes_kept"), (F.avg("left") <= 0.05).alias("rules_gone"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """Template rows of a sheet for each size of part, a question for each part, laid out in columns; one option is chosen."""
    items = A.table(spark, d, "part").select(F.col("p_size").alias("exam"), F.col("p_partkey").alias("q_no"))
    laid = K.column_major(items, 60, 3)
    option = F.explode(F.array(*(F.struct(F.lit(c).alias("option"), F.lit(i).alias("i")) for i, c in enumerate("ABCD")))).alias("o")
    rows = laid.select("exam", "page", "q_no", "column", "row", option)
    x, y = 30.0 + F.col("column") * 60.0 + F.col("o.i") * 8.0, 60.0 + F.col("row") * 9.0
    return rows.select(F.col("exam").cast("long").alias("sheet"), "page", F.col("q_no").cast("long").alias("q_no"), "o.option", x.alias("x_mm"), y.alias("y_mm"), (F.col("q_no") * 7 % 4 == F.col("o.i")).alias("chosen"))


@query("round_trip_sheets", "SELECT p_size AS sheet, kind, count(*) AS questions, CASE kind WHEN 'firm' THEN count(*) ELSE 0 END AS recovered, CASE kind WHEN 'firm' THEN 0 ELSE count(*) END AS flagged, kind = 'firm' AS apart FROM part, (VALUES ('firm'), ('faint')) k(kind) GROUP BY 1, 2")
def _(spark, d):
    """Sheets filled firmly come back whole, by far; filled too faintly no answer does, and each is flagged."""
    rows = sheets(spark, d)
    kinds = {"firm": (0.8, 25), "faint": (0.3, 160)}
    told = [P.round_trip(rows, coverage=c, shade=s).withColumn("kind", F.lit(kind)) for kind, (c, s) in kinds.items()]
    both = told[0].unionByName(told[1])
    return both.select("sheet", "kind", "questions", "recovered", "flagged", (F.col("least_filled") - F.col("most_empty") > 0.4).alias("apart"))


#: What is wrong with a sheet, by its key's remainder; 0 is sound.
DEFECTS = ("", "bubbles print empty", "quiet zone", "marker solid", "orientation", "bubble spacing", "safe margin", "page index", "answer box blank", "page bounds")


def sheet_marks(key: int) -> pd.DataFrame:
    """A sheet's marks: corners, orientation, bars, six questions of four bubbles and an answer box; those of a defect that needs no ink moved."""
    bad, page = key % 10, key % 3 + 1
    rows = [("fiducial", c, *at, 8.0, 8.0, 0) for c, at in TEMPLATE.fiducials.items()]
    rows.append(("orientation", "TR" if bad == 4 else "TL", 40.0, 14.0, 5.0, 5.0, 0))
    rows += [("bar", f"bar{i}", 60.0 + 14.0 * i, 14.0, 10.0, 5.0, i) for i in range(1, 4)]
    rows += [("bubble", f"Q{q}-{'ABCD'[o]}", 40.0 + 8.0 * o, 50.0 + 9.0 * q, 0.0, 0.0, 0) for q in range(6) for o in range(4)]
    rows.append(("box", "Q7", 20.0, 130.0, 170.0, 40.0, 4))
    if bad == 5:
        rows.append(("bubble", "Q9-A", 42.0, 51.0, 0.0, 0.0, 0))
    if bad == 9:
        rows.append(("box", "Q8", 215.0, 200.0, 30.0, 20.0, 2))
    out = pd.DataFrame(rows, columns=["kind", "name", "x_mm", "y_mm", "w_mm", "h_mm", "extra"])
    return out.assign(sheet=key, page=page)[["sheet", "page", *out.columns]]


def spoiled(key: int, gray: np.ndarray, k: float) -> None:
    """Ink where a defect has it, or a marker that is faint."""
    spots = {1: (40.0, 50.0, 1.2, 0), 2: (19.0, 19.0, 0.4, 0), 6: (2.0, 150.0, 0.5, 90), 7: (102.0 if key % 3 + 1 != 3 else 74.0, 14.0, 3.0, 0), 8: (100.0, 136.0, 1.0, 80)}
    bad = key % 10
    if bad in spots:
        x, y, r, shade = spots[bad]
        P._disc(gray, x * k, y * k, max(1.0, r * k), shade)
        if bad == 7:
            gray[round(12 * k) : round(16 * k), round((x - 4.5) * k) : round((x + 4.5) * k)] = 0
    if bad == 3:
        part = gray[round(281 * k) : round(289 * k), round(8 * k) : round(16 * k)]
        part[::2, ::2] = 255


@query("preflight_checks", "SELECT s_suppkey AS sheet, CASE s_suppkey % 10 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(DEFECTS)) + " END AS checks FROM supplier")
def _(spark, d):
    """The checks that each sheet fails: a sound one in ten none, the others their own defect's."""

    def marks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.concat([sheet_marks(int(k)) for k in part["id"]]) if len(part) else part

    def spoil(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                gray = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width).copy()
                spoiled(int(row.sheet), gray, 100.0 / 25.4)
                out.append(gray.tobytes())
            yield part.assign(data=out)

    ids = dealt(A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), "id")
    told = ids.mapInPandas(marks, L.MARKS).persist()
    pages = L.printed(told, 100.0)
    issues = L.preflight(told, pages.mapInPandas(spoil, pages.schema), 100.0)
    failed = issues.where("severity = 'error'").groupBy("sheet").agg(F.array_join(F.array_sort(F.collect_set("check")), ",").alias("checks"))
    return ids.select(F.col("id").alias("sheet")).join(failed, "sheet", "left").select("sheet", F.coalesce("checks", F.lit("")).alias("checks"))


def printed_block(key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block of five by four outlines as it lies on a scan, where the template has it, and where it is.

    Every third is whole and moved by more than half a row, the others lack some outlines or have strays beside them.
    """
    random = np.random.default_rng(key)
    expected = np.array([(60.0 + 26 * i, 70.0 + 30 * j) for j in range(5) for i in range(4)])
    turn, grow = random.uniform(-0.03, 0.03), random.uniform(0.97, 1.03)
    move = random.uniform(16, 22, 2) * random.choice([-1, 1], 2) if key % 3 == 0 else random.uniform(-10, 10, 2)
    matrix = np.array([[grow * np.cos(turn), -grow * np.sin(turn)], [grow * np.sin(turn), grow * np.cos(turn)]])
    centre = expected.mean(axis=0)
    truth = (expected - centre) @ matrix.T + centre + move
    gray = np.full((280, 240), 255, dtype=np.uint8)
    # no row is gone as a whole: nothing would tell which
    gone = set() if key % 3 == 0 else {4 * int(j) + int(random.integers(4)) for j in random.choice(5, key % 3 + 2, replace=False)}
    for i, (x, y) in enumerate(truth):
        if i not in gone:
            P._disc(gray, x, y, 9.0, 40, hollow=2.0)
    if key % 3 == 2:
        for _ in range(3):
            P._disc(gray, random.uniform(15, 225), random.uniform(240, 265), 9.0, 40, hollow=2.0)
    return gray, expected, truth


@query("block_registration", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'ordered' ELSE 'votes' END AS way, TRUE AS near FROM supplier")
def _(spark, d):
    """Each block's outlines are found on its scan and its template is brought onto them, to two pixels."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for key in part["id"]:
                gray, expected, truth = printed_block(int(key))
                found = pixels.register_block(expected, pixels.rings(gray, 9.0), 12.0, 12.0)
                far = np.inf if found is None else np.hypot(*(expected @ found[1][:, :2].T + found[1][:, 2] - truth).T).max()
                out.append((key, found and found[0], bool(far <= 2.0)))
            yield pd.DataFrame(out, columns=["id", "way", "near"])

    ids = dealt(A.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), "id")
    return ids.mapInPandas(run, "id long, way string, near boolean")
