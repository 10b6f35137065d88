"""Exam settings and sheet layout (V2, V3, V7, I9, I10, P22, K17, M6, X4's table).

A sheet is planned on the driver: an exam has tens of questions. Its template is then a table of rows.
"""

from __future__ import annotations

import importlib.util
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import text_quality
from gradeloom.operators.grading import key_values
from gradeloom.operators.release import violations

SECTIONS = ("mcq", "numerical", "written")


@dataclass
class Written:
    q_no: int
    max_marks: float
    lines: int


@dataclass
class Numerical:
    q_no: int
    max_marks: float
    digits: int


@dataclass
class Exam:
    exam_id: str
    num_mcq: int
    mcq_options: int = 4
    marks_per_mcq: float = 1.0
    written: list[Written] = field(default_factory=list)
    numerical: list[Numerical] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)


def exam_errors(e: Exam) -> list[str]:
    """V3: every rule that the settings break."""
    numbers, texts = [q.q_no for q in e.numerical], [q.q_no for q in e.written]
    present = {"mcq": e.num_mcq > 0, "numerical": bool(numbers), "written": bool(texts)}
    rules = {
        "num_mcq": e.num_mcq >= 0,
        "mcq_options": 2 <= e.mcq_options <= 6,
        "written_fields": all(q.q_no > 0 and q.max_marks > 0 and q.lines > 0 for q in e.written),
        "numerical_fields": all(q.q_no > 0 and 0 < q.max_marks < math.inf and 1 <= q.digits <= 8 for q in e.numerical),
        "written_unique": len(texts) == len(set(texts)),
        "numerical_unique": len(numbers) == len(set(numbers)),
        "written_after_mcq": all(n > e.num_mcq for n in texts),
        "numerical_after_mcq": all(n > e.num_mcq for n in numbers),
        "written_after_numerical": not numbers or all(n > max(numbers) for n in texts),
        "some_question": any(present.values()),
        "sections": not e.sections or (len(e.sections) == len(set(e.sections)) and set(e.sections) == {s for s, there in present.items() if there}),
    }
    return [name for name, fine in rules.items() if not fine]


@dataclass
class Sheet:
    """Measures of a page, in millimetres. tops: where content begins on page 1 and on later pages."""

    width: float = 210.0
    margin: float = 12.0
    bottom: float = 275.0
    tops: tuple[float, float] = (110.0, 60.0)
    radius: float = 2.5
    header: float = 6.0
    gap: float = 7.0
    option_header: float = 4.5
    row: float = 8.0
    option: float = 8.0
    label: float = 12.0
    written_header: float = 6.0
    line: float = 7.0
    written_gap: float = 5.0
    number_header: float = 12.0
    number_width: float = 42.0
    number_height: float = 62.0
    number_position: float = 9.0
    number_gap: float = 6.0
    columns: tuple[int, ...] = (2, 3, 4)

    @property
    def usable(self) -> float:
        return self.width - 2 * self.margin


class TooTight(ValueError):
    """A question does not fit on a page of its own, or options not side by side."""


class _Pen:
    """The place where the next block goes."""

    def __init__(self, sheet: Sheet):
        self.sheet, self.page, self.y = sheet, 1, sheet.tops[0]

    def turn(self) -> None:
        self.page, self.y = self.page + 1, self.sheet.tops[1]

    def fits(self, height: float) -> bool:
        return self.y + height <= self.sheet.bottom + 1e-6


def _mcq(pen: _Pen, exam: Exam, columns: int, out: list[tuple]) -> None:
    s, left = pen.sheet, list(range(1, exam.num_mcq + 1))
    while left:
        first = pen.y + s.header + s.option_header
        room = math.floor((s.bottom - first - s.radius) / s.row + 1e-6) + 1 if first + s.radius <= s.bottom + 1e-6 else 0
        if room >= 1:
            here, left = left[: room * columns], left[room * columns :]
            rows = math.ceil(len(here) / columns)
            out += [("mcq", q, pen.page, s.margin + (i // rows) * s.usable / columns, first + (i % rows) * s.row) for i, q in enumerate(here)]
            pen.y = first + (rows - 1) * s.row + s.radius
        if left or room < 1:
            pen.turn()


def _rows_of_numbers(exam: Exam, s: Sheet) -> list[list[tuple[Numerical, float]]]:
    rows: list[list[tuple[Numerical, float]]] = []
    used = math.inf
    for q in exam.numerical:
        wide = max(s.number_width, q.digits * s.number_position + s.label)
        if wide > s.usable + 1e-6:
            raise TooTight(f"question {q.q_no} is too wide")
        if used + s.number_gap + wide > s.usable + 1e-6:
            rows.append([])
            used = -s.number_gap
        used += s.number_gap + wide
        rows[-1].append((q, wide))
    return rows


def _numbers(pen: _Pen, exam: Exam, out: list[tuple]) -> None:
    s, header = pen.sheet, pen.sheet.number_header
    for row in _rows_of_numbers(exam, s):
        if not pen.fits(header + s.number_height):
            pen.turn()
            header = s.number_header
            if not pen.fits(header + s.number_height):
                raise TooTight("a digit grid is too tall")
        pen.y, header, x = pen.y + header, 0.0, s.margin
        for q, wide in row:
            out.append(("numerical", q.q_no, pen.page, x, pen.y))
            x += wide + s.number_gap
        pen.y += s.number_height + s.number_gap


def _texts(pen: _Pen, exam: Exam, out: list[tuple]) -> None:
    s, header = pen.sheet, pen.sheet.header
    for q in exam.written:
        tall = s.written_header + q.lines * s.line
        if not pen.fits(header + tall):
            pen.turn()
            header = s.header
            if not pen.fits(header + tall):
                raise TooTight(f"question {q.q_no} does not fit on a page")
        pen.y, header = pen.y + header, 0.0
        out.append(("written", q.q_no, pen.page, s.margin, pen.y + s.written_header))
        pen.y += tall + s.written_gap


def laid_out(exam: Exam, sheet: Sheet | None = None) -> tuple[int, int, list[tuple]]:
    """Pages, columns and places (kind, q_no, page, x, y): of 2, 3 and 4 columns those of the fewest pages, then of the fewest columns.

    Sections follow each other by one cursor; each is tried whole, as pages depend on how they meet. One column
    is taken if no more fit side by side.
    """
    s = sheet or Sheet()
    narrowest = s.label + (exam.mcq_options - 1) * s.option + 10.0
    order = exam.sections or [k for k, there in zip(SECTIONS, (exam.num_mcq, exam.numerical, exam.written)) if there]
    tried = s.columns if exam.num_mcq else s.columns[:1]
    wide = [c for c in tried if not exam.num_mcq or s.usable / c >= narrowest] or [1]
    if exam.num_mcq and s.usable / wide[0] < narrowest:
        raise TooTight("the options are too wide for one column")
    best = None
    for columns in wide:
        pen, out = _Pen(s), []
        for k in order:
            if out and k != "mcq":
                pen.y += s.gap
            _mcq(pen, exam, columns, out) if k == "mcq" else _numbers(pen, exam, out) if k == "numerical" else _texts(pen, exam, out)
        if best is None or (pen.page, columns) < best[:2]:
            best = pen.page, columns, out
    return best if exam.num_mcq else (best[0], 0, best[2])


def template(spark: SparkSession, exam: Exam, sheet: Sheet | None = None) -> DataFrame:
    """An exam's template as rows, if its settings break no rule."""
    broken = exam_errors(exam)
    if broken:
        raise ValueError(f"{exam.exam_id}: {', '.join(broken)}")
    pages, columns, places = laid_out(exam, sheet)
    rows = [(exam.exam_id, pages, columns, *p) for p in places]
    return spark.createDataFrame(rows, "exam_id string, pages int, columns int, kind string, q_no int, page int, x_mm double, y_mm double")


def preflight(places: DataFrame, sheet: Sheet | None = None) -> DataFrame:
    """What of a template lies outside the printable area, by rule."""
    s = sheet or Sheet()
    rules = {"left": F.col("x_mm") >= s.margin, "right": F.col("x_mm") <= s.width - s.margin, "bottom": F.col("y_mm") <= s.bottom, "top": F.col("y_mm") >= F.least(F.lit(s.tops[0]), F.lit(s.tops[1]))}
    return violations(places, "q_no", rules)


def catalogue(mcq: DataFrame, numerical: DataFrame, marks_per_mcq: float) -> DataFrame:
    """A template's objective questions as one list: q_no, kind, marks, options or digits."""
    a = mcq.select("q_no", F.lit("mcq").alias("kind"), F.lit(marks_per_mcq).alias("marks"), F.size("options").alias("choices"))
    return a.unionByName(numerical.select("q_no", F.lit("numerical").alias("kind"), F.col("max_marks").alias("marks"), F.col("positions").alias("choices")))


def numerical_key_errors(numerical: DataFrame, key: DataFrame) -> DataFrame:
    """V2: numerical questions whose key is missing, whose marks are neither the template's nor 0, or whose values need more digits."""
    j = numerical.select("q_no", "positions", "max_marks").join(key.select("q_no", "answer", "marks"), "q_no", "left")
    values = key_values(F.col("answer"))
    dropped = F.coalesce(F.col("marks") == 0, F.lit(False))
    there = F.col("answer").isNotNull()
    rules = {
        "missing": there,
        "marks": ~there | dropped | (F.col("marks") == F.col("max_marks")),
        "values": ~there | dropped | (F.size(values) > 0),
        "capacity": ~there | dropped | ~F.exists(values, lambda v: v >= F.pow(F.lit(10), F.col("positions"))),
    }
    return violations(j, "q_no", rules)


def health(spark: SparkSession, folders: tuple[str, ...] = (), modules: tuple[str, ...] = ("pyarrow", "pandas", "numpy", "cv2", "torch", "fitz")) -> DataFrame:
    """V7: which libraries are there, and whether folders can be read by Spark."""
    rows = [("module", m, importlib.util.find_spec(m) is not None) for m in modules]
    for f in folders:
        try:
            spark.read.format("binaryFile").load(f).select("path").isEmpty()
            rows.append(("folder", f, True))
        except Exception:  # noqa: BLE001
            rows.append(("folder", f, False))
    return spark.createDataFrame(rows, "kind string, name string, fine boolean")


def line_score(text: Column, confidence: Column) -> Column:
    """M6: .62 of a reader's confidence (.58 if it tells none) and .38 of its text's quality, in 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.58)) * 0.62 + text_quality(text) * 0.38))


def best_lines(candidates: DataFrame, keys: list[str], line: str) -> DataFrame:
    """M6: keys and text: of each line's readings the one of the best score (then the longest, then the earlier reader), lines joined.

    A reader's text of confidence .72 and score .74 is taken at once: readers behind it are not asked.
    candidates: keys, line, reader (its place), text, confidence.
    """
    own = [*keys, line]
    scored = candidates.withColumn("score", F.round(line_score(F.col("text"), F.col("confidence")), 4))
    sure = (F.col("text") != "") & (F.col("confidence") >= 0.72) & (F.col("score") >= 0.74)
    before = Window.partitionBy(*own).orderBy("reader").rowsBetween(Window.unboundedPreceding, -1)
    asked = scored.withColumn("done", F.coalesce(F.max(F.when(sure, 1)).over(before), F.lit(0))).where("done = 0")
    order = Window.partitionBy(*own).orderBy(F.desc("score"), F.desc(F.length("text")), "reader")
    best = asked.withColumn("place", F.row_number().over(order)).where("place = 1")
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line, "text"))), lambda x: x["text"]), "\n").alias("text"), F.min("score").alias("least_score"))
