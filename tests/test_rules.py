"""The domain's decision rules on small tables, with permutations, ties and bad input."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import pixels
from gradeloom.functions import scalars as P
from gradeloom.functions.evidence import evidence
from gradeloom.operators import evaluation as E
from gradeloom.operators import grading as G
from gradeloom.operators import ownership as O
from gradeloom.operators import reading as B
from gradeloom.operators import release as K
from gradeloom.operators import review as R
from gradeloom.session import NotAvailable
from gradeloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("fills", "inks", "enhanced", "want"),
    [
        ([0.95, 0, 0, 0], [0.9, 0.02, 0.02, 0.02], [0.9, 0, 0, 0], ("answered", "A", "high", False)),
        ([0, 0, 0, 0], [0.02] * 4, [0.1] * 4, ("blank", None, "high", False)),
        ([0, 0, 0, 0], [0.30] * 4, [0.1] * 4, ("blank", None, "high", False)),
        ([0.9, 0, 0.8, 0], [0.8, 0, 0.8, 0], [0.9, 0, 0.8, 0], ("multiple", None, "low", True)),
        ([0.62, 0.48, 0, 0], [0.5, 0.4, 0, 0], [0.6, 0.5, 0, 0], ("answered", "A", "low", True)),
        ([0.95, 0.30, 0, 0], [0.9, 0.2, 0, 0], [0.9, 0.3, 0, 0], ("answered", "A", "medium", True)),
        ([0.1, 0.2, 0.1, 0.1], [0.02, 0.40, 0.02, 0.02], [0.1, 0.2, 0.1, 0.1], ("blank", None, "low", True)),
        ([0.1, 0.2, 0.1, 0.1], [0.02, 0.40, 0.02, 0.02], [0.1, 0.7, 0.1, 0.1], ("answered", "B", "low", True)),
    ],
)
def test_mcq_cases(spark, fills, inks, enhanced, want):
    rows = [(1, 1, "ABCD"[i], float(fills[i]), float(inks[i]), float(enhanced[i])) for i in range(4)]
    df = spark.createDataFrame(rows[::-1], "sheet int, q_no int, option string, fill double, ink double, enhanced double")
    r = B.read_mcq(df).first()
    assert (r.outcome, r.selected, r.confidence, r.needs_review) == want


PAGE = "source_index long, sheet_page int, cell_roll string, cell_program string, cell_min double, bubble_roll string, bubble_confidence string, selector_state string, quality string"


def page(source, slot, roll, cell_min=0.95, bubble=True, confidence="high", state="clear", quality="ready", program="BTECH"):
    return (source, slot, roll, program, cell_min, roll if bubble and slot == 1 else None, confidence, state, quality)


def owned(spark, pages, rolls=("2024001", "2024002", "2024003")):
    roster = spark.createDataFrame([(r, "BTECH") for r in rolls], "roll_no string, program string")
    return {r.source_index: r for r in O.assess_ownership(spark.createDataFrame(pages, PAGE), roster, 3).collect()}


def test_ownership_does_not_depend_on_order(spark):
    pages = [page(i * 3 + s, s, f"202400{i + 1}") for i in range(3) for s in (1, 2, 3)]
    results = [{k: (r.accepted, r.roll) for k, r in owned(spark, order).items()} for order in (pages, pages[::-1], pages[4:] + pages[:4])]
    assert results[0] == results[1] == results[2] and all(a for a, _ in results[0].values())


@pytest.mark.parametrize(
    ("second", "code"),
    [
        (page(2, 2, "2024001", cell_min=0.79), "LOW_CELL_CONFIDENCE"), (page(2, 2, "2024002"), "NO_ANCHOR_FOR_ROLL"), (page(2, 2, "2024001", quality="needs_review"), "QUALITY_UNAVAILABLE"),
        (page(2, 2, None), "CELL_ROLL_UNREADABLE"), (page(2, 5, "2024001"), "INVALID_SOURCE_OR_SLOT"), (page(2, 2, "2024001", cell_min=float("nan")), "LOW_CELL_CONFIDENCE"),
        (page(2, 2, "2024009"), "ROLL_NOT_IN_ROSTER"), (page(2, 2, "2024001", state="ambiguous"), "PROGRAM_SELECTOR_AMBIGUOUS"),
    ],
)
def test_ownership_failures(spark, second, code):
    r = owned(spark, [page(1, 1, "2024001"), second])
    assert r[1].accepted and not r[2].accepted and code in {f.code for f in r[2].flags if f.severity == "block"}


def test_duplicates_block_each_other_and_blank_selectors_warn(spark):
    r = owned(spark, [page(1, 1, "2024001"), page(2, 2, "2024001"), page(3, 2, "2024001"), page(4, 1, "2024002", state="blank")])
    assert not r[2].accepted and not r[3].accepted and r[4].accepted


def test_completeness(spark):
    pages = spark.createDataFrame([page(1, 1, "2024001"), page(2, 2, "2024001"), page(3, 3, "2024001"), page(4, 1, "2024002")], PAGE)
    got = {r.roll: (r.status, r.missing) for r in O.completeness(O.assess_ownership(pages, None, 3), 3).collect()}
    assert got == {"2024001": ("auto_matched", []), "2024002": ("missing_pages", [2, 3])}


def test_near_neighbours_equal_all_pairs(spark):
    rolls = [f"20240{a}{b}" for a in range(3) for b in range(4)]
    got = {(r.roll_no, r.neighbour) for r in O.near_neighbours(spark.createDataFrame([(r, "BTECH") for r in rolls], "roll_no string, program string")).collect()}
    assert got == {(a, b) for a in rolls for b in rolls if sum(x != y for x, y in zip(a, b, strict=True)) == 1}


def test_neighbour_guard_threshold(spark):
    near = spark.createDataFrame([("12", "13", 2, "BTECH")], "roll_no string, neighbour string, place int, program string")
    rows = [(i, "12", [{"1": 0.99}, {"2": p, "3": 1 - p}]) for i, p in enumerate((0.84, 0.85))]
    got = {r.source_index: r.code for r in O.neighbour_guard(spark.createDataFrame(rows, "source_index int, roll string, probs array<map<string,double>>"), near).collect()}
    assert got == {0: "NEAR_NEIGHBOUR_HOLD", 1: None}


def test_scalars(spark):
    lit = F.lit
    assert one(spark, P.normalize_roll(lit(" 24 001\t"), lit("MTECH"))) == "MT24001"
    assert one(spark, P.normalize_roll(lit("24abc"), lit("SP"))) == "SP24ABC"
    assert one(spark, P.ocr_roll(lit("2O24-OSl"), lit("BTECH"))) == "2024051" and one(spark, P.ocr_roll(lit("2O24"), lit("BTECH"))) is None and one(spark, P.ocr_roll(lit("2O24OSl"), lit("BTECH"))) == "2024051"
    assert one(spark, P.number_text(lit(17.0))) == "17" and one(spark, P.number_text(lit(14.5))) == "14.5"
    assert one(spark, P.number_or(lit("x"))) == 0.0 and one(spark, P.number_or(lit("2.5"))) == 2.5
    assert one(spark, P.parse_bool(lit(" YES\n"))) is True and one(spark, P.parse_bool(lit("maybe"))) is None
    assert one(spark, P.safe_id(lit("..a b/c.."))) == "a_b_c" and one(spark, P.header_key(lit("Sl.No. "))) == "slno"
    assert one(spark, P.noise_line(lit("a" * 11))) and not one(spark, P.noise_line(lit("a plain answer with words")))
    assert one(spark, P.roll_labels(lit("PHD20301"), lit("PHD"))) == list("20301") and one(spark, P.roll_labels(lit("20301"), lit("PHD"))) is None
    with pytest.raises(ValueError):
        evidence("X", "fatal")


def test_grading_rules(spark):
    key = spark.createDataFrame([(1, "A", 2.0), (2, "B", 0.0)], "q_no int, answer string, marks double")
    rows = spark.createDataFrame([(1, 1, "A", "answered", "high"), (1, 2, "C", "answered", "low"), (1, 3, "A", "answered", "high")], "sheet int, q_no int, selected string, outcome string, confidence string")
    by = {r.q_no: r for r in G.grade_mcq(rows, key).collect()}
    assert (by[1].awarded, by[1].marks) == (2.0, 2.0) and by[2].dropped and not by[2].review and by[3].no_key and by[3].review
    numbers = spark.createDataFrame([(1, 1, 36), (1, 2, None)], "sheet int, q_no int, value int")
    graded = {r.q_no: r for r in G.grade_numerical(numbers, spark.createDataFrame([(1, "35|36", 2.0), (2, "7", 0.0)], "q_no int, answer string, marks double")).collect()}
    assert graded[1].awarded == 2.0 and graded[2].dropped and graded[2].awarded == 0.0


def test_review_log(spark):
    log = spark.createDataFrame([("a", "verify", 1, 1, 1), ("a", "hold", 2, 2, 1), ("b", "approve", 1, 3, 1), ("b", "assign_source", 2, 4, 2)], "entity string, action string, ts long, seq long, slot int")
    got = {r.entity: (r.status, r.eligible, r.assigned) for r in R.fold(log).collect()}
    assert got == {"a": ("needs_review", False, 0), "b": ("approved", True, 1)}


def test_markers(spark):
    required = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (3, "x")], "roll int, marker string")
    marks = spark.createDataFrame([(1, "x", 3.0), (1, "y", 4.0), (2, "x", 2.0), (3, "x", 1.0)], "roll int, marker string, marks double")
    got = {r.roll: (r.status, r.mark) for r in G.combine_markers(marks, required, ["roll"]).collect()}
    assert got == {1: ("disagreement", None), 2: ("awaiting_marks", None), 3: ("complete", 1.0)}


def test_splits_and_leakage(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "id long, label int, sheet int")
    kept = E.balanced(rows, "label", 7, 5).where("kept")
    assert {r["count"] for r in kept.groupBy("label").count().collect()} == {5}
    assert [r.id for r in kept.orderBy("id").collect()] == [r.id for r in E.balanced(rows.repartition(7), "label", 7, 5).where("kept").orderBy("id").collect()]
    with pytest.raises(ValueError, match="duplicate"):
        K.require(K.violations(rows.groupBy("sheet").count(), "sheet", {"duplicate": F.col("count") == 1}), "sheets")
    with pytest.raises(ValueError, match="unknown fields: nope"):
        K.rendered("{nope}", {}, ("name",))


def test_csv_sources(spark, tmp_path):
    (tmp_path / "roster.csv").write_text("Sl.No.,Roll No.,Class Type,Student Name,Email Id\n2,24001,MTECH,M  Student,m@example.edu\n,,,,\n3,20301,PHD,P Student,p@example.edu\n", encoding="utf-8")
    got = {r.roll_no: (r.program, r.name, r.email, r.extra) for r in files.read_roster(spark, str(tmp_path / "roster.csv")).collect()}
    assert got == {"MT24001": ("MTECH", "M Student", "m@example.edu", {"Sl.No.": "2"}), "PHD20301": ("PHD", "P Student", "p@example.edu", {"Sl.No.": "3"})}
    (tmp_path / "key.csv").write_text("q_no,answer,marks\n1,a,\n2,DROPPED,2\n3,B,0\n", encoding="utf-8")
    key = {r.q_no: (r.answer, r.marks, r.dropped) for r in files.read_answer_key(spark, str(tmp_path / "key.csv")).collect()}
    assert key == {1: ("A", 1.0, False), 2: ("DROPPED", 2.0, True), 3: ("B", 0.0, True)}
    (tmp_path / "bad.csv").write_text("q_no,answer,marks\n1,A,1\n1,B,1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="duplicate"):
        files.read_answer_key(spark, str(tmp_path / "bad.csv"))


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Marks</t></is></c></row><row/><row><c r="A3"><v>2024001</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Roll No</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    assert [r.cells for r in files.read_table(spark, str(tmp_path / "t.xlsx")).collect()] == [{"Roll No": "2024001", "Marks": "TRUE"}]


def test_gated_operators_refuse():
    for f in (pixels.train_network, files.render_pdf):
        with pytest.raises(NotAvailable):
            f()
