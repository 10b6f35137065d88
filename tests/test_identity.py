"""Ownership and proposals: each rule alone on hand-made pages."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.evidence import codes
from gradeloom.operators import identity as I
from gradeloom.operators import ownership as O
from gradeloom.plans import q_identity as Q

PAGE = (
    "source_index long, sheet_page int, cell_roll string, cell_program string, cell_min double, cell_probs array<array<double>>, bubble_roll string, bubble_program string, bubble_confidence string, "
    "signals map<string,struct<fill:double,ink:double>>, program string, evidence_flags array<struct<code:string,severity:string,message:string,metadata:map<string,string>>>, "
    "quality struct<status:string,geometry:string,local:string,image:string>, current_roll string, suggestion struct<roll_no:string,score:double,margin:double>"
)
NAMES = [x.split()[0] for x in PAGE.replace(", ", "\n").split("\n")][:13] + ["current_roll", "suggestion"]
READY = ("ready", "ready", "warning", "ready")
ROSTER = [("2000010", "BTECH"), ("2000011", "BTECH"), ("2077777", None), ("MT00010", "MTECH"), ("2055555", "MTECH")]


def cells(roll, own=0.99, other=0.004):
    rows = []
    for c in roll.removeprefix("PHD").removeprefix("MT"):
        row = [0.0] * 10
        row[int(c)], row[(int(c) + 1) % 10] = own, other
        rows.append(row)
    return rows


def page(source, slot, roll, **other):
    program = {"M": "MTECH", "P": "PHD"}.get(roll[:1], "BTECH")
    told = dict(source_index=source, sheet_page=slot, cell_roll=roll, cell_program=program, cell_min=0.95, cell_probs=cells(roll), bubble_roll=roll if slot == 1 else None, bubble_program=program if slot == 1 else None, bubble_confidence="high", signals={program: (0.9, 0.5), "X": (0.0, 0.0)}, program=None, evidence_flags=None, quality=READY, current_roll=None, suggestion=None)
    return told | other


def frame(spark, pages):
    return spark.createDataFrame([tuple(p[n.strip()] for n in ("source_index", "sheet_page", "cell_roll", "cell_program", "cell_min", "cell_probs", "bubble_roll", "bubble_program", "bubble_confidence", "signals", "program", "evidence_flags", "quality", "current_roll", "suggestion")) for p in pages], PAGE)


def roster(spark):
    return spark.createDataFrame(ROSTER, "roll_no string, program string")


def told(df):
    return df.withColumn("codes", codes(F.col("flags"))).drop("flags")


flag = lambda code, severity="block": [(code, severity, "", {})]

ALONE = [
    ({}, "", True),
    ({"evidence_flags": flag("EMPTY_FIELD")}, "EMPTY_FIELD:block", False),
    ({"evidence_flags": flag("FAINT_BUBBLE", "warn")}, "FAINT_BUBBLE:warn", True),
    ({"quality": None}, "QUALITY_UNAVAILABLE:block", False),
    ({"quality": ("aligned", "ready", "failed", "ready")}, "IDENTITY_ALIGNMENT_HOLD:block", False),
    ({"quality": ("review", "ready", "ready", "ready")}, "IDENTITY_ALIGNMENT_HOLD:block", False),
    ({"sheet_page": 3}, "INVALID_SOURCE_OR_SLOT:block,NO_ANCHOR_FOR_ROLL:block", False),
    ({"cell_min": 0.79}, "LOW_CELL_CONFIDENCE:block", False),
    ({"cell_min": 1.01}, "LOW_CELL_CONFIDENCE:block", False),
    ({"cell_probs": lambda roll: cells(roll)[:6]}, "LOW_CELL_CONFIDENCE:block", False),
    ({"cell_probs": lambda roll: cells(roll, own=0.7)}, "LOW_CELL_CONFIDENCE:block", False),
    ({"cell_probs": None}, "", True),
    ({"program": "PHD"}, "SOURCES_CONTRADICT:block", False),
    ({"signals": {"MTECH": (0.9, 0.5)}}, "SOURCES_CONTRADICT:block", False),
    ({"signals": {"BTECH": (0.1, 0.1)}}, "PROGRAM_SELECTOR_BLANK:warn", True),
    ({"signals": {"BTECH": (0.1, 0.1)}, "evidence_flags": flag("PROGRAM_SELECTOR_BLANK")}, "PROGRAM_SELECTOR_BLANK:warn", True),
    ({"signals": {"BTECH": (0.3, 0.1)}}, "PROGRAM_SELECTOR_AMBIGUOUS:block", False),
    ({"signals": {"BTECH": (0.9, 0.1), "PHD": (0.6, 0.1)}}, "PROGRAM_SELECTOR_AMBIGUOUS:block", False),
    ({"signals": {}}, "PROGRAM_SELECTOR_BLANK:block", False),
    ({"bubble_program": "PHD"}, "SOURCES_CONTRADICT:block", False),
    ({"bubble_roll": "2000010"}, "SOURCES_CONTRADICT:block", False),
    ({"bubble_confidence": "low"}, "BUBBLE_IDENTITY_UNCERTAIN:block", False),
]


@pytest.fixture(scope="module")
def alone(spark):
    """Each case as a page 1 of a roll of its own, no two of which are neighbours."""
    pages = []
    for i, (change, *_) in enumerate(ALONE, 1):
        roll = f"2{i * 10101:06d}"
        pages.append(page(i, 1, roll) | {k: v(roll) if callable(v) else v for k, v in change.items()})
    known = roster(spark).unionByName(spark.createDataFrame([(p["cell_roll"], None) for p in pages], "roll_no string, program string"))
    return {r.source_index: r for r in told(I.assess(frame(spark, pages), known, 2)).collect()}


@pytest.mark.parametrize("case", range(len(ALONE)))
def test_each_rule(alone, case):
    _, want, accepted = ALONE[case]
    row = alone[case + 1]
    assert (row.codes, row.accepted) == (want, accepted)


def test_pages_beside_each_other(spark):
    pages = [
        page(1, 1, "2077777"), page(2, 2, "2077777"),
        page(3, 2, "2088888"),  # not in the roster, no anchor
        page(4, 1, "2000010"), page(5, 2, "2000010"),  # a neighbour: 2000011
        page(6, 1, "2000011", cell_probs=cells("2000011", own=0.84)), page(7, 2, "2000011"),
        page(8, 1, "MT00010"), page(9, 2, "MT00010", cell_program="BTECH"),  # cells no roll of their program
        page(10, 1, "2055555"), page(11, 2, "MT00010"), page(12, 2, "MT00010"),  # two claims
    ]
    got = {r.source_index: r for r in told(I.assess(frame(spark, pages), roster(spark), 2)).collect()}
    assert {s for s, r in got.items() if r.accepted} == {1, 2, 4, 5, 8}
    assert got[3].codes == "ROLL_NOT_IN_ROSTER:block,NO_ANCHOR_FOR_ROLL:block"
    assert got[6].codes == "NEAR_NEIGHBOUR_HOLD:block"
    assert got[7].codes == "NO_ANCHOR_FOR_ROLL:block"
    assert got[9].codes.startswith("CELL_ROLL_UNREADABLE:block,SOURCES_CONTRADICT:block") and got[9].status == "unmatched"
    assert got[10].codes == "SOURCES_CONTRADICT:block" and got[10].status == "suggested"
    assert got[11].codes == got[12].codes == "DUPLICATE_AGREED_CLAIM:block"
    # an anchor whose own cells do not carry the digit holds its continuation
    weak = [page(1, 1, "2000010", cell_probs=None), page(2, 2, "2000010")]
    got = {r.source_index: r for r in told(I.assess(frame(spark, weak), roster(spark), 2)).collect()}
    assert got[1].codes == "NEAR_NEIGHBOUR_EVIDENCE_MISSING:block" and got[2].codes == "NO_ANCHOR_FOR_ROLL:block"
    without = {r.source_index: r.codes for r in told(I.assess(frame(spark, weak), None, 2)).collect()}
    assert without == {1: "", 2: ""}
    assert I.assess(frame(spark, []), roster(spark), 2).collect() == []


def test_sources_have_to_be_unique_and_positive(spark):
    with pytest.raises(ValueError, match="unique positive"):
        I.check_sources(frame(spark, [page(1, 1, "2077777"), page(1, 2, "2077777")]))
    with pytest.raises(ValueError, match="unique positive"):
        I.check_sources(frame(spark, [page(0, 1, "2077777")]))
    assert I.check_sources(frame(spark, [page(3, 1, "2077777")])).count() == 1


def test_proposals(spark):
    pages = [
        page(1, 1, "2077777", current_roll="2077777"), page(2, 2, "2077777"),  # B, fine
        page(3, 2, "2077777", cell_min=0.2),  # too unsure to be shown
        page(4, 1, "2000010", bubble_roll=None), page(5, 2, "2000010", cell_min=0.5),  # C, weak
        page(6, 1, "MT00010", current_roll="MT00010"), page(7, 2, "MT00010", signals={"MTECH": (0.1, 0.1)}), page(8, 2, "2099999", current_roll="MT00010"),
        page(9, 1, "2000011", cell_roll="2033333", suggestion=("2000011", 0.7, 0.2)), page(10, 2, "2000011"),
    ]
    got = {(r.path, r.roll, r.page1, r.continuation): r for r in told(I.proposals(frame(spark, pages), roster(spark))).collect()}
    assert set(got) == {("B", "2077777", 1, 2), ("C", "2000010", 4, 5), ("B", "MT00010", 6, 7), ("B", "2000011", 9, 10)}
    fine = got["B", "2077777", 1, 2]
    # the page that is too unsure still counts as a claim
    assert fine.codes == "DUPLICATE_AGREED_CLAIM:block,ANCHOR_VIA_PAGE2:warn" and not fine.eligible
    assert got["C", "2000010", 4, 5].codes == "ANCHOR_VIA_CELLS:warn,LOW_CELL_CONFIDENCE:warn"
    assert not got["C", "2000010", 4, 5].blocked and not got["C", "2000010", 4, 5].eligible
    assert got["B", "MT00010", 6, 7].codes == "ANCHOR_SLOT_TAKEN:block,ANCHOR_VIA_PAGE2:warn,PROGRAM_SELECTOR_BLANK:block"
    assert got["B", "2000011", 9, 10].codes == "ROSTER_CELL_SUPPORT:warn,ANCHOR_VIA_PAGE2:warn,NO_ANCHOR_FOR_ROLL:block"
    alone = told(I.in_order(I.proposals(frame(spark, [pages[0], pages[1], pages[3], pages[4]]), roster(spark)))).collect()
    assert [(r.path, r.eligible) for r in alone] == [("B", True), ("C", False)]
    assert I.order_proposals(frame(spark, pages), "page-major", 2, 7, "p").collect() == []
    assert [(r.page1, r.continuation) for r in I.order_proposals(frame(spark, pages), "sheet-major", 2, 10, "p").orderBy("page1").collect()] == [(1, 2), (6, 7), (9, 10)]


def outermost_join(df):
    """The line of the plan's last join."""
    return next(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Join" in x)


def test_pairs_of_pages_are_dealt_no_further(spark):
    # what hangs on a roll is joined before its pages meet each other
    assert "Inner" in outermost_join(I.proposals(frame(spark, [page(1, 1, "2077777")]), roster(spark)))
    pages = frame(spark, [page(1, 1, "2077777")]).withColumn("selector_state", F.lit("clear"))
    assert "Inner" in outermost_join(O.candidates(pages))


def test_what_each_source_says_of_neighbours_makes_the_same_flags(spark):
    near = [("2000011", 7, "0", "1"), ("2000020", 6, "1", "2"), ("2000110", 5, "0", "1"), ("2077777", 1, "2", "x")]
    probs = [None, [], [*cells("2000010")[:5], [0.0] * 10, [0.5] * 10], cells("2000010"), cells("2000010", own=0.5), cells("2000010")[:6], [*cells("2000010")[:6], [0.0] * 10], [*cells("2000010")[:5], [0.1] * 10, [0.5] * 10], [[0.5] * 10, *cells("2000010")[1:6]]]
    rows = spark.createDataFrame([(used, a, b, near) for a in probs for b in probs for used in (True, False)], f"used boolean, a array<array<double>>, b array<array<double>>, near {I.NEIGHBOURS}")
    a, b = (F.coalesce(c, F.array().cast("array<array<double>>")) for c in ("a", "b"))
    seen = F.array_distinct(F.transform(I.guard(F.col("near"), [(F.col("used"), a), (F.lit(True), b)]), lambda f: f["code"]))
    new = F.transform(I.guard_of(F.when(F.col("used"), I.guarded(F.col("near"), a)), I.guarded(F.col("near"), b)), lambda f: f["code"])
    got = rows.select(seen.alias("old"), new.alias("new")).collect()
    assert all(r.old == r.new for r in got) and len({tuple(r.old) for r in got}) == 5


def test_packed_neighbours_say_the_same(spark):
    rng = random.Random(11)
    near = [(str(i), rng.randint(1, 7), rng.choice("0123456789x"), rng.choice("0123456789x")) for i in range(40)]
    probs = [[[rng.choice([0.0, 0.1, 0.84, 0.9, None]) for _ in range(10)] for _ in range(n)] for n in (0, 3, 5, 7)] + [None]
    rows = spark.createDataFrame([(used, a, near[i:n]) for used in (True, False) for a in probs for i in range(0, 40, 4) for n in (i, i + 1, 40)], f"used boolean, a array<array<double>>, near {I.NEIGHBOURS}")
    source = [(F.col("used"), F.coalesce("a", F.array().cast("array<array<double>>")))]
    told = rows.select(*(codes(I.guard(n, source)).alias(c) for c, n in (("plain", F.col("near")), ("packed", I._unpacked(I._packed(F.col("near")))))))
    assert all(r.plain == r.packed for r in told.collect()) and told.where("plain <> ''").count() > 50


def test_no_page_goes_on_with_a_list_of_neighbours(spark, sf):
    owned = I.assess(Q.evidence_pages(spark, sf), Q.students(spark, sf), Q.EXPECTED)
    lines = owned._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert any("cell_probs#" in x for x in lines) and not any("cell_probs#" in x and "neighbours#" in x for x in lines)


def test_proposals_in_order_need_no_shuffle_of_pairs(spark, sf):
    pages, known = Q.evidence_pages(spark, sf), Q.students(spark, sf)
    got = I.proposal_list(pages, known)
    rows = got.collect()
    assert [(r.blocked, not r.eligible, r.roll, r.sheet_page, r.continuation) for r in rows] == sorted((r.blocked, not r.eligible, r.roll, r.sheet_page, r.continuation) for r in rows)
    plain_ = I.proposals(pages, known).withColumn("codes", codes(F.col("flags"))).select(got.columns)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, plain_.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    # the pairs are the last that is made: nothing is dealt or sorted after it
    assert plan.index("Generate explode(ones") < min(plan.index(x) for x in ("Sort [", "Exchange "))


def test_flags_are_counted_without_pairs(spark, sf):
    pages, known = Q.evidence_pages(spark, sf), Q.students(spark, sf)
    want = I.proposals(pages, known).select("path", F.explode("flags").alias("f")).groupBy("path", "f.code", "f.severity").count()
    assert sorted(map(tuple, I.proposal_flags(pages, known).collect())) == sorted(map(tuple, want.collect()))
