"""Page ownership and proposals by their whole rule chains.

A page's evidence: source_index, sheet_page, cell_roll, cell_program, cell_min, cell_probs (for each
digit cell ten probabilities), bubble_roll, bubble_program, bubble_confidence, signals (map of
program to fill and ink), program (as detected on the page), evidence_flags (of its readers), quality
(status, geometry, local, image). For proposals also current_roll and suggestion (roll_no, score, margin).

Claims are counted by groupBy of those that name a roll, and joined, so unreadable pages are no
hot key; neighbours of the rolls that pages name come from an equi-join on masked digits.
Acceptance has two phases: pages 1 first, then continuations beside their roll's anchor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.evidence import FLAG, blocked, evidence, flag_when, merged
from gradeloom.functions.scalars import candidate_id, valid_roll

# Fixed thresholds of the domain.
CELL_MIN, NEIGHBOUR_MIN = 0.80, 0.85
REVIEW_B_MIN, SUGGEST_MIN, PATH_C_MIN = 0.25, 0.30, 0.65
SUPPORT_SCORE, SUPPORT_MARGIN = 0.60, 0.15
FILLED, MARKED_FILL, MARKED_INK = 0.50, 0.28, 0.24
POLICY = "identity-resolution-v2-shadow-2026-10-01"


def selected_programs(signals: Column) -> Column:
    """Programs whose selector is filled, in order."""
    return F.array_sort(F.map_keys(F.map_filter(signals, lambda k, v: v["fill"] >= FILLED)))


def selector_state(signals: Column) -> Column:
    """Unavailable, clear, ambiguous or blank."""
    filled = F.size(selected_programs(signals))
    marked = F.size(F.map_filter(signals, lambda k, v: (v["fill"] >= MARKED_FILL) | (v["ink"] >= MARKED_INK)))
    none = signals.isNull() | (F.size(signals) == 0)
    return F.when(none, "unavailable").when(filled == 1, "clear").when((filled > 1) | (marked > 0), "ambiguous").otherwise("blank")


def program_of(roll: Column, known: Column) -> Column:
    """The roster's program of a roll, else that of its prefix."""
    return F.coalesce(F.upper(known), F.when(roll.startswith("PHD"), "PHD").when(roll.startswith("MT"), "MTECH").otherwise("BTECH"))


def labels(roll: Column, program: Column) -> Column:
    """A roll's digits if it has its program's form, else null."""
    return (
        F.when((program == "BTECH") & roll.rlike(r"^[0-9]{7}\z"), roll)
        .when((program == "MTECH") & roll.startswith("MT") & (F.length(roll) == 7), F.substring(roll, 3, 5))
        .when((program == "PHD") & roll.startswith("PHD") & (F.length(roll) == 8), F.substring(roll, 4, 5))
    )


def _masked(rolls: DataFrame) -> DataFrame:
    """roll, program, place, mask, digit: each digit masked in turn."""
    d = rolls.withColumn("labels", labels(F.col("roll"), F.col("program"))).where("labels IS NOT NULL")
    d = d.select("roll", "program", "labels", F.explode(F.sequence(F.lit(1), F.length("labels"))).alias("place"))
    mask = F.concat(F.expr("substring(labels, 1, place - 1)"), F.lit("_"), F.expr("substring(labels, place + 1)"))
    return d.select("roll", "program", "place", mask.alias("mask"), F.expr("substring(labels, place, 1)").alias("digit"))


NEIGHBOURS = "array<struct<roll:string,place:int,own:string,other:string>>"


def neighbours_of(rolls: DataFrame, roster: DataFrame) -> DataFrame:
    """Roll, program and the roster's rolls of the program that differ in one digit, ascending.

    rolls: roll, program, distinct; they need not be in the roster. A mask is shared by ten rolls at most.
    """
    other = _masked(roster.select("roll", "program")).select("program", "place", "mask", F.col("roll").alias("neighbour"), F.col("digit").alias("other"))
    near = _masked(rolls).join(other, ["program", "place", "mask"]).where("roll <> neighbour")
    row = F.struct(F.col("neighbour").alias("roll"), F.col("place"), F.col("digit").alias("own"), F.col("other"))
    return near.groupBy("roll", "program").agg(F.array_sort(F.collect_list(row)).cast(NEIGHBOURS).alias("neighbours"))


def guard(neighbours: Column, sources: list[tuple[Column, Column]]) -> Column:
    """Flags of the neighbours. sources: (used, probabilities of the digit cells).

    A neighbour is missing evidence if a source has no row for its place or neither digit any probability;
    else it is a hold where the least own probability is under .85.
    """

    def one(n: Column) -> Column:
        missing, least = F.lit(False), F.lit(None).cast("double")
        for used, probs in sources:
            row = F.get(probs, n["place"] - 1)
            own, other = (F.coalesce(F.get(row, n[x].try_cast("int")), F.lit(0.0)) for x in ("own", "other"))
            lacking = row.isNull() | (own + other <= 0)
            missing = missing | (used & lacking)
            least = F.least(least, F.when(used & ~lacking, F.bround(own, 6)))
        return F.when(missing, evidence("NEAR_NEIGHBOUR_EVIDENCE_MISSING", "block")).when(F.coalesce(least, F.lit(0.0)) < NEIGHBOUR_MIN, evidence("NEAR_NEIGHBOUR_HOLD", "block"))

    return F.coalesce(F.filter(F.transform(neighbours, one), lambda f: f.isNotNull()), F.array().cast(f"array<{FLAG}>"))


def guarded(neighbours: Column, probs: Column) -> Column:
    """Of one source the places, in the list of neighbours, of those that are missing evidence and of those that are a hold.

    Both are few: the list itself need not go on with the page.
    """

    def lacking(n: Column) -> Column:
        row = F.get(probs, n["place"] - 1)
        own, other = (F.coalesce(F.get(row, n[x].try_cast("int")), F.lit(0.0)) for x in ("own", "other"))
        return F.when(row.isNull() | (own + other <= 0), "missing").when(F.bround(own, 6) < NEIGHBOUR_MIN, "held")

    every = F.transform(F.coalesce(neighbours, F.array().cast(NEIGHBOURS)), lacking)
    at = lambda kind: F.filter(F.transform(every, lambda x, i: F.when(x == kind, i)), lambda i: i.isNotNull()).alias(kind)
    return F.struct(at("missing"), at("held"))


def guard_of(one: Column, other: Column) -> Column:
    """The flags of guard, once each, from what one or two sources (null: not used) say of the same list of neighbours."""
    none = F.array().cast("array<int>")
    both = lambda kind: F.array_union(F.coalesce(one[kind], none), F.coalesce(other[kind], none))
    missing = both("missing")
    held = F.array_except(both("held"), missing)
    first = F.coalesce(F.array_min(held) < F.array_min(missing), F.lit(False))
    lacks, holds = flag_when(F.size(missing) > 0, evidence("NEAR_NEIGHBOUR_EVIDENCE_MISSING", "block")), flag_when(F.size(held) > 0, evidence("NEAR_NEIGHBOUR_HOLD", "block"))
    return F.when(first, F.concat(holds, lacks)).otherwise(F.concat(lacks, holds))


def _claims_of(pages: DataFrame) -> DataFrame:
    """roll, claims: how many first pages name it by bubbles (B1) or cells (C1), continuations by slot (R2, ...), holders by slot (T1, ...)."""
    first, text = F.col("sheet_page") == 1, F.col("sheet_page").cast("string")
    kinds = [(F.when(first, F.col("bubble_roll")), F.lit("B1")), (F.when(first, F.col("cell_roll")), F.lit("C1")), (F.when(F.col("sheet_page") > 1, F.col("cell_roll")), F.concat(F.lit("R"), text)), (F.when(text.isNotNull(), F.col("current_roll")), F.concat(F.lit("T"), text))]
    each = pages.select(F.explode(F.array(*(F.struct(r.alias("roll"), k.alias("kind")) for r, k in kinds))).alias("x")).select("x.*").where("roll IS NOT NULL")
    return _counted(each, ["roll", "kind"], "n").groupBy("roll").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("claims"))


def _counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def known_rolls(roster: DataFrame) -> DataFrame:
    """roll, known (the roster's program, may be null), program: each roll once."""
    one = roster.groupBy(F.col("roll_no").alias("roll")).agg(F.max("program").alias("known"))
    return one.withColumn("program", program_of(F.col("roll"), F.col("known")))


def check_sources(pages: DataFrame) -> DataFrame:
    """The pages, if their source indices are positive and unique; else an error."""
    bad = pages.groupBy("source_index").agg(F.count("*").alias("n")).where("n > 1 OR source_index <= 0 OR source_index IS NULL").limit(1)
    if bad.head(1):
        raise ValueError("ownership evidence must have unique positive source indices")
    return pages


def _quality_flags(required: bool) -> Column:
    q = F.col("quality")
    fine = F.lit(True)
    for part in ("geometry", "local", "image"):
        fine = fine & F.coalesce(q[part].isin("ready", "warning"), F.lit(False))
    held = ~(fine & F.coalesce(q["status"].isin("ready", "aligned"), F.lit(False)))
    return merged(flag_when(q.isNull() & F.lit(required), evidence("QUALITY_UNAVAILABLE", "block")), flag_when(q.isNotNull() & held, evidence("IDENTITY_ALIGNMENT_HOLD", "block")))


def _own_flags(expected: int, in_roster: bool, required: bool) -> Column:
    """Rules 1 to 10a, of a page beside the counts of claims."""
    slot, roll, program, state = (F.col(c) for c in ("sheet_page", "roll", "cell_program", "state"))
    differs = lambda a, b: ~a.eqNullSafe(b)
    sure = F.coalesce(F.col("cell_min").between(CELL_MIN, 1.0), F.lit(False))
    contradicts = evidence("SOURCES_CONTRADICT", "block")
    btech = F.coalesce(program == "BTECH", F.lit(False))
    duplicate = evidence("DUPLICATE_AGREED_CLAIM", "block")
    return merged(
        F.coalesce(F.col("evidence_flags"), F.array().cast("array<struct<code:string,severity:string,message:string,metadata:map<string,string>>>")),
        _quality_flags(required),
        flag_when(F.coalesce(F.col("source_index"), F.lit(0)).cast("long") <= 0, evidence("INVALID_SOURCE_OR_SLOT", "block")),
        flag_when(~F.coalesce(slot.between(1, expected), F.lit(False)), evidence("INVALID_SOURCE_OR_SLOT", "block")),
        flag_when(roll.isNull(), evidence("CELL_ROLL_UNREADABLE", "block")),
        flag_when(roll.isNotNull() & ~sure, evidence("LOW_CELL_CONFIDENCE", "block")),
        flag_when(F.lit(in_roster) & roll.isNotNull() & F.col("in_roster").isNull(), evidence("ROLL_NOT_IN_ROSTER", "block")),
        flag_when(F.col("known").isNotNull() & differs(F.col("known"), program), contradicts),
        flag_when(F.col("program").isNotNull() & differs(F.col("program"), program), contradicts),
        flag_when((state == "clear") & differs(F.col("selected"), F.array(program)), contradicts),
        flag_when((state == "blank") & btech, evidence("PROGRAM_SELECTOR_BLANK", "warn")),
        flag_when(state == "ambiguous", evidence("PROGRAM_SELECTOR_AMBIGUOUS", "block")),
        flag_when((state == "unavailable") | ((state == "blank") & ~btech), evidence("PROGRAM_SELECTOR_BLANK", "block")),
        flag_when(roll.isNotNull() & (F.col("slot_claims") != 1), duplicate),
        flag_when((slot == 1) & differs(F.col("bubble_program"), program), contradicts),
        flag_when((slot == 1) & (F.col("bubble_roll").isNull() | differs(F.col("bubble_roll"), roll)), contradicts),
        flag_when((slot == 1) & ~F.coalesce(F.col("bubble_confidence").isin("high", "medium"), F.lit(False)), evidence("BUBBLE_IDENTITY_UNCERTAIN", "block")),
        flag_when((slot == 1) & F.col("bubble_roll").isNotNull() & (F.col("bubble_claims") != 1), duplicate),
    )


def _low_cells() -> Column:
    """Rule 11: the digit cells' rows do not fit the roll, or a digit of it was read with less than .80."""
    probs, digits = F.col("cell_probs"), F.col("digits")
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.get(F.get(probs, i - 1), F.substring(digits, i, F.lit(1)).try_cast("int")))
    unsure = (F.size(probs) != F.length(digits)) | F.exists(each, lambda p: ~F.coalesce(p.between(CELL_MIN, 1.0), F.lit(False)))
    return flag_when(F.col("roll").isNotNull() & (F.coalesce(F.size(probs), F.lit(0)) > 0) & unsure, evidence("LOW_CELL_CONFIDENCE", "block"))


def _read_roll() -> Column:
    return F.when(valid_roll(F.col("cell_roll"), F.col("cell_program")), F.col("cell_roll"))


def _packed(neighbours: Column) -> Column:
    """Neighbours as a small number each, in their order: place, own and other digit (10: no digit) are all that guard asks for."""
    digit = lambda x: F.coalesce(x.try_cast("int"), F.lit(10))
    return F.transform(neighbours, lambda n: (n["place"] * 121 + digit(n["own"]) * 11 + digit(n["other"])).cast("smallint"))


def _unpacked(near: Column) -> Column:
    digit = lambda x: F.when(x < 10, x)
    part = lambda n: F.struct(F.floor(n / 121).cast("int").alias("place"), digit(F.floor(n / 11).cast("int") % 11).alias("own"), digit(n.cast("int") % 11).alias("other"))
    return F.transform(near, part)


def _about_rolls(pages: DataFrame, roster: DataFrame | None) -> DataFrame:
    """by_roll, slots (claims by slot), known, in_roster, near (packed neighbours): each roll that pages name, once, as a roll has one program's form."""
    named = pages.select(_read_roll().alias("roll"), "cell_program", "sheet_page").where("roll IS NOT NULL")
    slot = F.when(F.col("sheet_page").isNotNull(), F.struct("sheet_page", "n"))
    about = _counted(named, ["roll", "cell_program", "sheet_page"], "n").groupBy("roll", F.col("cell_program").alias("program")).agg(F.map_from_entries(F.collect_list(slot)).alias("slots"))
    if roster is None:
        about = about.withColumns({"known": F.lit(None).cast("string"), "in_roster": F.lit(None).cast("int"), "near": F.lit(None).cast("array<smallint>")})
    else:
        known = known_rolls(roster)
        near = neighbours_of(named.select("roll", F.col("cell_program").alias("program")).distinct(), known)
        about = about.join(near.select("roll", "program", _packed(F.col("neighbours")).alias("near")), ["roll", "program"], "left")
        about = about.join(known.select("roll", "known", F.lit(1).alias("in_roster")), "roll", "left")
    return about.select(F.col("roll").alias("by_roll"), "slots", "known", "in_roster", "near")


def assess(pages: DataFrame, roster: DataFrame | None, expected: int, require_quality: bool = True) -> DataFrame:
    """source_index, sheet_page, roll, cell_program, flags, accepted, status of each page.

    roster: roll_no, program; without one no roll is unknown and none has neighbours. Flags of one
    code and severity are one. Rules are applied in their order, anchors before continuations.
    """
    p = pages.withColumn("roll", _read_roll())
    p = p.withColumn("digits", labels(F.col("roll"), F.col("cell_program"))).withColumn("selected", selected_programs(F.col("signals"))).withColumn("state", selector_state(F.col("signals")))
    # pages that name no roll are spread by their source
    spread = lambda c: F.coalesce(F.col(c), F.concat(F.lit("?"), F.col("source_index").cast("string")))
    p = p.withColumn("by_roll", spread("roll"))
    # only first pages name a roll by bubbles; what else hangs on a roll stands once beside it, so that a page goes to its roll once
    is_first = F.col("sheet_page") == 1
    one = p.where(is_first).withColumn("by_bubble", spread("bubble_roll"))
    bubbles = _counted(p.where("sheet_page = 1 AND bubble_roll IS NOT NULL"), ["bubble_roll"], "bubble_claims").withColumnRenamed("bubble_roll", "by_bubble")
    one = one.join(bubbles, "by_bubble", "left").drop("by_bubble")
    p = one.unionByName(p.where(~F.coalesce(is_first, F.lit(False))).withColumn("bubble_claims", F.lit(None).cast("long")))
    p = p.join(_about_rolls(pages, roster), "by_roll", "left").withColumn("slot_claims", F.try_element_at("slots", "sheet_page"))

    def finished(own: Column, *between: Column, anchor: Column | None = None) -> Column:
        named = F.col("roll").isNotNull()
        sources = [(named, F.coalesce(F.col("cell_probs"), F.array().cast("array<array<double>>")))]
        if anchor is not None:
            sources.append((anchor.isNotNull(), F.coalesce(anchor["cell_probs"], F.array().cast("array<array<double>>"))))
        flags = merged(own, *between, _low_cells(), guard(_unpacked(F.col("near")), sources))
        dropped = (F.col("state") == "blank") & F.coalesce(F.col("cell_program") == "BTECH", F.lit(False))
        return F.filter(flags, lambda f: ~(dropped & (f["code"] == "PROGRAM_SELECTOR_BLANK") & (f["severity"] == "block")))

    own = _own_flags(expected, roster is not None, require_quality)
    accepted = F.col("roll").isNotNull() & ~blocked(F.col("flags"))
    p = p.withColumn("flags", F.when(is_first, finished(own)))
    # an accepted page 1 is the only one of its roll, as its slot has one claim
    anchor = F.max(F.when(is_first & accepted, F.struct("roll", "cell_program", "cell_probs"))).over(Window.partitionBy("by_roll"))
    # a slot before the first is read before any anchor is there
    late = F.coalesce(F.col("sheet_page") > 1, F.lit(False))
    p = p.withColumn("anchor", anchor).withColumn("anchor", F.when(late, F.col("anchor")))
    held = F.col("anchor")
    rest = finished(
        own,
        flag_when(held.isNull(), evidence("NO_ANCHOR_FOR_ROLL", "block")),
        flag_when(held.isNotNull() & ~held["cell_program"].eqNullSafe(F.col("cell_program")), evidence("SOURCES_CONTRADICT", "block")),
        anchor=held,
    )
    done = p.withColumn("flags", F.when(is_first, F.col("flags")).otherwise(rest)).withColumn("accepted", accepted)
    columns = ["source_index", "sheet_page", "roll", "cell_program", "flags", "accepted", "bubble_roll"]
    done = done.select(columns)
    status = F.when(F.col("accepted"), "auto_matched").when(F.col("roll").isNotNull() | F.col("bubble_roll").isNotNull(), "suggested").otherwise("unmatched")
    return done.withColumn("status", status).drop("bubble_roll")


#: Flags of a proposal in their order, a bit each; those of neighbours may come in two orders.
PROPOSED = (
    ("ROLL_NOT_IN_ROSTER", "block"), ("ROSTER_CELL_SUPPORT", "warn"), ("DUPLICATE_AGREED_CLAIM", "block"), ("ANCHOR_SLOT_TAKEN", "block"), ("ANCHOR_VIA_PAGE2", "warn"), ("NO_ANCHOR_FOR_ROLL", "block"),
    ("SOURCES_CONTRADICT", "block"), ("LOW_CELL_CONFIDENCE", "warn"), ("ANCHOR_VIA_CELLS", "warn"), ("LOW_CELL_CONFIDENCE", "warn"), ("SOURCES_CONTRADICT", "block"), ("PROGRAM_SELECTOR_BLANK", "warn"), ("PROGRAM_SELECTOR_BLANK", "block"),
    ("PROGRAM_SELECTOR_AMBIGUOUS", "block"), ("SOURCES_CONTRADICT", "block"), ("NEAR_NEIGHBOUR_EVIDENCE_MISSING", "block"), ("NEAR_NEIGHBOUR_EVIDENCE_MISSING", "block"), ("NEAR_NEIGHBOUR_HOLD", "block"), ("NEAR_NEIGHBOUR_EVIDENCE_MISSING", "block"),
)
UNLISTED, SUPPORTED, DOUBLED, TAKEN, VIA_B, UNANCHORED, CONTRA_B, LOW_B, VIA_C, LOW_C, CONTRA_C, BLANK, BLANK_BLOCK, AMBIGUOUS, CONTRA_REST, UNLABELLED, LACKS_FIRST, HOLDS, LACKS_LAST = (1 << i for i in range(len(PROPOSED)))
#: What a continuation's cells say to either path, no flags yet.
UNDER_CELL, UNDER_C, FOR_C = (1 << (24 + i) for i in range(3))
BLOCKING = sum(1 << i for i, (_, severity) in enumerate(PROPOSED) if severity == "block")
#: Pages of a roll that are paired in one row; pages for each task that pairs them.
TOGETHER, PAIRED = 512, 16384


def _has(bits: Column, which: int) -> Column:
    return bits.bitwiseAND(F.lit(which)) != 0


def _bits(*told: tuple[Column, int]) -> Column:
    out = F.lit(0)
    for condition, bit in told:
        out = out.bitwiseOR(F.when(condition, F.lit(bit)).otherwise(F.lit(0)))
    return out


def _guard_bits(one: Column, other: Column) -> Column:
    """guard_of as bits."""
    none = F.array().cast("array<int>")
    both = lambda kind: F.array_union(F.coalesce(one[kind], none), F.coalesce(other[kind], none))
    missing = both("missing")
    held = F.array_except(both("held"), missing)
    first = F.coalesce(F.array_min(held) < F.array_min(missing), F.lit(False))
    return _bits((~first & (F.size(missing) > 0), LACKS_FIRST), (F.size(held) > 0, HOLDS), (first, LACKS_LAST))


def _sides(pages: DataFrame, roster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What may meet: pages 1 (roll, page1, bits, near) by both paths, and continuations (roll, continuation, sheet_page, program, bits, near).

    bits: all that a page says of its proposals; of neighbours that of a continuation alone, as path B has it.
    """
    p = pages.withColumn("state", selector_state(F.col("signals"))).withColumn("cell_min", F.coalesce("cell_min", F.lit(0.0)))
    known = known_rolls(roster)
    none = F.array().cast("array<array<double>>")
    # what hangs on a roll alone stands once beside it; a page meets it before pages meet each other, as nothing wide
    # may be dealt anew for each pair: a roll of n pages has n by n of them
    named = p.select(F.explode(F.array("bubble_roll", "cell_roll")).alias("roll")).where("roll IS NOT NULL").distinct()
    rolls = named.join(known.select("roll", "known", F.lit(1).alias("in_roster")), "roll", "left").withColumn("program", program_of(F.col("roll"), F.col("known")))
    rolls = rolls.join(neighbours_of(rolls.select("roll", "program"), known), ["roll", "program"], "left").join(_claims_of(p), "roll", "left").drop("known")

    one = p.where("sheet_page = 1").select(*(F.col(c).alias(f"one_{c}") for c in ("source_index", "cell_roll", "cell_min", "cell_probs", "bubble_roll", "current_roll", "suggestion")))
    # pages that name no roll are spread by their source
    one = one.withColumn("by", F.coalesce("one_cell_roll", F.concat(F.lit("?"), F.col("one_source_index").cast("string"))))
    one = one.join(known.select(F.col("roll").alias("by"), F.lit(1).alias("one_cell_known")), "by", "left").drop("by")
    b = one.where("one_bubble_roll IS NOT NULL").withColumn("roll", F.col("one_bubble_roll")).withColumn("path", F.lit("B")).withColumn("one_cell_probs", F.lit(None).cast("array<array<double>>"))
    c = one.where(f"one_cell_roll IS NOT NULL AND one_cell_min >= {SUGGEST_MIN} AND NOT (one_bubble_roll <=> one_cell_roll)").withColumn("roll", F.col("one_cell_roll")).withColumn("path", F.lit("C"))
    claims = lambda key: F.coalesce(F.try_element_at("claims", key), F.lit(0))
    one = b.unionByName(c).join(rolls, "roll")
    roll, program, is_b = F.col("roll"), F.col("program"), F.col("path") == "B"

    def supports(suggestion: Column, cell_known: Column) -> Column:
        named = (suggestion["roll_no"] == roll) & (suggestion["score"] >= SUPPORT_SCORE) & (suggestion["margin"] >= SUPPORT_MARGIN)
        return F.coalesce(named, F.lit(False)) & cell_known.isNull()

    said = _bits(
        (supports(F.col("one_suggestion"), F.col("one_cell_known")), SUPPORTED), (claims(F.concat("path", F.lit("1"))) != 1, DOUBLED), (is_b, VIA_B), (is_b & ~F.col("one_current_roll").eqNullSafe(roll), UNANCHORED),
        (is_b & F.col("one_cell_known").isNotNull() & (F.col("one_cell_roll") != roll), CONTRA_B), (~is_b, VIA_C), (~is_b & (F.col("one_cell_min") < PATH_C_MIN), LOW_C), (~is_b & F.col("one_bubble_roll").isNotNull(), CONTRA_C),
    )
    one = one.select("roll", F.col("one_source_index").alias("page1"), said.alias("bits"), F.when(~is_b, guarded(F.col("neighbours"), F.coalesce("one_cell_probs", none))).alias("near"))

    rest = p.where(f"sheet_page > 1 AND cell_roll IS NOT NULL AND cell_min >= {REVIEW_B_MIN} AND NOT (current_roll <=> cell_roll)")
    rest = rest.select(F.col("cell_roll").alias("roll"), "source_index", "sheet_page", "cell_min", "cell_probs", "cell_program", "state", "suggestion").join(rolls, "roll")
    slot, blank = F.col("sheet_page").cast("string"), F.col("state") == "blank"
    said = _bits(
        (F.col("in_roster").isNull(), UNLISTED), (supports(F.col("suggestion"), F.col("in_roster")), SUPPORTED), (claims(F.concat(F.lit("R"), slot)) != 1, DOUBLED), (claims(F.concat(F.lit("T"), slot)) > 0, TAKEN),
        (blank & (program == "BTECH"), BLANK), (blank & (program != "BTECH"), BLANK_BLOCK), (F.col("state") == "ambiguous", AMBIGUOUS), (~F.col("state").isin("blank", "ambiguous") & (F.col("cell_program") != program), CONTRA_REST),
        (labels(roll, program).isNull(), UNLABELLED), (F.col("cell_min") < CELL_MIN, UNDER_CELL), (F.col("cell_min") < PATH_C_MIN, UNDER_C), (F.col("cell_min") >= SUGGEST_MIN, FOR_C),
    )
    rest = rest.select("roll", F.col("source_index").alias("continuation"), "sheet_page", "program", said.alias("bits"), guarded(F.col("neighbours"), F.coalesce("cell_probs", none)).alias("near"))
    return one, rest.withColumn("bits", F.col("bits").bitwiseOR(_guard_bits(F.lit(None).cast("struct<missing:array<int>,held:array<int>>"), F.col("near"))))


def _meet(one: Column, one_near: Column, rest: Column, near: Column) -> Column:
    """The bits of a pair; null if it is none."""
    guards = LACKS_FIRST | HOLDS | LACKS_LAST
    via_c = _has(one, VIA_C)
    both = one.bitwiseOR(rest).bitwiseOR(F.when(via_c, F.when(_has(rest, UNDER_C), F.lit(LOW_C)).otherwise(F.lit(0))).otherwise(F.when(_has(rest, UNDER_CELL), F.lit(LOW_B)).otherwise(F.lit(0))))
    return F.when(~via_c, both).when(_has(rest, FOR_C), both.bitwiseAND(F.lit(~guards)).bitwiseOR(_guard_bits(one_near, near)))


def _shown(bits: Column) -> list[Column]:
    """Whether each flag of PROPOSED stands: of one code and severity the first."""
    out = []
    for i, flag in enumerate(PROPOSED):
        before = sum(1 << j for j in range(i) if PROPOSED[j] == flag)
        out.append(_has(bits, 1 << i) & ~_has(bits, before) if before else _has(bits, 1 << i))
    return out


def _told_of(j: DataFrame, text: bool) -> DataFrame:
    """Proposals of pairs (roll, program, page1, continuation, sheet_page, bits); text: codes instead of flags."""
    bits = F.col("bits")
    path = F.when(_has(bits, VIA_B), "B").otherwise("C")
    shown = list(zip(_shown(bits), PROPOSED, strict=True))
    if text:
        flags = F.concat_ws(",", *(F.when(is_, F.lit(f"{code}:{severity}")) for is_, (code, severity) in shown)).alias("codes")
    else:
        flags = F.concat(*(flag_when(is_, evidence(code, severity)) for is_, (code, severity) in shown)).alias("flags")
    ident = candidate_id(F.lit(POLICY), path, "roll", F.col("page1").cast("string"), F.col("continuation").cast("string"), F.col("sheet_page").cast("string"))
    stopped, sure = _has(bits, BLOCKING), _has(bits, VIA_B) & ~_has(bits, UNDER_CELL)
    return j.select(ident.alias("candidate_id"), path.alias("path"), "roll", "program", "page1", "continuation", "sheet_page", flags, stopped.alias("blocked"), (sure & ~stopped).alias("eligible"))


def proposals(pages: DataFrame, roster: DataFrame) -> DataFrame:
    """Candidates of paths B and C with all their flags, blocked, eligible; to be ordered by ORDER.

    B: a page 1 whose bubbles name the roll in a continuation's cells. C: a page 1 and a continuation whose
    cells agree, the bubbles not. Both need a continuation that is not the roll's already, so a slot
    that is taken is taken by another page, and no pair is of both paths.
    """
    one, rest = _sides(pages, roster)
    one = one.withColumnsRenamed({"bits": "one_bits", "near": "one_near"})
    j = one.join(rest, "roll").withColumn("bits", _meet(F.col("one_bits"), F.col("one_near"), F.col("bits"), F.col("near")))
    return _told_of(j.where("bits IS NOT NULL"), False)


def proposal_list(pages: DataFrame, roster: DataFrame) -> DataFrame:
    """O1: the proposals in ORDER, with codes as text.

    A roll's pages are put in order before they meet: what is dealt and sorted grows with the pages, not with their pairs.
    """
    one, rest = _sides(pages, roster)
    ones = one.groupBy("roll").agg(F.collect_list(F.struct("page1", "bits", "near")).alias("ones"))
    piece = F.floor((F.row_number().over(Window.partitionBy("roll").orderBy("sheet_page", "continuation")) - 1) / TOGETHER).cast("int")
    rests = rest.withColumn("piece", piece).groupBy("roll", "piece").agg(F.first("program").alias("program"), F.array_sort(F.collect_list(F.struct("sheet_page", "continuation", "bits", "near"))).alias("rests"))
    open_ = lambda c: F.filter(c, lambda x: ~_has(x["bits"], BLOCKING))
    every, few = F.struct(F.lit(2).alias("group"), "ones", "rests"), [F.struct(F.lit(g).alias("group"), open_("ones").alias("ones"), open_("rests").alias("rests")) for g in (0, 1)]
    # a pair is first open and eligible, then open, then blocked
    j = ones.join(rests, "roll").select("roll", "piece", "program", F.explode(F.array(*few, every)).alias("x")).select("roll", "piece", "program", "x.*").where("size(ones) > 0 AND size(rests) > 0")
    tasks = max(8, -(-pages.count() // PAIRED))
    j = j.repartitionByRange(tasks, "group", "roll", "piece").sortWithinPartitions("group", "roll", "piece")
    j = j.select("group", "roll", "program", "ones", F.explode("rests").alias("rest")).select("group", "roll", "program", "rest", F.explode("ones").alias("one"))
    j = j.select("group", "roll", "program", "one.page1", "rest.continuation", "rest.sheet_page", _meet(F.col("one.bits"), F.col("one.near"), F.col("rest.bits"), F.col("rest.near")).alias("bits")).where("bits IS NOT NULL")
    bits = F.col("bits")
    own = F.when(_has(bits, BLOCKING), 2).when(_has(bits, VIA_B) & ~_has(bits, UNDER_CELL), 0).otherwise(1)
    return _told_of(j.where(own == F.col("group")), True)


def proposal_flags(pages: DataFrame, roster: DataFrame) -> DataFrame:
    """path, code, severity, n: how many proposals have each flag.

    Pages of a roll that say the same are one with their number, so pairs of pages need not be made.
    """
    one, rest = _sides(pages, roster)
    one = one.groupBy("roll", F.col("bits").alias("one_bits"), F.col("near").alias("one_near")).agg(F.count("*").alias("n"))
    rest = rest.groupBy("roll", "bits", "near").agg(F.count("*").alias("m"))
    j = one.join(rest, "roll").select(_meet(F.col("one_bits"), F.col("one_near"), F.col("bits"), F.col("near")).alias("bits"), (F.col("n") * F.col("m")).alias("n"))
    kinds = j.where("bits IS NOT NULL").groupBy("bits").agg(F.sum("n").alias("n"))
    each = F.array_compact(F.array(*(F.when(is_, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for is_, (code, severity) in zip(_shown(F.col("bits")), PROPOSED, strict=True))))
    told = kinds.select(F.when(_has(F.col("bits"), VIA_B), "B").otherwise("C").alias("path"), "n", F.explode(each).alias("f"))
    return told.groupBy("path", F.col("f.code").alias("code"), F.col("f.severity").alias("severity")).agg(F.sum("n").alias("n"))


#: O1: the order in which proposals are shown.
ORDER = ("blocked", "NOT eligible", "roll", "sheet_page", "continuation")


def in_order(found: DataFrame) -> DataFrame:
    return found.orderBy(*map(F.expr, ORDER))


def order_proposals(pages: DataFrame, mode: str, expected: int, total: int, policy: str) -> DataFrame:
    """Where scanner order would put a page 1's continuations: always blocked, never ownership."""
    if mode not in ("sheet-major", "page-major") or expected <= 1 or (mode == "page-major" and total % expected):
        return pages.sparkSession.createDataFrame([], "candidate_id string, roll string, page1 long, continuation long, sheet_page int, codes string")
    step = 1 if mode == "sheet-major" else total // expected
    anchors = pages.where("sheet_page = 1 AND bubble_roll IS NOT NULL").select(F.col("bubble_roll").alias("roll"), F.col("source_index").alias("page1"), F.explode(F.sequence(F.lit(2), F.lit(expected))).alias("sheet_page"))
    wanted = anchors.withColumn("continuation", F.col("page1") + (F.col("sheet_page") - 1) * step)
    have = pages.where("current_roll IS NULL").select(F.col("source_index").alias("continuation"), "sheet_page")
    ident = candidate_id(F.lit(policy), F.lit("order"), "roll", F.col("page1").cast("string"), F.col("continuation").cast("string"), F.col("sheet_page").cast("string"))
    return wanted.join(have, ["continuation", "sheet_page"]).select(ident.alias("candidate_id"), "roll", "page1", "continuation", "sheet_page", F.lit("SCANNER_ORDER_ONLY:block").alias("codes"))
