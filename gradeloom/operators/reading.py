"""Reading decisions on measured bubbles, digit cells and pages.

Measurements are long: a row for each option. Groups are a sheet's question, so they are
small; partial aggregation and one window by (sheet, question) do all the work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed thresholds of the domain.
FILL, FLOOR, MARGIN, INK, INK_EXCESS, FAINT_EXCESS = 0.50, 0.28, 0.18, 0.24, 0.10, 0.055


def top_two(bubbles: DataFrame, keys: list[str], value: str = "fill", option: str = "option") -> DataFrame:
    """Each group's best option, its value, and the margin over the runner-up (ties: smaller option)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), option)
    ranked = bubbles.withColumn("place", F.row_number().over(w)).where("place <= 2")
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    second = F.coalesce(F.max(F.when(F.col("place") == 2, F.col(value))), F.lit(0.0))
    return ranked.groupBy(*keys).agg(first(option).alias("best"), first(value).alias("best_value"), (first(value) - second).alias("margin"))


def _middle(values: Column) -> Column:
    """The median of an array; null if it is empty."""
    s = F.array_sort(values)
    n = F.size(s)
    at = lambda i: F.get(s, F.floor(i).cast("int"))
    return F.when(n > 0, (at((n - 1) / 2) + at(n / 2)) / 2)


def questions(bubbles: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each question with its options, fullest first (ties: smaller option): the only shuffle of B1 to B3."""
    option = F.struct((-F.col("fill")).alias("neg"), "option", "fill", "ink", "enhanced")
    g = bubbles.groupBy(*keys).agg(F.sort_array(F.collect_list(option)).alias("options"))
    empty = F.transform(F.filter("options", lambda x: x["fill"] < FLOOR), lambda x: x["ink"])
    return g.withColumn("baseline", F.coalesce(_middle(empty), _middle(F.transform("options", lambda x: x["ink"]))))


def _assessed(g: DataFrame) -> dict[str, Column]:
    filled = F.size(F.filter("options", lambda x: x["fill"] >= FILL))
    top, second = F.get("options", F.lit(0)), F.get("options", F.lit(1))
    margin = top["fill"] - F.coalesce(second["fill"], F.lit(0.0))
    marked = lambda x: (x["fill"] >= FLOOR) | ((x["ink"] >= INK) & (x["ink"] - F.col("baseline") >= INK_EXCESS))
    others = F.exists(F.slice("options", F.lit(2), F.greatest(F.size("options") - 1, F.lit(0))), marked)
    outcome = F.when(filled > 1, "multiple").when(filled == 1, "answered").otherwise("blank")
    confidence = (
        F.when(filled > 1, "low")
        .when((filled == 1) & (margin < MARGIN), "low")
        .when((filled == 1) & others, "medium")
        .when(filled == 1, "high")
        .when(F.exists("options", marked), "low")
        .otherwise("high")
    )
    return {"outcome": outcome, "selected": F.when(filled == 1, top["option"]), "confidence": confidence, "margin": margin, "needs_review": confidence != "high"}


def _provisional(g: DataFrame) -> Column:
    by = F.sort_array(F.transform("options", lambda x: F.struct((-x["enhanced"]).alias("neg"), x["option"].alias("option"), x["enhanced"].alias("enhanced"), x["ink"].alias("ink"))))
    best, second = F.get(by, F.lit(0)), F.get(by, F.lit(1))
    rest = _middle(F.transform(F.slice(by, F.lit(2), F.greatest(F.size("options") - 1, F.lit(0))), lambda x: x["ink"]))
    sure = (best["enhanced"] >= FILL) & (best["enhanced"] - F.coalesce(second["enhanced"], F.lit(0.0)) >= MARGIN) & (best["ink"] - F.coalesce(rest, F.lit(0.0)) >= FAINT_EXCESS)
    return F.when(sure, best["option"])


def assess_mcq(bubbles: DataFrame, keys: list[str] = ("sheet", "q_no")) -> DataFrame:
    """B1: outcome, selected, confidence, margin and review of each question from fill and ink of its options.

    More than one filled: multiple. One filled: answered, low if the margin is small, medium if another
    option is marked. None filled: blank, low if some option is marked, high otherwise.
    """
    g = questions(bubbles, list(keys))
    return g.select(*keys, *[c.alias(n) for n, c in _assessed(g).items()])


def faint_option(bubbles: DataFrame, keys: list[str] = ("sheet", "q_no")) -> DataFrame:
    """B2: the option that an enhanced reading shows, if it is clear and its raw ink stands out; else null."""
    g = questions(bubbles, list(keys))
    return g.select(*keys, _provisional(g).alias("provisional"))


def read_mcq(bubbles: DataFrame, keys: list[str] = ("sheet", "q_no")) -> DataFrame:
    """B1, and where no option is filled what B2 finds, as an answer of low confidence."""
    g = questions(bubbles, list(keys))
    told = g.select(*keys, *[c.alias(n) for n, c in _assessed(g).items()], F.when(F.get("options", F.lit(0))["fill"] < FILL, _provisional(g)).alias("provisional"))
    up = (F.col("outcome") == "blank") & F.col("provisional").isNotNull()
    return told.select(
        *keys,
        F.when(up, "answered").otherwise(F.col("outcome")).alias("outcome"),
        F.when(up, F.col("provisional")).otherwise(F.col("selected")).alias("selected"),
        F.when(up, "low").otherwise(F.col("confidence")).alias("confidence"),
        (up | F.col("needs_review")).alias("needs_review"),
    )


def read_numerical(places: DataFrame, keys: list[str]) -> DataFrame:
    """A number from its places (place, outcome, selected, needs_review): digits keep leading zeros."""
    has = lambda o: F.bool_or(F.col("outcome") == o)
    all_answered, all_blank = F.bool_and(F.col("outcome") == "answered"), F.bool_and(F.col("outcome") == "blank")
    outcome = F.when(has("multiple"), "multiple").when(all_blank, "blank").when(has("blank"), "incomplete").when(all_answered, "answered").otherwise("ambiguous")
    digits = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "selected"))), lambda x: F.coalesce(x["selected"], F.lit("?"))), "")
    told = places.groupBy(*keys).agg(outcome.alias("outcome"), digits.alias("digits_text"), F.bool_or("needs_review").alias("needs_review"))
    return told.withColumn("value", F.when(F.col("outcome") == "answered", F.col("digits_text").try_cast("int")))


def decode_grid(columns: DataFrame, keys: list[str]) -> DataFrame:
    """A roll from its columns (place, filled, faint, digit): ? where unsure, null if any is."""
    one = F.when(F.col("filled") == 1, F.col("digit")).when((F.col("filled") == 0) & (F.col("faint") == 1), F.col("digit")).otherwise("?")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", one.alias("c")))), lambda x: x["c"]), "")
    told = columns.groupBy(*keys).agg(text.alias("read"), F.bool_or(F.col("filled") == 0).alias("flagged"))
    return told.withColumn("roll", F.when(~F.col("read").contains("?"), F.col("read")))


def reconcile_program(selector: Column, completed: Column, shared: Column) -> Column:
    """The selector's program; else the one completed grid's, unless programs share it; else null."""
    return F.when(selector.isNotNull(), selector).when((F.size(completed) == 1) & ~shared, F.get(completed, F.lit(0)))


def cells_read(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A field's confidence is its cells' least; also their geometric mean; two blanks: empty."""
    blank = F.count_if(F.col("digit") == "")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "digit"))), lambda x: F.when(x["digit"] == "", "?").otherwise(x["digit"])), "")
    told = cells.groupBy(*keys).agg(text.alias("read"), F.min(F.when(F.col("digit") == "", 0.0).otherwise(F.col("p"))).alias("confidence"), F.exp(F.avg(F.ln(F.greatest("p", F.lit(1e-6))))).alias("mean_p"), blank.alias("blanks"))
    return told.withColumn("empty_field", F.col("blanks") >= 2)


def band(confidence: Column, high: float = 0.82, medium: float = 0.60, empty: Column | None = None) -> Column:
    """High, medium or low; a null confidence counts as .65, an empty field as low."""
    c = F.coalesce(confidence, F.lit(0.65))
    told = F.when(c >= high, "high").when(c >= medium, "medium").otherwise("low")
    return told if empty is None else F.when(empty, "low").otherwise(told)


def reconcile_reads(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Of several reads (roll, confidence) the surest; conflict if they name several rolls."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("confidence", F.lit(0.65))), "roll")
    first = reads.withColumn("place", F.row_number().over(w))
    return first.groupBy(*keys).agg(F.max(F.when(F.col("place") == 1, F.col("roll"))).alias("roll"), (F.count_distinct("roll") > 1).alias("conflict"), F.max(F.when(F.col("place") == 1, band(F.col("confidence")))).alias("band"))


def vote_digits(reads: DataFrame, keys: list[str]) -> DataFrame:
    """The digit of most votes, then of highest median and greatest confidence, then the smaller."""
    by = reads.groupBy(*keys, "digit").agg(F.count("*").alias("votes"), F.median("confidence").alias("middle"), F.max("confidence").alias("most"))
    by = by.withColumn("all_votes", F.sum("votes").over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(F.desc("votes"), F.desc("middle"), F.desc("most"), "digit")
    best = by.withColumn("place", F.row_number().over(w)).where("place = 1")
    return best.select(*keys, "digit", "votes", F.least(F.lit(0.99), 0.30 * F.col("votes") / F.col("all_votes") + 0.70 * F.col("middle")).alias("confidence"))


def alignment_score(flags: Column, warnings: Column) -> Column:
    """1 less .18 a flag (.60 at most) and .05 a warning (.20 at most), in 0 to 1."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(0.60), flags * 0.18) - F.least(F.lit(0.20), warnings * 0.05))


def alignment_gates(m: dict[str, Column]) -> Column:
    """How many of the gates a page's metrics fail."""
    gates = [m["dark"] < 0.58, m["residual"] > 0.90, m["bar"] < 0.45, m["contrast"] < 0.18, m["anchors"] < 0.72, m["blur"] < 5, m["median"] < 135]
    return sum((F.when(g, 1).otherwise(0) for g in gates), F.lit(0))


def detect_page(bars: DataFrame, keys: list[str]) -> DataFrame:
    """The page whose bar alone reaches .45; null if none or several do."""
    dark = F.count_if(F.col("bar") >= 0.45)
    return bars.groupBy(*keys).agg(F.when(dark == 1, F.max(F.when(F.col("bar") >= 0.45, F.col("page")))).alias("page"), F.max("bar").alias("confidence"))


def dispatch_identity(page: Column, roll_page: int, bubbled: Column, written: Column) -> tuple[Column, Column]:
    """Z3: kind and roll: bubbles on the roll page, or what is written if they can't be read; else by hand."""
    kind = F.when((page == roll_page) & bubbled.isNotNull(), "bubbled").when(page == roll_page, "write_in").otherwise("handwritten")
    return kind, F.when((page == roll_page) & bubbled.isNotNull(), bubbled).otherwise(written)
