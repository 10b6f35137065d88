"""Exports, markers' packets, layout and constraints (K*, P19, P20, Z10, W6 to W9, C8, I8 to I10, V*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packets(rows: DataFrame, mode: str, markers: int, size: int) -> DataFrame:
    """Rows in order of roll dealt to markers (split: every n-th; double: all to each), in batches.

    A packet list is ranked within a centre, so no one task ranks all of them.
    """
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("centre").orderBy("roll_no")))
    if mode == "split":
        dealt = ranked.withColumn("marker", F.pmod(F.col("rn") - 1, F.lit(markers))).withColumn("own", F.floor((F.col("rn") - 1) / markers))
    else:
        dealt = ranked.withColumn("marker", F.explode(F.sequence(F.lit(0), F.lit(markers - 1)))).withColumn("own", F.col("rn") - 1)
    return dealt.withColumn("batch", F.floor(F.col("own") / size).cast("long") + 1).drop("own")


def skip_reason(status: Column, has_page: Column, claims: Column) -> Column:
    """Why a sheet is in no packet."""
    return F.when(~status.isin("verified", "approved", "auto_matched"), "Ownership awaiting approval").when(~has_page, "Question page missing").when(claims.isNull() | (claims != 1), "Source ownership is missing or disputed")


def range_overlaps(ranges: DataFrame) -> DataFrame:
    """Ranges of one question that share positions, unless one is an additional marker."""
    a = ranges.select("q_no", F.col("marker").alias("a"), F.col("first").alias("a1"), F.col("last").alias("a2"), F.col("additional").alias("a3"))
    b = ranges.select("q_no", F.col("marker").alias("b"), F.col("first").alias("b1"), F.col("last").alias("b2"), F.col("additional").alias("b3"))
    return a.join(b, "q_no").where((F.col("a") < F.col("b")) & (F.col("a1") <= F.col("b2")) & (F.col("b1") <= F.col("a2")) & ~F.col("a3") & ~F.col("b3")).select("q_no", "a", "b")


def rendered(template: str, fields: dict[str, Column], allowed: tuple[str, ...]) -> Column:
    """P20: a text with {named} places filled; other names are an error."""
    import string

    used = [n for _, n, _, _ in string.Formatter().parse(template) if n]
    unknown = sorted(set(used) - set(allowed))
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    out = F.lit(template)
    for name in used:
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(fields[name], F.lit("")))
    return out


def answer_rows(mcq: DataFrame, numerical: DataFrame) -> DataFrame:
    """Both kinds of answers as one list with their marks as text."""
    text = F.when(F.col("dropped"), "Dropped").otherwise(F.concat_ws("/", F.col("awarded").cast("int").cast("string"), F.col("marks").cast("int").cast("string")))
    a = mcq.select("sheet", "q_no", F.lit("MCQ").alias("kind"), F.coalesce("selected", F.lit("")).alias("response"), text.alias("marks_text"))
    b = numerical.select("sheet", "q_no", F.lit("NUMERIC").alias("kind"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("response"), text.alias("marks_text"))
    return a.unionByName(b)


def report(*parts: DataFrame) -> DataFrame:
    """Students, unmatched pages and errors as one report; columns that one lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def grid_centres(grids: DataFrame) -> DataFrame:
    """A centre for each place and digit of a grid; orientation says which way digits run."""
    each = grids.select("*", F.explode(F.sequence(F.lit(0), F.col("positions") - 1)).alias("place")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("digit"))
    down = F.col("orientation") == "vertical"
    x = F.col("x_mm") + F.when(down, F.col("place") * F.col("position_pitch_mm")).otherwise(F.col("digit") * F.col("digit_pitch_mm"))
    y = F.col("y_mm") + F.when(down, F.col("digit") * F.col("digit_pitch_mm")).otherwise(F.col("place") * F.col("position_pitch_mm"))
    return each.select("grid", "place", "digit", x.alias("cx_mm"), y.alias("cy_mm"))


def column_major(items: DataFrame, per_page: int, columns: int) -> DataFrame:
    """Items of an exam laid out column by column, page by page; rows used are what the page needs."""
    w = Window.partitionBy("exam")
    i = items.withColumn("i", F.row_number().over(w.orderBy("q_no")) - 1).withColumn("n", F.count("*").over(w))
    page = F.floor(F.col("i") / per_page)
    here = F.least(F.lit(per_page), F.col("n") - page * per_page)
    rows = F.ceil(here / columns)
    at = F.col("i") % per_page
    return i.select("exam", "q_no", (page + 1).cast("int").alias("page"), F.floor(at / rows).cast("int").alias("column"), (at % rows).cast("int").alias("row"))


def overlaps(boxes: DataFrame) -> DataFrame:
    """I8: pairs of boxes of a page that overlap on both axes."""
    a = boxes.select("page", *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "x2", "y1", "y2")])
    b = boxes.select("page", *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "x2", "y1", "y2")])
    return a.join(b, "page").where("a_id < b_id AND a_x1 < b_x2 AND b_x1 < a_x2 AND a_y1 < b_y2 AND b_y1 < a_y2").select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


def crowded(points: DataFrame, radius: float, gap: float = 1.5) -> DataFrame:
    """Pairs of bubbles of a page that touch (error) or nearly do (warning).

    Points are dealt to cells of the greatest distance that matters, and meet those of their own and
    neighbouring cells, so only near pairs are made.
    """
    reach = 2 * radius + gap
    cell = lambda c: F.floor(F.col(c) / reach)
    a = points.select("page", F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("gx"), cell("y").alias("gy"))
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    b = points.select("page", F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy")).withColumn("dx", near).withColumn("dy", near)
    b = b.withColumn("gx", F.col("cx") + F.col("dx")).withColumn("gy", F.col("cy") + F.col("dy"))
    apart = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))
    # each point stands in nine cells, which sizes of files don't tell: neither side is for the driver to hold
    pairs = a.hint("merge").join(b, ["page", "gx", "gy"]).where("a < b").withColumn("apart", apart).where(F.col("apart") < reach * reach)
    return pairs.select("page", "a", "b", F.when(F.col("apart") < 4 * radius * radius, "overlap").otherwise("crowded").alias("kind"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """V1 to V6: a row for each rule that a row breaks; a null test counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(key).alias("key"), F.explode(broken).alias("rule"))


def require(found: DataFrame, what: str) -> None:
    """Early failure: the first few violations and their number, as one error."""
    some = found.limit(5).collect()
    if some:
        raise ValueError(f"{what}: {found.count()} violations, such as {[tuple(r) for r in some]}")
