"""Spans of regular expressions as columns, by Spark's own functions only.

A span is a struct(start, ord, end, kind): code points, end exclusive; ord is the kind's place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,end:int,kind:string>"
MATCH = "struct<start:int,end:int,text:string,part:string>"


def no(kind: str) -> Column:
    """An empty array of spans (SPAN) or matches (MATCH)."""
    return F.expr(f"cast(array() as array<{kind}>)")


#: Items of an array that are folded together; longer arrays are folded by blocks of so many.
FOLDED = 128


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / FOLDED).cast("int")), lambda i: F.slice(items, i * FOLDED + 1, F.lit(FOLDED)))


def running(items: Column, value: Callable[[Column], Column], merge: Callable[[Column, Column], Column], first: Column) -> Column:
    """For each item what merge makes of first and the values of all items before it.

    An array that grows by an item at a time is copied each time. So blocks of FOLDED items are
    folded first, then the blocks' results, then each block from where it begins: the work is
    about n * FOLDED + (n / FOLDED) ** 2 small steps, not n ** 2.
    """

    def scan(part: Column, start: Column, of: Callable[[Column], Column]) -> Column:
        # the last element is what comes after the part
        return F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), of(x)))))

    def blocked(blocks: Column) -> Column:
        starts = scan(F.transform(blocks, lambda part: F.aggregate(part, first, lambda acc, x: merge(acc, value(x)))), first, lambda x: x)
        return F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), lambda part, start: F.slice(scan(part, start, value), F.lit(1), F.size(part))))

    none = F.slice(F.array(first), 1, 0)
    return let(items, lambda its: F.when(F.size(its) == 0, none).when(F.size(its) <= FOLDED, F.slice(scan(its, first, value), F.lit(1), F.size(its))).otherwise(let(_blocks(its), blocked)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """The pattern's leftmost non-overlapping matches: array of struct(start, end, text, part).

    Positions add up from the gaps between matches, which split() returns, and the matches.
    part is the given group's text, or the match.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)

    def placed(three: Column) -> Column:
        before = running(three, lambda x: F.length(x["gap"]) + F.length(x["text"]), _sum, F.lit(0))
        start = lambda x, at: at + F.length(x["gap"])
        return F.zip_with(three, before, lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + F.length(x["text"])).alias("end"), x["text"].alias("text"), x["part"].alias("part")))

    # there is a gap more than matches
    found = let(whole, lambda w: let(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(w)).alias("gap"), w.alias("text"), (w if group is None else part).alias("part")), placed))
    return F.when(text.rlike(pattern), found).otherwise(no(MATCH))


def spans(found: Column, kind: str | Column, order: int | Column) -> Column:
    """Matches as spans of one kind."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    order = F.lit(order) if isinstance(order, int) else order
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), order.alias("ord"), m["end"].alias("end"), kind.alias("kind")))


def in_order(found: Column) -> Column:
    """Spans by start, then kind as listed."""
    return F.sort_array(found)


def told(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def apart(parts: Column, span: Callable[[Column], Column], base: Column) -> Column:
    """Those parts whose span meets none of the base spans, both in order.

    All are put in one order; a span is met from the left if an earlier base span reaches over its
    start, from the right if the next base span begins before its end.
    """

    def mark(s: Column, own: Column, at: Column) -> Column:
        return F.struct(s["start"].alias("start"), own.alias("own"), s["end"].alias("end"), at.alias("at"))

    far = 2**31 - 1

    def free(every: Column) -> Column:
        reach = running(every, lambda x: F.when(x["own"] == 1, x["end"]).otherwise(0), lambda a, b: F.greatest(a, b), F.lit(0))
        following = F.reverse(running(F.reverse(every), lambda x: F.when(x["own"] == 1, x["start"]).otherwise(far), lambda a, b: F.least(a, b), F.lit(far)))
        zipped = F.arrays_zip(every.alias("x"), reach.alias("reach"), following.alias("following"))
        return F.filter(zipped, lambda z: (z["x"]["own"] == 2) & (z["reach"] <= z["x"]["start"]) & (z["following"] >= z["x"]["end"]))

    def left(both: Column) -> Column:
        own, against = both["parts"], both["base"]
        every = F.array_sort(F.concat(F.transform(against, lambda b: mark(b, F.lit(1), F.lit(-1))), F.transform(own, lambda p, i: mark(span(p), F.lit(2), i))))
        return F.transform(let(every, free), lambda z: F.get(own, z["x"]["at"]))

    return F.when((F.size(parts) == 0) | (F.size(base) == 0), parts).otherwise(let(F.struct(parts.alias("parts"), base.alias("base")), left))


def redacted(text: Column, found: Column, mark: str) -> Column:
    """text with each run of overlapping spans (in order) replaced by a mark.

    A run's first span gives the text since the run before, and the mark. A long text is cut by
    blocks of FOLDED spans first, as taking a part counts the characters before it.
    """

    def told(block: Column) -> Column:
        base = block[0]["reach"]
        part = F.substring(text, base + 1, F.element_at(block, -1)["s"]["start"] - base)
        piece = lambda own, p: F.substring(own, p["reach"] - base + 1, p["s"]["start"] - p["reach"])
        return let(part, lambda own: F.array_join(F.transform(block, lambda p: F.when(p["s"]["start"] < p["reach"], F.lit("")).otherwise(F.concat(piece(own, p), F.lit(mark)))), ""))

    def whole(pairs: Column) -> Column:
        last = F.array_max(F.transform(pairs, lambda p: p["s"]["end"]))
        return F.concat(F.array_join(F.transform(_blocks(pairs), told), ""), let(last, lambda n: F.substring(text, n + 1, F.length(text))))

    def paired(found: Column) -> Column:
        reach = running(found, lambda s: s["end"], lambda a, b: F.greatest(a, b), F.lit(0))
        return let(F.arrays_zip(found.alias("s"), reach.alias("reach")), whole)

    return F.when(F.size(found) > 0, let(found, paired)).otherwise(text)


def packed(columns: list[str]) -> Column:
    """Columns in one struct named row, out of the way of names that an operator uses itself."""
    return F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns]).alias("row")


def unpacked(columns: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in columns]
