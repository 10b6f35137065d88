"""Evidence flags (P21, C5, U6): structs of code, severity, message and metadata in arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG = "struct<code:string,severity:string,message:string,metadata:map<string,string>>"
SEVERITIES = ("info", "warn", "block")


def evidence(code: str, severity: str, message: str = "", **metadata: Column) -> Column:
    """One flag. A severity outside the vocabulary is an error."""
    if severity not in SEVERITIES:
        raise ValueError(f"severity {severity!r} is not one of {SEVERITIES}")
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    held = F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), held.alias("metadata"))


def flag_when(condition: Column, flag: Column) -> Column:
    """The flag in an array if the condition holds (null counts as not), else an empty array."""
    return F.when(condition, F.array(flag)).otherwise(F.expr(f"cast(array() as array<{FLAG}>)"))


def merged(*groups: Column) -> Column:
    """All flags in order, of those with one code, severity and message the first."""
    same = lambda a, b: (a["code"] == b["code"]) & (a["severity"] == b["severity"]) & (a["message"] == b["message"])
    add = lambda held, x: F.when(F.exists(held, lambda y: same(x, y)), held).otherwise(F.concat(held, F.array(x)))
    return F.aggregate(F.concat(*groups), F.expr(f"cast(array() as array<{FLAG}>)"), add)


def blocked(flags: Column) -> Column:
    """Any flag blocks."""
    return F.exists(flags, lambda x: x["severity"] == "block")


def codes(flags: Column) -> Column:
    return F.array_join(F.transform(flags, lambda x: F.concat(x["code"], F.lit(":"), x["severity"])), ",")
