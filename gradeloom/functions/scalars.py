"""Column functions for names, rolls, programs, flags, numbers and text quality (P and C families).

All but the counts of text quality are compositions of Spark's own functions, so they stay in whole-stage code generation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the domain: programs by alias, roll formats, characters that readers confuse.
PROGRAM_ALIASES = {
    "BTECH": "BTECH", "BTECHNOLOGY": "BTECH", "MTECH": "MTECH", "MT": "MTECH", "MTECHNOLOGY": "MTECH", "PHD": "PHD", "DOCTOROFPHILOSOPHY": "PHD", "SP": "SP",
}
ROLL_FORMATS = {"BTECH": r"^\d{7}$", "MTECH": r"^MT\d{5}$", "PHD": r"^PHD\d{5}$"}
CONFUSED, MEANT = "OQILSZGB", "00115268"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def strip(x: Column) -> Column:
    """White space of any kind off both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def header_key(x: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def first_filled(*columns: Column) -> Column:
    """The first of several alias columns that isn't blank."""
    return F.coalesce(*(F.when(strip(c) != "", strip(c)) for c in columns), F.lit(""))


def _program_key(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]+", "")


def normalize_roll(roll: Column, program: Column) -> Column:
    """Upper case without white space; bare digits get their program's prefix."""
    r, key = F.regexp_replace(F.upper(roll), r"\s+", ""), _program_key(program)
    bare = r.rlike(r"^\d+$")
    return (
        F.when(r == "", r)
        .when(key.isin("MTECH", "MT") & bare, F.concat(F.lit("MT"), r))
        .when((key == "PHD") & bare, F.concat(F.lit("PHD"), r))
        .when(key.startswith("SP") & ~r.startswith("SP"), F.concat(F.lit("SP"), r))
        .otherwise(r)
    )


def infer_program(value: Column, roll: Column, context: Column) -> Column:
    """Alias, else the roll's form, else a program's name anywhere in the row, else ''."""
    key, r, c = _program_key(value), F.regexp_replace(F.upper(roll), r"\s+", ""), _program_key(context)
    by_alias = F.lit(None).cast("string")
    for alias, program in PROGRAM_ALIASES.items():
        by_alias = F.when(key == alias, F.lit(program)).otherwise(by_alias)
    by_roll = F.when(r.rlike(r"^PHD\d+$"), "PHD").when(r.rlike(r"^MT\d+$"), "MTECH").when(r.rlike("^SP[A-Z0-9]+$"), "SP").when(r.rlike(r"^\d{7}$"), "BTECH")
    by_row = F.when(c.contains("PHD"), "PHD").when(c.contains("MTECH"), "MTECH").when(c.contains("BTECH"), "BTECH")
    return F.coalesce(by_alias, by_roll, by_row, F.lit(""))


def email_of(cells: list[Column]) -> Column:
    """The one cell that looks like an address; null if none or several do."""
    shaped = F.filter(F.array(*(strip(c) for c in cells)), lambda x: x.rlike(EMAIL))
    return F.when(F.size(shaped) == 1, F.get(shaped, F.lit(0)))


def valid_roll(roll: Column, program: Column) -> Column:
    """P5: the roll has its program's full form."""
    out = F.lit(False)
    for name, form in ROLL_FORMATS.items():
        out = F.when(program == name, roll.rlike(form)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def ocr_roll(text: Column, program: Column) -> Column:
    """A roll from read text: characters often confused with digits become these."""
    plain = F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "")
    digits = F.translate(F.regexp_replace(plain, "^(PHD|MT|SP)", ""), CONFUSED, MEANT)
    size = F.when(program == "BTECH", 7).otherwise(5)
    prefix = F.when(program == "MTECH", "MT").when(program == "PHD", "PHD").otherwise("")
    run = F.regexp_extract(digits, r"(?<!\d)(\d{5,7})(?!\d)", 1)
    return F.when(plain.startswith("SP"), F.concat(F.lit("SP"), F.regexp_extract(digits, r"(\d+)", 1))).when(F.length(run) == size, F.concat(prefix, run))


def roll_labels(roll: Column, program: Column) -> Column:
    """A roll's digits one by one; null if prefix or length are not the program's."""
    digits = F.regexp_replace(roll, "^(PHD|MT)", "")
    return F.when(valid_roll(roll, program), F.split(digits, "(?!^)(?!$)"))


def selector_state(fills: Column, inks: Column) -> Column:
    """Unavailable, clear, ambiguous or blank by how many selector bubbles are filled or inked."""
    filled = F.size(F.filter(fills, lambda x: x >= 0.5))
    doubt = F.exists(fills, lambda x: x >= 0.28) | F.exists(inks, lambda x: x >= 0.24)
    return F.when(F.coalesce(F.size(fills), F.lit(0)) <= 0, "unavailable").when(filled == 1, "clear").when(filled > 1, "ambiguous").when(doubt, "ambiguous").otherwise("blank")


def number_or(x: Column, default: float = 0.0) -> Column:
    """The number that a text is, or a default."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def number_text(x: Column) -> Column:
    """P10: whole numbers without a point, others in two places without trailing zeros."""
    whole = F.floor(x) == x
    return F.when(x.isNull(), "").when(whole, x.cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.2f", x), r"0+$", ""))


def parse_bool(x: Column) -> Column:
    """True, false, or null for what is neither."""
    v = F.lower(strip(x))
    return F.when(v.isin("1", "true", "yes", "y", "review", "needs_review"), True).when(v.isin("", "0", "false", "no", "n"), False)


def join_flags(flags: Column, separator: str = " | ") -> Column:
    """Flags in one cell, line ends as spaces."""
    return F.array_join(F.transform(flags, lambda x: F.regexp_replace(x, r"[\r\n]", " ")), separator)


def safe_id(x: Column) -> Column:
    """What a file name may hold; other runs become _ and ends lose _ and dots."""
    return F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9_.-]+", "_"), r"^[_.]+|[_.]+$", "")


def count_of(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


#: By byte of UTF-8: whether it is a letter or digit, and whether it begins a character that is no white space.
_PLAIN = np.array([chr(i).isascii() and chr(i).isalnum() for i in range(256)])
_SHOWN = np.array([i & 0xC0 != 0x80 and i not in b"\t\n\x0b\f\r " for i in range(256)])
_RUNS = r"[_=\-]{3,}|[^0-9A-Za-z_\t\n\x0b\f\r ]{4,}"


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("shown", "plain", "runs")]))
def _counts(text: pa.Array) -> pa.Array:
    """How many characters are no white space and how many are letters or digits, and the noise runs, looking at each text once."""
    text = text.cast(pa.large_string())
    at, data = (np.frombuffer(b, dtype=t) if b else np.zeros(1, t) for b, t in zip(text.buffers()[1:], (np.int64, np.uint8), strict=True))
    rows = [data[a:b] for a, b in zip(at[text.offset : text.offset + len(text)], at[text.offset + 1 : text.offset + len(text) + 1], strict=True)]
    null = text.is_null().to_numpy(zero_copy_only=False)
    shown, plain = (pa.array([np.count_nonzero(table[r]) for r in rows], pa.int64(), mask=null) for table in (_SHOWN, _PLAIN))
    return pa.StructArray.from_arrays([shown, plain, pc.count_substring_regex(text, _RUNS).cast(pa.int64())], ["shown", "plain", "runs"])


def text_quality(text: Column) -> Column:
    """.20 + .48 alphanumeric share + .22 length up to 14 - .35 symbol share - noise runs, in 0 to 1."""
    told = _counts(text)
    shown, plain, runs = (told[x] for x in ("shown", "plain", "runs"))
    n = F.greatest(shown, F.lit(1))
    alnum, symbol = plain / n, (shown - plain) / n
    score = 0.20 + 0.48 * alnum + 0.22 * F.least(F.lit(1.0), shown / 14.0) - 0.35 * symbol - F.least(F.lit(0.30), 0.12 * runs)
    return F.when(shown == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def dominant_count(text: Column) -> Column:
    """How often the most frequent letter or digit of a text occurs: the longest run of its sorted characters."""
    t = F.array_join(F.array_sort(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", ""), "")), "")
    return F.array_max(F.transform(F.regexp_extract_all(t, F.lit(r"(.)\1*"), F.lit(0)), F.length))


def noise_line(text: Column) -> Column:
    """A character repeated 11 times, or one that dominates, or mostly symbols."""
    t = F.regexp_replace(text, r"\s+", "")
    n, alnum = F.length(t), F.length(F.regexp_replace(text, "[^A-Za-z0-9]+", ""))
    top = F.coalesce(dominant_count(t), F.lit(0))
    share = top / F.greatest(alnum, F.lit(1))
    symbols = (n - alnum) / F.greatest(n, F.lit(1))
    return t.rlike(r"(.)\1{10,}") | ((n >= 24) & (share >= 0.70)) | ((alnum >= 5) & (share >= 0.85) & (symbols >= 0.25)) | ((n >= 18) & (symbols >= 0.55))


def candidate_id(*parts: Column) -> Column:
    """The first 20 hex digits of the SHA-256 of the parts joined by |."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20)


def clamp(x: Column) -> Column:
    """Into 0 to 1; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def ratio(a: Column, b: Column) -> Column:
    """Null for a zero denominator."""
    return F.when(b != 0, a / b)


def to_px(mm: Column, dpi: float) -> Column:
    """Millimetres to pixels, halves to even."""
    return F.bround(mm * F.lit(dpi) / F.lit(25.4)).cast("long")
