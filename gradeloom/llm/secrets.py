"""Operator 2: secrets, with weak parts of credentials reported only where complementary parts co-occur.

Base spans (assign, access, hex) are found by pattern alone. Besides, a text has parts that
alone say little: account identifiers and addresses to log in with, unlabelled random strings,
labelled secrets of other names, what misses a base kind's length (short assignments, hex of 16
to 23 places), endpoints and hosts. An interval join links weak parts with complementary ones: it deals both by row
and by stretches of SCOPE code points, and keeps a weak part if some complementary part is
at most SCOPE code points away. Only Spark functions are used. The join reads rows that
hold both a weak and a complementary part; its keys are (row, stretch), and what a stretch
can hold is bounded by its length, so no key is hot and no group grows with the corpus.

What was found in each text is written to the shared folder once; the texts are scanned
once and never shuffled.

Null text: empty, no spans. Repeated rows: a result for each. Extra columns: kept by
``find`` if named. A weak part that overlaps a base span is not reported again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, native

SCOPE = 200

# Fixed patterns of the base kinds; hex and access with their least lengths, which changes no match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A cheap test that goes before a costly pattern.
ASSIGN_LIKELY = r"(?i:passw|secret|token|api_?key)"
BASE_KINDS = ("assign", "access", "hex")

#: Weak parts: kind, role, pattern.
WEAK = (
    ("account", "identifier", r"""(?<![A-Za-z0-9_])(?i:client_?id|access_?key_?id|account_?(?:id|name)|user_?name|login)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._-]{3,128}"""),
    ("shortkey", "identifier", r"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,124}(?![A-Za-z0-9])"),
    ("labelled", "secret", r"""(?<![A-Za-z0-9_])(?i:pwd|passphrase|credential|private_?key|auth_?key|account_?key|(?:aws_?)?(?:secret_?)?access_?key)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6,}+"""),
    ("random", "secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/_=-])"),
    ("shorthex", "secret", r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{16,23}(?![A-Za-z0-9])"),
    ("login", "identifier", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("host", "endpoint", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?+(?![0-9.]?[0-9])"),
    ("endpoint", "endpoint", r"(?<![A-Za-z0-9])(?:https?|ftps?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.@:%_/?&=#~+-]{3,2048}"),
)
#: An assignment whose value is too short for the base kind.
SHORT = "shortassign"
KINDS = (*BASE_KINDS, *(k for k, _, _ in WEAK), SHORT)
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", SHORT: "secret"} | {k: r for k, r, _ in WEAK}
#: What a text must hold for a costly pattern to match.
LIKELY = {"login": "@", "endpoint": "://"}


def extract(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """rid, row (the kept columns), base (spans by pattern, in order) and weak (weak parts outside of them)."""
    t = F.coalesce(F.col(text), F.lit(""))

    def weak_spans(kind: str, pattern: str) -> Column:
        found = native.spans(native.matches(t, pattern), kind, KINDS.index(kind))
        return F.when(F.contains(t, F.lit(LIKELY[kind])), found).otherwise(native.no(native.SPAN)) if kind in LIKELY else found

    rows = df.select(
        F.monotonically_increasing_id().alias("rid"),
        native.packed(keep),
        F.when(t.rlike(ASSIGN_LIKELY), native.matches(t, ASSIGN, 2)).otherwise(native.no(native.MATCH)).alias("assigned"),
        native.spans(native.matches(t, ACCESS), "access", 1).alias("access"),
        native.spans(native.matches(t, HEX), "hex", 2).alias("hex"),
        F.concat(*(weak_spans(k, p) for k, _, p in WEAK)).alias("other"),
    )
    long = F.filter("assigned", lambda m: F.length(m["part"]) >= 6)
    short = F.filter("assigned", lambda m: F.length(m["part"]) < 6)
    both = rows.select(
        "rid", "row",
        native.in_order(F.concat(native.spans(long, "assign", 0), "access", "hex")).alias("base"),
        native.in_order(F.concat("other", native.spans(short, SHORT, KINDS.index(SHORT)))).alias("parts"),
    )
    return both.select("rid", "row", "base", native.apart(F.col("parts"), lambda w: w, F.col("base")).alias("weak"))


def _role(kind):
    out = F.lit(None).cast("string")
    for k, r in ROLE.items():
        out = F.when(kind == k, F.lit(r)).otherwise(out)
    return out


def linked(rows: DataFrame) -> DataFrame:
    """rid, added: the weak parts that have a complementary part in scope. rows: rid, base, weak.

    Identifiers and endpoints go with secrets, secrets with either.
    """
    weak = rows.select("rid", F.explode("weak").alias("w")).select("rid", "w", _role(F.col("w.kind")).alias("role"))
    every = rows.select("rid", F.explode(F.concat("base", "weak")).alias("p")).select("rid", "p", _role(F.col("p.kind")).alias("p_role"))
    # a weak part, which may be long, is dealt to all its stretches; a part to all in which it can be in scope
    weak = weak.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("w.start") / SCOPE), F.floor(F.col("w.end") / SCOPE))))
    every = every.withColumn("stretch", F.explode(F.sequence(F.floor((F.col("p.start") - SCOPE) / SCOPE), F.floor((F.col("p.end") + SCOPE) / SCOPE)))).withColumnRenamed("rid", "p_rid").withColumnRenamed("stretch", "p_stretch")
    near = (F.col("p.start") <= F.col("w.end") + SCOPE) & (F.col("w.start") <= F.col("p.end") + SCOPE)
    completes = (F.col("role") == "secret") != (F.col("p_role") == "secret")
    kept = weak.join(every, (F.col("rid") == F.col("p_rid")) & (F.col("stretch") == F.col("p_stretch")) & near & completes, "left_semi")
    return kept.groupBy("rid").agg(native.in_order(F.collect_set("w")).alias("added"))


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all if none are named; those named base or spans give way), base and spans (base and linked weak parts, in order)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("base", "spans")]
    rows = common.shared_table(extract(df, text, keep), "parts")
    both = (F.size("weak") > 0) & (F.size("base") + F.size("weak") > 1)
    some = rows.where(both)
    joined = some.join(linked(some), "rid", "left")
    found = joined.select(*native.unpacked(keep), "base", native.in_order(F.concat("base", F.coalesce("added", native.no(native.SPAN)))).alias("spans"))
    return found.unionByName(rows.where(~both).select(*native.unpacked(keep), "base", F.col("base").alias("spans")))


def redact(df: DataFrame, text: str = "text", mark: str = "<SECRET>", roles: tuple[str, ...] = ("secret",)) -> DataFrame:
    """df with the base spans of its texts, and linked parts of the roles, replaced by a mark; a null text stays null.

    Identifiers and endpoints that are linked with a secret are no secrets themselves and stay, unless asked for.
    """
    found = find(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("whole"), F.col(text).alias("own_text")), "own_text")
    kept = [F.col(f"whole.`{c}`").alias(c) for c in df.columns if c != text]
    told = [k for k in KINDS if k in BASE_KINDS or ROLE[k] in roles]
    hidden = F.filter("spans", lambda s: s["kind"].isin(told))
    return found.select(*kept, native.redacted(F.col("own_text"), hidden, mark).alias(text)).select(*[f"`{c}`" for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_secrets: counts and digests of every document's spans; n_spans: all, n_linked: those that the join added."""
    found = find(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(native.count(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(native.told(F.col("base")), 256).alias("base_sha256"),
        native.told(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )
