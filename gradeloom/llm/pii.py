"""Operator 8: personal data, by patterns and by weak supervision. Only Spark functions are used.

Base spans (email, ip, card, phone) are found by pattern and check alone and always stay.
Besides, candidates of looser kinds are found: what matches a base pattern but fails its check
(numbers that fail Luhn, addresses over 255, ...), local phone numbers, social security numbers,
bank account numbers, e-mail addresses written out, and names behind a title. Four labelers
vote on each candidate and each base span, for (+1), against (-1) or not at all (0): a regex
labeler that checks the kind's format, a gazetteer labeler that looks up card issuers, country
codes, name endings, reserved networks and given names, and two context labelers, for the words before the candidate and for the characters
around it. The votes have at most 3 ** 4 patterns; expectation-maximisation over their counts
in the whole corpus estimates how often each labeler votes so for personal data and for
other data, and gives each pattern a probability. With these as soft labels a final
classifier is trained (naive Bayes over kind, shape, length, words around), by grouped sums
over a vocabulary of bounded size; candidates that it finds likelier than not are reported.

The texts are scanned once and not shuffled: base spans and candidates are written to the
shared folder. Only candidates are joined and grouped, by features and by row.

Null text: empty, no spans. Repeated rows: a result for each, and votes for each. No loose
candidates: base spans alone. A candidate that overlaps a base span isn't reported again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, native

# Fixed patterns of the base kinds. A look-behind, or the end of the previous match, keeps
# the search from trying again within a run, which changes no match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Looser kinds: kind, pattern, strict form (of the regex labeler), words before that speak for it.
LOOSE = (
    ("localphone", r"(?<![0-9A-Za-z+.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])", r"\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}", r"phone|tel|call|mobile|cell|fax|anruf|appel|llama"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", r"ssn|social|security"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,38}", r"iban|account|konto|compte|cuenta|bank"),
    ("spelled", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,24}", r"[A-Za-z0-9][A-Za-z0-9._-]*\x20?[\[(]at[\])].*", r"mail|contact|write|kontakt|contacto"),
    ("name", r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?", r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20[A-Z][a-z]+\x20[A-Z][a-z]+", r"dear|name|by|from|with|patient|client"),
)
# Fixed lists of the gazetteer labeler.
COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IL IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK TR"
ENDINGS = "com org net edu gov de fr es it uk us eu info io"
GIVEN = "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Maria Anna Peter Thomas Hans Karl Jean Pierre Marie Sophie Jose Carmen Juan Luis"
AGAINST = r"isbn|version|order|invoice|page|item|part|serial|rev|fig"
#: Issuers' first digits of card numbers, and networks that belong to nobody, also fixed.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6)"
RESERVED = r"^(?:0|10|127|192\.168|22[4-9]|2[3-9][0-9])\."
#: What matches a base pattern but fails its check, by base kind.
MISSED = ("emaillike", "iplike", "cardlike", "phonelike")
#: Words before that speak for a base kind or what misses it.
NEAR = {"email": "mail|contact|write|kontakt|contacto", "ip": "host|server|address|login|client", "card": "card|visa|credit|karte|carte|tarjeta|pay", "phone": "phone|tel|call|mobile|cell|fax|anruf|appel|llama"}
AROUND, VOTERS, ROUNDS = 40, 4, 25
KINDS = (*BASE_KINDS, *(k for k, *_ in LOOSE), *MISSED)
#: A pattern for addresses without a dot behind the @.
BARE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?![A-Za-z0-9.-])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether a string of digits (19 at most) passes: from the right, each second digit is doubled."""
    n = F.length(value)
    return (
        F.aggregate(
            F.sequence(F.lit(1), n),
            F.lit(0),
            lambda total, i: total
            + F.when(F.pmod(i, F.lit(2)) == 1, F.substring(value, n - i + 1, F.lit(1)).cast("int")).otherwise(
                F.pmod(F.substring(value, n - i + 1, F.lit(1)).cast("int") * 2, F.lit(10)) + F.floor(F.substring(value, n - i + 1, F.lit(1)).cast("int") / 5).cast("int")
            ),
        )
        % 10
        == 0
    )


def _checks() -> tuple:
    """For each base kind whether a match of its pattern passes."""
    digits = lambda m: _digits(m["text"])
    return (
        lambda m: F.lit(True),
        lambda m: m["text"].rlike(f"^{BYTE}(?:\\.{BYTE}){{3}}$"),
        lambda m: F.when(F.length(digits(m)).between(14, 19), luhn(digits(m))).otherwise(F.lit(False)),
        lambda m: F.length(digits(m)).between(10, 15),
    )


def _fails(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: ~check(m)


def extract(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """rid, row (the kept columns), base, and candidates (base spans and loose ones outside of them) as
    struct(span, text, before, after, known), known telling base spans."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = native.no(native.MATCH)
    # a cheap look before the pattern where a text must hold a certain character
    having = lambda sign, pattern: F.when(F.contains(t, F.lit(sign)), native.matches(t, pattern)).otherwise(none)
    found = {"email": having("@", EMAIL), "ip": native.matches(t, IP), "card": native.matches(t, CARD), "phone": having("+", PHONE), "bare": having("@", BARE)}
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"), native.packed(keep), F.col(text).alias("own"),
        *(m.alias(f"m_{k}") for k, m in found.items()), *(native.matches(t, p).alias(f"m_{k}") for k, p, *_ in LOOSE),
    )

    def listed(matches: Column, kind: str) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["text"].alias("text")))

    passed, missed = [], []
    for kind, miss, check in zip(BASE_KINDS, MISSED, _checks(), strict=True):
        passed.append(listed(F.filter(f"m_{kind}", check), kind))
        missed.append(listed(F.filter(f"m_{kind}", _fails(check)), miss))
    missed[0] = listed(F.col("m_bare"), "emaillike")
    loose = [listed(F.col(f"m_{k}"), k) for k, *_ in LOOSE]
    told = rows.select("rid", "row", "own", native.in_order(F.concat(*passed)).alias("passed"), native.in_order(F.concat(*loose, *missed)).alias("others"))
    told = told.select("rid", "row", "own", "passed", native.apart(F.col("others"), lambda c: c, F.col("passed")).alias("others"))

    def candidates(matches: str, known: bool) -> Column:
        span = lambda m: F.struct(m["start"].alias("start"), m["ord"].alias("ord"), m["end"].alias("end"), m["kind"].alias("kind"))
        before = lambda m: F.substring("own", F.greatest(F.lit(1), m["start"] + 1 - AROUND), F.least(m["start"], F.lit(AROUND)))
        return F.transform(matches, lambda m: F.struct(span(m).alias("span"), m["text"].alias("text"), before(m).alias("before"), F.substring("own", m["end"] + 1, F.lit(AROUND)).alias("after"), F.lit(known).alias("known")))

    base = F.transform("passed", lambda m: F.struct(m["start"].alias("start"), m["ord"].alias("ord"), m["end"].alias("end"), m["kind"].alias("kind")))
    return told.select("rid", "row", base.alias("base"), F.concat(candidates("passed", True), candidates("others", False)).alias("candidates"))


def _sign(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def voted(rows: DataFrame) -> DataFrame:
    """rid, c (the candidate) and v1 to v4, the labelers' votes."""
    c = rows.select("rid", F.explode("candidates").alias("c"))
    kind, value, before, after = F.col("c.span.kind"), F.col("c.text"), F.lower("c.before"), F.col("c.after")
    # the regex labeler abstains where a looser kind has not its strict form
    strict, near = F.when(F.col("c.known"), 1).when(kind.isin(*MISSED), -1).otherwise(0), F.lit(False)
    for k, _, form, words in LOOSE:
        strict = F.when((kind == k) & value.rlike(f"^(?:{form})$"), 1).otherwise(strict)
        near = F.when(kind == k, before.rlike(words)).otherwise(near)
    for k, miss in zip(BASE_KINDS, MISSED, strict=True):
        near = F.when(kind.isin(k, miss), before.rlike(NEAR[k])).otherwise(near)
    listed = (
        F.when(kind == "iban", F.substring(value, 1, 2).isin(COUNTRIES.split()))
        .when(kind.isin("spelled", "email", "emaillike"), F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1)).isin(ENDINGS.split()))
        .when(kind == "name", F.regexp_extract(value, r"\x20([A-Z][a-z]+)", 1).isin(GIVEN.split()))
        .when(kind.isin("card", "cardlike"), value.rlike(ISSUERS))
        .when(kind.isin("ip", "iplike") & value.rlike(RESERVED), F.lit(False))
    )
    tight = F.col("c.before").rlike(r"[#$%&*=/_\\-]\x20?$") | after.rlike(r"^\x20?[#$%&*=/_\\-]")
    loose = (F.col("c.before") == "") | F.col("c.before").rlike(r"[\s(:,;]$")
    return c.select(
        "rid", "c",
        strict.alias("v1"),
        F.when(listed.isNull(), 0).when(listed, 1).otherwise(-1).alias("v2"),
        _sign(near, before.rlike(AGAINST)).alias("v3"),
        _sign(loose & ~tight, tight).alias("v4"),
    )


def reliabilities(votes: DataFrame) -> DataFrame:
    """v1 to v4 and p: each vote pattern's probability, by expectation-maximisation over all candidates.

    The model is prior and, for each class and labeler, the probabilities of the three votes
    (25 numbers, in one array). It is refined in one expression over at most 81 patterns.
    """
    names = [f"v{i + 1}" for i in range(VOTERS)]
    patterns = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    one = patterns.agg(F.collect_list(F.struct(F.array(*names).alias("v"), "n")).alias("ps")).where(F.size("ps") > 0)

    def likelihood(theta: Column, v: Column, true: int) -> Column:
        out = theta[0] if true else 1 - theta[0]
        for j in range(VOTERS):
            out = out * F.get(theta, F.lit(1 + true * 3 * VOTERS + j * 3 + 1) + F.get(v, F.lit(j)))
        return out

    def posterior(theta: Column, v: Column) -> Column:
        yes, no = likelihood(theta, v, 1), likelihood(theta, v, 0)
        return yes / (yes + no)

    def refine(theta: Column, ps: Column) -> Column:
        soft = F.transform(ps, lambda p: F.struct(p["v"].alias("v"), p["n"].alias("n"), posterior(theta, p["v"]).alias("q")))

        def told(soft: Column) -> Column:
            def mass(true: int, j: int | None, vote: int) -> Column:
                return F.aggregate(
                    soft,
                    F.lit(0.0),
                    lambda a, p: a + p["n"] * (p["q"] if true else 1 - p["q"]) * (F.lit(1.0) if j is None else F.when(F.get(p["v"], F.lit(j)) == vote, 1.0).otherwise(0.0)),
                )

            every = [mass(0, None, 0), mass(1, None, 0)]
            prior = (every[1] + 1) / (every[0] + every[1] + 2)
            rest = [(mass(true, j, vote) + 1) / (every[true] + 3) for true in (0, 1) for j in range(VOTERS) for vote in (-1, 0, 1)]
            return F.array(prior, *rest)

        return F.get(F.transform(F.array(soft), told), F.lit(0))

    start = F.array(*map(F.lit, [0.5, *([0.6, 0.3, 0.1] * VOTERS), *([0.1, 0.3, 0.6] * VOTERS)]))
    fitted = one.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda theta, _: refine(theta, F.col("ps"))).alias("theta"))
    each = fitted.select("theta", F.explode("ps").alias("p"))
    return each.select(*[F.get("p.v", F.lit(i)).alias(n) for i, n in enumerate(names)], posterior(F.col("theta"), F.col("p.v")).alias("p"))


def _features(c: str = "c") -> Column:
    """A candidate's features: strings of bounded number (words are hashed to 64 places)."""
    kind = F.col(f"{c}.span.kind")
    # what misses a base kind is judged by the shapes and words of that kind
    family = kind
    for k, miss in zip(BASE_KINDS, MISSED, strict=True):
        family = F.when(kind == miss, F.lit(k)).otherwise(family)
    word = F.regexp_extract(F.lower(f"{c}.before"), r"([a-zß-ɏ]+)[^a-zß-ɏ]*$", 1)
    return F.array(
        F.concat_ws("|", F.lit("kind"), kind),
        F.concat_ws("|", F.lit("length"), family, F.least(F.length(f"{c}.text"), F.lit(40)).cast("string")),
        F.concat_ws("|", F.lit("first"), family, F.substring(F.regexp_replace(F.regexp_replace(f"{c}.text", "[0-9]", "9"), "[A-Za-z]", "a"), 1, 3)),
        F.concat_ws("|", F.lit("word"), F.when(word == "", F.lit("-")).otherwise(F.pmod(F.xxhash64(word), F.lit(64)).cast("string"))),
        F.concat_ws("|", F.lit("next"), F.substring(F.regexp_replace(F.regexp_replace(F.col(f"{c}.after"), r"[A-Za-z]", "a"), r"[^a\x20,.;:()#$%&*]", "?"), 1, 1)),
    )


def classified(votes: DataFrame) -> DataFrame:
    """rid, span of the candidates, but for base spans, that the final classifier finds likelier than not
    to be personal data. It learns from both."""
    names = [f"v{i + 1}" for i in range(VOTERS)]
    soft = votes.join(reliabilities(votes), names).select("rid", "c", "p")
    features = soft.select("rid", F.col("c.span").alias("span"), F.col("c.known").alias("known"), "p", F.explode(_features()).alias("feature"))
    weights = features.groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    total = F.struct(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    prior = soft.groupBy(F.lit("prior").alias("feature")).agg(total.alias("t")).select("feature", (F.col("t.yes") + 1).alias("yes"), (F.col("t.no") + 1).alias("no"))
    # log odds of a feature against those of the prior
    joined = weights.withColumn("key", F.lit("prior")).join(prior.select(F.col("feature").alias("key"), F.col("yes").alias("all_yes"), F.col("no").alias("all_no")), "key")
    odds = joined.select("feature", F.ln((F.col("yes") + 1) / (F.col("all_yes") + 1) / ((F.col("no") + 1) / (F.col("all_no") + 1))).alias("w"), F.ln(F.col("all_yes") / F.col("all_no")).alias("base"))
    scored = features.where("NOT known").join(odds, "feature").groupBy("rid", "span").agg(F.sum("w").alias("w"), F.first("base").alias("base"))
    return scored.where("w + base > 0").select("rid", "span")


def find(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all if none are named; those named base or spans give way), base and spans (base and classified ones, in order)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("base", "spans")]
    rows = common.shared_table(extract(df, text, keep), "candidates")
    votes = common.shared_table(voted(rows.where(F.size("candidates") > 0)), "votes")
    added = classified(votes).groupBy("rid").agg(F.collect_list("span").alias("added"))
    several = F.size("candidates") > F.size("base")
    found = rows.where(several).join(added, "rid", "left").select(*native.unpacked(keep), "base", native.in_order(F.concat("base", F.coalesce("added", native.no(native.SPAN)))).alias("spans"))
    return found.unionByName(rows.where(~several).select(*native.unpacked(keep), "base", F.col("base").alias("spans")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8_pii: counts and digests of every document's spans; n_spans: all, n_added: those that the classifier added."""
    found = find(common.table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *(native.count(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(native.told(F.col("base")), 256).alias("base_sha256"),
        native.told(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
