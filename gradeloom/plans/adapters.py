"""Domain relations derived from the driver's tables, and the same derivations as SQL.

Derivations are integer and string expressions, so both engines agree to the bit.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Whether pages() gives a page for every order.
_EVERY: ContextVar[bool] = ContextVar("every", default=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(x: Column) -> Column:
    return F.lpad((x % 100000).cast("string"), 5, "0")


def roll_of(key: Column) -> Column:
    return F.when(key % 10 < 7, F.concat(F.lit("20"), _padded(key))).when(key % 10 < 9, F.concat(F.lit("MT"), _padded(key))).otherwise(F.concat(F.lit("PHD"), _padded(key)))


def program_of(key: Column) -> Column:
    return F.when(key % 10 < 7, "BTECH").when(key % 10 < 9, "MTECH").otherwise("PHD")


ROLL_SQL = "CASE WHEN {k} % 10 < 7 THEN '20' WHEN {k} % 10 < 9 THEN 'MT' ELSE 'PHD' END || lpad(CAST({k} % 100000 AS VARCHAR), 5, '0')"
PROGRAM_SQL = "CASE WHEN {k} % 10 < 7 THEN 'BTECH' WHEN {k} % 10 < 9 THEN 'MTECH' ELSE 'PHD' END"


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("student_key"), roll_of(k).alias("roll_no"), program_of(k).alias("program"), F.col("c_name").alias("name"), F.concat(F.lower(F.translate("c_name", "#", "")), F.lit("@example.edu")).alias("email"), F.col("c_nationkey").alias("centre"), F.col("c_mktsegment").alias("segment"))


ROSTER_SQL = f"""roster AS (SELECT c_custkey AS student_key, {ROLL_SQL.format(k="c_custkey")} AS roll_no, {PROGRAM_SQL.format(k="c_custkey")} AS program,
 c_name AS name, lower(replace(c_name, '#', '')) || '@example.edu' AS email, c_nationkey AS centre, c_mktsegment AS segment FROM customer)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claimed pages: the first three orders of a customer, and each order whose key is divisible by 7 as a duplicate.

    In a query of on_every_page all other orders are duplicates too.
    """
    o = table(spark, sf_dir, "orders")
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    k = F.col("o_orderkey")
    slot = F.when(F.col("rn") <= 3, F.col("rn")).otherwise(k % 3 + 1)
    return (
        o.withColumn("rn", rn)
        .where("TRUE" if _EVERY.get() else "rn <= 3 OR o_orderkey % 7 = 0")
        .select(
            (k + 1).alias("source_index"),
            slot.cast("int").alias("sheet_page"),
            F.col("o_custkey").alias("student_key"),
            roll_of(F.col("o_custkey")).alias("cell_roll"),
            program_of(F.col("o_custkey")).alias("cell_program"),
            ((F.floor("o_totalprice").cast("long") % 100) / 100.0).alias("cell_min"),
            F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 13 == 0, "2099999").otherwise(roll_of(F.col("o_custkey"))).alias("bubble_roll"),
            F.when(k % 5 == 0, "low").when(k % 5 == 1, "medium").otherwise("high").alias("bubble_confidence"),
            F.when(k % 17 == 0, "blank").when(k % 19 == 0, "ambiguous").otherwise("clear").alias("selector_state"),
            F.when(k % 23 == 0, "needs_review").otherwise("ready").alias("quality"),
            F.col("o_orderstatus").alias("state"),
        )
    )


PAGES_SQL = f"""pages AS (SELECT o_orderkey + 1 AS source_index, CAST(CASE WHEN rn <= 3 THEN rn ELSE o_orderkey % 3 + 1 END AS INTEGER) AS sheet_page, o_custkey AS student_key,
 {ROLL_SQL.format(k="o_custkey")} AS cell_roll, {PROGRAM_SQL.format(k="o_custkey")} AS cell_program, (CAST(floor(o_totalprice) AS BIGINT) % 100) / 100.0::DOUBLE AS cell_min,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN '2099999' ELSE {ROLL_SQL.format(k="o_custkey")} END AS bubble_roll,
 CASE WHEN o_orderkey % 5 = 0 THEN 'low' WHEN o_orderkey % 5 = 1 THEN 'medium' ELSE 'high' END AS bubble_confidence,
 CASE WHEN o_orderkey % 17 = 0 THEN 'blank' WHEN o_orderkey % 19 = 0 THEN 'ambiguous' ELSE 'clear' END AS selector_state,
 CASE WHEN o_orderkey % 23 = 0 THEN 'needs_review' ELSE 'ready' END AS quality, o_orderstatus AS state
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3 OR o_orderkey % 7 = 0)"""

#: The same for every order.
ALL_PAGES_SQL = PAGES_SQL.removesuffix(" WHERE rn <= 3 OR o_orderkey % 7 = 0)") + ")"


def on_every_page(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query with a page for every order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        token = _EVERY.set(True)
        try:
            return query(spark, sf_dir)
        finally:
            _EVERY.reset(token)

    return run


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer for each sheet and question: the first line item in full order."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    one = li.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    p, q = F.col("l_partkey"), F.col("l_quantity").cast("long")
    return one.select(
        F.col("l_orderkey").alias("sheet"),
        F.col("l_linenumber").alias("q_no"),
        F.when(q % 9 == 0, F.lit(None).cast("string")).otherwise(F.substring(F.lit("ABCD"), (p % 4 + 1).cast("int"), F.lit(1))).alias("selected"),
        F.when(q % 9 == 0, "blank").when(q % 10 == 0, "multiple").otherwise("answered").alias("outcome"),
        F.when(q % 9 == 0, "high").when(q % 10 == 0, "low").when(q % 4 == 0, "medium").otherwise("high").alias("confidence"),
        (F.col("l_suppkey") % 100).cast("int").alias("value"),
        p.alias("part"),
        F.col("l_suppkey").alias("supp"),
        q.alias("quantity"),
    )


RESPONSES_SQL = """responses AS (SELECT l_orderkey AS sheet, l_linenumber AS q_no,
 CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN NULL ELSE substr('ABCD', CAST(l_partkey % 4 + 1 AS INTEGER), 1) END AS selected,
 CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN 'blank' WHEN CAST(l_quantity AS BIGINT) % 10 = 0 THEN 'multiple' ELSE 'answered' END AS outcome,
 CASE WHEN CAST(l_quantity AS BIGINT) % 9 = 0 THEN 'high' WHEN CAST(l_quantity AS BIGINT) % 10 = 0 THEN 'low' WHEN CAST(l_quantity AS BIGINT) % 4 = 0 THEN 'medium' ELSE 'high' END AS confidence,
 CAST(l_suppkey % 100 AS INTEGER) AS value, l_partkey AS part, l_suppkey AS supp, CAST(l_quantity AS BIGINT) AS quantity
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn FROM lineitem) WHERE rn = 1)"""

#: The answer key: question, answer (or alternatives), marks; question 4 is dropped, question 7 has no key.
KEY = [(1, "A", 2.0), (2, "B", 1.0), (3, "C", 1.0), (4, "D", 0.0), (5, "A", 2.0), (6, "12|34,56", 1.0)]


def answer_key(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEY, "q_no int, answer string, marks double")


KEY_SQL = "answer_key(q_no, answer, marks) AS (VALUES " + ", ".join(f"({q}, '{a}', {m}::DOUBLE)" for q, a, m in KEY) + ")"


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill, ink and enhanced fill of four options for each response, in hundredths."""
    r = responses(spark, sf_dir)
    k = F.col("part") * 7 + F.col("supp") * 13 + F.col("i") * 29
    level = F.when((F.col("part") + F.col("i")) % 4 == 0, 50 + k % 50).otherwise(k % 31)
    return (
        r.select("sheet", "q_no", "part", "supp", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
        .select(
            "sheet", "q_no",
            F.substring(F.lit("ABCD"), F.col("i") + 1, F.lit(1)).alias("option"),
            (F.when(F.col("supp") % 3 == 0, k % 40).otherwise(level) / 100.0).alias("fill"),
            ((k * 3) % 45 / 100.0).alias("ink"),
            ((k * 5) % 90 / 100.0).alias("enhanced"),
        )
    )


BUBBLES_SQL = """bubbles AS (SELECT sheet, q_no, substr('ABCD', i + 1, 1) AS option,
 (CASE WHEN supp % 3 = 0 THEN k % 40 WHEN (part + i) % 4 = 0 THEN 50 + k % 50 ELSE k % 31 END) / 100.0::DOUBLE AS fill, ((k * 3) % 45) / 100.0::DOUBLE AS ink, ((k * 5) % 90) / 100.0::DOUBLE AS enhanced
 FROM (SELECT sheet, q_no, part, supp, CAST(i AS INTEGER) AS i, part * 7 + supp * 13 + i * 29 AS k FROM responses, range(4) t(i)))"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log: a student (user), an action by event type, a sequence by time and id."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "click", "verify").when(F.col("event_type") == "view", "hold").when(F.col("event_type") == "purchase", "assign_source").when(F.col("event_type") == "signup", "approve").otherwise("reject")
    n = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("entity"), action.alias("action"), F.col("ts"), F.col("event_id").alias("seq"), F.coalesce(n, F.lit(0)).alias("n"), (F.coalesce(n, F.lit(0)) % 3 + 1).alias("slot"))


DECISIONS_SQL = """decisions AS (SELECT user_id AS entity, CASE event_type WHEN 'click' THEN 'verify' WHEN 'view' THEN 'hold' WHEN 'purchase' THEN 'assign_source' WHEN 'signup' THEN 'approve' ELSE 'reject' END AS action,
 ts, event_id AS seq, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS n, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) % 3 + 1 AS slot FROM events)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digit predictions: eleven scores of each vector (four members by component block), label and writer."""
    e = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    member = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("member")
    scores = F.slice("embedding", F.col("member") * 11 + 1, F.lit(11))
    return e.select("vec_id", "label", "embedding", member).select(
        F.col("vec_id").alias("crop"), (F.col("label") % 11).cast("int").alias("expected"), "member", scores.alias("scores"),
        (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("predicted"),
        (F.col("vec_id") % 37).cast("int").alias("writer"), (F.col("vec_id") % 97 / 97.0).alias("confidence"), (F.col("vec_id") % 20 / 100.0).alias("margin"),
    )


PREDICTIONS_SQL = """predictions AS (SELECT vec_id AS crop, CAST(label % 11 AS INTEGER) AS expected, CAST(m AS INTEGER) AS member, s AS scores, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS predicted,
 CAST(vec_id % 37 AS INTEGER) AS writer, (vec_id % 97) / 97.0::DOUBLE AS confidence, (vec_id % 20) / 100.0::DOUBLE AS margin
 FROM (SELECT vec_id, label, m, embedding[m * 11 + 1 : m * 11 + 11] AS s FROM embeddings, range(4) t(m) WHERE embedding IS NOT NULL))"""

ALL = {"roster": ROSTER_SQL, "pages": PAGES_SQL, "responses": RESPONSES_SQL, "answer_key": KEY_SQL, "bubbles": BUBBLES_SQL, "decisions": DECISIONS_SQL, "predictions": PREDICTIONS_SQL}
NEEDS = {"bubbles": ("responses",)}


def sql(relations: str, body: str) -> str:
    """SQL over the named relations (separated by spaces). A body may begin with further relations: ', x AS (...) SELECT'."""
    names: list[str] = []
    for r in relations.split():
        names += [n for n in (*NEEDS.get(r, ()), r) if n not in names]
    body = body.strip()
    if not names:
        return body
    return "WITH " + ",\n".join(ALL[n] for n in names) + (body if body.startswith(",") else "\n" + body)
