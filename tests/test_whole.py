"""Queries that take every row, against brute force on small tables and on the smallest ones."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from gradeloom.operators import evaluation as E
from gradeloom.operators import ownership as O
from gradeloom.plans import adapters as A
from gradeloom.plans import catalogue


def voted(vectors, k=3):
    out = {}
    for i, _, v in vectors:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j, label) for j, label, w in vectors if j != i)[:k]
        labels = [x[2] for x in near]
        votes = Counter(labels)
        out[i] = min(votes.items(), key=lambda e: (-e[1], labels.index(e[0])))
    return out


def test_every_vector_votes_and_is_voted_on(spark, sf):
    random.seed(5)
    few = [(i, random.randint(0, 3), [random.randint(-2, 2) for _ in range(5)]) for i in range(90)]
    got = {r.id: (r.label, r.votes) for r in E.knn_vote_all(spark.createDataFrame(few, "id long, label int, v array<int>")).collect()}
    assert got == voted(few)
    every = [(r.vec_id, r.label, [math.floor(x * 1000) for x in r.embedding]) for r in A.table(spark, sf, "embeddings").where("embedding IS NOT NULL").collect()]
    got = {r.id: (r.label, r.votes) for r in catalogue.QUERIES["knn_vote_all"](spark, sf).collect()}
    assert got == voted(every) and len(got) == len(every)


def test_votes_of_known_vectors_make_no_row_of_a_pair(spark):
    random.seed(8)
    few = [(i, random.randint(0, 3), [random.choice([0.1, 0.25, 0.7, 1.3]) for _ in range(4)]) for i in range(120)]
    frame = spark.createDataFrame(few, "id long, label int, v array<double>")
    told = E.knn_vote(frame.where("id < 50").select("id", F.col("v").alias("q")), frame.where("id >= 50").select(F.col("id").alias("known_id"), "label", F.col("v").alias("x")))
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i, _, v in few[:50]:
        labels = [x[2] for x in sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j, label) for j, label, w in few[50:])[:3]]
        want[i] = min(Counter(labels).items(), key=lambda e: (-e[1], labels.index(e[0])))
    assert {r.id: (r.label, r.votes) for r in told.collect()} == want


def test_every_roll_is_decoded(spark, sf):
    got = catalogue.QUERIES["roster_decode_all"](spark, sf)
    assert got.count() == A.roster(spark, sf).count()
    random.seed(6)
    rolls = sorted({f"{random.choice(['20', 'MT', 'PHD'])}{random.randint(0, 999):05}" for _ in range(60)})
    reads = [(i, [[random.choice([0.0, 0.05, 0.3, 0.9]) for _ in range(10)] for _ in range(random.choice([5, 7]))]) for i in range(40)]
    want = {}
    for i, probs in reads:
        scores = []
        for roll in rolls:
            digits = roll.removeprefix("PHD").removeprefix("MT")
            if len(digits) == len(probs):
                scores.append((-round(sum(math.log(max(p[int(c)], 1e-6)) for p, c in zip(probs, digits, strict=True)), 6), roll))
        (a, roll), (b, _) = sorted(scores)[:2]
        want[i] = roll, round(math.exp(-a / len(probs)), 5), round(math.exp(-a / len(probs)) - math.exp(-b / len(probs)), 5)
    told = O.decode_against_roster(spark.createDataFrame(reads, "id int, probs array<array<double>>"), spark.createDataFrame([(r,) for r in rolls], "roll_no string"))
    assert {r.id: (r.roll_no, round(r.score, 5), round(r.margin, 5)) for r in told.where(F.col("id").isNotNull()).collect()} == want


def test_reads_and_rolls_that_repeat_are_one(spark):
    def probs(roll):
        return [[0.82 if k == int(c) else 0.02 for k in range(10)] for c in roll]

    rows = ["2000001"] * 3 + ["2000002", "2000011", "2000011"]
    reads = [(i, probs("2000001" if i % 2 else "2000002")) for i in range(50)] + [(99, None)]
    told = O.decode_against_roster(spark.createDataFrame(reads, "id int, probs array<array<double>>"), spark.createDataFrame([(r,) for r in rows], "roll_no string"))
    got = {r.id: (r.roll_no, round(r.score, 9), round(r.margin, 9)) for r in told.collect()}

    def mean(read, roll):
        # as in SQL, a roll's log score counts for each of its rows
        return math.exp(rows.count(roll) * sum(math.log(0.82 if a == b else 0.02) for a, b in zip(read, roll, strict=True)) / 7)

    want = {}
    for i in range(50):
        read = "2000001" if i % 2 else "2000002"
        (a, roll), (b, _) = sorted(((mean(read, r), r) for r in set(rows)), reverse=True)[:2]
        want[i] = roll, round(a, 9), round(a - b, 9)
    assert got == want


def test_every_order_is_a_page(spark, sf):
    orders = A.table(spark, sf, "orders")
    pages = A.on_every_page(A.pages)(spark, sf)
    assert pages.count() == orders.count() > A.pages(spark, sf).count()
    assert pages.select("source_index").exceptAll(orders.select(F.col("o_orderkey") + 1)).count() == 0
    counts = catalogue.QUERIES["claim_counts_all"](spark, sf)
    assert counts.count() == orders.count()
    on_pages = [n for n, sql in catalogue.ORACLE_SQL.items() if A.PAGES_SQL in sql]
    assert len(on_pages) == 40 and all(A.ALL_PAGES_SQL in catalogue.ORACLE_SQL[f"{n}_all"] for n in on_pages)
