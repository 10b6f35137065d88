"""Review commands: a plain loop over holdings, and a stream in one batch and in many."""

import random

import pytest

from gradeloom.operators import commands as C
from gradeloom.plans import q_commands

NAMES = [x.split()[0] for x in C.LOG.split(", ")]


def row(exam, seq, action, **told):
    return tuple({"exam": exam, "seq": seq, "action": action, "note": "seen", "expected": 2, "image": True, "in_roster": True, "replace": False, "allow_missing": False}.get(n, None) if n not in told else told[n] for n in NAMES)


def loop(log):
    """(exam, seq, accepted, displaced) and final holdings (exam, roll, source, slot), for found, assign and hold only."""
    held, loose, out = [], {}, []
    for r in sorted(log, key=lambda r: (r[0], r[1])):
        c = dict(zip(NAMES, r))
        exam, source, roll, slot = c["exam"], c["source"], c["roll"], c["slot"]
        mine = [h for h in held if h[0] == exam]
        if c["action"] == "found":
            if roll:
                held.append((exam, roll, source, slot))
            else:
                loose[exam, source] = slot
            out.append((exam, c["seq"], True, []))
        elif c["action"] == "hold":
            out.append((exam, c["seq"], any(h[1] == roll for h in mine) or (exam, roll) in known, []))
        else:
            there = sorted(h[2] for h in mine if h[1] == roll and h[3] == slot and h[2] != source)
            fine = (any(h[2] == source for h in mine) or (exam, source) in loose) and 1 <= slot <= 2 and (c["replace"] or not there)
            if fine:
                held = [h for h in held if not (h[0] == exam and (h[2] == source or (h[1] == roll and h[3] == slot)))] + [(exam, roll, source, slot)]
                loose |= {(exam, x): slot for x in there}
            out.append((exam, c["seq"], fine, there if fine else []))
        if out[-1][2] and roll:
            known.add((exam, roll))
    return out, sorted(held)


known: set = set()


def test_fold_is_that_of_a_plain_loop(spark):
    known.clear()
    pick, log = random.Random(5), []
    for exam in range(6):
        rolls = [f"20{exam:02d}{i:03d}" for i in range(4)]
        log += [row(exam, i, "found", source=i + 1, roll=rolls[i // 2] if i < 6 else None, slot=i % 2 + 1) for i in range(9)]
        for seq in range(100, 160):
            if pick.random() < 0.1:
                log.append(row(exam, seq, "hold", roll=pick.choice(rolls)))
            else:
                log.append(row(exam, seq, "assign", source=pick.randrange(1, 12), roll=pick.choice(rolls), slot=pick.randrange(1, 4), replace=pick.random() < 0.5))
    done = C.fold_commands(spark.createDataFrame(log, C.LOG).repartition(3, "seq"))
    want, held = loop(log)
    assert sorted((r.exam, r.seq, r.accepted, r.displaced) for r in done.collect()) == want
    students = C.review_state(done).where("kind = 'student' AND pages <> ''").collect()
    assert sorted((r.exam, r.id, int(x.split(":")[1]), int(x.split(":")[0])) for r in students for x in r.pages.split(",")) == held


def test_a_displaced_page_is_unmatched_again_and_refusals_change_nothing(spark):
    log = [
        row(1, 1, "found", source=1, roll="2000001", slot=1), row(1, 2, "found", source=2, roll="2000001", slot=2), row(1, 3, "found", source=3, slot=1),
        row(1, 4, "assign", source=3, roll="2000001", slot=1), row(1, 5, "assign", source=3, roll="2000001", slot=1, replace=True),
        row(1, 6, "approve", candidate="c", roll="2000002", page_one=1, continuation=99, slot=2), row(1, 7, "assign_unmatched", source=1, roll="2000001"), row(1, 8, "nonsense"),
        row(1, 9, "approve", candidate="c", roll="2000002", page_one=1, continuation=2, slot=2), row(1, 10, "approve", candidate="c", roll="2000002", page_one=1, continuation=2, slot=2),
    ]
    done = C.fold_commands(spark.createDataFrame(log, C.LOG)).orderBy("seq").collect()
    assert [r.reason for r in done[3:]] == ["slot_taken", None, "unknown_source", None, "unknown_action", "assigned_elsewhere", "assigned_elsewhere"]
    assert done[4].displaced == [1] and done[4].from_roll is None
    # page 1 of the student is now source 1 again, put there by hand after source 3
    state = {(r.kind, r.id): (r.status, r.pages) for r in C.review_state(spark.createDataFrame(done, C.OUTCOME)).collect()}
    assert state["student", "2000001"] == ("needs_review", "1:1,2:2")
    assert ("student", "2000002") not in state
    assert state["source", "1"] == ("assigned", "2000001:1")
    assert C.fold_commands(spark.createDataFrame([], C.LOG)).collect() == []


@pytest.mark.parametrize("files", [1, 4])
def test_a_stream_gives_what_a_batch_gives(spark, sf, tmp_path, files):
    log = q_commands.review_log(spark, sf).where("exam < 6").orderBy("seq").collect()
    want = {(r.exam, r.seq): r for r in C.fold_commands(spark.createDataFrame(log, C.LOG)).collect()}
    for k in range(files):
        part = log[len(log) * k // files : len(log) * (k + 1) // files]
        spark.createDataFrame(part, C.LOG).coalesce(1).write.parquet(f"{tmp_path}/log/{k}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k in range(files):
            # one folder more each time, from the same checkpoint: state is kept between runs
            stream = spark.readStream.schema(C.LOG).parquet(f"{tmp_path}/log/[0-{k}]")
            C.fold_stream(stream).writeStream.option("checkpointLocation", f"{tmp_path}/marks").outputMode("append").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    assert {(r.exam, r.seq): r for r in spark.read.schema(C.OUTCOME).parquet(f"{tmp_path}/out").collect()} == want
