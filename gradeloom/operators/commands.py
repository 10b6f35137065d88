"""Review commands folded into the state of an exam (T1): who holds which page, and what is refused.

A log has the pages that were found and the commands on them, in order of seq. Commands of one
exam depend on each other (a page that goes to one student leaves all others, and may push out a
page that goes back to the unmatched ones), so no window can express them: a machine
replays an exam's log. ``fold_commands`` reads a log sorted by exam and seq in each partition, one
command at a time; ``fold_stream`` keeps the same machine's state by exam in a state store and
takes the log as it comes. A command is accepted whole or refused with a reason and without effect.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a log holds. found: source, slot, image, roll (null: unmatched). decide_*: candidate, roll, page_one, continuation, slot.
LOG = (
    "exam long, seq long, action string, source long, roll string, slot int, replace boolean, note string, image boolean, "
    "candidate string, page_one long, continuation long, assigned string, allow_missing boolean, in_roster boolean, expected int"
)
OUTCOME = "exam long, seq long, action string, accepted boolean, reason string, from_roll string, displaced array<long>, changes array<struct<kind:string,id:string,status:string,pages:string>>"
ROLL = re.compile(r"[0-9]{7}|MT[0-9]{5}|PHD[0-9]{5}")
#: Actions on a suggestion, and which of its two pages each moves.
DECISIONS = {"approve": (True, True), "approve_page1": (True, False), "approve_page2": (False, True), "assign_suggestion": (True, True), "reject_suggestion": (False, False)}


class Refused(Exception):
    """A command that breaks a rule; its text is the reason."""


class Review:
    """One exam's students, sources and decided suggestions, in three stores with get(id) and put(id, record).

    A student has a status and pages (source, slot) as parsed and as put there by hand; a hand's
    page stands before a parsed one of its slot. A source has the slot of its page, whether there is an
    image, who holds it, and, if it was ever unmatched, a status (needs_review, assigned, ignored) with
    the roll and slot it went to.
    """

    def __init__(self, students, sources, decided):
        self.stores = {"student": students, "source": sources, "decided": decided}
        self.draft: dict[tuple[str, str], dict] = {}

    def apply(self, c: Row) -> tuple:
        """The outcome of a command, as of OUTCOME."""
        self.draft = {}
        self.expected = c["expected"] or 0
        self.from_roll, self.displaced = None, []
        try:
            self._do(c)
        except Refused as e:
            return (c["exam"], c["seq"], c["action"], False, str(e), None, [], [])
        changes = []
        for (kind, name), record in sorted(self.draft.items()):
            if kind == "student":
                self._refresh(record)
            self.stores[kind].put(name, record)
            if kind == "student":
                changes.append((kind, name, record["status"], ",".join(f"{slot}:{source}" for slot, source in sorted(self._selected(record).items()))))
            elif kind == "source":
                changes.append((kind, name, record["status"] or "held", f"{record['roll']}:{record['page']}" if record["roll"] else ""))
        return (c["exam"], c["seq"], c["action"], True, None, self.from_roll, sorted(self.displaced), changes)

    # records

    def _get(self, kind: str, name: object) -> dict | None:
        """A copy that is written back if the command is accepted."""
        key = (kind, str(name))
        if key not in self.draft:
            found = self.stores[kind].get(str(name))
            if found is None:
                return None
            self.draft[key] = json.loads(json.dumps(found))
        return self.draft[key]

    def _student(self, roll: str | None, make: bool = False) -> dict:
        found = self._get("student", roll)
        if found is None and make:
            found = self.draft["student", roll] = {"status": "needs_review", "parsed": [], "manual": []}
        if found is None:
            raise Refused("unknown_student")
        return found

    @staticmethod
    def _selected(student: dict) -> dict[int, int]:
        return {slot: source for source, slot in [*student["parsed"], *student["manual"]]}

    def _missing(self, student: dict) -> bool:
        return not set(range(1, self.expected + 1)) <= set(self._selected(student))

    def _refresh(self, student: dict) -> None:
        if self._missing(student) and student["status"] not in ("verified", "rejected"):
            student["status"] = "missing_pages"

    def _owner(self, source: int | None) -> tuple[dict, str | None, int | None]:
        """A source, the first student that holds it, and its page's slot."""
        found = self._get("source", source) if source is not None else None
        if found is None:
            raise Refused("unknown_source")
        if not found["holders"]:
            return found, None, found["slot"]
        roll = min(found["holders"])
        held = self._student(roll)
        return found, roll, next(slot for x, slot in [*held["manual"], *held["parsed"]] if x == source)

    def _holds(self, source: int, roll: str) -> None:
        """Sets whether the roll is among the source's holders."""
        found, student = self._get("source", source), self._student(roll)
        holders = set(found["holders"]) - {roll}
        if any(x == source for x, _ in [*student["parsed"], *student["manual"]]):
            holders.add(roll)
        found["holders"] = sorted(holders)

    def _known(self, c: Row, roll: str) -> bool:
        """In the roster, or a student already; without a roster (null) every roll is."""
        return c["in_roster"] is not False or self._get("student", roll) is not None

    # commands

    def _do(self, c: Row) -> None:
        action = c["action"]
        if action in DECISIONS:
            self._decide(c, *DECISIONS[action])
        else:
            do = getattr(self, f"_on_{action}", None)
            if do is None:
                raise Refused("unknown_action")
            do(c)

    def _on_found(self, c: Row) -> None:
        if self._get("source", c["source"]) is not None:
            raise Refused("source_known")
        self.draft["source", str(c["source"])] = {"slot": c["slot"], "image": c["image"] is not False, "status": None if c["roll"] else "needs_review", "roll": None, "page": None, "holders": []}
        if c["roll"]:
            new = self._get("student", c["roll"]) is None
            student = self._student(c["roll"], make=True)
            student["parsed"].append([c["source"], c["slot"]])
            if new or student["status"] == "missing_pages":
                student["status"] = "auto_matched"
            self._holds(c["source"], c["roll"])

    def _on_verify(self, c: Row) -> None:
        student = self._student(c["roll"])
        if self._missing(student) and not c["allow_missing"]:
            raise Refused("missing_pages")
        student["status"] = "verified"

    def _on_reject(self, c: Row) -> None:
        self._student(c["roll"])["status"] = "rejected"

    def _on_hold(self, c: Row) -> None:
        self._student(c["roll"])["status"] = "needs_review"

    def _on_ignore(self, c: Row) -> None:
        self._unmatched(c["source"])["status"] = "ignored"

    def _unmatched(self, source: int | None) -> dict:
        found = self._get("source", source) if source is not None else None
        if found is None or found["status"] is None:
            raise Refused("unknown_source")
        return found

    def _on_assign_unmatched(self, c: Row) -> None:
        """A page that no parser could match goes to a student as the page it is; other holders keep it."""
        student = self._student(c["roll"])
        found = self._unmatched(c["source"])
        if found["status"] == "ignored":
            raise Refused("ignored_source")
        slot = c["slot"] or found["slot"] or 0
        if slot <= 0:
            raise Refused("no_slot")
        if slot != found["slot"]:
            raise Refused("no_such_page")
        student["manual"] = [x for x in student["manual"] if x[0] != c["source"]] + [[c["source"], slot]]
        student["status"] = "needs_review"
        found.update(status="assigned", roll=c["roll"], page=slot)
        self._holds(c["source"], c["roll"])

    def _detach(self, source: int, roll: str) -> None:
        """No student but this one holds the source any more."""
        for other in [x for x in self._get("source", source)["holders"] if x != roll]:
            student = self._student(other)
            for kind in ("parsed", "manual"):
                student[kind] = [x for x in student[kind] if x[0] != source]
            student["status"] = "needs_review"
            self._refresh(student)
            self._holds(source, other)

    def _on_assign(self, c: Row) -> None:
        """A page goes to (roll, slot); what is there already is pushed out only by a replacement that says so."""
        source, roll = c["source"], c["roll"]
        if not (c["note"] or "").strip():
            raise Refused("no_note")
        if not roll or not ROLL.fullmatch(roll):
            raise Refused("bad_roll")
        if not self._known(c, roll):
            raise Refused("not_in_roster")
        found, owner, own_slot = self._owner(source)
        slot = c["slot"] or own_slot or 0
        if not 1 <= slot <= self.expected:
            raise Refused("bad_slot")
        if not found["image"]:
            raise Refused("no_image")
        target = self._get("student", roll)
        there = [] if target is None else sorted({x for x, s in [*target["parsed"], *target["manual"]] if s == slot and x != source})
        if there and not c["replace"]:
            raise Refused("slot_taken")
        target = self._student(roll, make=True)
        self.from_roll, self.displaced = owner, there
        self._detach(source, roll)
        for kind in ("parsed", "manual"):
            target[kind] = [x for x in target[kind] if x[0] != source and x[1] != slot]
        target["manual"].append([source, slot])
        target["status"] = "needs_review"
        for x in there:
            self._get("source", x).update(status="needs_review", roll=None, page=None, slot=slot)
            self._holds(x, roll)
        if found["status"] is not None:
            found.update(status="assigned", roll=roll, page=slot)
        self._holds(source, roll)

    def _decide(self, c: Row, first: bool, second: bool) -> None:
        """A suggestion is decided once; but for a rejection its pages go to the roll, or none does."""
        if not (c["note"] or "").strip():
            raise Refused("no_note")
        if self.stores["decided"].get(str(c["candidate"])) is not None:
            raise Refused("suggestion_decided")
        self.draft["decided", str(c["candidate"])] = {"action": c["action"]}
        if c["action"] == "reject_suggestion":
            return
        roll = (c["assigned"] if c["action"] == "assign_suggestion" else c["roll"]) or ""
        if not roll:
            raise Refused("no_roll")
        if not self._known(c, roll):
            raise Refused("not_in_roster")
        moves = ({c["page_one"]: 1} if first else {}) | ({c["continuation"]: c["slot"]} if second else {})
        target = self._student(roll, make=True)
        for source, slot in moves.items():
            if not source or source <= 0 or not slot or slot <= 0:
                raise Refused("invalid_source")
            found, owner, _ = self._owner(source)
            if owner == roll:
                continue
            if found["status"] == "assigned" and found["roll"] not in (None, roll):
                raise Refused("assigned_elsewhere")
            self._detach(source, roll)
            out = [x for x in target["manual"] if x[0] == source or x[1] == slot]
            target["manual"] = [x for x in target["manual"] if x not in out] + [[source, slot]]
            if found["status"] is not None:
                found.update(status="assigned", roll=roll, page=slot)
            for x, _ in [*out, [source, slot]]:
                self._holds(x, roll)
        target["status"] = "needs_review"


class Kept(dict):
    """A store in memory."""

    def put(self, name: str, record: dict) -> None:
        self[name] = record


class Stored:
    """A store in a map state, records as JSON."""

    def __init__(self, state):
        self.state = state

    def get(self, name: str) -> dict | None:
        found = self.state.getValue((name,))
        return json.loads(found[0]) if found else None

    def put(self, name: str, record: dict) -> None:
        self.state.updateValue((name,), (json.dumps(record),))


def fold_commands(log: DataFrame) -> DataFrame:
    """Each row of the log (LOG) with accepted, reason, the page's former holder, displaced sources and changes.

    One shuffle by exam; a partition's exams are replayed one after the other, a command at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exam, review, schema = None, None, None
        for rows in batches:
            out = []
            for c in rows.to_pylist():
                if review is None or c["exam"] != exam:
                    exam, review = c["exam"], Review(Kept(), Kept(), Kept())
                out.append(review.apply(c))
            if out:
                schema = schema or outcome_schema()
                yield pa.RecordBatch.from_pylist([_named(x) for x in out], schema=schema)

    columns = [x.split()[0] for x in LOG.split(", ")]
    return log.select(*columns).repartition("exam").sortWithinPartitions("exam", "seq").mapInArrow(run, OUTCOME)


def _named(x: tuple) -> dict:
    names = ("exam", "seq", "action", "accepted", "reason", "from_roll", "displaced", "changes")
    return dict(zip(names, x, strict=True)) | {"changes": [dict(zip(("kind", "id", "status", "pages"), y, strict=True)) for y in x[7]]}


def outcome_schema() -> pa.Schema:
    change = pa.struct([(n, pa.string()) for n in ("kind", "id", "status", "pages")])
    return pa.schema([("exam", pa.int64()), ("seq", pa.int64()), ("action", pa.string()), ("accepted", pa.bool_()), ("reason", pa.string()), ("from_roll", pa.string()), ("displaced", pa.list_(pa.int64())), ("changes", pa.list_(change))])


class Reviewer(StatefulProcessor):
    """The machine's stores as map states of a stream, by exam."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.review = Review(*(Stored(handle.getMapState(n, "id string", "record string")) for n in ("students", "sources", "decided")))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for c in sorted(rows, key=lambda c: c["seq"]):
            x = _named(self.review.apply(c))
            yield Row(**(x | {"changes": [Row(**y) for y in x["changes"]]}))

    def close(self) -> None:
        pass


def fold_stream(log: DataFrame) -> DataFrame:
    """T1 on a stream of the log: outcomes as they come. Within a trigger commands go by seq, else by arrival.

    The session's state store has to be RocksDB's (spark.sql.streaming.stateStore.providerClass).
    """
    columns = [x.split()[0] for x in LOG.split(", ")]
    return log.select(*columns).groupBy("exam").transformWithState(statefulProcessor=Reviewer(), outputStructType=OUTCOME, outputMode="append", timeMode="none")


def review_state(outcomes: DataFrame) -> DataFrame:
    """The state after all commands: exam, kind (student or source), id, status, pages (slot:source, or roll:slot)."""
    each = outcomes.where("accepted").select("exam", "seq", F.explode("changes").alias("c"))
    last = each.groupBy("exam", F.col("c.kind").alias("kind"), F.col("c.id").alias("id")).agg(F.max_by(F.struct("c.status", "c.pages"), "seq").alias("s"))
    return last.select("exam", "kind", "id", "s.status", "s.pages")
