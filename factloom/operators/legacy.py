"""State from raw journals of any generation.

Entries are parsed and judged as columns (``events``); the fold applies them in
order, migrates the older ones to version 3, and has typed side outputs: a verdict
an entry, the facts and tombstones a branch ends with, and its counters.  Which rule
a version-1 or -2 event migrates by depends on the state at its place, so migration
is part of the fold.  A pass over the judged entries finds each branch's latest
valid version-3 snapshot first, and the fold begins there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from . import events, replay
from .replay import Branch, canonical_key, normalise, units
from .runs import fold

#: Entry types of the journal: events, and single facts of the first releases.
EVENT_ENTRY, FACT_ENTRY = "fact-event", "fact"

REBUILT = (
    "branch_id string, seq long, part string, kind string, code string, accepted boolean, effect string, warnings array<string>, "
    "id string, type string, text string, created_at double, updated_at double, hot boolean, priority int, priority_explicit boolean, revision long, at double, "
    "n_facts long, n_chars long, migrated long, skipped long, future long, mutations long"
)
COLUMNS = [c.split()[0] for c in REBUILT.split(", ")]


def base36(n: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out or "0"


def number(x):
    """A JSON number as JavaScript shows it: whole ones without a fraction."""
    return int(x) if x is not None and float(x).is_integer() else x


def payload(f: dict) -> dict:
    return {k: f[k] for k in replay.PAYLOAD} | {"revision": number(f["revision"]), "priority": number(f["priority"])}


class Journal:
    """Folds judged entries of one branch; emits a verdict an entry, and what is left at the end."""

    def __init__(self, branch):
        self.branch, self.state, self.standalones, self.last = branch, Branch(), 0, None
        self.migrated = self.skipped = self.future = 0

    def row(self, seq, part: str, **values) -> tuple:
        values |= {"branch_id": self.branch, "seq": seq, "part": part}
        return tuple(values.get(c) for c in COLUMNS)

    def said(self, code: str, id_: str = "", **values) -> list[str]:
        """The warning that belongs to a code, if there is one."""
        form = C.WARNINGS.get(code)
        return [form.format(id=id_, **values)] if form else []

    def other(self, fact: dict) -> str:
        return self.state.keys.get(canonical_key(fact["type"], fact["text"]), "")

    def apply(self, op: str, id_: str, fact: dict | None, at, snapshot: dict | None = None) -> tuple[str, list[str]]:
        now, other = self.state.facts.get(id_), self.other(fact) if fact else ""
        code = self.state.apply(op, id_, fact, at, snapshot)
        if code == "snapshot-invalid":
            return code, self.said(code)
        has = now["revision"] if now else 0
        return code, self.said(code, id_, other=other, has=has, next=has + 1, got=fact["revision"] if fact else 0)

    def old(self, id_: str, f: dict, created, updated, ranked: bool) -> dict | None:
        """A payload of the first versions: default priority, never hot, the revision that fits; none if its text or id does not."""
        text = normalise(f["text"])
        type_ = C.LEGACY_TYPE[1] if f["type"] == C.LEGACY_TYPE[0] else f["type"]
        if not 0 < units(text) <= C.MAX_FACT_CHARS or not replay.valid_id(id_):
            return None
        now, tomb = (self.state.facts.get(id_), self.state.tombs.get(id_)) if ranked else (None, None)
        revision = max(now["revision"] if now else 0, tomb[0] if tomb else 0) + 1
        return {"type": type_, "text": text, "created_at": created, "updated_at": max(created, updated), "hot": False, "priority": C.TYPE_PRIORITY[type_], "priority_explicit": False, "revision": revision}

    def old_snapshot(self, row: dict) -> tuple[dict, list[str]]:
        """A snapshot of the second form of version 2: revoked ids win, first facts stay."""
        revoked = {i: {"revision": 1, "at": row["at"]} for i in row["revoked_ids"]}
        kept, warnings = {}, []
        for f in row["facts"]:
            if f["id"] in revoked:
                warnings += self.said("v2b-both", f["id"])
            elif f["id"] in kept:
                warnings += self.said("v2b-repeated", f["id"])
            else:
                kept[f["id"]] = f
        return {"facts": [{"id": i, **payload(f)} for i, f in kept.items()], "revoked": revoked}, warnings

    def event(self, row: dict) -> tuple[str, list[str], str]:
        """code, warnings, effect."""
        kind, op, id_, body = row["kind"], row["op"], row["event_id"], row["body"]
        if kind == "future":
            self.future += 1
            return kind, [], "ignored"
        if kind == "invalid":
            return kind, self.said("no-object" if row["broken"] == "no-object" else kind), "ignored"
        if op == "snapshot":
            if kind == "v3":
                snapshot, warnings = {"facts": [{"id": f["id"], **payload(f)} for f in row["facts"]], "revoked": {t["id"]: {"revision": number(t["revision"]), "at": t["at"]} for t in row["revoked"]}}, []
            else:
                snapshot, warnings = self.old_snapshot(row)
            code, more = self.apply(op, "", None, row["at"], snapshot)
            return code, warnings + more, "applied" if code.startswith("ok") else "ignored"
        if op == "revoke":
            code, warnings = self.apply(op, id_, None, row["at"])
        else:
            id_ = body["id"]
            fact = payload(body) if kind in ("v3", "v2b") else self.old(id_, body, body["created_at"], body["updated_at"], True)
            if fact and op == "add":
                fact["revision"] = 1
            if not fact or op == "supersede" and fact["updated_at"] > row["at"]:
                self.skipped += 1
                return "unsafe", self.said("unsafe", version=kind[:1].upper() + kind[1:], op=op), "skipped"
            code, warnings = self.apply(op, id_, fact, row["at"])
        if kind == "v3":
            return code, warnings, "applied" if code.startswith("ok") else "ignored"
        return code, warnings, self.counted(code)

    def counted(self, code: str) -> str:
        if code.startswith("ok"):
            self.migrated += 1
            return "migrated"
        self.skipped += 1
        return "skipped"

    def standalone(self, row: dict) -> tuple[str, list[str], str]:
        """A single fact of the first releases, under an id made from its time and place."""
        if not row["sound"]:
            self.skipped += 1
            return "legacy-invalid", self.said("legacy-invalid"), "skipped"
        own, time = row["own"], number(row["own"]["timestamp"])
        # a time with a fraction makes an id that no fact may have
        id_ = f"cf_legacy_{base36(time) if isinstance(time, int) else time}_{base36(self.standalones)}"
        self.standalones += 1
        if id_ in self.state.facts or id_ in self.state.tombs:
            return "legacy-known", [], "ignored"
        type_ = C.LEGACY_TYPE[1] if own["type"] == C.LEGACY_TYPE[0] else own["type"]
        if other := self.other({"type": type_, "text": own["text"]}):
            self.skipped += 1
            return "legacy-duplicate", self.said("legacy-duplicate", other=other), "skipped"
        fact = self.old(id_, own, own["timestamp"], own["timestamp"], False)
        if not fact:
            self.skipped += 1
            return "legacy-oversized", self.said("legacy-oversized", id_), "skipped"
        code, warnings = self.apply("add", id_, fact, None)
        return code, warnings, self.counted(code)

    def add(self, row) -> list:
        self.last = row["seq"]
        standalone = row["entry_type"] == FACT_ENTRY
        code, warnings, effect = self.standalone(row) if standalone else self.event(row)
        return [self.row(row["seq"], "verdict", kind="standalone" if standalone else row["kind"], code=code, accepted=code.startswith("ok"), effect=effect, warnings=warnings, n_facts=len(self.state.facts))]

    def finish(self) -> list:
        state, chars = self.state, sum(units(f["text"]) for f in self.state.facts.values())
        out = [self.row(self.last, "fact", id=i, **f) for i, f in state.facts.items()]
        out += [self.row(self.last, "tombstone", id=i, revision=t[0], at=t[1]) for i, t in state.tombs.items()]
        warnings = self.said("newer", n=self.future) if self.future else []
        warnings += self.said("many-facts", n=len(state.facts), limit=C.MAX_FACTS) if len(state.facts) > C.MAX_FACTS else []
        warnings += self.said("many-chars", n=chars, limit=C.MAX_TOTAL_CHARS) if chars > C.MAX_TOTAL_CHARS else []
        return [*out, self.row(self.last, "counters", warnings=warnings, n_facts=len(state.facts), n_chars=chars, migrated=self.migrated, skipped=self.skipped, future=self.future, mutations=state.mutations)]


def judged(entries: DataFrame) -> DataFrame:
    """Journal entries with their members, generation and broken rule; entries of other types are left out."""
    rows = entries.select("branch_id", "seq", "entry_type", "data").where(F.col("entry_type").isin(EVENT_ENTRY, FACT_ENTRY))
    return events.classified(events.typed(rows)).withColumn("sound", events.valid_standalone())


def from_last_snapshot(entries: DataFrame) -> DataFrame:
    """Entries from each branch's latest valid version-3 snapshot on.

    Only entries that can be snapshots are parsed for it: those that hold the
    word, or an escape that may stand for one of its letters.
    """
    may_be = (F.col("entry_type") == EVENT_ENTRY) & (F.contains("data", F.lit("snapshot")) | F.contains("data", F.lit("\\u")))
    start = judged(entries.where(may_be)).where("kind = 'v3' and op = 'snapshot'").groupBy("branch_id").agg(F.max("seq").alias("snapshot_seq"))
    return entries.join(start, "branch_id", "left").where(F.col("seq") >= F.coalesce("snapshot_seq", F.lit(-(2**63)))).drop("snapshot_seq")


def folded(rows: DataFrame) -> DataFrame:
    """Judged entries folded by branch; see ``REBUILT``."""
    used = rows.select("branch_id", "seq", "entry_type", "kind", "broken", "op", "event_id", "at", "body", "facts", "revoked", "revoked_ids", "own", "sound")
    return fold(used, "branch_id", ["seq"], Journal, REBUILT)


def rebuild(entries: DataFrame) -> DataFrame:
    """``entries``: branch_id, seq, entry_type, data (JSON).  Verdicts, facts, tombstones and counters, told apart by ``part``.

    The parts are views of one result: keep it (checkpoint, table) to read several.
    """
    return folded(judged(from_last_snapshot(entries)))


def outcomes(entries: DataFrame) -> DataFrame:
    """One row per journal entry from the first on, snapshots included."""
    rows = folded(judged(entries)).where("part = 'verdict'")
    return rows.select("branch_id", "seq", "kind", "code", "accepted", "effect", "warnings", "n_facts")


def facts(rebuilt: DataFrame) -> DataFrame:
    return rebuilt.where("part = 'fact'").select("branch_id", "id", "type", "text", "created_at", "updated_at", "hot", "priority", "priority_explicit", "revision")


def tombstones(rebuilt: DataFrame) -> DataFrame:
    return rebuilt.where("part = 'tombstone'").select("branch_id", "id", "revision", "at")


def diagnostics(rebuilt: DataFrame) -> DataFrame:
    """Per branch: older events that counted and that did not, events of a later schema, warnings, and the state's size."""
    own = rebuilt.where("part in ('verdict', 'counters')")
    last = lambda c: F.max(F.when(F.col("part") == "counters", F.col(c))).alias(c)
    return own.groupBy("branch_id").agg(*(last(c) for c in ("migrated", "skipped", "future", "n_facts", "n_chars", "mutations")), F.sum(F.size("warnings")).cast("long").alias("n_warnings"))


def warnings(rebuilt: DataFrame) -> DataFrame:
    """branch_id, seq, place, text of every warning; those about the whole branch come last."""
    rows = rebuilt.where("part in ('verdict', 'counters')").select("branch_id", "seq", (F.col("part") == "counters").alias("whole"), F.posexplode("warnings").alias("place", "text"))
    return rows.select("branch_id", "seq", "whole", "place", "text")


def data_of(event: dict) -> str:
    """An event as the journal holds it."""
    return json.dumps(event, sort_keys=True, ensure_ascii=False)
