"""Write commands with their guards, for many branches at once.

Commands (add, revise, forget) are judged in order against the branch as it
stands; those that pass become journal events with ids made from branch and
place, so that a retried batch writes the same events.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .legacy import EVENT_ENTRY, data_of
from .replay import PAYLOAD, Branch, canonical_key, normalise, units, valid_id, valid_snapshot
from .runs import fold

OUTCOMES = "branch_id string, seq long, command string, id string, outcome string, event string, snapshot string, n_facts long, n_chars long"


def resolve(type_: str, priority: int | None, hot: bool | None, old: dict | None) -> tuple[bool, int, bool]:
    """hot, priority, explicit; a given priority always holds."""
    now_hot = hot if hot is not None else bool(old and old["hot"])
    if priority is not None:
        return now_hot, priority, True
    fresh = C.TYPE_PRIORITY[type_]
    if not old:
        return now_hot, C.HOT_PRIORITY if now_hot else fresh, False
    if old["priority_explicit"]:
        return now_hot, old["priority"], True
    if now_hot and not old["hot"] and old["priority"] < C.HOT_PRIORITY:
        return now_hot, C.HOT_PRIORITY, False
    if not now_hot and old["hot"] and old["priority"] == C.HOT_PRIORITY:
        return now_hot, fresh, False
    if type_ != old["type"] and old["priority"] == C.TYPE_PRIORITY[old["type"]]:
        return now_hot, fresh, False
    return now_hot, old["priority"], False


#: Names of fact members in the journal that differ from the columns'.
STORED = {"created_at": "createdAt", "updated_at": "updatedAt", "priority_explicit": "priorityExplicit"}


def stored(id_: str, fact: dict) -> dict:
    """A fact as the journal holds it."""
    return {"id": id_} | {STORED.get(k, k): v for k, v in fact.items()}


class Desk:
    """Judges the commands of one branch; after ``every`` mutations a snapshot follows."""

    def __init__(self, branch, every: int = C.SNAPSHOT_EVERY):
        self.branch, self.every, self.state, self.chars = branch, every, Branch(), 0

    def size(self, id_: str) -> int:
        fact = self.state.facts.get(id_)
        return units(fact["text"]) if fact else 0

    def other(self, type_: str, text: str, own: str | None) -> bool:
        return self.state.keys.get(canonical_key(type_, text), own) != own

    def judge(self, c: dict) -> tuple[str, str | None, dict | None]:
        """outcome, fact id, event."""
        name, facts = c["command"], self.state.facts
        if name == "add":
            text = normalise(c["text"] or "")
            if not text or units(text) > C.MAX_FACT_CHARS:
                return "bad-text", None, None
            if c["type"] not in C.FACT_TYPES:
                return "bad-type", None, None
            if self.other(c["type"], text, None):
                return "duplicate", self.state.keys[canonical_key(c["type"], text)], None
            if len(facts) >= C.MAX_FACTS or self.chars + units(text) > C.MAX_TOTAL_CHARS:
                return "full", None, None
            id_ = "cf_" + hashlib.sha256(f"{self.branch}#{c['seq']}".encode()).hexdigest()[:32]
            hot, priority, explicit = resolve(c["type"], c["priority"], c["hot"], None)
            fact = {"type": c["type"], "text": text, "created_at": c["at"], "updated_at": c["at"], "hot": hot, "priority": priority, "priority_explicit": explicit, "revision": 1}
            return "ok", id_, {"op": "add", "fact": fact}
        if not valid_id(c["id"]):
            return "bad-id", None, None
        old = facts.get(c["id"])
        if not old:
            return "missing", c["id"], None
        if name == "forget":
            return "ok", c["id"], {"op": "revoke"}
        type_ = c["type"] or old["type"]
        text = normalise(c["text"]) if c["text"] is not None else old["text"]
        if not text or units(text) > C.MAX_FACT_CHARS:
            return "bad-text", c["id"], None
        if type_ not in C.FACT_TYPES:
            return "bad-type", c["id"], None
        hot, priority, explicit = resolve(type_, c["priority"], c["hot"], old)
        fact = old | {"type": type_, "text": text, "hot": hot, "priority": priority, "priority_explicit": explicit}
        if all(fact[k] == old[k] for k in PAYLOAD):
            return "unchanged", c["id"], None
        if self.chars - units(old["text"]) + units(text) > C.MAX_TOTAL_CHARS:
            return "full", c["id"], None
        if self.other(type_, text, c["id"]):
            return "duplicate", c["id"], None
        return "ok", c["id"], {"op": "supersede", "fact": fact | {"revision": old["revision"] + 1, "updated_at": max(c["at"], old["updated_at"])}}

    def stored_event(self, event: dict, id_: str, at: int) -> dict:
        """The event in the journal's form; a revision is never later than itself."""
        out = {"version": C.SCHEMA_VERSION, "op": event["op"]}
        if event["op"] == "add":
            return out | {"fact": stored(id_, event["fact"])}
        if event["op"] == "supersede":
            return out | {"id": id_, "replacement": stored(id_, event["fact"]), "at": max(at, event["fact"]["updated_at"])}
        return out | {"id": id_, "at": at}

    def snapshot(self, at: int) -> str | None:
        if self.state.mutations < self.every:
            return None
        snap = self.state.to_snapshot(at)
        if not valid_snapshot(snap, snap["at"]):
            return None
        self.state.mutations = 0
        return data_of(snap | {"facts": [stored(f["id"], {k: v for k, v in f.items() if k != "id"}) for f in snap["facts"]]})

    def add(self, row) -> list:
        outcome, id_, event = self.judge(row) if row["command"] in ("add", "revise", "forget") else ("bad-command", None, None)
        data = snapshot = None
        if event:
            at = row["at"]
            if event["op"] == "revoke":
                at = max(at, self.state.facts[id_]["updated_at"])
            before = self.size(id_)
            self.state.apply(event["op"], id_, event.get("fact"), at)
            self.chars += self.size(id_) - before
            data, snapshot = data_of(self.stored_event(event, id_, at)), self.snapshot(at)
        return [(self.branch, row["seq"], row["command"], id_, outcome, data, snapshot, len(self.state.facts), self.chars)]

    def finish(self) -> list:
        return []


def outcomes(commands: DataFrame, every: int = C.SNAPSHOT_EVERY) -> DataFrame:
    """``commands``: branch_id, seq, command, id, type, text, priority, hot, at."""
    rows = commands.select("branch_id", "seq", "command", "id", "type", "text", F.col("priority").cast("int").alias("priority"), "hot", "at")
    return fold(rows, "branch_id", ["seq"], lambda branch: Desk(branch, every), OUTCOMES)


def journal_entries(outcomes: DataFrame) -> DataFrame:
    """branch_id, seq, entry_type, data of the events that outcomes made; a snapshot stands right behind its event."""
    made = F.posexplode(F.array("event", "snapshot")).alias("place", "data")
    rows = outcomes.select("branch_id", F.col("seq").alias("command_seq"), made).where("data is not null")
    return rows.select("branch_id", (2 * F.col("command_seq") + F.col("place")).alias("seq"), F.lit(EVENT_ENTRY).alias("entry_type"), "data")
