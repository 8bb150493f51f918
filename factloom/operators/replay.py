"""Replaying journals of add, supersede, revoke and snapshot events.

Whether an event counts depends on those before it and, by the duplicate rule,
on all active facts of its branch, so the fold runs per branch in sequence
order.  It streams: its state is the active facts and tombstones, and it emits
one verdict per event, and what an accepted snapshot holds.  Current facts,
tombstones and diagnostics follow from these rows by plain aggregation.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .. import constants as C
from ..functions import rules as R
from .runs import fold

_SPACE = re.compile("[\t-\r \xa0  -     　﻿]+")
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f￾￿]")


def normalise(text: str) -> str:
    text = _UNSAFE.sub("", text).replace("\r\n", "\n")
    return re.sub(rf"\A{_SPACE.pattern}|{_SPACE.pattern}\Z", "", text)


def canonical_key(type_: str, text: str) -> tuple[str, str]:
    text = normalise(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return type_, _SPACE.sub(" ", text)


PAYLOAD = ("type", "text", "created_at", "updated_at", "hot", "priority", "priority_explicit")


class Branch:
    """Active facts and tombstones of one branch; apply() judges one event."""

    def __init__(self, facts: dict | None = None, tombs: dict | None = None, mutations: int = 0):
        self.facts: dict[str, dict] = facts or {}
        self.tombs: dict[str, list[int]] = tombs or {}  # id -> revision, at
        self.keys = {canonical_key(f["type"], f["text"]): i for i, f in self.facts.items()}
        self.mutations = mutations

    def _put(self, id_: str, fact: dict) -> None:
        self._drop(id_)
        self.facts[id_] = fact
        self.keys[canonical_key(fact["type"], fact["text"])] = id_

    def _drop(self, id_: str) -> None:
        old = self.facts.pop(id_, None)
        if old:
            self.keys.pop(canonical_key(old["type"], old["text"]), None)

    def apply(self, op: str, id_: str, fact: dict | None = None, at: int | None = None, snapshot: dict | None = None) -> str:
        """Verdict: 'ok...' if the event counts, else why not."""
        code = getattr(self, f"_{op}")(id_, fact, at, snapshot) if op in ("add", "supersede", "revoke", "snapshot") else "unknown-op"
        if code.startswith("ok"):
            self.mutations = 0 if op == "snapshot" else self.mutations + 1
        return code

    def _add(self, id_, fact, at, snapshot) -> str:
        if id_ in self.tombs:
            return "add-revoked"
        now = self.facts.get(id_)
        if now:
            return "add-identical" if all(now[k] == fact[k] for k in PAYLOAD) else "add-conflict"
        if canonical_key(fact["type"], fact["text"]) in self.keys:
            return "add-duplicate"
        self._put(id_, fact)
        return "ok"

    def _supersede(self, id_, fact, at, snapshot) -> str:
        if id_ in self.tombs:
            return "supersede-revoked"
        now = self.facts.get(id_)
        if not now:
            return "supersede-missing"
        ahead = fact["revision"] - now["revision"]
        if ahead != 1:
            return "supersede-stale" if ahead <= 0 else "supersede-gap"
        if fact["updated_at"] < now["updated_at"]:
            return "supersede-older"
        if self.keys.get(canonical_key(fact["type"], fact["text"]), id_) != id_:
            return "supersede-duplicate"
        self._put(id_, fact)
        return "ok"

    def _revoke(self, id_, fact, at, snapshot) -> str:
        now, tomb = self.facts.get(id_), self.tombs.get(id_)
        if not now:
            if tomb and at <= tomb[1]:
                return "revoke-duplicate"
            self.tombs[id_] = [tomb[0] if tomb else 1, at]
            return "ok-later" if tomb else "ok-orphan"
        if at < now["updated_at"]:
            return "revoke-stale"
        self.tombs[id_] = [max(now["revision"], tomb[0] if tomb else 0) + 1, at]
        self._drop(id_)
        return "ok"

    def _snapshot(self, id_, fact, at, snapshot) -> str:
        if not valid_snapshot(snapshot, at):
            return "snapshot-invalid"
        self.load({f["id"]: {k: v for k, v in f.items() if k != "id"} for f in snapshot["facts"]}, {k: [t["revision"], t["at"]] for k, t in snapshot["revoked"].items()})
        return "ok"

    def load(self, facts: dict, tombs: dict) -> None:
        """Put a snapshot's content, in which no two facts say the same, in place of all that was."""
        self.facts, self.tombs = facts, tombs
        self.keys = {canonical_key(f["type"], f["text"]): i for i, f in facts.items()}

    def to_snapshot(self, now: int) -> dict:
        """One event that replays to this state; not earlier than anything in it."""
        at = min(max([now, *(f["updated_at"] for f in self.facts.values()), *(t[1] for t in self.tombs.values())]), C.MAX_TIME)
        rank = lambda i: (-bool(self.facts[i]["hot"]), -self.facts[i]["priority"], -self.facts[i]["updated_at"], -self.facts[i]["revision"], i)
        return {"version": C.SCHEMA_VERSION, "op": "snapshot", "facts": [{"id": i, **self.facts[i]} for i in sorted(self.facts, key=rank)], "revoked": {i: {"revision": t[0], "at": t[1]} for i, t in sorted(self.tombs.items(), key=lambda x: (-x[1][1], x[0]))}, "at": at}

    def check(self) -> list[str]:
        """Broken invariants; none in a sound state."""
        bad = [f"both:{i}" for i in self.facts if i in self.tombs]
        bad += [f"invalid:{i}" for i, f in self.facts.items() if not valid_fact({"id": i, **f})]
        return bad + ([] if len(self.keys) == len(self.facts) else ["duplicate"])


def _whole(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and float(x).is_integer()


def valid_time(t) -> bool:
    return isinstance(t, (int, float)) and not isinstance(t, bool) and 0 < t <= C.MAX_TIME


def valid_id(x) -> bool:
    return isinstance(x, str) and len(x) <= C.MAX_ID_CHARS and re.fullmatch(r"(?i)cf_[a-z0-9_-]+", x) is not None


def units(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def valid_fact(f) -> bool:
    return (
        isinstance(f, dict) and valid_id(f.get("id")) and f.get("type") in C.FACT_TYPES
        and isinstance(f.get("text"), str) and 0 < units(f["text"]) <= C.MAX_FACT_CHARS and normalise(f["text"]) == f["text"]
        and valid_time(f.get("created_at")) and valid_time(f.get("updated_at")) and f["updated_at"] >= f["created_at"]
        and isinstance(f.get("hot"), bool) and isinstance(f.get("priority_explicit"), bool)
        and _whole(f.get("priority")) and 0 <= f["priority"] <= 100 and _whole(f.get("revision")) and f["revision"] >= 1
    )


def valid_snapshot(s, at) -> bool:
    if not isinstance(s, dict) or not isinstance(s.get("facts"), list) or not isinstance(s.get("revoked"), dict) or not valid_time(at):
        return False
    facts, revoked = s["facts"], s["revoked"]
    if len(facts) > C.MAX_FACTS or not all(map(valid_fact, facts)) or sum(units(f["text"]) for f in facts) > C.MAX_TOTAL_CHARS:
        return False
    ids = [f["id"] for f in facts]
    tombs_ok = all(valid_id(i) and isinstance(t, dict) and _whole(t.get("revision")) and t["revision"] >= 1 and valid_time(t.get("at")) and t["at"] <= at for i, t in revoked.items())
    return tombs_ok and len(set(ids)) == len(ids) and not set(ids) & set(revoked) and len({canonical_key(f["type"], f["text"]) for f in facts}) == len(ids) and all(f["updated_at"] <= at for f in facts)


#: Values of fact columns that a journal may leave out.
DEFAULTS = {"type": "finding", "hot": False, "priority": C.DEFAULT_PRIORITY, "priority_explicit": False, "created_at": None}
VERDICTS = "branch_id string, seq long, op string, id string, text string, revision int, updated_at long, at long, code string, accepted boolean, tomb_revision int, mutations long"


def fact_of(row: dict) -> dict:
    fact = {k: row.get(k) if row.get(k) is not None else v for k, v in DEFAULTS.items()}
    fact |= {"text": row["text"], "revision": row["revision"], "updated_at": row["updated_at"]}
    fact["created_at"] = fact["created_at"] if fact["created_at"] is not None else row["updated_at"]
    return fact


#: Code of the rows that tell what an accepted snapshot brought in.
LOADED = "loaded"


def snapshot_of(row: dict) -> dict | None:
    try:
        return json.loads(row["snapshot"]) if row.get("snapshot") else None
    except ValueError:
        return None


def words_of(branch, state: Branch, row: dict) -> list[tuple]:
    """The verdict on one event, and after an accepted snapshot a row for everything it holds.

    An event that breaks a rule by itself (``broken``) is judged by no other.
    """
    if row.get("broken"):
        code = row["broken"]
    else:
        code = state.apply(row["op"], row["id"], fact_of(row) if row["op"] in ("add", "supersede") else None, row["at"], snapshot_of(row))
    tomb, ok = state.tombs.get(row["id"]), code.startswith("ok")
    out = [(branch, row["seq"], row["op"], row["id"], row["text"], row["revision"], row["updated_at"], row["at"], code, ok, tomb[0] if ok and row["op"] == "revoke" else None, state.mutations)]
    if ok and row["op"] == "snapshot":
        out += [(branch, row["seq"], "add", i, f["text"], f["revision"], f["updated_at"], row["at"], LOADED, True, None, 0) for i, f in state.facts.items()]
        out += [(branch, row["seq"], "revoke", i, None, None, None, t[1], LOADED, True, t[0], 0) for i, t in state.tombs.items()]
    return out


class Replay:
    def __init__(self, branch):
        self.branch, self.state = branch, Branch()

    def add(self, row) -> list:
        return words_of(self.branch, self.state, row)

    def finish(self) -> list:
        return []


def broken(columns: list[str]) -> Column:
    """Code of the rule that an event of a flat journal breaks by itself, null if it breaks none; members that the journal leaves out hold."""
    has = lambda name, rule: F.coalesce(rule, F.lit(False)) if name in columns else F.lit(True)
    op, created = F.col("op"), F.col("created_at" if "created_at" in columns else "updated_at")
    fact = (
        R.valid_id(F.col("id")) & R.valid_text(F.col("text")) & R.valid_time(F.col("updated_at")) & F.coalesce((F.col("revision") >= 1) & R.valid_time(created) & (created <= F.col("updated_at")), F.lit(False))
        & has("type", F.col("type").isin(*C.FACT_TYPES) if "type" in columns else F.lit(True)) & has("priority", F.col("priority").between(0, 100) if "priority" in columns else F.lit(True))
    )
    timed = R.valid_time(F.col("at"))
    holds = (
        F.when(op == "add", fact & (F.col("revision") == 1)).when(op == "supersede", fact & timed & F.coalesce(F.col("updated_at") <= F.col("at"), F.lit(False)))
        .when(op == "revoke", R.valid_id(F.col("id")) & timed).when(op == "snapshot", timed).otherwise(True)
    )
    return F.when(~F.coalesce(holds, F.lit(False)), F.concat(F.coalesce(op, F.lit("event")), F.lit("-broken"))).when(op.isNull(), "event-broken")


def words(journal: DataFrame) -> DataFrame:
    """The verdicts, and the facts and tombstones that accepted snapshots bring in."""
    return fold(journal.withColumn("broken", broken(journal.columns)), "branch_id", ["seq"], Replay, VERDICTS)


def verdicts(journal: DataFrame) -> DataFrame:
    """One row per event: whether it counted, why not, and the mutations since the last snapshot."""
    return words(journal).where(F.col("code") != LOADED)


def last_words(words: DataFrame) -> DataFrame:
    """The last word on every fact: an event that counted, or the latest accepted snapshot, which clears all before it."""
    told = words.where("accepted")
    last = F.max_by(F.struct("seq", "op", "text", "revision", "updated_at", "at", "tomb_revision"), "seq").alias("last")
    last = told.where("op != 'snapshot'").groupBy("branch_id", "id").agg(last).select("branch_id", "id", "last.*")
    cleared = told.where("op = 'snapshot'").groupBy("branch_id").agg(F.max("seq").alias("cleared"))
    return last.join(cleared, "branch_id", "left").where("seq >= coalesce(cleared, seq)").drop("cleared")


def active(words: DataFrame) -> DataFrame:
    return last_words(words).where("op != 'revoke'").select("branch_id", "id", "text", "revision", "updated_at")


def tombstones(words: DataFrame) -> DataFrame:
    return last_words(words).where("op = 'revoke'").select("branch_id", "id", F.col("tomb_revision").alias("revision"), "at")


def holds_snapshot(snapshot: str, at: str) -> Column:
    """Whether the JSON in column ``snapshot`` is one that replay would accept at the time in ``at``."""

    def holds(snapshots: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([bool(t) and valid_snapshot(snapshot_of({"snapshot": s}), int(t)) for s, t in zip(snapshots, times.fillna(0))], dtype=bool)

    # made here, for a module that holds a UDF cannot be sent to executors
    return F.pandas_udf(holds, BooleanType())(snapshot, at)


def from_last_snapshot(journal: DataFrame, is_snapshot) -> DataFrame:
    """Events from the latest valid snapshot of each branch on; all if there is none."""
    start = journal.where(is_snapshot).groupBy("branch_id").agg(F.max("seq").alias("snapshot_seq"))
    return journal.join(start, "branch_id", "left").where(F.col("seq") >= F.coalesce("snapshot_seq", F.lit(-(2**63)))).drop("snapshot_seq")


def since_snapshot(journal: DataFrame, is_snapshot, counts) -> DataFrame:
    """Running number of counting events since the last snapshot."""
    order = Window.partitionBy("branch_id").orderBy("seq")
    group = F.sum(F.when(is_snapshot, 1).otherwise(0)).over(order)
    rows = journal.withColumn("era", group)
    run = Window.partitionBy("branch_id", "era").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("mutations", F.sum(F.when(counts & ~is_snapshot, 1).otherwise(0)).over(run))


class AutoSnapshot(Replay):
    """A snapshot event after every ``every`` mutations that counted since the last one."""

    def __init__(self, branch, every: int):
        super().__init__(branch)
        self.every = every

    def add(self, row) -> list:
        super().add(row)
        if self.state.mutations < self.every:
            return []
        snap = self.state.to_snapshot(row["at"])
        if not valid_snapshot(snap, snap["at"]):
            return []  # a state beyond the limits has no snapshot that would replay
        self.state.mutations = 0
        return [(self.branch, row["seq"], snap["at"], len(snap["facts"]), len(snap["revoked"]), json.dumps(snap, sort_keys=True, ensure_ascii=False))]


def auto_snapshots(journal: DataFrame, every: int = C.SNAPSHOT_EVERY) -> DataFrame:
    """The snapshots a writer adds to its journal; each belongs right after the event ``seq``."""
    return fold(journal, "branch_id", ["seq"], lambda branch: AutoSnapshot(branch, every), "branch_id string, seq long, at long, n_facts long, n_tombstones long, snapshot string")


def tombstone_order(tombs: DataFrame) -> DataFrame:
    """Tombstones of each branch numbered as snapshots list them: latest first, then by id."""
    return tombs.withColumn("place", F.row_number().over(Window.partitionBy("branch_id").orderBy(F.col("at").desc(), "id")).cast("long"))


class Compaction(Replay):
    """The branch's state as one snapshot event, and whether writing it has a point.

    ``action`` is empty (nothing stored), current (no mutation since the last
    snapshot) or written.
    """

    def add(self, row) -> list:
        super().add(row)
        self.last = row["at"]
        return []

    def finish(self) -> list:
        snap = self.state.to_snapshot(self.last)
        action = "empty" if not (snap["facts"] or snap["revoked"]) else "written" if self.state.mutations else "current"
        return [(self.branch, snap["at"], len(snap["facts"]), len(snap["revoked"]), ",".join(f["id"] for f in snap["facts"]), ",".join(sorted(snap["revoked"])), json.dumps(snap, sort_keys=True, ensure_ascii=False), len(self.state.check()), action)]


def compacted(journal: DataFrame) -> DataFrame:
    return fold(journal, "branch_id", ["seq"], Compaction, "branch_id string, at long, n_facts long, n_tombstones long, fact_ids string, tombstone_ids string, snapshot string, broken long, action string")
