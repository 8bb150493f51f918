"""Rules of every journal generation, rebuilding from raw entries, and writing what can be read again."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from factloom.api import Engine
from factloom.operators import commands, events, legacy, replay, runs
from factloom.plans import fixtures
from factloom.sources import journal

SF = "/root/testdata/sf0.001"
ENTRIES = "branch_id string, seq long, entry_type string, data string"
FACT = {"id": "cf_a", "type": "finding", "text": "a", "createdAt": 1, "updatedAt": 2, "hot": True, "priority": 95, "priorityExplicit": True, "revision": 1}
OLD = {k: v for k, v in FACT.items() if k != "revision"}
FIRST = {"id": "cf_a", "type": "tz_approved", "text": " a ", "createdAt": 1, "updatedAt": 2}
LONG = "x" * 501


def entries(spark, *data, kind=legacy.EVENT_ENTRY):
    return spark.createDataFrame([("b", k, *(d if isinstance(d, tuple) else (kind, d if isinstance(d, str) or d is None else json.dumps(d)))) for k, d in enumerate(data)], ENTRIES)


CASES = [
    ({"version": 3, "op": "add", "fact": FACT}, "v3", None),
    ({"version": 3, "op": "add", "fact": FACT | {"revision": 2}}, "invalid", "first-revision"),
    ({"version": 3, "op": "add", "fact": FACT | {"createdAt": 1.5, "updatedAt": 1.75}}, "v3", None),
    ({"version": 3.0, "op": "add", "fact": FACT | {"priority": 95.0}}, "v3", None),
    ({"version": 3, "op": "add", "fact": FACT | {"priority": 9.5}}, "invalid", "priority"),
    ({"version": 3, "op": "add", "fact": FACT | {"priority": "95"}}, "invalid", "priority"),
    ({"version": 3, "op": "add", "fact": FACT | {"text": " a"}}, "invalid", "text"),
    ({"version": 3, "op": "add", "fact": FACT | {"text": "x" * 2001}}, "invalid", "text"),
    ({"version": 3, "op": "add", "fact": FACT | {"id": "cf_a\n"}}, "invalid", "fact-id"),
    ({"version": 3, "op": "add", "fact": FACT | {"id": "CF_" + "a" * 126}}, "invalid", "fact-id"),
    ({"version": 3, "op": "add", "fact": FACT | {"type": "tz_approved"}}, "invalid", "type"),
    ({"version": 3, "op": "add", "fact": FACT | {"createdAt": 3}}, "invalid", "order"),
    ({"version": 3, "op": "add", "fact": FACT | {"updatedAt": 8_640_000_000_000_001}}, "invalid", "time"),
    ({"version": 3, "op": "add", "fact": FACT | {"hot": 1}}, "invalid", "hot"),
    ({"version": 3, "op": "add", "fact": None}, "invalid", "fact-id"),
    ({"version": 3, "op": "supersede", "id": "cf_a", "replacement": FACT, "at": 2}, "v3", None),
    ({"version": 3, "op": "supersede", "id": "cf_b", "replacement": FACT, "at": 2}, "invalid", "replacement-id"),
    ({"version": 3, "op": "supersede", "id": "cf_a", "replacement": FACT, "at": 1}, "invalid", "later"),
    ({"version": 3, "op": "supersede", "id": "cf_a", "replacement": FACT, "at": 2, "reason": LONG}, "invalid", "reason"),
    ({"version": 3, "op": "revoke", "id": "cf_a", "at": 2, "reason": None}, "invalid", "reason"),
    ({"version": 3, "op": "revoke", "id": "cf_a", "at": 2, "reason": ""}, "v3", None),
    ({"version": 3, "op": "revoke", "id": 7, "at": 2}, "invalid", "id"),
    ({"version": 3, "op": "merge"}, "invalid", "op"),
    ({"version": "3", "op": "add", "fact": FACT}, "invalid", "version"),
    ({"version": 3.5, "op": "add", "fact": FACT}, "future", None),
    ({"version": 2, "op": "add", "fact": FACT}, "v2b", None),
    ({"version": 2, "op": "add", "fact": OLD | {"text": " a "}}, "v2a", None),
    ({"version": 2, "op": "add", "fact": OLD | {"revision": None}}, "invalid", "revision"),
    ({"version": 2, "op": "add", "fact": FIRST}, "invalid", "type"),
    ({"version": 2, "op": "add", "fact": {k: FIRST[k] for k in ("id", "text", "createdAt", "updatedAt")} | {"type": "finding"}}, "invalid", "hot"),
    ({"version": 2, "op": "supersede", "id": "cf_a", "replacement": OLD, "at": 1}, "invalid", "later"),
    ({"version": 2, "op": "snapshot", "facts": [FACT, FACT], "revokedIds": ["cf_a"], "at": 1}, "v2b", None),
    ({"version": 2, "op": "snapshot", "facts": [OLD], "revokedIds": [], "at": 9}, "invalid", "facts"),
    ({"version": 2, "op": "snapshot", "facts": [], "revokedIds": ["x"], "at": 9}, "invalid", "revoked"),
    ({"version": 1, "op": "add", "fact": FIRST}, "v1", None),
    ({"version": 1, "op": "add", "fact": FIRST | {"text": "x" * 20_001}}, "invalid", "text"),
    ({"version": 1, "op": "supersede", "id": "cf_a", "replacement": FIRST, "at": 1}, "v1", None),
    ({"version": 1, "op": "supersede", "id": "cf_a", "replacement": FIRST, "at": 9, "reason": LONG}, "invalid", "reason"),
    ({"version": 3, "op": "snapshot", "facts": [FACT], "revoked": {"cf_b": {"revision": 1, "at": 3}}, "at": 3}, "v3", None),
    ({"version": 3, "op": "snapshot", "facts": [], "revoked": [], "at": 3}, "v3", None),
    ({"version": 3, "op": "snapshot", "facts": [], "revoked": [1], "at": 3}, "invalid", "revoked"),
    ({"version": 3, "op": "snapshot", "facts": [], "revoked": None, "at": 3}, "invalid", "revoked"),
    ({"version": 3, "op": "snapshot", "facts": [FACT], "revoked": {"cf_a": {"revision": 1, "at": 3}}, "at": 3}, "invalid", "both"),
    ({"version": 3, "op": "snapshot", "facts": [FACT], "revoked": {"cf_b": {"revision": 0, "at": 3}}, "at": 3}, "invalid", "tombstones"),
    ({"version": 3, "op": "snapshot", "facts": [FACT], "revoked": {"cf_b": {"revision": 1, "at": 4}}, "at": 3}, "invalid", "tombstone-later"),
    ({"version": 3, "op": "snapshot", "facts": [FACT, FACT | {"text": "b"}], "revoked": {}, "at": 3}, "invalid", "fact-ids"),
    ({"version": 3, "op": "snapshot", "facts": [FACT | {"text": "ﬁne  x"}, FACT | {"id": "cf_b", "text": "fine x"}], "revoked": {}, "at": 3}, "invalid", "duplicates"),
    ({"version": 3, "op": "snapshot", "facts": [FACT], "revoked": {}, "at": 1}, "invalid", "later"),
    ({"version": 3, "op": "snapshot", "facts": [FACT | {"id": f"cf_{k}", "text": f"t{k}"} for k in range(51)], "revoked": {}, "at": 3}, "invalid", "too-many"),
    ({"version": 3, "op": "snapshot", "facts": [FACT | {"id": f"cf_{k}", "text": f"{k}" + "y" * 1999} for k in range(7)], "revoked": {}, "at": 3}, "invalid", "too-long"),
    ("[]", "invalid", "version"), ("3", "invalid", "no-object"), ("null", "invalid", "no-object"), ("", "invalid", "no-object"), (None, "invalid", "no-object"),
]


def test_rules(spark):
    rows = events.class_of(entries(spark, *(c[0] for c in CASES)), "data")
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    got = {r.seq: (r.kind, r.broken) for r in rows.collect()}
    assert {k: (json.dumps(c[0])[:90], *got[k]) for k, c in enumerate(CASES)} == {k: (json.dumps(c[0])[:90], c[1], c[2]) for k, c in enumerate(CASES)}


def test_later_form_of_version_two_keeps_its_members(spark):
    rows = legacy.rebuild(entries(spark, {"version": 2, "op": "add", "fact": FACT}, {"version": 2, "op": "add", "fact": OLD | {"id": "cf_b", "text": " b "}}))
    got = {r.id: (r.text, r.hot, r.priority, r.priority_explicit, r.revision) for r in legacy.facts(rows).collect()}
    assert got == {"cf_a": ("a", True, 95, True, 1), "cf_b": ("b", False, 50, False, 1)}


def test_snapshots(spark):
    """The latest valid one of version 3 is where a replay begins; one of version 2 is migrated where it stands."""
    snap = {"version": 3, "op": "snapshot", "facts": [FACT | {"revision": 4}], "revoked": {"cf_b": {"revision": 2, "at": 3}}, "at": 3}
    old = {"version": 2, "op": "snapshot", "facts": [FACT | {"id": "cf_c"}, FACT | {"id": "cf_d", "text": "d"}, FACT | {"id": "cf_d", "text": "e"}], "revokedIds": ["cf_c", "cf_c"], "at": 5}
    late = snap | {"facts": [FACT | {"updatedAt": 9}]}
    rows = legacy.rebuild(entries(spark, {"version": 1, "op": "add", "fact": FIRST}, snap, {"version": 3, "op": "add", "fact": FACT | {"id": "cf_b", "text": "z"}}, late))
    said = {r.seq: (r.code, r.effect) for r in rows.where("part = 'verdict'").collect()}
    assert said == {1: ("ok", "applied"), 2: ("add-revoked", "ignored"), 3: ("invalid", "ignored")}
    assert [(r.id, r.revision) for r in legacy.facts(rows).collect()] == [("cf_a", 4)]
    rows = legacy.rebuild(entries(spark, snap, old))
    assert [(r.id, r.text) for r in legacy.facts(rows).collect()] == [("cf_d", "d")]
    assert [(r.id, r.revision, r.at) for r in legacy.tombstones(rows).collect()] == [("cf_c", 1, 5.0)]
    assert [r.text for r in legacy.warnings(rows).orderBy("seq", "place").collect()] == ["V2b snapshot conflict: cf_c is both active and revoked; tombstone wins.", "V2b snapshot duplicate fact cf_d; first occurrence kept."]


def test_diagnostics_count_what_became_of_entries(spark):
    alone = lambda **more: (legacy.FACT_ENTRY, json.dumps({"type": "decision", "text": "alone", "timestamp": 36} | more))
    rows = legacy.rebuild(entries(
        spark, {"version": 1, "op": "add", "fact": FIRST}, {"version": 1, "op": "add", "fact": FIRST}, {"version": 1, "op": "supersede", "id": "cf_a", "replacement": FIRST | {"text": "b"}, "at": 1},
        {"version": 1, "op": "supersede", "id": "cf_a", "replacement": FIRST | {"text": "b"}, "at": 2}, alone(), alone(timestamp=37), alone(timestamp=1.5, text="c"), alone(text="  ", timestamp=38), alone(timestamp=0), alone(text="last", timestamp=36),
        {"version": 4}, {"version": 9, "op": "add"}, "nope", {"version": 0}, ("other", "{}"),
    )).checkpoint()
    got = legacy.diagnostics(rows).first()
    assert (got.migrated, got.skipped, got.future, got.n_facts, got.mutations, got.n_warnings) == (4, 6, 2, 3, 4, 9)
    assert sorted(r.id for r in legacy.facts(rows).collect()) == ["cf_a", "cf_legacy_10_0", "cf_legacy_10_4"]
    said = {r.text for r in legacy.warnings(rows).collect()}
    assert {"V1 supersede event could not be migrated safely.", "Legacy standalone fact duplicates active fact cf_legacy_10_0; skipped.", "Journal contains 2 newer-schema pinned event(s); those events were ignored."} <= said
    assert [r.revision for r in legacy.facts(rows).where("id = 'cf_a'").collect()] == [2]


def test_capacity_warnings(spark):
    many = [{"version": 3, "op": "add", "fact": FACT | {"id": f"cf_{k}", "text": f"{k} " + "y" * 300}} for k in range(51)]
    said = [r.text for r in legacy.warnings(legacy.rebuild(entries(spark, *many))).where("whole").orderBy("place").collect()]
    assert said == ["Active fact count 51 exceeds limit 50.", f"Active text size {sum(len(str(k)) + 301 for k in range(51))} exceeds limit 12000."]


def test_no_entries(spark):
    rows = legacy.rebuild(entries(spark).limit(0))
    assert rows.count() == 0 and legacy.diagnostics(rows).count() == 0


def written(spark, n, at=0):
    columns = "branch_id string, seq long, command string, id string, type string, text string, priority int, hot boolean, at long"
    return spark.createDataFrame([(f"b{k % 3}", k + at, "add", None, "finding", f"t{k + at}", None, None, 5 + k) for k in range(n)], columns)


def test_write_then_rebuild(spark, tmp_path):
    path, engine = str(tmp_path / "journal"), Engine(spark)
    requests = written(spark, 9)
    judged = engine.write(requests, path).collect()
    assert engine.write(requests, path).count() == 9 and journal.committed(spark, path).count() == 9
    made = {r.id for r in judged}
    more = requests.withColumns({"command": F.lit("revise"), "id": F.lit(min(made)), "seq": F.col("seq") + 100, "at": F.lit(1).cast("long"), "text": F.lit("new")}).where(f"branch_id = '{next(r.branch_id for r in judged if r.id == min(made))}'").limit(1)
    engine.write(requests.unionByName(more), path)
    rows = engine.rebuild(path)
    assert {r.id for r in legacy.facts(rows).collect()} == made
    assert {(r.text, r.revision) for r in legacy.facts(rows).where(F.col("id") == min(made)).collect()} == {("new", 2)}
    assert journal.last_commit(spark, path) == 2
    assert rows.where("part = 'verdict' and not accepted").count() == 0


def test_two_writers_leave_every_entry_once(spark, tmp_path):
    path = str(tmp_path / "journal")
    rows = [commands.journal_entries(commands.outcomes(written(spark, 6, at))) for at in (0, 3, 3, 50)]
    found, failed = [], []

    def write(part):
        try:
            found.append(journal.append(part, path).count())
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(part,)) for part in rows]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    every = {tuple(r) for part in rows for r in part.collect()}
    kept = journal.committed(spark, path).select(*journal.ENTRY).collect()
    assert sorted(map(tuple, kept)) == sorted(every) and sum(found) == len(every)
    assert spark.read.parquet(path).count() == len(every)  # lost batches are gone


def test_one_claim_wins(spark, tmp_path):
    path, won = str(tmp_path / "log"), []
    threads = [threading.Thread(target=lambda k=k: won.append(journal.claim(spark, path, 1, f"batch{k}"))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert won.count(True) == 1 and journal.last_commit(spark, path) == 1


def test_canonical(spark):
    rows = spark.createDataFrame([('{"b":1,"a":{"d":[2,{"f":1,"e":2}],"c":null}}',), ("no json",)], "t string")
    assert [r[0] for r in rows.select(journal.canonical(F.col("t"))).collect()] == ['{"a":{"c":null,"d":[2,{"e":2,"f":1}]},"b":1}', "no json"]


@pytest.mark.parametrize("every", [1, 3])
def test_snapshots_while_writing(spark, every):
    rows = fixtures.commands(fixtures.table(spark, SF, "events"))
    plain = legacy.facts(legacy.rebuild(commands.journal_entries(commands.outcomes(rows))))
    often = commands.journal_entries(commands.outcomes(rows, every=every)).checkpoint()
    assert often.where("data like '%snapshot%'").count() > 10
    assert sorted(map(str, legacy.facts(legacy.rebuild(often)).collect())) == sorted(map(str, plain.collect()))
    assert events.class_of(often, "data").where("kind != 'v3'").count() == 0


def test_stale_revision_replayed(spark):
    change = lambda r: {"version": 3, "op": "supersede", "id": "cf_a", "replacement": FACT | {"text": f"rev {r}", "revision": r, "updatedAt": r}, "at": r}
    rows = legacy.rebuild(entries(spark, {"version": 3, "op": "add", "fact": FACT}, change(2), change(3), change(2)))
    assert [r.text for r in legacy.facts(rows).collect()] == ["rev 3"]
    assert [r.text for r in legacy.warnings(rows).collect()] == ["Stale supersede for cf_a ignored (rev 2 <= 3)."]
    assert replay.C.SNAPSHOT_EVERY == 100


def test_blocks_of_unmoved_branches_are_taken_over(spark):
    from factloom.operators import blocks

    add = lambda b, k, n: (b, n, legacy.EVENT_ENTRY, json.dumps({"version": 3, "op": "add", "fact": FACT | {"id": f"cf_{k}", "text": f"t{k}"}}))
    gone = ("z", 9, legacy.EVENT_ENTRY, json.dumps({"version": 3, "op": "revoke", "id": "cf_1", "at": 9}))
    rows = [add("a", 1, 1), add("b", 1, 1), add("z", 1, 1), add("b", 1, 2)]
    first, second = (legacy.rebuild(spark.createDataFrame(r, ENTRIES)).checkpoint() for r in (rows, [*rows, add("b", 2, 3), add("c", 1, 1), gone]))
    stored = blocks.packed(legacy.facts(first), blocks.revisions(first)).checkpoint()
    assert {r.branch_id: r.revision for r in stored.collect()} == {"a": 1, "b": 1, "z": 1}
    marked = stored.withColumn("text", F.concat(F.lit("old "), "text"))  # what is taken over, not packed
    got = {r.branch_id: r for r in blocks.refreshed(marked, legacy.facts(second), blocks.revisions(second)).collect()}
    assert {k: (r.renewed, r.revision, r.text.startswith("old "), r.n_facts) for k, r in got.items()} == {"a": (False, 1, True, 1), "b": (True, 3, False, 2), "c": (True, 1, False, 1)}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Batches of any cut, with a restart between them, give the verdicts of one batch fold."""
    from factloom.streaming import replay_stream

    table = fixtures.table(spark, SF, "events")
    (tmp_path / "in").mkdir()
    out, parts = str(tmp_path / "out"), [table.where(f"event_id % 1000 < {b} and event_id % 1000 >= {a}") for a, b in ((0, 150), (150, 500), (500, 1000))]
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
        replay_stream.run(replay_stream.words(fixtures.snapshot_journal(stream)), out)
    got = spark.read.parquet(f"{out}/verdicts").select("branch_id", "seq", "id", "code", "mutations")
    want = replay.words(fixtures.snapshot_journal(table)).select("branch_id", "seq", "id", "code", "mutations")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_key_is_one_fold_behind_a_join_that_turns_into_a_broadcast(spark):
    """The join is planned by shuffles on the key and broadcast once the sizes are known."""

    class Count:
        def __init__(self, key):
            self.key, self.n = key, 0

        def add(self, row):
            self.n += 1
            return []

        def finish(self):
            return [(self.key, self.n)]

    rows = spark.range(0, 4000, 1, 6).select((F.col("id") % 40).cast("string").alias("k"), "id")
    start = rows.groupBy("k").agg(F.min("id").alias("start"))
    sizes = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for name, value in sizes.items():
            spark.conf.set(name, value)
        got = runs.fold(rows.join(start, "k", "left"), "k", ["id"], Count, "k string, n long").collect()
    finally:
        for name in sizes:
            spark.conf.unset(name)
    assert sorted((r.k, r.n) for r in got) == sorted((str(k), 100) for k in range(40))


def test_a_revoke_of_the_first_version_has_no_text_to_be_unsafe(spark):
    rows = legacy.rebuild(entries(spark, {"version": 1, "op": "add", "fact": FIRST}, {"version": 1, "op": "revoke", "id": "cf_a", "at": 5}))
    assert [(r.kind, r.code, r.effect) for r in rows.where("part = 'verdict' and seq = 1").collect()] == [("v1", "ok", "migrated")]
