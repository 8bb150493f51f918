import json

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators import commands, legacy, replay
from factloom.operators.replay import Branch

FACT = {"type": "finding", "text": "a", "created_at": 1, "updated_at": 1, "hot": False, "priority": 50, "priority_explicit": False, "revision": 1}


def fact(**more):
    return FACT | more


def test_stale_supersede_is_ignored():
    b = Branch()
    codes = [b.apply("add", "cf_a", fact())] + [b.apply("supersede", "cf_a", fact(revision=r, text=f"t{r}", updated_at=r)) for r in (2, 3, 2)]
    assert codes == ["ok", "ok", "ok", "supersede-stale"]
    assert b.facts["cf_a"]["revision"] == 3


def test_revokes():
    b = Branch()
    assert b.apply("revoke", "cf_x", at=5) == "ok-orphan"
    assert b.apply("revoke", "cf_x", at=5) == "revoke-duplicate"
    assert b.apply("revoke", "cf_x", at=6) == "ok-later"
    assert b.apply("add", "cf_x", fact()) == "add-revoked"
    b.apply("add", "cf_a", fact(updated_at=10))
    assert b.apply("revoke", "cf_a", at=9) == "revoke-stale"
    assert b.apply("revoke", "cf_a", at=10) == "ok"
    assert b.tombs["cf_a"] == [2, 10]


def test_duplicates_are_canonical():
    b = Branch()
    assert b.apply("add", "cf_a", fact(text="ﬁne  x")) == "ok"
    assert b.apply("add", "cf_b", fact(text="fine x")) == "add-duplicate"
    assert b.apply("add", "cf_b", fact(text="Fine x")) == "ok"
    assert b.apply("add", "cf_b", fact(text="Fine x")) == "add-identical"
    assert b.apply("add", "cf_b", fact(text="other")) == "add-conflict"
    assert b.apply("supersede", "cf_b", fact(text="fine x", revision=2)) == "supersede-duplicate"
    assert b.apply("supersede", "cf_b", fact(text="z", revision=3)) == "supersede-gap"


events = st.lists(st.tuples(st.sampled_from(["add", "supersede", "revoke"]), st.sampled_from(["cf_a", "cf_b", "cf_c"]), st.integers(1, 4), st.integers(0, 4), st.integers(1, 9)), max_size=40)


@settings(max_examples=200, deadline=None)
@given(events)
def test_snapshot_then_replay_is_replay(rows):
    b, cut = Branch(), len(rows) // 2
    for k, (op, i, rev, text, at) in enumerate(rows):
        if k == cut:
            snap = b.to_snapshot(1)
            again = Branch()
            assert again.apply("snapshot", "", None, snap["at"], json.loads(json.dumps(snap))) == "ok"
            assert (again.facts, again.tombs) == ({f["id"]: {k: v for k, v in f.items() if k != "id"} for f in snap["facts"]}, b.tombs)
        b.apply(op, i, fact(text=f"t{text}", revision=1 if op == "add" else rev, updated_at=at), at)
        assert b.check() == []
        before = (json.dumps(b.facts, sort_keys=True), json.dumps(b.tombs, sort_keys=True))
        b.apply(op, i, fact(text=f"t{text}", revision=1 if op == "add" else rev, updated_at=at), at)
        assert (json.dumps(b.facts, sort_keys=True), json.dumps(b.tombs, sort_keys=True)) == before  # an event twice changes nothing


def test_stream_split_gives_the_same_state(spark):
    from factloom.plans import fixtures
    from factloom.streaming import replay_stream

    sf = "/root/testdata/sf0.001"
    batch = replay.active(replay.verdicts(fixtures.journal(fixtures.table(spark, sf, "events"))))
    assert sorted(map(tuple, replay_stream.state(spark, sf).collect())) == sorted(map(tuple, batch.collect()))


def entry(seq, data, kind=legacy.EVENT_ENTRY):
    return ("b", seq, kind, data if isinstance(data, str) else json.dumps(data))


def test_generations(spark):
    old = {"id": "cf_a", "type": "tz_approved", "text": " spec ", "createdAt": 1, "updatedAt": 2}
    new = {"id": "cf_b", "type": "finding", "text": "b", "createdAt": 1, "updatedAt": 2, "hot": True, "priority": 9, "priorityExplicit": True, "revision": 1}
    rows = [
        entry(1, {"version": 1, "op": "add", "fact": old}),
        entry(2, {"version": 3, "op": "add", "fact": new}),
        entry(3, {"version": 4, "op": "add", "fact": new}),
        entry(4, {"version": 3, "op": "revoke", "id": "cf_b", "at": 5, "reason": "x" * 501}),
        entry(5, {"version": 3, "op": "revoke", "id": "cf_b", "at": 5, "reason": None}),
        entry(6, {"version": 2, "op": "revoke", "id": "cf_b", "at": 5}),
        entry(7, "not json"),
        entry(8, {"type": "decision", "text": "alone", "timestamp": 36}, legacy.FACT_ENTRY),
        entry(9, {"type": "decision", "text": "alone", "timestamp": 37}, legacy.FACT_ENTRY),
        entry(10, {"type": "decision", "text": "", "timestamp": 37}, legacy.FACT_ENTRY),
        entry(11, {}, "other"),
        entry(12, {"version": 3, "op": "add", "fact": new | {"id": "cf_c\n"}}),
        entry(13, {"version": 3, "op": "snapshot", "facts": [new | {"id": "cf_d"}], "revoked": {"cf_e": {"revision": 1, "at": 3}}, "at": 9}),
        entry(14, None),
    ]
    got = {r.seq: (r.kind, r.code) for r in legacy.outcomes(spark.createDataFrame(rows, "branch_id string, seq long, entry_type string, data string")).collect()}
    assert got == {
        1: ("v1", "ok"), 2: ("v3", "ok"), 3: ("future", "future"), 4: ("invalid", "invalid"), 5: ("invalid", "invalid"), 6: ("v2b", "ok"), 7: ("invalid", "invalid"),
        8: ("standalone", "ok"), 9: ("standalone", "legacy-duplicate"), 10: ("standalone", "legacy-invalid"), 12: ("invalid", "invalid"), 13: ("v3", "ok"), 14: ("invalid", "invalid"),
    }


def test_commands(spark):
    columns = "branch_id string, seq long, command string, id string, type string, text string, priority int, hot boolean, at long"
    first = spark.createDataFrame([("b", 1, "add", None, "finding", "x", None, None, 5)], columns)
    made = commands.outcomes(first).first()
    rows = [
        ("b", 1, "add", None, "finding", "x", None, None, 5), ("b", 2, "add", None, "finding", " x ", None, None, 6), ("b", 3, "revise", made.id, None, None, None, True, 7),
        ("b", 4, "revise", made.id, None, None, None, True, 8), ("b", 5, "revise", "cf_none", None, "y", None, None, 8), ("b", 6, "forget", "bad id", None, None, None, None, 9),
        ("b", 7, "forget", made.id, None, None, None, None, 9), ("b", 8, "add", None, "finding", "", None, None, 9), ("b", 9, "add", None, "odd", "z", None, None, 9),
    ]
    rows += [("c", k, "add", None, "finding", f"t{k}", None, None, 5) for k in range(51)]
    got = commands.outcomes(spark.createDataFrame(rows, columns)).collect()
    assert [r.outcome for r in sorted(got, key=lambda r: r.seq) if r.branch_id == "b"] == ["ok", "duplicate", "ok", "unchanged", "missing", "bad-id", "ok", "bad-text", "bad-type"]
    assert json.loads(next(r.event for r in got if r.branch_id == "b" and r.seq == 3))["replacement"]["priority"] == 80
    assert [r.outcome for r in got if r.branch_id == "c"].count("full") == 1


def test_append_is_idempotent(spark, tmp_path):
    from factloom.sources import journal

    events = spark.createDataFrame([("b", 1, "x"), ("b", 2, "y"), ("b", 2, "y")], "branch_id string, seq long, event string")
    path = str(tmp_path / "journal")
    assert journal.append(events, path).count() == 2
    assert journal.append(events, path).count() == 0
    more = events.unionByName(spark.createDataFrame([("b", 3, "z")], events.schema))
    assert journal.append(more, path).count() == 1
    assert spark.read.parquet(path).count() == 3
