import json

import pandas as pd
from pyspark.sql import functions as F

from factloom.api import Engine
from factloom.operators import evaluate, gates, lineage, notices, replay, requests
from factloom.plans import fixtures
from factloom.sources import journal

SF = "/root/testdata/sf0.001"


def test_automatic_snapshots_replay_to_the_same_state(spark):
    rows = fixtures.journal(fixtures.table(spark, SF, "events"))
    snaps = replay.auto_snapshots(rows, 8)
    assert snaps.count() > 10
    events = [r.asDict() | {"place": (r.seq, 0), "snapshot": None} for r in rows.collect()]
    events += [{"branch_id": r.branch_id, "op": "snapshot", "id": "", "text": None, "revision": None, "at": r.at, "updated_at": None, "snapshot": r.snapshot, "place": (r.seq, 1)} for r in snaps.collect()]
    with_snaps = [e | {"seq": k} for k, e in enumerate(sorted(events, key=lambda e: e["place"]))]
    frame = spark.createDataFrame([{k: v for k, v in e.items() if k != "place"} for e in with_snaps], "branch_id string, seq long, op string, id string, text string, revision int, at long, updated_at long, snapshot string")
    plain, again = Engine(spark).state(rows), Engine(spark).state(frame)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, again.collect()))
    assert replay.verdicts(frame).where("op = 'snapshot' and not accepted").count() == 0


def test_nothing_to_snapshot(spark):
    rows = fixtures.journal(fixtures.table(spark, SF, "events"))
    assert replay.auto_snapshots(rows, 10_000).count() == 0
    assert replay.auto_snapshots(rows.limit(0)).count() == 0
    revoked = spark.createDataFrame([("b", 1, "add", "cf_a", "t", 2, 5, 5), ("c", 1, "supersede", "cf_a", "t", 2, 5, 5)], rows.schema)
    assert {r.branch_id: r.action for r in replay.compacted(revoked).collect()} == {"b": "written", "c": "empty"}


def test_requests_of_odd_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("\tSTATUS\u00a0",), ("compare  a  b",), ("7x 99999999999999999999 2",), ("0",)], "raw string")
    got = rows.select(*(v.alias(k) for k, v in requests.analysis(F.col("raw")).items()), requests.switch(F.col("raw")).alias("switch"), *(v.alias(f"p_{k}") for k, v in requests.page(F.col("raw")).items())).collect()
    assert [r.kind for r in got] == ["current", "current", "status", "compare", "usage", "usage"]
    assert got[3].target == "a  b"
    assert [r.switch for r in got] == ["on", "on", "status", "usage", "usage", "usage"]
    assert [r.p_page for r in got] == [1, 1, 1, 1, 999_999_999, 1]
    assert [r.p_full for r in got] == [False] * 6


def test_gates_pass_and_fail(spark):
    text = "[untrusted persisted data] <a> <b>"
    contexts = spark.createDataFrame([("x", text, len(text), 8), ("y", text, 10_001, 8)], "branch_id string, text string, total_chars long, tokens long")
    base = spark.createDataFrame([("x", 16), ("y", 16)], "branch_id string, tokens long")
    must = spark.createDataFrame([("x", "<a>"), ("x", "<b>"), ("y", "<c>")], "branch_id string, text string")
    none = must.limit(0)
    got = {r.branch_id: r for r in gates.measured(contexts, base, must, none).collect()}
    assert (got["x"].required_recall, got["x"].leakage, got["x"].budget_ok, got["x"].framed) == (1, 0, True, True)
    assert (got["y"].required_recall, got["y"].n_found, got["y"].budget_ok) == (0, 0, False)
    only = contexts.where("branch_id = 'x'")
    assert gates.judged(gates.measured(only, base, must, none)).first().passed
    assert not gates.judged(gates.measured(only, base, must, must)).first().passed
    assert not gates.judged(gates.measured(only.limit(0), base, must, none)).first().passed


def test_evaluations_that_lack_things(spark):
    scores = dict.fromkeys(evaluate.C.METRICS, 50)
    full = {"scores": scores, "confidence": "0.5", "summary": "s", "issues": ["a", 1, None, {"b": 2}] + ["c"] * 20}
    docs = [None, "", "[]", "3", "{}", json.dumps(full), json.dumps(full | {"confidence": 2}), json.dumps(full | {"scores": scores | {"task": "1e400"}}), json.dumps(full | {"scores": scores | {"task": "0x10"}})]
    rows = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, raw string")
    got = {r.k: r for r in evaluate.evaluations(rows, "raw").collect()}
    assert [k for k in got if got[k].valid] == [5] and got[5].mean == 50.0
    assert got[5].issues == ["a"] + ["c"] * 11 and got[5].evidence == [] and got[0].issues == []


def test_comparison_session_errors(spark):
    rows = spark.createDataFrame([("/s/a1.jsonl", "/w", 1, 3), ("/s/a2.jsonl", "/w", 2, 0), ("/s/b.jsonl", "/v", 3, 3), ("/s/c.jsonl", None, 9, 3)], "path string, cwd string, modified long, n_messages long")
    ask = lambda targets, current=None: {r.target: (r.path, r.how) for r in lineage.comparisons(rows, targets, "/w", "/s", current).collect()}
    got = ask(["PREVIOUS", "a", "a2.jsonl", "b", "c", "zz", "a"])
    assert got == {"PREVIOUS": ("/s/a1.jsonl", "previous"), "a": ("/s/a1.jsonl", "match"), "a2.jsonl": (None, "no-messages"), "b": (None, "other-folder"), "c": (None, "other-folder"), "zz": (None, "missing")}
    assert ask(["previous"], "/s/a1.jsonl") == {"previous": (None, "missing")}


def test_readers_of_optional_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 30)
    (tmp_path / "b.txt").write_text("short")
    got = {r.path.rsplit("/", 1)[1]: r for r in journal.optional_text(spark, [str(tmp_path)], 20).collect()}
    assert got["a.txt"].truncated and got["a.txt"].source_chars == 30 and got["b.txt"].text == "short"
    assert journal.optional_text(spark, [], 20).count() == 0
    rows = spark.createDataFrame(pd.DataFrame({"k": [0, 1, 2, 3], "raw": ["{}", "null", "{", ""]}))
    assert {r.k: r.problem for r in journal.json_objects(rows, "raw").collect()} == {0: None, 1: "no-object", 2: "no-json", 3: None}


def test_notices(spark):
    rows = spark.createDataFrame([("b", k, n, 0) for k, n in enumerate([39, 40, 41, 39, 40])], "branch_id string, seq long, n_facts long, n_chars long")
    assert [r.seq for r in notices.near_limit_notices(rows).orderBy("seq").collect()] == [1, 4]
    few = spark.createDataFrame([("b", 5, "x"), ("b", 3, "y")], "branch_id string, seq long, code string")
    assert notices.warning_notices(few).first().text == "2 warning(s).\n• 3 y\n• 5 x"
    one = spark.range(1).select(notices.message("page", "fr", page=F.lit(1), pages=F.lit("{mode}"), mode=F.lit("m")).alias("t"))
    assert one.first().t == "Page 1 of {mode}, m"
