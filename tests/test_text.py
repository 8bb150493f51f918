from pyspark.sql import functions as F

from factloom import constants as C
from factloom.functions import rules as R
from factloom.functions import text as T
from factloom.operators import audit, lineage, pack, transcript

FACT = "branch_id string, id string, type string, text string, created_at long, updated_at long, hot boolean, priority int, priority_explicit boolean, revision int"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_units_and_spaces(spark):
    assert one(spark, "a😀b", T.utf16_length) == 4
    assert one(spark, " ﻿ x　y  ", T.trim) == "x　y"
    assert one(spark, "a  \n b", T.collapse) == "a b"
    assert one(spark, "a\x00\x7f\r\nb\rc\t", T.normalise) == "a\nb\rc"
    assert one(spark, "ﬁ", T.nfkc) == "fi"
    assert one(spark, "я" * 10, T.tokens) == 5
    assert one(spark, "x" * 121, T.preview) == "x" * 119 + "…"
    assert one(spark, "", T.tokens) == 0
    assert one(spark, None, T.normalise) is None


def test_ids_and_rounding(spark):
    assert [one(spark, x, R.valid_id) for x in ("cf_a", "CF_A-1", "cf_a\n", "cf_", "x", None, "cf_" + "a" * 126)] == [True, True, False, False, False, False, False]
    assert spark.range(1).select(R.round2(F.lit(1.005)).alias("y")).first().y == 1.0
    assert spark.range(1).select(R.ratio(F.lit(1), F.lit(0)).alias("y")).first().y == 0.0


def facts(spark, n, size, branch="b", **more):
    row = lambda k: (branch, f"cf_{k}", "finding", f"{k} " + "x" * size, 1, 1, more.get("hot", False), k % 100, True, 1)
    return spark.createDataFrame([row(k) for k in range(n)], FACT)


def test_budget_holds_and_index_goes_first(spark):
    for n, size in ((0, 1), (1, 5), (50, 150), (45, 240), (500, 200), (3, 9_700), (200, 9_000)):
        rows = pack.contexts(facts(spark, n, size)).collect()
        assert len(rows) == (n > 0)
        for r in rows:
            assert r.total_chars == len(r.text) <= C.CONTEXT_BUDGET
            assert r.n_expanded + r.n_indexed + r.n_omitted == n
            assert r.text.startswith(C.CONTEXT_HEADER) and r.text.endswith(C.CONTEXT_FOOTER)
        for r in pack.compactions(facts(spark, n, size)).collect():
            assert r.total_chars == len(r.text) <= C.COMPACTION_BUDGET


def test_page_of_long_facts(spark):
    r = pack.pages(facts(spark, 3, 9_000), with_text=True).first()
    assert len(r.text) <= C.LIST_BUDGET and r.returned == 1 and r.next_offset == 1
    assert pack.pages(facts(spark, 3, 5), offset=2).first().next_offset is None


def test_audit_golden(spark):
    line = lambda i, p: f'<fact id="cf_{i}" type="finding" p="{p}">t</fact>'
    base = spark.createDataFrame([("b", "\n".join(line(i, p) for i, p in (("a", 95), ("b", 50), ("c", 20))))], "branch_id string, text string")
    compact = spark.createDataFrame([("b", line("a", 95) + "\n- cf_b · finding · p50")], "branch_id string, text string")
    r = audit.audit(base, compact).first()
    assert (r.fact_recall, r.expanded_recall, r.critical_loss, r.index_only, r.unexpected) == (2 / 3, 1 / 3, 0, 1, 0)
    spoof = spark.createDataFrame([("b", line("a", 95) + line("a", 95) + "\n- cf_z · decision · p1 · HOT · x\n- cf_y · decision · p101")], "branch_id string, text string")
    r = audit.audit(base, spoof).first()
    assert (r.unexpected, r.duplicates, r.contamination) == (1, 1, 1.0)
    codes = [x.code for x in audit.recommendations(audit.audit(base, spoof), F.lit(False)).orderBy("place").collect()]
    assert codes[0] == "runtime-inactive" and "stale-or-unexpected" in codes and "context-contamination" in codes


def test_dialogues():
    read = transcript.read_dialogue
    assert [m["role"] for m in read('[{"role":"user","content":"a"},{"role":"toolResult","content":[{"text":"b"},{"type":"image"}]}]')] == ["user", "tool"]
    assert read('{"type":"message","id":"e","message":{"role":"user","content":"a"}}\n{"type":"compaction","summary":" s "}')[1]["content"].endswith("\ns")
    assert read('{"role":"user","content":"a"}\n\n{"role":"user","content":"b"}\n') and read("plain")[0]["content"] == "plain"
    deep = {"role": "user", "content": "x"}
    for _ in range(3000):
        deep = [deep]
    assert transcript.flatten(deep)[0]["content"] == "x"
    assert transcript.first_json_object('a {"k": "}"} b') == '{"k":"}"}'
    assert transcript.first_json_object("none {") is None


def test_lineage_cycle(spark):
    rows = [("a", None, 1), ("b", "a", 2), ("c", "b", 3), ("x", "y", 4), ("y", "x", 5), ("z", "x", 6), ("o", "gone", 7)]
    got = {r.id: (r.root, r.depth) for r in lineage.roots(spark.createDataFrame(rows, "id string, parent string, modified long")).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "x": (None, None), "y": (None, None), "z": (None, None), "o": ("o", 0)}
