import json

import pytest
from pyspark.sql import functions as F

from factloom import queries
from factloom.operators import audit, evaluate, pack, prompts, reports
from factloom.sources import config


def parsed(spark, text):
    rows = audit.parse(spark.createDataFrame([("b", text)], "branch_id string, text string")).orderBy("source", "pos").collect()
    return [(r.source, r.id, r.type, r.priority, r.hot, r.fact_text) for r in rows]


def test_facts_written_as_elements(spark):
    one = lambda tag, body="x": f"<fact {tag}>{body}</fact>"
    good = 'id="cf_a" type="finding" p="7"'
    assert parsed(spark, one(good, "a &lt;b&gt; &amp;lt;\nc")) == [("expanded", "cf_a", "finding", 7, False, "a <b> &lt;\nc")]
    assert parsed(spark, one('p="7" hot type="finding" id="cf_a"'))[0][4]
    assert parsed(spark, f"</fact> <factor> <fact> {one(good)}") == []  # the first start tag holds everything up to the end tag
    assert len(parsed(spark, one(good).upper().replace("CF_A", "cf_A").replace("FINDING", "finding").replace("ID=", "id=").replace("TYPE=", "type=").replace(" P=", " p="))) == 1
    for bad in ('id="x_a" type="finding" p="7"', 'id="cf_a" type="rumour" p="7"', 'id="cf_a" type="finding" p="101"', 'id="cf_a" type="finding" p="7', 'id="cf_a" type="finding"', 'xid="cf_a" type="finding" p="7"'):
        assert parsed(spark, one(bad)) == [], bad
    assert parsed(spark, f"<fact {good}>open") == [] and parsed(spark, "") == []


def test_facts_written_as_lines(spark):
    assert parsed(spark, "- cf_a · finding · p7") == [("index", "cf_a", "finding", 7, False, "")]
    assert parsed(spark, "  -  cf_a · finding · p7 · HOT · more · p9  \r\n- cf_b · decision · p0 · HOT") == [("index", "cf_a", "finding", 7, True, ""), ("index", "cf_b", "decision", 0, True, "")]
    assert not parsed(spark, "- cf_a · finding · p7 · HOT-ish")[0][4]
    for bad in ("cf_a · finding · p7", "-cf_a · finding · p7", "- cf_a· finding · p7", "- cf_a ·finding · p7", "- cf_a · finding · 7", "- cf_a · finding · p7x", "- cf_a · finding", "- cf_a · finding · p7 ·HOT", "- cf_a · finding · p101", "- cf_a b · finding · p7"):
        assert parsed(spark, bad) == [], bad


def test_evidence_names_ids_in_the_order_of_their_contexts(spark):
    text = lambda ids: "\n".join(f'<fact id="cf_{i}" type="finding" p="1">{"t" * 40}</fact>' for i in ids)
    of = lambda ids: spark.createDataFrame([("b", text(ids))], "branch_id string, text string")
    said = {r.code: r.evidence for r in audit.recommendations(audit.with_names(of(range(40, 0, -1)), of([99, 3, 50, 3]))).collect()}
    assert said["stale-or-unexpected"] == ["cf_99", "cf_50"]
    assert said["prune-low-priority"] == [f"cf_{i}" for i in range(40, 28, -1)]
    assert said["context-contamination"] == ["duplicateExpanded=1", "unexpected=2"] and said["priority-recall"] == ["priorityWeightedRecall=0.025"]


def test_state_is_audited_as_its_full_context(spark):
    rows = [("b", f"cf_{k}", "finding", "x<&>" * k + "длинный текст 😀" * (k % 3), 5, 5 + k % 2, k % 4 == 0, k % 5, True, 1) for k in range(40)] + [("c", "cf_1", "decision", "ы" * 500, 5, 5, False, 99, True, 1), ("d", "no id", "decision", "t", 5, 5, False, 99, True, 1)]
    facts = spark.createDataFrame(rows, "branch_id string, id string, type string, text string, created_at long, updated_at long, hot boolean, priority int, priority_explicit boolean, revision int")
    compact = spark.createDataFrame([("b", '<fact id="cf_2" type="finding" p="2">t</fact>\n- cf_z · finding · p1'), ("c", ""), ("d", "")], "branch_id string, text string")
    whole, parts = audit.with_names(pack.full_contexts(facts), compact), audit.of_state(facts, compact)
    assert parts.columns == whole.columns and sorted(parts.collect()) == sorted(whole.collect())
    assert parts.where("branch_id = 'b'").first().omitted_ids[0] == "cf_24"


def test_advice_on_a_pair_of_replays(spark):
    cases = [(-5.0, 0.0, 1, "quality-regression", ["meanDelta=-5.00", "taskCompletionDelta=0.00"]), (5.0, 0.0, 7, "quality-preserved-with-savings", ["meanDelta=5.00", "inputTokensSaved=7"]), (5.0, 0.0, None, None, None), (0.005, 9.0, 0, "quality-neutral", ["meanDelta=0.01"])]
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, mean double, task double, saved long")
    found = rows.select("k", evaluate.replay_recommendation(F.col("mean"), F.col("task"), F.col("saved")).alias("r")).orderBy("k").collect()
    assert [(r.r and r.r.code, r.r and r.r.evidence) for r in found] == [c[3:] for c in cases]


def test_values_are_quoted_by_both_ends(spark):
    text = "A=\"x\" # y\nB='x' # 'y'\nC=#x\nD=x #y # z\nE='\nF=\"a\\\\nb\"\nG =   g  \n export H=1\nexport\nI=1\nI='"
    rows = config.dotenv(spark.createDataFrame([("f", text)], "file string, content string"))
    assert {r.key: r.value for r in rows.collect()} == {"B": "x' # 'y", "C": "#x", "D": "x", "F": "a\\\nb", "G": "g", "H": "1", "I": "1"}


def test_prompts_leave_out_what_is_missing(spark):
    row = spark.range(1).select(*(F.lit(x).cast("string").alias(n) for n, x in (("d", None), ("none", None), ("c", "ctx"))))
    alone = row.select(prompts.evaluation(F.col("d"), F.col("none"), F.col("none"), F.col("c"), F.col("none"), F.col("none")).alias("p")).first().p
    assert "<dialogue>\n\n</dialogue>" in alone and "<compact-context>\nctx\n" in alone and "baseline" not in alone and prompts.CONTEXTS not in alone
    two = row.select(prompts.evaluation(F.col("d"), F.lit("x"), F.lit("b"), F.col("c"), F.lit("{}"), F.lit("{}")).alias("p")).first().p
    places = [two.index(x) for x in ("<left-dialogue>", "<right-dialogue>", "<baseline-context>", "<runtime>", "<compression-audit>", "<compact-context>", prompts.CONTEXTS, prompts.BOTH_SIDES, prompts.CLOSING)]
    assert places == sorted(places)


def test_report_without_contexts(spark):
    told = spark.createDataFrame([("b", 2, 10, 10, False)], "branch_id string, n_messages long, source_chars long, analysed_chars long, truncated boolean")
    nothing = told.where("false").drop("n_messages")
    base = spark.createDataFrame([], "branch_id string, text string")
    audited = audit.with_names(base, base)
    status = spark.createDataFrame([("b", "{}")], "branch_id string, status string")
    r = json.loads(reports.inputs_report(audited, audit.recommendations(audited), told, nothing, nothing, status).first().report)
    assert r == {"dialogue": {"messages": 2, "sourceChars": 10, "analyzedChars": 10, "truncated": False}, "compactContext": None, "baselineContext": None, "runtime": None, "compressionAudit": None, "recommendations": [], "contextComparison": None, "comparisonDialogue": None}


@pytest.mark.parametrize("name", ["audit_compression", "audit_contamination", "audit_recall_tiers", "audit_recommendations", "audit_sets", "audit_report", "audit_weighted_recall"])
def test_audit_queries_write_no_full_context(spark, monkeypatch, name):
    """A branch's full context is one row of any size; the audits read its facts one by one."""

    def never(facts):
        raise AssertionError("a full context is written")

    monkeypatch.setattr(queries.pack, "full_contexts", never)
    monkeypatch.setattr(queries, "settled", lambda df: df)
    assert "branch_id" in queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns
