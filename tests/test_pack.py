"""Packing with rows sieved out where they are read gives what packing all rows gives."""

import random

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import pack, runs

FACT = "branch_id string, id string, type string, text string, created_at long, updated_at long, hot boolean, priority int, revision int"


def random_facts(spark, seed, n):
    """One branch holds nine facts of ten; many sizes are equal, some texts are longer than any budget."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        size = rng.choice([1, 2, 3, 5, 8, 40, 40, 120, 400, 1900, 12000])
        rows.append(("b_hot" if k % 10 else f"b_{k % 7}", f"cf_{k}", rng.choice(["finding", "decision", "milestone"]), rng.choice("aé漢😀") * size, 0, rng.randrange(50), rng.random() < 0.2, rng.randrange(101), 1))
    return spark.createDataFrame(rows, FACT).repartition(7)


def folded(rows, order, make):
    """Every row through one packer a branch, on the driver."""
    out, current, packer = [], None, None
    for row in rows.orderBy("branch_id", *order).collect():
        if row["branch_id"] != current:
            out += packer.finish() if packer else []
            current, packer = row["branch_id"], make(row["branch_id"])
        packer.add(row.asDict())
    return sorted(map(tuple, out + packer.finish()))


def test_sieved_packing_is_packing_of_all_rows(spark, monkeypatch):
    facts = random_facts(spark, 5, 3000)
    plain = {}
    with monkeypatch.context() as m:
        m.setattr(pack, "sieved_facts", lambda rows, budget, sizes: rows.withColumn("standing", F.lit(1).cast("long")))
        for budget in (700, 2500, 10000):
            plain["context", budget] = folded(pack._first_fit(facts, T.fact_line(), budget), pack.rank_order(), lambda b: pack.ContextPacker(b, budget))
        plain["greedy"] = sorted(map(tuple, pack.greedy(facts).collect()))
        plain["compact"] = sorted(map(tuple, pack.compactions(facts, 3000).collect()))
    for budget in (700, 2500, 10000):
        rows = runs.fold(pack._first_fit(facts, T.fact_line(), budget), "branch_id", pack.rank_order(), lambda b: pack.ContextPacker(b, budget), pack.CONTEXT)
        assert sorted(map(tuple, rows.collect())) == plain["context", budget]
    assert sorted(map(tuple, pack.greedy(facts).collect())) == plain["greedy"]
    assert sorted(map(tuple, pack.compactions(facts, 3000).collect())) == plain["compact"]


def test_few_rows_of_a_hot_branch_reach_its_fold(spark):
    n = 60_000
    facts = spark.range(n).selectExpr("'b' branch_id", "concat('cf_', id) id", "'finding' type", "repeat('x', 300 + id % 5) text", "id created_at", "id updated_at", "false hot", "50 priority", "1 revision")
    kept = pack._first_fit(facts, T.fact_line(), 10000)
    assert kept.agg(F.sum("standing")).first()[0] == n
    assert kept.where("index_line is not null").count() < n / 8
    row = pack.contexts(facts).first()
    assert (row["n_facts"], row["n_expanded"] + row["n_indexed"] + row["n_omitted"]) == (n, n)


def test_facts_without_text_are_left_out_and_counted(spark):
    rows = spark.createDataFrame([("b", "cf_1", "finding", None, 0, 1, True, 50, 1), ("b", "cf_2", "finding", "said", 0, 1, False, 50, 1)], FACT)
    row = pack.contexts(rows).first()
    assert (row["n_facts"], row["n_expanded"], row["n_omitted"]) == (2, 1, 1)
    assert pack.contexts(rows.limit(0)).count() == pack.compactions(rows.limit(0)).count() == 0
    assert pack.compactions(rows).first()["n_facts"] == 2
