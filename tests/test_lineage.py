"""Sessions below others, their places, and the names users give them."""

import random

import pytest

from factloom.api import Engine
from factloom.operators import lineage
from factloom.operators.ordering import numbered


def frame(spark, parents):
    return spark.createDataFrame([(k, p, n) for n, (k, p) in enumerate(parents.items())], "id string, parent string, modified long")


def climbed(parents):
    """Pairs of a session and each other one that its parents lead to."""
    out = set()
    for start in parents:
        at, seen = parents[start], set()
        while at in parents and at not in seen:
            seen.add(at)
            out.add((at, start))
            at = parents[at]
    return {(a, b) for a, b in out if a != b}


@pytest.mark.parametrize("seed", range(3))
def test_below(spark, seed):
    rng = random.Random(seed)
    names = [f"s{k}" for k in range(40)]
    parents = {n: rng.choice([None, "gone", *names[max(0, k - 4) : k], *names[max(0, k - 4) : k]]) for k, n in enumerate(names)}
    parents |= {"c1": "c2", "c2": "c3", "c3": "c1", "d": "c2", "e": "d", "self": "self", "under": "self", "s3": "s3" if seed else None}
    sessions = frame(spark, parents)
    labels = lineage.intervals(sessions).checkpoint()
    targets = spark.createDataFrame([(n,) for n in [*parents, "nobody"]], "target string")
    want = climbed(parents)
    assert {tuple(r) for r in lineage.below(labels, targets).collect()} == want
    assert {r.id: r.n_below for r in lineage.sizes(labels).collect()} == {n: sum(a == n for a, _ in want) for n in parents}


def test_inner_sessions_have_children(spark):
    got = Engine(spark).children(frame(spark, {"a": None, "b": "a", "c": "b"}), "b", "a").collect()
    assert [(r.target, r.id) for r in got] == [("a", "c"), ("a", "b"), ("b", "c")]


def test_a_long_chain_and_no_sessions(spark):
    labels = lineage.intervals(frame(spark, {f"n{k}": f"n{k - 1}" if k else None for k in range(70)}))
    assert {r.n_below for r in lineage.sizes(labels).collect()} == set(range(70))
    assert lineage.intervals(frame(spark, {"a": None}).limit(0)).count() == 0


def test_folder_named_like_a_session(spark):
    parents = {"/s/a.jsonl": None, "/s/a/b.jsonl": None, "/s/a/deep/c.jsonl": "/s/x.jsonl", "/s/ab/d.jsonl": None, "/s/x.jsonl": None}
    got = Engine(spark).children(frame(spark, parents), "/s/a.jsonl", "/s/x.jsonl").collect()
    assert {(r.target, r.id) for r in got} == {("/s/a.jsonl", "/s/a/b.jsonl"), ("/s/a.jsonl", "/s/a/deep/c.jsonl"), ("/s/x.jsonl", "/s/a/deep/c.jsonl")}


def test_resolved(spark):
    sessions = frame(spark, {"abc": None, "abd": None, "b": None, "/w/f.jsonl": None, "2": None})
    targets = spark.createDataFrame([(x,) for x in ("1", "2", "9", "abc", "ab", "b", "/w/f.jsonl", "/w", "", "zz")], "target string")
    got = {r.target: (r.id, r.how) for r in lineage.resolved(targets, sessions).collect()}
    assert got == {"1": ("2", "place"), "2": ("/w/f.jsonl", "place"), "9": (None, "none"), "abc": ("abc", "id"), "ab": (None, "ambiguous"), "b": ("b", "id"), "/w/f.jsonl": ("/w/f.jsonl", "id"), "/w": ("/w/f.jsonl", "prefix"), "": (None, "none"), "zz": (None, "none")}
    assert not [n for n in ("Window", "CartesianProduct") if n in lineage.resolved(targets, sessions)._jdf.queryExecution().executedPlan().toString()]


def test_numbered(spark):
    rows = spark.range(500).selectExpr("id", "hash(id) % 9 as k")
    got = [tuple(r) for r in numbered(rows, rows["k"].desc(), rows["id"]).orderBy("place").collect()]
    assert [r[2] for r in got] == list(range(1, 501)) and [r[:2] for r in got] == sorted((tuple(r) for r in rows.collect()), key=lambda r: (-r[1], r[0]))
    assert numbered(rows.limit(0), "id").count() == 0
