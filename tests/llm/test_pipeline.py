"""The corpus pipeline, stage by stage, on a small table."""

import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from factloom.llm import quality_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark, stages):
    docs, rules, lines, joined, clean, mixed = stages
    for table in (rules, lines, joined, clean):
        assert table.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id").where("n_chars > 500")
    assert rules.join(good, "doc_id", "left_semi").count() >= 0.97 * good.count()
    # line dedup: no worded line stands twice
    text = lines.select(F.explode(F.split("text", "\n")).alias("x")).where(F.trim("x") != "")
    assert text.count() == text.select(F.trim("x")).distinct().count()
    assert mixed.count() == clean.count()


def words(pattern, text):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:4]:
        tables.append(spark.createDataFrame(stage(spark, tables[-1], sf).collect(), docs.schema))
    raw, rules, lines, joined, clean = ({r.doc_id: r.text for r in t.collect()} for t in tables)
    assert set(rules) == {r.doc_id for r in quality_rules.measures(docs).collect() if r.kept} and all(rules[k] == raw[k] for k in rules)

    # of the lines of equal or near-equal text the first stays
    strip = " \t\n\x0b\x0c\r"
    every = [(d, k, x.strip(strip)) for d in sorted(rules) for k, x in enumerate(rules[d].split("\n")) if x.strip(strip)]
    shingles = {x: {x[i : i + 7] for i in range(max(1, len(x) - 6))} for _, _, x in every}
    distinct, up = list(shingles), {}
    for b, x in enumerate(distinct):
        for y in distinct[:b]:
            m, n = len(shingles[x]), len(shingles[y])
            if 100 * min(m, n) >= 80 * max(m, n):
                both = len(shingles[x] & shingles[y])
                if 100 * both >= 80 * (m + n - both):
                    up.setdefault(x, []).append(y)
                    up.setdefault(y, []).append(x)
    seen, gone = set(), set()
    for d, k, x in every:
        if x in seen:
            gone.add((d, k))
            continue
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += up.get(y, [])
    want = {}
    for d, text in rules.items():
        parts = text.split("\n")
        if any((d, k) not in gone and x.strip(strip) for k, x in enumerate(parts)) or not any(x.strip(strip) for x in parts):
            want[d] = "\n".join(x for k, x in enumerate(parts) if (d, k) not in gone)
    assert lines == want

    # of near-equal documents the first stays
    sets = {}
    for d, text in lines.items():
        w = words(r"[^\x20\x09-\x0D]+", text)
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}
    for b in sorted(sets):
        for a in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert joined == {d: lines[d] for d in lines if root[d] == d}

    # documents with a twentieth of their words inside benchmark windows go
    alnum, windows = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(alnum, r.text)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    left = {}
    for d, text in joined.items():
        w = words(alnum, text)
        hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            left[d] = text
    assert clean == left


def test_stages_bear_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, item string, key string, found string, runs binary, place int"
    long_ = " ".join(f"word{k}" for k in range(30_000))
    rows = [(None, None), (None, "some words that stand alone here in this row of ten"), (1, ""), (1, long_), (1, long_), (2, None), (2, "\n\n"), (3, "one two three four five six seven eight nine ten eleven twelve")]
    odd = spark.createDataFrame([(d, t, None, None, None, "i", None, "f", None, k) for k, (d, t) in enumerate(rows)], schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "mix" or out.columns == docs.columns
            if docs is odd:
                assert name == "mix" or {3} <= {r.doc_id for r in out.collect()}
            else:
                assert out.count() == 0


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].select(*got.columns).collect()))
