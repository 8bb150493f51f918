"""Importance resampling against brute force, in blocks and pieces of every size."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score string, rank int, block string, n int"


def frame(spark, rows, n=3):
    return spark.createDataFrame([(d, t, "x", 1, "b", 2) for d, t in rows], DOCS).repartition(n)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("aeiouéßnrst") for _ in range(rng.randint(1, 7))) for _ in range(200)] + ["long" * 30, "İx"]
    text = lambda n: " ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) + rng.choice(["", ".", "-"]) for _ in range(n))
    rows = [(k, text(rng.randint(0, 90))) for k in range(200)] + [(200, None), (201, ""), (202, " .,"), (203, text(4000)), (204, "z" * 5000), (None, text(40)), (3, text(30)), (4, "same " * 30), (4, "same " * 30)]
    return rows, [(0, text(50)), (1, None), (2, text(9))]


def features(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, longest=1, buckets=10_000, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, longest)[1])
    t = Counter(bucket(f) for _, x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    out = []
    for doc, text in rows:
        words, found = features(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
        score = None if doc is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc, len(words), len(found), weight, score))
    able = sorted((r for r in out if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("longest,block,piece,held", [(1, 1 << 22, 1 << 19, 1 << 20), (1, 900, 200, 50), (3, 700, 150, 40)])
def test_resampled(spark, corpus, monkeypatch, longest, block, piece, held):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    monkeypatch.setattr(importance, "SLICE_BYTES", piece)
    monkeypatch.setattr(importance.pieces, "__defaults__", (piece,))
    monkeypatch.setattr(importance, "HELD", held)
    rows, target = corpus
    got = importance.resampled(frame(spark, rows), frame(spark, target), longest=longest).collect()
    want, drawn = brute(rows, target, longest)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(((d, n, w, s) for d, _, n, w, s in want), key=key)
    ranks = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["rank"])
    assert ranks == [(k + 1, r[0], r[4]) for k, r in enumerate(drawn)] and len(ranks) > 10


def test_odd_tables(spark, corpus):
    rows, target = corpus
    assert importance.resampled(frame(spark, []), frame(spark, target)).count() == 0
    got = importance.resampled(frame(spark, rows), frame(spark, [])).collect()
    want, _ = brute(rows, [])
    assert Counter((r["doc_id"], r["weight"]) for r in got) == Counter((d, w) for d, _, _, w, _ in want)
    assert importance.resampled(frame(spark, [(1, None), (None, None)]), frame(spark, target)).where("rank is null and weight = 0").count() == 2


def test_ranks_across_many_partitions(spark):
    rows = spark.range(5000).selectExpr("id", "pmod(hash(id), 17) as score")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = importance.ranked(rows, [rows["score"].desc(), rows["id"]], 1234).where("rank is not null").orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted((tuple(r) for r in rows.collect()), key=lambda r: (-r[1], r[0]))[:1234]
    assert [(r["id"], r["score"], r["rank"]) for r in got] == [(*w, k + 1) for k, w in enumerate(want)]


def test_crc32():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 4000, dtype=np.uint8)
    start = rng.integers(0, 3900, 300)
    end = start + rng.integers(0, 100, 300)
    assert importance.crc32(data, start, end).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(start, end)]
