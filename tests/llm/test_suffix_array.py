"""Byte-string removal against brute force, in buckets and pieces of every size."""

import hashlib
import random

import numpy as np
import pytest

from factloom.llm import suffix_array

DOCS = "doc_id long, text string, pos int, n int, t0 string, state string, digest string"


def frame(spark, corpus, n=3):
    return spark.createDataFrame([(d, t, 1, 2, "x", "y", None) for d, t in corpus], DOCS).repartition(n)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    passage, line, base = text(150), text(70), text(900)
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "y" * 450, "ab" * 300, base, base, base[:400] + "!" + base[401:], base[50:-50], line + text(60) + line]
    out += [text(rng.randint(0, 80)) + passage + text(rng.randint(0, 80)) for _ in range(12)] + [passage[:101], passage[30:129], passage * 3]
    out += [text(30) + line + text(30) for _ in range(40)] + [text(3000), text(200) * 8]
    out += [base[:k] + base[k + 1 :] for k in range(100, 900, 97)]
    rows = [(k if k % 11 else -k, t) for k, t in enumerate(out)]
    return rows + [(None, base), (None, None), (5, base), (5, base), (40, text(40) + passage), (41, None), (7, "ab" * 300)]


def brute(corpus, length=100):
    places = {}
    for doc, text in corpus:
        data = (text or "").encode()
        for k in range(len(data) - length + 1 if doc is not None else 0):
            key = data[k : k + length]
            places[key] = min(places.get(key, (doc, k)), (doc, k))
    out = []
    for doc, text in corpus:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for k in range(len(data) - length + 1 if doc is not None else 0):
            if places[data[k : k + length]] < (doc, k):
                gone[k : k + length] = True
        spans = int(np.sum(gone[1:] > gone[:-1]) + gone[0]) if len(data) else 0
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone[:-1]])).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket,piece,gram,length", [(1 << 19, 1 << 19, 36, 100), (7, 300, 36, 100), (3, 130, 20, 60)])
def test_removals(spark, corpus, monkeypatch, bucket, piece, gram, length):
    monkeypatch.setattr(suffix_array, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(suffix_array, "PIECE", piece)
    some = corpus if bucket > 7 else corpus[::3] + corpus[-7:]
    got = suffix_array.removals(frame(spark, some), length, gram)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(some, length)


def test_no_documents(spark):
    assert suffix_array.removals(frame(spark, [])).count() == 0
    got = suffix_array.removals(frame(spark, [(1, None), (None, "z" * 300)])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0]


def test_multikey_order():
    rng = np.random.default_rng(3)
    tokens = [rng.integers(0, 4, 500), rng.integers(-3, 3, 500), rng.integers(0, 9, 500), np.arange(500)[::-1]]
    order = suffix_array.multikey_order(tokens)
    assert order.tolist() == sorted(range(500), key=lambda k: tuple(t[k] for t in tokens))
    assert suffix_array.multikey_order([np.zeros(0, dtype=np.int64)] * 3).tolist() == []


@pytest.mark.parametrize("seed", range(40))
def test_summaries_settle_what_buckets_leave_open(seed):
    """Any cut of a sorted list into buckets gives what one bucket gives."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 30))
    rows = sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in zip(rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 3, n)))
    parts = [0, *sorted(k for k in set(rng.integers(0, n, 5).tolist()) if k and rows[k] != rows[k - 1]), n]  # ties share a bucket
    found, summaries = [], []
    for number, (a, b) in enumerate(zip(parts, parts[1:])):
        state, belongs, summary = suffix_array.scan(*(np.array(c) for c in zip(*rows[a:b])), True)
        summaries.append((number, summary))
        found += [(number, int(s), int(w)) for s, w in zip(state, belongs)]
    flags = {b: rest for b, *rest in suffix_array.across(summaries)}
    got = []
    for number, state, where in found:
        goes_on, first_several, last_several = flags[number]
        if state == suffix_array.DEPENDS:
            several = where & 8 or where & 2 and first_several or where & 4 and last_several
            state = suffix_array.REPEAT if where & 1 and goes_on else suffix_array.OPEN if several else -1
        got.append(state)
    least = {}
    for r in rows:
        least.setdefault(r[:2], r[2:])
    several = {t for t in {r[0] for r in rows} if len({r[1] for r in rows if r[0] == t}) > 1}
    assert got == [suffix_array.REPEAT if r[2:] > least[r[:2]] else suffix_array.OPEN if r[0] in several else -1 for r in rows]
