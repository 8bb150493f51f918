"""Each operator against a brute-force version, and on the odd inputs it must bear."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate, line_dedup, mix, ngram_join, pii, prefix_trie, quality_rules, substring_dedup
from factloom.llm.queries import ORACLES, QUERIES

from oracle import compare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, item string, bits string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def corpus():
    """Small documents with copies, near copies, shared passages, nulls, ties and long texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeiouéßnrst") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
    base, passage = text(60), text(30)
    out = [None, "", "  \n\t ", "one", "One", "two words", base, base, base.upper()]
    for _ in range(30):
        words = base.split(" ")
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    out += [text(rng.randint(1, 120)) for _ in range(40)]
    out += [text(20) + " " + passage + " " + text(20) for _ in range(10)] + [passage + " " + passage, "la la " * 400, text(6000)]
    return [(k, t) for k, t in enumerate(out)] + [(6, base)]


def frame(spark, corpus, n=3):
    rows = [(d, t, "en" if (d or 0) % 2 else None, None if (d or 0) % 5 == 0 else f"s{d % 3}", len(t or ""), "k", None, "b") for d, t in corpus]
    return spark.createDataFrame(rows, DOCS).repartition(n)


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLES[name], SF)


def components(n, links):
    up = list(range(n))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def shingles(text, k):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("k,numerator", [(4, 85), (5, 80)])
def test_ngram_join(spark, corpus, k, numerator):
    sets = {}
    for d, t in corpus:
        sets[d] = shingles(t, k)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])]
    root = components(len(ids), links)
    got = sorted(map(tuple, ngram_join.components_of(frame(spark, corpus), k, numerator).collect()))
    assert got == sorted((d, len(sets[d]), root[d]) for d, _ in corpus)
    kept = ngram_join.representatives(frame(spark, corpus), k, numerator)
    assert kept.columns == frame(spark, corpus).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in corpus if root[d] == d)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.components_of(empty(spark)).count() == 0
    rows = frame(spark, [(None, "a b c d e"), (1, None), (None, None)])
    assert sorted(map(tuple, ngram_join.components_of(rows).collect()), key=str) == [(1, 0, 1), (None, 0, None), (None, 2, None)]


def test_trie_join_matches_all_pairs():
    import numpy as np

    rng = random.Random(1)
    base = [rng.getrandbits(60) for _ in range(80)]
    sets = []
    for _ in range(60):
        own = set(rng.sample(base, rng.randint(1, 80))) | {rng.getrandbits(60) for _ in range(rng.randint(0, 6))}
        sets.append(np.array(sorted(own), dtype=np.uint64))
    sets += [sets[0], np.array([], dtype=np.uint64)]
    for bar in (50, 80, 100):
        want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if len(x) and len(y) and 100 * len(set(x) & set(y)) >= bar * len(set(x) | set(y))}
        assert set(prefix_trie.links(sets, sets, bar)) == want
        hashes = np.concatenate(sets)
        bounds = np.cumsum([0, *map(len, sets)])
        maps = prefix_trie.bitmaps(hashes, bounds)
        pairs = prefix_trie.candidate_forest(list(range(62)), np.zeros(62, int), list(range(62)), [len(s) for s in sets], maps, bar)
        root, exact = components(62, pairs), components(62, want)
        assert all(root[a] == root[b] for a, b in want) and len(set(root)) <= len(set(exact))


def test_line_dedup(spark, corpus):
    strip = " \t\n\x0b\x0c\r"
    rows = sorted({(d, t) for d, t in corpus if t}, key=lambda x: x[0])
    lines = [(d, k, x.strip(strip)) for d, t in rows for k, x in enumerate(t.split("\n")) if x.strip(strip)]
    distinct = list(dict.fromkeys(x for _, _, x in lines))
    sets = [{x[i : i + 7] for i in range(max(1, len(x) - 6))} for x in distinct]
    links = [(a, b) for b in range(len(sets)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(len(distinct), links)
    at = {x: k for k, x in enumerate(distinct)}
    seen, gone = set(), defaultdict(set)
    for d, k, x in lines:
        if root[at[x]] in seen:
            gone[d].add(k)
        seen.add(root[at[x]])
    want = []
    for d, t in corpus:
        kept = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[d])
        want.append((d, sum(1 for x in (t or "").split("\n") if x.strip(strip)), len(gone[d]), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, line_dedup.digests(frame(spark, corpus)).collect())) == sorted(want)
    out = line_dedup.deduplicated(frame(spark, corpus))
    assert out.columns == frame(spark, corpus).columns
    for r in out.collect():
        assert not gone[r.doc_id] or r.n_chars == len(r.text)
    assert line_dedup.digests(empty(spark)).count() == 0


def test_substring_dedup(spark, corpus):
    first = {}
    for d, t in corpus:
        w = WORD.findall(t or "")
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    want = []
    for d, t in corpus:
        w = WORD.findall(t or "")
        gone = {p for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, substring_dedup.removals(frame(spark, corpus)).collect())) == sorted(want)
    assert substring_dedup.removals(empty(spark)).count() == 0


def test_substring_levels_double_until_none_is_left(spark, corpus):
    found = substring_dedup.Repeats(frame(spark, corpus), 13, None)
    assert found.lengths == [13 * 2**k for k in range(len(found.lengths))] and len(found.lengths) >= 2
    copies = {r.doc_id for r in found.copies.collect()}
    for length, level in zip(found.lengths, found.levels):
        where = defaultdict(set)
        for d, t in dict(corpus).items():
            w = WORD.findall(t or "")
            if d not in copies:
                for i in range(len(w) - length + 1):
                    where[tuple(w[i : i + length])].add((d, i))
        want = {x for places in where.values() if len({d for d, _ in places}) > 1 for x in places}
        assert {(r.doc_id, r.pos) for r in level.collect()} == want


@pytest.fixture(scope="module")
def repeated_ids():
    """Rows of one id whose texts differ, rows repeated whole, and null ids."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    p, q, other, long_ = text(20), text(50), text(50), text(200)
    rows = [(1, p), (5, long_ + " " + p), (5, text(20)), (7, text(30)), (1, q), (5, q), (5, other), (5, other), (9, q + " " + text(3)), (None, q), (None, text(40)), (8, "")]
    a, b, c, d = (text(12) for _ in range(4))
    return rows + [(11, f"{a}\n{b}"), (15, f"{c}\n{a}"), (15, f"{text(9)}\n{d}"), (15, f"{text(9)}\n{d} x"), (11, f"{a}\n{b}")]


def test_ngram_join_tells_rows_of_one_id_apart(spark, repeated_ids):
    kept = sorted(Counter((r.doc_id, r.text) for r in ngram_join.representatives(frame(spark, repeated_ids)).collect()).items(), key=str)
    sets = {row: shingles(row[1], 5) for row in dict.fromkeys(repeated_ids)}
    rows = list(sets)
    links = [(a, b) for b in range(len(rows)) for a in range(b) if sets[rows[a]] and 100 * len(sets[rows[a]] & sets[rows[b]]) >= 80 * len(sets[rows[a]] | sets[rows[b]])]
    root = components(len(rows), links)
    gone = set()
    for group in set(root):
        own = [rows[k] for k in range(len(rows)) if root[k] == group]
        known = [r for r in own if r[0] is not None]
        least = min((r[0] for r in known), default=None)
        assert sum(r[0] == least for r in own) == 1  # no group here leaves the choice to the hash
        gone |= {r for r in own if r[0] != least}
    assert kept == sorted(((r, n) for r, n in Counter(repeated_ids).items() if r not in gone), key=str)
    assert ((5, repeated_ids[6][1]), 2) in kept


def test_line_dedup_tells_rows_of_one_id_apart(spark, repeated_ids):
    rows = [r for r in repeated_ids if r[0] is None or r[0] > 9]
    texts = Counter((r.doc_id, r.text) for r in line_dedup.deduplicated(frame(spark, rows)).collect())
    for doc, text in rows:
        lines = text.split("\n")
        if doc == 15 and text.endswith(lines[-1]) and rows.index((doc, text)) > 0:
            continue
        assert texts[(doc, text)] == rows.count((doc, text))
    left = sorted(x for (doc, text), n in texts.items() if doc == 15 for x in text.split("\n"))
    a, d = rows[2][1].split("\n")[0], rows[4][1].split("\n")[1]
    assert a not in left and (d in left) != (d + " x" in left) and len(left) == 4


def test_substring_dedup_tells_rows_of_one_id_apart(spark, repeated_ids):
    rows = [(d, t) for d, t in repeated_ids]
    first = {}
    for d, t in rows:
        w = WORD.findall(t)
        for i in range(len(w) - 12 if d is not None else 0):
            g = tuple(w[i : i + 13])
            first[g] = min(first.get(g, d), d)
    want = []
    for d, t in rows:
        w = WORD.findall(t)
        gone = {p for i in range(len(w) - 12 if d is not None else 0) if first[tuple(w[i : i + 13])] < d for p in range(i, i + 13)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    assert sorted(map(tuple, substring_dedup.removals(frame(spark, rows)).collect()), key=str) == sorted(want, key=str)


def test_families_of_many_blocks(spark):
    # one leader family of chains: blocks of four items must lose no link
    import numpy as np

    rng = random.Random(9)
    sets = {1: list(range(1000, 1040))}
    for k in range(2, 120):
        base = list(sets[rng.choice(list(sets))])
        for _ in range(rng.randint(0, 5)):
            base[rng.randrange(len(base))] = rng.randrange(10**6)
        sets[k] = sorted(set(base))
    want = [(a, b) for a in sets for b in sets if a < b and 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))]
    exact = components(121, want)
    members = spark.createDataFrame([(1, k) for k in sets] + [(3, 3), (3, 4)], "leader long, item long")
    data = {k: np.array(s, dtype=np.uint64) for k, s in sets.items()}
    table = spark.createDataFrame([(k, s.tobytes()) for k, s in data.items()], "item long, data binary")
    for block in (4, 1000):
        links = prefix_trie.join_families(members, table, 85, lambda rows: [np.frombuffer(x, dtype=np.uint64) for x in rows], block=block, small=3).collect()
        assert components(121, links) == exact
        bits = [(k, len(s), prefix_trie.bitmaps(s, np.array([0, len(s)]))[0]) for k, s in data.items()]
        pairs = prefix_trie.candidates(members, spark.createDataFrame(bits, "item long, n long, bits binary"), 85, block=block).collect()
        root = components(121, pairs)
        assert all(root[a] == root[b] for a, b in want)


def bench_rows(spark, corpus):
    long_ = next(t for d, t in corpus if t and len(t.split()) > 70 and "la la" not in t and d > 8)
    rows = [("a", " ".join(ALNUM.findall(lower(long_))[5:40])), ("b", "one"), ("b", "one"), ("c", ""), (None, "two words"), ("d", None), ("10", "never seen here at all")]
    return rows, spark.createDataFrame(rows, "item_id string, text string")


@pytest.mark.parametrize("block", [8_000_000, 20])
def test_decontamination(spark, corpus, block):
    rows, benchmark = bench_rows(spark, corpus)
    want = []
    for d, t in corpus:
        w = ALNUM.findall(lower(t or ""))
        hit, items = set(), set()
        for i, text in rows:
            b = ALNUM.findall(lower(text or ""))
            k = min(13, len(b))
            windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1 if b else 0):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    items |= {i} - {None}
        want.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    docs = frame(spark, corpus)
    assert sorted(map(tuple, decontaminate.contamination(docs, benchmark, block_chars=block).collect())) == sorted(want)
    clean = decontaminate.clean_documents(docs, benchmark, block_chars=block)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(x[0] for x in want if not x[5])
    assert decontaminate.contamination(empty(spark), benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0)).collect())


@pytest.mark.parametrize("block", [4_000_000, 20])
def test_decontamination_judges_rows_of_one_id_by_their_own_text(spark, block):
    hit, clean = "a b c d e f g h i j k l m n", "something else"
    rows = [(None, hit), (None, clean), (3, hit), (3, clean), (3, clean), (4, clean), (5, "x " * 300 + hit), (6, None)]
    benchmark = spark.createDataFrame([("q", "A b c, d e f g h i j k l m"), ("r", "b c d e f g h i j k l m n"), ("s", "never " * 9)], "item_id string, text string")
    kept = decontaminate.clean_documents(frame(spark, rows), benchmark, block_chars=block).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, clean), (3, clean), (3, clean), (4, clean), rows[6], (6, None)])
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(frame(spark, rows), benchmark, block_chars=block).collect()}
    assert got == {(None, 14, 14, 2), (None, 2, 0, 0), (3, 14, 14, 2), (3, 2, 0, 0), (4, 2, 0, 0), (5, 314, 14, 2), (6, 0, 0, 0)}


def test_proximity(spark):
    docs = frame(spark, [(1, "alpha x beta y gamma"), (2, "gamma alpha beta"), (3, "alpha beta"), (4, "alpha " + "x " * 50 + "beta gamma")])
    benchmark = spark.createDataFrame([("q", "alpha beta gamma")], "item_id string, text string")
    near = {(r.doc_id, r.kind) for r in decontaminate.matches(docs, benchmark, slop=4).collect()}
    assert near == {(1, "near"), (2, "near")}
    assert {(r.doc_id, r.kind, r.start) for r in decontaminate.matches(frame(spark, [(5, "Alpha, BETA gamma")]), benchmark).collect()} == {(5, "exact", 0)}


def test_proximity_does_not_depend_on_neighbours(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    item = [f"t{k}" for k in range(20)]
    docs = []
    for k in range(60):
        passage = list(item)
        for _ in range(k % 6):
            passage[rng.randrange(20)] = rng.choice(words)  # a word replaced
        if k % 2:
            passage.insert(rng.randrange(20), "more")
        docs.append((k, " ".join(rng.choices(words, k=30) + (passage if k % 5 else rng.sample(item, 4)) + rng.choices(words, k=30))))
    docs += [(100, " ".join(item[:9] + ["x"] + item[10:13])), (101, "unrelated t9 words")]
    benchmark = spark.createDataFrame([("q", " ".join(item))], "item_id string, text string")
    want = set()
    for d, text in docs:
        w = text.split(" ")
        for i in range(8):
            window = set(item[i : i + 13])
            want |= {(d, s) for s in range(len(w)) if w[s] in window and len(window & set(w[s : s + 15])) >= 10}
    assert {d for d, _ in want} >= {1, 100}
    for n in (1, 3, 30):  # slices of other documents
        rows = decontaminate.matches(frame(spark, docs, n), benchmark, slop=2).where("kind = 'near'").collect()
        assert {(r.doc_id, r.start) for r in rows} == want
    alone = decontaminate.matches(frame(spark, docs[-2:-1]), benchmark, slop=2)
    assert {r.doc_id for r in alone.collect()} == {100}


def test_quality_counts(spark, corpus):
    rows = [*corpus, (900, "a#b *|\n a#b *|\n\na#b *|\n<>"), (901, "w " * 12), (902, "x y z w v " * 2 + " ".join(map(str, range(60))))]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.measures(frame(spark, rows)).collect()}
    want = set()
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        want.add((d, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)))
    assert got == want
    assert quality_rules.keep(empty(spark)).count() == 0


def test_duplicate_lines_of_texts_that_end_in_newlines():
    texts = ["a\n", "b\nc\nb", "x\nx\n", "\n", "", None, "y\n\ny\n\n", "z\nz"]
    out = quality_rules.base_counts(pa.array(texts), quality_rules.Kernel(quality_rules.SPACED, lower=False))
    assert out["n_dup_lines"].tolist() == [0, 1, 1, 0, 0, 0, 1, 1]


def test_quality_rules_keep_clean_and_reject_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.measures(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"))
    share = {r.quality: r.kept for r in rows.collect()}
    assert share[1] > 0.99 and share[0] < 0.3


NATURAL = {
    "en": "The harbour was quiet when the first boats returned. Fishermen carried their baskets up the stone steps, and the women who had waited since before dawn began to sort the catch by size. Nobody spoke about the storm. Later, after the market had closed and the gulls had taken whatever was left, an old man sat on the wall, repaired a torn net with patient fingers and told the children how the lighthouse had once gone dark for three winters.",
    "de": "Der Hafen lag still, als die ersten Boote zurückkehrten. Die Fischer trugen ihre Körbe die steinernen Stufen hinauf, und die Frauen, die seit dem frühen Morgen gewartet hatten, sortierten den Fang nach Größe. Niemand sprach über das Unwetter. Später, als der Markt geschlossen war, saß ein alter Mann auf der Mauer, flickte geduldig ein zerrissenes Netz und erzählte den Kindern, wie der Leuchtturm einst drei Winter lang dunkel geblieben war.",
    "fr": "Le port était calme quand les premiers bateaux revinrent. Les pêcheurs montaient leurs paniers par l'escalier de pierre, et les femmes qui attendaient depuis l'aube triaient le poisson selon sa taille. Personne ne parlait de la tempête. Plus tard, une fois le marché fermé, un vieil homme assis sur le mur réparait patiemment un filet déchiré et racontait aux enfants comment le phare était resté éteint pendant trois hivers.",
    "es": "El puerto estaba tranquilo cuando regresaron los primeros barcos. Los pescadores subían sus cestas por la escalera de piedra, y las mujeres que esperaban desde el amanecer clasificaban la pesca según su tamaño. Nadie hablaba de la tormenta. Más tarde, cuando cerró el mercado, un anciano sentado en el muro remendaba con paciencia una red rota y contaba a los niños cómo el faro había quedado apagado durante tres inviernos.",
}


def test_quality_rules_keep_natural_prose(spark):
    # whole paragraphs, and halves of them, whatever the language column says of Latin text
    rows = [(text[: len(text) // part], lang) for lang, text in NATURAL.items() for part in (1, 2)] + [(t, "it") for t in NATURAL.values()]
    # single sentences too
    rows += [(sentence, lang) for lang, text in NATURAL.items() for sentence in text.split(". ") if len(sentence.split()) >= 10]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert [r for r in quality_rules.measures(docs).collect() if not r.kept] == []
    junk = [("la la " * 8 + "na na", "en"), ("\x01\x02\x03 " * 12, "en"), ("\u4e00\u0001 " * 15, "en"), ("x1 y2 " * 6, "fr")]
    assert not any(r.kept for r in quality_rules.measures(spark.createDataFrame([(k, *r) for k, r in enumerate(junk)], "doc_id long, text string, lang string")).collect())


def test_quality_bands_are_fitted_and_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").repartition(6)
    for lang, curve in quality_rules.fitted(docs, labels).items():
        assert curve == pytest.approx(quality_rules.BANDS[lang], abs=0.002)
    held = quality_rules.measures(docs).where(f"not base_failed and crc32(cast(doc_id as string)) % 4 = {quality_rules.HELD_OUT}").join(labels, "doc_id")
    share = {r.quality: r.kept for r in held.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.15


def test_mix(spark, corpus):
    docs = frame(spark, corpus)
    for block in (1024, 8):
        rows = mix.mix(docs, block=block).collect()
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mix.mix(docs.repartition(7), block=block).collect()), key=str)
        assert sorted((r.doc_id, r.size) for r in rows) == sorted((d, len(WORD.findall(t or ""))) for d, t in corpus)
        taken, largest, sizes = defaultdict(int), defaultdict(int), {}
        for r in rows:
            key = (r.source_size, round(r.target, 3))
            assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
            taken[key] += r.taken
            largest[key] = max(largest[key], r.size)
            sizes[key] = r.source_size
        for key, words in taken.items():
            assert abs(words - key[1]) <= largest[key]
        assert abs(sum(k[1] for k in taken) - sum(sizes.values())) < 1e-6 * sum(sizes.values()) + 0.01
    assert mix.mix(empty(spark)).count() == 0
    assert [r.taken for r in mix.mix(frame(spark, [(1, None), (2, "")])).collect()] == [0, 0]


def test_mix_deals_repeated_rows_to_blocks(spark):
    rows = [(1, "a b c d e")] * 2500 + [(None, f"n{k} x y") for k in range(600)] + [(k, "a b") for k in range(300)]
    docs = spark.createDataFrame([(d, t, "en", "s" if k % 2 else "t", 0, "", "", "") for k, (d, t) in enumerate(rows)], DOCS)
    sizes = mix.sized(docs).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(64)))
    assert sizes.count() == len(rows) == sizes.select("source", "key").distinct().count()
    assert sizes.groupBy("source", "block").count().agg(F.max("count")).first()[0] < 120
    out = [mix.mix(docs.repartition(n), block=64).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect() for n in (2, 5)]
    assert sorted(map(tuple, out[0])) == sorted(map(tuple, out[1])) and all(abs(r.taken - r.target) <= 5 for r in out[0])


def test_targets_fill_up(spark):
    def want(sizes):
        names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
        weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
        total, fixed = sum(sizes.values()), {}
        while True:
            free = [s for s in names if s not in fixed]
            left = total - sum(fixed.values())
            goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            over = [s for s in free if goal[s] > 3 * sizes[s]]
            if not over:
                return fixed | goal
            fixed |= {s: 3.0 * sizes[s] for s in over}

    for sizes in ({"a": 1, "b": 100, None: 40}, {"a": 10}, {"a": 0, "b": 5}, {"a": 1, "b": 1, "c": 1, "d": 500, "e": 3}, {"a": 7, "b": 0, None: 1}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mix.targets(rows).collect()}
        assert got == pytest.approx(want(sizes))


def test_pseudonyms(spark):
    text = 'card 4111 1111 1111 1111, not 4111111111111112. +1 (743) 555-3824!! 10.0.255.1 999.1.1.1 a.Bc9@mail.example.com 2020-02-29 31.02.2020 29.02.2020 "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"'
    docs = spark.createDataFrame([(1, text, 1), (2, "4111-1111-1111-1111 on 2020-02-29", 2), (3, None, 3), (4, "", 4), (5, "no data " * 9000, 5)], "doc_id long, text string, found long")
    rows = {r.doc_id: r for r in pii.pseudonymise(docs.withColumnRenamed("found", "extra"), "k").collect()}
    new = rows[1].text
    assert [rows[1].found[k] for k in pii.KINDS] == [1, 1, 1, 2, 1, 1, 0, 0]
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
    assert "4111111111111112" in new and "999.1.1.1" in new and "31.02.2020" in new and "@mail.example.com" in new
    for old in ("4111 1111 1111 1111", "555-3824", "10.0.255.1", "a.Bc9@", "2020-02-29", "2321bac4d15e"):
        assert old not in new
    card = re.search(r"card ([\d ]{19}),", new)[1]
    digits = [int(c) for c in card if c != " "][::-1]
    assert sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0
    assert card.replace(" ", "-") in rows[2].text
    day = re.search(r"\d{4}-\d\d-\d\d", new)[0]
    assert day in rows[2].text and ".".join(reversed(day.split("-"))) in new
    assert rows[3].text is None and rows[4].text == "" and rows[5].text == "no data " * 9000
    assert shape(re.search(r"\+1 [^!]*", new)[0]) == "+9 (999) 999-9999"
    assert "Python" not in pii.pseudonymise(docs.drop("found"), "k")._jdf.queryExecution().executedPlan().toString()


def test_cards_beside_other_numbers(spark):
    cases = [
        ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", 1), ("4111111111111111 123", "4111111111111111", 1), ("no 1 4111111111111111", "4111111111111111", 1),
        ("1234 4111 1111 1111 1111 99", "4111 1111 1111 1111", 1), ("3782 822463 10005 777", "3782 822463 10005", 1), ("4111-1111-1111-1111-1-2", "4111-1111-1111-1111", 1),
        ("4111111111111111 5555555555554444", "5555555555554444", 2), ("41111111 11111111", "41111111 11111111", 1), ("4111111111111111 10.0.0.1", "4111111111111111", 1), ("4111111111111111 2020-02-29", "4111111111111111", 1),
        ("41111111 11111111 55555555 55554444", "55555555 55554444", 2), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", None, 0), ("4111111111111112 123", None, 0),
    ]
    out = {r.k: r for r in pii.pseudonymise(spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k long, text string"), "k").collect()}
    for k, (text, card, n) in enumerate(cases):
        assert (text, out[k].found.card) == (text, n)
        assert out[k].text == text if card is None else card not in out[k].text
        assert out[k].found.ipv4 or re.sub(r"\d", "9", out[k].text) == re.sub(r"\d", "9", text)
    assert out[0].text.endswith(" 12/27") and out[1].text.endswith(" 123") and out[2].text.startswith("no 1 ") and out[3].text.startswith("1234 ")
    assert (out[8].found.ipv4, out[9].found.date) == (1, 1)


def feistel(value, kind, alphabets, key, back=False):
    """The character network in plain Python, forth or back."""
    cut = len(value) // 2
    sides = [value[:cut], value[cut:]]
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        stream = hashlib.sha512(f"{key}|{kind}|{i}|{sides[1 - i % 2]}".encode()).hexdigest()
        out = ""
        for k, c in enumerate(sides[i % 2]):
            by = int(stream[k % 64 * 2 : k % 64 * 2 + 2], 16) * (-1 if back else 1)
            own = next((a for a in alphabets if c in a), None)
            out += own[(own.index(c) + by) % len(own)] if own else c
        sides[i % 2] = out
    return "".join(sides)


def test_permutations_are_one_to_one(spark):
    days = spark.range(pii.DAYS).repartition(3)
    out = days.select("id", pii.permute_day(F.col("id"), F.lit(False), "k").alias("p"))
    assert out.select("p").distinct().count() == pii.DAYS and out.where(f"p < 0 or p >= {pii.DAYS}").count() == 0
    late = days.where(F.dayofmonth(pii.day_name(F.col("id"))) > 12)
    out = late.select(pii.day_name(pii.permute_day(F.col("id"), F.lit(True), "k")).alias("p"))
    assert out.distinct().count() == late.count() and out.where("dayofmonth(p) <= 12 or year(p) < 1900 or year(p) > 2099").count() == 0
    every = spark.range(100_000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("d"))
    assert every.select(pii.permute_characters(F.col("d"), "card", (pii.DIGITS,), "k").alias("p")).distinct().count() == 100_000
    numbers = spark.range(0, 898 * 989_901, 17_777).select((F.col("id") / 989_901).cast("long").alias("a"), (F.col("id") % 989_901).alias("b"))
    text = F.concat_ws("-", F.lpad((F.col("a") + 1 + F.when(F.col("a") >= 665, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad(((F.col("b") / 9999).cast("long") + 1).cast("string"), 2, "0"), F.lpad((F.col("b") % 9999 + 1).cast("string"), 4, "0"))
    out = numbers.select(text.alias("t")).select("t", pii.ssn(F.col("t"), "k").alias("p"))
    assert out.select("p").distinct().count() == numbers.count() and out.where("not p rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'").count() == 0


def test_networks_agree_with_python_and_back(spark):
    rng = random.Random(3)
    alphabets = (pii.LOWER, pii.UPPER, pii.DIGITS, *pii.BEYOND)
    values = ["".join(rng.choice("abzAZ09._é-ñßÄЖжαΩ") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", pii.permute_characters(F.col("v"), "email", alphabets, "k").alias("p")).collect()
    for v, p in rows:
        assert p == feistel(v, "email", alphabets, "k") and feistel(p, "email", alphabets, "k", back=True) == v


def test_further_kinds_and_clashing_names(spark):
    secret = "0123456789abcdef" * 10
    text = f"josé@example.com 123-45-6789 666-12-3456 DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE88 3704 0044 0532 0130 00 {secret} AB12 4111 1111 1111 1111 12/25/2020 4111111111111111 123-45-6789"
    docs = spark.createDataFrame([(text, "own"), (None, None), ("", "x")], "text string, found string")
    row, null, blank = pii.pseudonymise(docs, "k").collect()
    assert row.found == "own" and (null.text, blank.text) == (None, "")
    assert [row.found_[k] for k in pii.KINDS] == [2, 0, 0, 1, 1, 1, 2, 2]
    for old in ("josé", "123-45-6789", "3704 0044 0532 0130 00,", "WEST12345698765432", secret, "4111 1111 1111 1111", "12/25/2020"):
        assert old not in row.text
    assert "666-12-3456" in row.text and "DE88 3704 0044 0532 0130 00" in row.text
    ibans = re.findall(r"DE\d\d(?: \d{4}){4} \d\d,|GB\w{20}", row.text)
    for x in ibans:
        x = x.strip(",").replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert len(ibans) == 2 and len(set(re.findall(r"\d{3}-\d\d-\d{4}", row.text))) == 2
    month, day, _ = map(int, re.search(r"(\d\d)/(\d\d)/(\d{4})", row.text).groups())
    assert month <= 12 < day
