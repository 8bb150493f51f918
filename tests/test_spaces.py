"""White space as ECMAScript has it: trimming and collapsing against plain Python over every character."""

import re

from pyspark.sql import functions as F

from factloom import constants as C
from factloom.functions import text as T
from factloom.operators import replay


def test_every_character(spark):
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(k, f"{c}{c}a{c}b {c} c  d\t{c}") for k, c in enumerate(chars)], "k int, t string")
    got = {r.k: (r.trimmed, r.collapsed, r.units) for r in rows.select("k", T.trim(F.col("t")).alias("trimmed"), T.collapse(F.col("t")).alias("collapsed"), T.utf16_length(F.col("t")).alias("units")).collect()}
    space = re.compile(replay._SPACE.pattern)
    for k, c in enumerate(chars):
        text = f"{c}{c}a{c}b {c} c  d\t{c}"
        assert got[k] == (re.sub(rf"\A{space.pattern}|{space.pattern}\Z", "", text), space.sub(" ", text), len(text)), hex(ord(c))


def test_preview_of_long_white_space(spark):
    texts = ["x" * 500, " " * 2000 + "y" * 130, "a b\n" * 400, "z " * 60, " " * 3000, "q" * 119 + " " * 2000 + "r" * 9, "e" * 121, "é" * 122, "\U0001f600" * 130]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.preview(F.col("t")).alias("p"), T.tokens(F.col("t")).alias("n")).collect()
    for r in rows:
        flat = re.sub(r"\s+", " ", r.t).strip()
        units = len(flat.encode("utf-16-le")) // 2
        assert r.p == (flat[: C.PREVIEW_CHARS - 1] + "…" if units > C.PREVIEW_CHARS else flat)
        raw = len(r.t.encode("utf-16-le")) // 2
        wide = sum(len(c.encode("utf-16-le")) // 2 for c in r.t if ord(c) > 0x3FF)
        assert r.n == -(-raw // (2 if wide / raw > 0.3 else 4))
