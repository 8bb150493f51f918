"""Quality rules: plain text counts, and tokeniser fertility as the verdict.

A public vocabulary with byte fallback encodes every whole text.  Three figures
are judged: characters per token, the share of byte-fallback tokens, and the
entropy of the token distribution.  Entropy rises with length, so its floor is a
curve in log2 of the number of tokens for the document's language (or, for a
language without a curve, its script), lower for few tokens.  Characters per
token have a floor only: ordinary prose has twice as many as the test tables'
invented prose, so there is no number above which a text is junk.

``fitted`` computes the curves from labelled clean documents outside the held-out
fold; ``BANDS`` is its result over the largest test table.  The floors stand well
below the curves, by a slack that grows as texts get shorter.

Defined cases: null and empty texts have no words, so they fail the base rules;
any other column is passed over; repeated rows are judged one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release
from .textkernel import SPACED, TABLE, Kernel, buffer_of, mix, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Entropy a + b*x + c*x*x, x = log2(tokens), of invented prose of few syllables
#: (the labelled clean documents); that of natural prose lies above it.
BANDS = {
    "de": (0.569, 1.066, -0.046),
    "en": (0.281, 1.135, -0.048),
    "es": (1.017, 0.973, -0.041),
    "fr": (0.740, 1.025, -0.044),
}
#: Remainder of crc32 of the ``doc_id`` modulo 4 whose labels are never learnt from.
HELD_OUT = 2
#: Latin text of another language: the lowest of the curves, and more slack.
LATIN = (0.281, 1.100, -0.047)
ENTROPY_SLACK, OTHER_ENTROPY_SLACK, ENTROPY_NOISE = 0.30, 1.0, 1.5
#: Below it most tokens are single characters, in any language.
MIN_CHARS = 1.5
MAX_BYTE_SHARE, MAX_BYTE_SHARE_OTHER_SCRIPT = 0.15, 0.90

#: ``[#*$%&|<>]``
SYMBOLS = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])

MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double"


def base_counts(texts: pa.Array, kernel: Kernel, repeat: int = 5) -> dict[str, np.ndarray]:
    """The base counts of each text of a slice."""
    words = kernel.words(texts)
    data, offsets = buffer_of(texts)
    n_docs, first = len(offsets) - 1, words.first
    per_doc = lambda flags, bounds: np.concatenate([[0], np.cumsum(flags)])[bounds]

    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = np.diff(per_doc(letters[words.end] - letters[words.start], first))
    symbols = np.diff(per_doc(SYMBOLS[data], offsets))

    # lines: cut at \n and at the ends of texts
    cuts = np.flatnonzero(data == 10)
    start = np.concatenate([offsets[:-1], cuts + 1])
    doc = np.concatenate([np.arange(n_docs), np.searchsorted(offsets, cuts, side="right") - 1])
    # a text's empty last line starts where the next text does
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    stop = np.concatenate([start[1:] - 1, offsets[-1:]]) if len(start) else start
    last = np.concatenate([doc[1:] != doc[:-1], [True]]) if len(doc) else np.zeros(0, bool)
    stop = np.where(last, offsets[doc + 1], stop)
    up, down = kernel.byte_powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(TABLE[data] * up[: len(data)], out=total[1:])
    line = mix((total[stop] - total[start]) * down[start])
    worded = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    line, doc = line[worded], doc[worded]
    order = np.lexsort((line, doc))
    line, doc = line[order], doc[order]
    again = np.zeros(len(line), dtype=bool)
    again[1:] = (line[1:] == line[:-1]) & (doc[1:] == doc[:-1])
    dup_lines = np.bincount(doc[again], minlength=n_docs)

    windows, valid = kernel.windows(words, repeat)
    at = np.flatnonzero(valid)
    owner = words.docs()[at]
    order = np.lexsort((windows[at], owner))
    h, o = windows[at][order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    begin = at[order][twice]
    cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + repeat, -1)
    repeated = np.diff(per_doc(np.cumsum(cover)[:-1] > 0, first))
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}


def load_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary's bytes, broadcast: executors need no file."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


class Fertility:
    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes = np.array([self.model.is_byte(k) for k in range(self.model.get_piece_size())])

    def figures(self, text: str) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte tokens, entropy in bits."""
        ids = np.array(self.model.encode(text, num_threads=1), dtype=np.int64)
        n = len(ids)
        if n == 0:
            return 0, 0.0, 0.0, 0.0
        counts = np.bincount(ids)
        share = counts[counts > 0] / n
        return n, len(text) / n, float(self.bytes[ids].mean()), float(-(share * np.log2(share)).sum())


def latin_share(text: str) -> float:
    """Share of the non-ASCII-or-letter characters that are Latin; 1 without letters."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = codes[(codes > 0xBF) | (((codes | 32) >= 0x61) & ((codes | 32) <= 0x7A))]
    return float((letters < 0x250).mean()) if len(letters) else 1.0


def verdict(n: int, chars: float, byte_share: float, entropy: float, lang: str | None, latin: bool) -> bool:
    """Whether all three figures lie within the bounds of the language or script."""
    if n == 0:
        return False
    if lang not in BANDS and not latin:
        return byte_share <= MAX_BYTE_SHARE_OTHER_SCRIPT and entropy >= 1.0
    a, b, c = BANDS.get(lang, LATIN)
    x = min(float(np.log2(n)), -b / (2 * c))  # the curve is flat beyond its top
    slack = (ENTROPY_SLACK if lang in BANDS else OTHER_ENTROPY_SLACK) + ENTROPY_NOISE / n**0.5
    return entropy >= a + b * x + c * x * x - slack and chars >= MIN_CHARS and byte_share <= MAX_BYTE_SHARE


def fitted(docs: DataFrame, labels: DataFrame, vocabulary: str = VOCABULARY) -> dict[str, tuple[float, float, float]]:
    """Entropy curves by language, by least squares over all labelled clean documents outside the held-out fold.

    Spark adds up the moments; the driver sees eight numbers a language.
    """
    clean = labels.where("quality = 1").select("doc_id").distinct()
    rows = docs.where(F.expr(f"crc32(cast(doc_id as string)) % 4 != {HELD_OUT}")).join(clean, "doc_id", "left_semi")
    found = measures(rows, vocabulary).where("not base_failed").join(rows.select("doc_id", "lang").distinct(), "doc_id")
    x = F.log2("n_tokens")
    sums = found.groupBy("lang").agg(*(F.sum(F.pow(x, k)).alias(f"x{k}") for k in range(5)), *(F.sum(F.col("entropy") * F.pow(x, k)).alias(f"y{k}") for k in range(3))).collect()
    return {r.lang: tuple(np.linalg.solve([[r[f"x{i + j}"] for j in range(3)] for i in range(3)], [r[f"y{i}"] for i in range(3)])) for r in sums}


def judge(part: pa.RecordBatch, kernel: Kernel, fertility: Fertility) -> dict[str, np.ndarray]:
    out = base_counts(part.column("text"), kernel)
    n = out["n_words"]
    failed = (n < 10) | (100 * out["n_repeat_words"] > 20 * n)
    langs = part.column("lang").to_pylist() if "lang" in part.schema.names else [None] * part.num_rows
    figures, kept = [], []
    for k, text in enumerate(part.column("text").to_pylist()):
        f = fertility.figures(text or "")
        figures.append(f)
        lang = langs[k]
        kept.append(not failed[k] and verdict(*f, lang, lang in BANDS or latin_share(text or "") > 0.5))
    names = ("n_tokens", "chars_per_token", "byte_share", "entropy")
    return out | {"base_failed": failed, "kept": np.array(kept, dtype=bool)} | {x: np.array([f[i] for f in figures], dtype=np.int64 if i == 0 else float) for i, x in enumerate(names)}


def measures(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Counts, tokeniser figures and verdict of every row."""
    model = load_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        kernel, fertility = Kernel(SPACED, lower=False), Fertility(model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                out = judge(part, kernel, fertility)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out]).select([x.split()[0] for x in MEASURES.split(", ")])
        release()

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(run, MEASURES)


def keep(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep."""
    model = load_vocabulary(docs.sparkSession, vocabulary)

    def run(batches):
        kernel, fertility = Kernel(SPACED, lower=False), Fertility(model.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(judge(part, kernel, fertility)["kept"]))
        release()

    return docs.mapInArrow(run, docs.schema)
