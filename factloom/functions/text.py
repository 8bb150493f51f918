"""Text functions as columns, all inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: code points, and astral ones twice; ASCII texts need no look at their characters."""
    points = F.length(text)
    return F.when(points == F.octet_length(text), points).otherwise(points + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", "")))


#: The characters of ``JS_SPACE``, one by one.
SPACES = "".join(chr(c) for c in range(0x3001) if re.match(C.JS_SPACE.replace("\\x{", "\\u").replace("}", ""), chr(c))) + "\uFEFF"


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Every run of white space as one blank."""
    other = SPACES.replace(" ", "")
    return F.regexp_replace(F.translate(text, other, " " * len(other)), " {2,}", " ")


def sanitise(text: Column) -> Column:
    return F.regexp_replace(text, C.UNSAFE, "")


def normalise(text: Column) -> Column:
    return trim(F.replace(sanitise(text), F.lit("\r\n"), F.lit("\n")))


def nfkc(text: Column) -> Column:
    """NFKC, by the library of Unicode rules that Spark brings; texts in ASCII stay as they are.

    The call sees other texts as empty, for Spark may evaluate it outside the condition.
    """
    plain = text.rlike(r"^[\x00-\x7F]*$")
    other = F.coalesce(F.when(~plain, text), F.lit(""))
    return F.when(text.isNull() | plain, text).otherwise(F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), other, F.lit(True)))


def canonical_key(type_: Column, text: Column) -> Column:
    """Equal for facts that say the same: type, NUL, NFKC text with collapsed white space."""
    return F.concat(type_, F.lit("\0"), collapse(nfkc(normalise(text))))


def escape_xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape_xml(text: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def preview(text: Column) -> Column:
    # the text's head is enough where it stays longer than a preview; more than one unit behind is never looked at
    head = trim(collapse(F.left(text, F.lit(8 * C.PREVIEW_CHARS))))
    flat = F.when(F.length(head) > C.PREVIEW_CHARS + 1, head).otherwise(trim(collapse(text)))
    return F.when(utf16_length(flat) > C.PREVIEW_CHARS, F.concat(F.left(flat, F.lit(C.PREVIEW_CHARS - 1)), F.lit("…"))).otherwise(flat)


def wide_units(text: Column) -> Column:
    """UTF-16 units above U+03FF."""
    return F.when(F.length(text) == F.octet_length(text), 0).otherwise(utf16_length(text) - F.length(F.regexp_replace(text, r"[^\x{0000}-\x{03FF}]", "")))


def tokens_of(units: Column, wide: Column) -> Column:
    """Estimated tokens: four units each, two where over 30 % of units are wide."""
    return F.when(units == 0, F.lit(0)).otherwise(F.ceil(units / F.when(wide / units > 0.3, 2).otherwise(4))).cast("long")


def tokens(text: Column) -> Column:
    """Estimated tokens of a text."""
    return tokens_of(utf16_length(text), wide_units(text))


def day(millis: Column) -> Column:
    """UTC date of epoch milliseconds as text."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


#: Stands between the parts of lines that list facts.
SEP = f" {C.SEPARATOR} "


def hot_mark(hot: Column) -> Column:
    return F.when(hot, SEP + C.HOT_MARK).otherwise("")


def fact_xml() -> Column:
    return F.concat(F.lit('<fact id="'), F.col("id"), F.lit('" type="'), F.col("type"), F.lit('" p="'), F.col("priority").cast("string"), F.lit('"'), F.when(F.col("hot"), " hot").otherwise(""), F.lit(">"), escape_xml(F.col("text")), F.lit("</fact>"))


def fact_line() -> Column:
    return F.concat(F.lit("- "), F.col("id"), F.lit(SEP), F.col("type"), F.lit(SEP + "p"), F.col("priority").cast("string"), hot_mark(F.col("hot")))


def fact_preview() -> Column:
    return F.concat(fact_line(), F.lit(SEP), preview(F.col("text")))


def list_entry(with_text: bool) -> Column:
    base = F.concat(F.col("id"), F.lit(SEP), F.col("type"), F.lit(SEP), day(F.col("updated_at")), F.lit(SEP + "p"), F.col("priority").cast("string"), hot_mark(F.col("hot")))
    return F.concat(base, F.lit("\n"), F.col("text"), F.lit("\n\n")) if with_text else F.concat(base, F.lit(SEP), preview(F.col("text")), F.lit("\n\n"))


def truncate(text: Column, limit: int) -> Column:
    """Head and tail with a marker between; longer than ``limit`` by the marker."""
    head = int(limit * 0.55)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(C.TRUNCATED), F.right(text, F.lit(limit - head))))
