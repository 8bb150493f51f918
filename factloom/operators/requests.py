"""Requests that users type, parsed as columns: what is asked, of what, or that it is not understood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import trim

#: The words that users type.
HELP = ("help", "-h", "--help")
SWITCH = {"": "on", "on": "on", "enable": "on", "off": "off", "disable": "off", "status": "status", "status --json": "status-json"}


def analysis(raw: Column) -> dict[str, Column]:
    """kind and target of a request for an analysis; kind is ``usage`` where it is not understood.

    The first word, in any case, is the command, the rest its argument.  No
    word at all asks for the current dialogue.  A null request counts as blank.
    """
    said = trim(F.coalesce(raw, F.lit("")))
    at = F.instr(said, " ")
    word = F.lower(F.when(at == 0, said).otherwise(F.left(said, at - 1)))
    rest = F.when(at == 0, "").otherwise(trim(F.substring(said, at + 1, F.length(said))))
    alone = lambda kind: F.when(rest == "", kind).otherwise("usage")
    named = lambda kind: F.when(rest == "", "usage").otherwise(kind)
    kind = (
        F.when(said == "", "current")
        .when(word.isin(*HELP), alone("help"))
        .when(word == "status", F.when(rest == "", "status").when(rest == "--json", "status-json").otherwise("usage"))
        .when(word == "subagents", F.when(rest == "", "subagents").otherwise("subagent"))
        .when(word == "subagent", named("subagent"))
        .when(word == "compact", F.when(rest == "", "compact").when(rest == "replay", "counterfactual").otherwise("usage"))
        .when(word.isin("counterfactual", "replay"), alone("counterfactual"))
        .when(word == "compare", named("compare"))
        .otherwise("usage")
    )
    return {"kind": kind, "target": F.when(kind.isin("subagent", "compare"), rest)}


def switch(raw: Column) -> Column:
    """on, off, status, status-json, help or usage of a request to the engine's switch."""
    said = F.lower(trim(F.coalesce(raw, F.lit(""))))
    out = F.when(said.isin(*HELP), "help")
    for word, meaning in SWITCH.items():
        out = out.when(said == word, meaning)
    return out.otherwise("usage")


def page(raw: Column) -> dict[str, Column]:
    """page, offset and full of a request for a page of facts: the first whole number, and ``--full`` anywhere.

    Numbers beyond nine digits name the same far page, which is empty.
    """
    words = F.filter(F.split(F.coalesce(raw, F.lit("")), f"{C.JS_SPACE}+"), lambda x: x != "")
    first = F.get(F.filter(words, lambda x: x.rlike(r"\A[0-9]+\z")), F.lit(0))
    digits = F.regexp_replace(first, r"\A0+", "")
    number = F.when(F.length(digits) > 9, F.lit(999_999_999)).otherwise(digits.try_cast("long"))
    shown = F.greatest(F.lit(1), F.coalesce(number, F.lit(1))).cast("long")
    return {"page": shown, "offset": (shown - 1) * C.PAGE_SIZE, "full": F.array_contains(words, "--full")}
