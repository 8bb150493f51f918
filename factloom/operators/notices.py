"""What users are shown: status lines, notices and the texts they are made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .evaluate import kind

#: Most warnings that one notice shows.
SHOWN = 3
#: Texts by language; a language or text that is missing falls back to English, then to the key.
TEXTS = {
    "en": {
        "near-limit": "More than four fifths of the room for facts is used. Review what is out of date.",
        "empty": "The journal is empty.",
        "current": "The journal holds nothing new since its last snapshot.",
        "written": "Snapshot of {facts} facts and {tombstones} tombstones written.",
        "revoked": "Fact {id} is revoked.",
        "missing": "There is no fact {id}.",
        "page": "Page {page} of {pages}, {mode}",
        "no-page": "Page {page} is empty; there are no facts.",
    },
    "de": {
        "near-limit": "Mehr als vier Fünftel des Platzes für Fakten sind belegt. Veraltetes bitte durchsehen.",
        "empty": "Das Journal ist leer.",
        "current": "Seit dem letzten Abbild enthält das Journal nichts Neues.",
        "written": "Abbild mit {facts} Fakten und {tombstones} Widerrufen geschrieben.",
        "revoked": "Fakt {id} ist widerrufen.",
        "page": "Seite {page} von {pages}, {mode}",
    },
}


def message(key: str, language: str = "en", **values: Column) -> Column:
    """The text for ``key`` with the first mark of each value's name filled in."""
    text = TEXTS.get(language, TEXTS["en"]).get(key, TEXTS["en"].get(key, key))
    parts: list[Column | str] = [text]
    for name, value in values.items():
        for k, part in enumerate(parts):
            if isinstance(part, str) and f"{{{name}}}" in part:
                head, tail = part.split(f"{{{name}}}", 1)
                parts[k : k + 1] = [head, value.cast("string"), tail]
                break
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def thousands(chars: Column) -> Column:
    """Characters in thousands with one decimal; halves go up."""
    tenths = F.floor((chars + 50) / 100).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("k"))


def status_lines(costs: DataFrame, warnings: DataFrame) -> DataFrame:
    """branch_id, line: facts, size of the context, and the number of warnings if there are any.

    ``costs``: packed contexts; ``warnings``: branch_id, n.
    """
    rows = costs.join(warnings.select("branch_id", F.col("n").alias("n_warnings")), "branch_id", "left")
    mark = F.when(F.coalesce("n_warnings", F.lit(0)) > 0, F.concat(F.lit(" · ⚠"), F.col("n_warnings").cast("string"))).otherwise("")
    size = F.concat(F.lit(" · ctx ~"), F.col("tokens").cast("string"), F.lit("t (exp "), thousands(F.col("expanded_chars")), F.lit(", idx "), thousands(F.col("index_chars")), F.lit(")"))
    return rows.select("branch_id", F.concat(F.lit("facts "), F.col("n_facts").cast("string"), F.lit(f"/{C.MAX_FACTS}"), size, mark).alias("line"))


def warning_notices(warnings: DataFrame) -> DataFrame:
    """branch_id, text: how many warnings a branch has, the first three, and how many more.

    ``warnings``: branch_id, seq, code.  Only the first three are gathered.
    """
    place = F.row_number().over(Window.partitionBy("branch_id").orderBy("seq"))
    totals = warnings.groupBy("branch_id").agg(F.count("*").alias("n"))
    first = warnings.withColumn("place", place).where(F.col("place") <= SHOWN)
    lines = first.groupBy("branch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "seq", "code"))), lambda x: F.concat(F.lit("• "), x["seq"].cast("string"), F.lit(" "), x["code"])).alias("lines"))
    head = F.concat(F.col("n").cast("string"), F.lit(" warning(s)."))
    more = F.when(F.col("n") > SHOWN, F.concat(F.lit("… and "), (F.col("n") - SHOWN).cast("string"), F.lit(" more.")))
    return totals.join(lines, "branch_id").select("branch_id", F.concat_ws("\n", head, F.array_join("lines", "\n"), more).alias("text"))


def near_limit_notices(rows: DataFrame) -> DataFrame:
    """branch_id, seq of each write after which a branch first nears its limits, and again after it left them.

    ``rows``: branch_id, seq, n_facts, n_chars.
    """
    near = (F.col("n_facts") >= C.WARN_FACTS) | (F.col("n_chars") >= C.WARN_CHARS)
    rows = rows.withColumn("near", near)
    before = F.lag("near", 1, False).over(Window.partitionBy("branch_id").orderBy("seq"))
    return rows.withColumn("before", before).where("near and not before").select("branch_id", "seq")


def applications(turns: DataFrame) -> DataFrame:
    """Telemetry of a session: how often its context and its compaction guidance were applied, and whether at all.

    ``turns``: session_id, event (context or compaction), text; an empty text applies nothing.
    """
    told = F.coalesce(F.col("text"), F.lit("")) != ""
    count = lambda event: F.count_if(told & (F.col("event") == event))
    rows = turns.groupBy("session_id").agg(count("context").alias("context_applications"), count("compaction").alias("guidance_applications"))
    return rows.withColumns({"context_applied": F.col("context_applications") > 0, "guidance_applied": F.col("guidance_applications") > 0})


def cost_tokens(cost: Column) -> Column:
    """The estimated tokens a cost (JSON) states as a number; 0 where it states none."""
    doc = F.try_parse_json(cost)
    said = F.when(kind(doc, "$.estimatedTokens").rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(doc, "$.estimatedTokens", "double"))
    return F.coalesce(said, F.lit(0.0))
