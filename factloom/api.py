"""The engine's surface: read a journal, pack it, audit it, write to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as C
from .operators import audit, commands, evaluate, evaluator, legacy, lineage, pack, replay, transcript
from .sources import journal, sessions
from .sources.shared import settled


class Engine:
    """All branches at once; disabled, it returns empty contexts and no advice."""

    def __init__(self, spark: SparkSession, enabled: bool = True):
        self.spark, self.enabled = spark, enabled

    def state(self, events: DataFrame) -> DataFrame:
        return replay.active(replay.words(events))

    def rebuild(self, path: str) -> DataFrame:
        """Verdicts, facts, tombstones and counters of a journal that ``write`` has written."""
        return legacy.rebuild(journal.committed(self.spark, path))

    def tombstones(self, events: DataFrame) -> DataFrame:
        return replay.tombstones(replay.words(events))

    def diagnostics(self, events: DataFrame) -> DataFrame:
        return replay.verdicts(events).where("not accepted").groupBy("branch_id", "code").agg(F.count("*").alias("n"))

    def snapshot(self, events: DataFrame) -> DataFrame:
        return replay.compacted(events)

    def context(self, facts: DataFrame, budget: int = C.CONTEXT_BUDGET) -> DataFrame:
        return pack.contexts(facts if self.enabled else facts.limit(0), budget)

    def compaction(self, facts: DataFrame, budget: int = C.COMPACTION_BUDGET) -> DataFrame:
        return pack.compactions(facts if self.enabled else facts.limit(0), budget)

    def list(self, facts: DataFrame, type_: str | None = None, id_: str | None = None, offset: int = 0, limit: int = C.PAGE_SIZE, with_text: bool = False) -> DataFrame:
        """A page of each branch; one named fact is a page of its own."""
        if type_:
            facts = facts.where(F.col("type") == type_)
        if id_:
            return pack.pages(facts.where(F.col("id") == id_), 0, 1, with_text)
        return pack.pages(facts, offset, limit, with_text)

    def write(self, requests: DataFrame, path: str | None = None) -> DataFrame:
        """Judge add, revise and forget commands; append what passes to the journal at ``path``."""
        judged = settled(commands.outcomes(requests))  # read twice
        if path and self.enabled:
            journal.append(commands.journal_entries(judged), path)
        return judged

    def inject(self, messages: DataFrame, contexts: DataFrame) -> DataFrame:
        """Messages with the context of their branch as a last system message, if there is one."""
        if not self.enabled:
            return messages
        last = messages.groupBy("session_id").agg((F.max("pos") + 1).alias("pos"))
        extra = contexts.where("text != ''").select(F.col("branch_id").alias("session_id"), F.col("text").alias("content"))
        rows = last.join(extra, "session_id").select("session_id", "pos", F.lit(None).cast("string").alias("id"), F.lit("system").alias("role"), "content")
        return messages.select(*rows.columns).unionByName(rows)

    def instructions(self, *sections: Column) -> Column:
        """Sections that are not empty, a blank line between."""
        return F.concat_ws("\n\n", *(F.nullif(s, F.lit("")) for s in sections))

    def audit(self, baseline: DataFrame, compact: DataFrame) -> DataFrame:
        return audit.audit(baseline, compact)

    def advise(self, audited: DataFrame, active: Column | None = None, applied: Column | None = None) -> DataFrame:
        return audit.recommendations(audited, active, applied)

    def compare(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        return evaluate.deltas(left, right, keys)

    def evaluate(self, prompts: DataFrame, model: evaluator.Model, path: str, name: str = "model") -> DataFrame:
        """Prompts with the scores a model gives them; answers are kept under ``path`` and not asked for again."""
        judged = settled(evaluator.outcomes(prompts, model, path, name))
        return evaluate.evaluations(judged, "evaluation")

    def sessions(self, *roots: str) -> DataFrame:
        """Headers of the session files below ``roots``."""
        return sessions.session_headers(sessions.session_files(self.spark, *roots))

    def transcript(self, raw: DataFrame, limit: int = C.DIALOG_CHARS) -> DataFrame:
        return transcript.rendered(transcript.deduplicated(transcript.flattened(raw)), limit)

    def children(self, found: DataFrame, *ids: str) -> DataFrame:
        """Sessions below each of the given ones, newest first."""
        targets = self.spark.createDataFrame([(x,) for x in dict.fromkeys(ids)], "target string")
        return lineage.children(found, targets).orderBy("target", F.col("modified").desc(), "id")
