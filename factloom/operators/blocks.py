"""Context blocks kept from one state of the journal to the next.

A branch's revision is the place of the last entry that changed its state.  Blocks
carry the revision they were packed at; of a later journal only branches whose
revision has moved are packed again, and the others' blocks are taken over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pack

COLUMNS = ("branch_id", "revision", "n_facts", "n_expanded", "n_indexed", "n_omitted", "expanded_chars", "index_chars", "wrapper_chars", "total_chars", "tokens", "text")


def revisions(rebuilt: DataFrame) -> DataFrame:
    """branch_id, revision of every branch with an entry that counted; ``rebuilt`` as ``legacy.rebuild`` gives it."""
    return rebuilt.where("part = 'verdict' and accepted").groupBy("branch_id").agg(F.max("seq").alias("revision"))


def packed(facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """A block for every branch with facts."""
    return pack.contexts(facts).join(revisions, "branch_id").select(*COLUMNS)


def refreshed(blocks: DataFrame, facts: DataFrame, revisions: DataFrame) -> DataFrame:
    """``blocks`` brought to the state of ``facts``, with ``renewed`` for those packed anew.

    A branch whose facts are all gone has no block.  ``blocks`` should be a
    stored table.
    """
    moved = revisions.join(blocks.select("branch_id", "revision"), ["branch_id", "revision"], "left_anti")
    kept = blocks.join(revisions, ["branch_id", "revision"], "left_semi")
    fresh = packed(facts.join(moved.select("branch_id"), "branch_id", "left_semi"), moved)
    return kept.select(*COLUMNS).withColumn("renewed", F.lit(False)).unionByName(fresh.withColumn("renewed", F.lit(True)))
