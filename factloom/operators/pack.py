"""Packing ranked facts into hard character budgets.

Facts come in rank order and are never gathered: what is expanded, indexed or
listed is bounded by the budget, and the rest is only counted.  Facts that no budget
could show are sieved out where they are read, so a branch of any size brings a
bounded number of rows to its fold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from .replay import units
from .runs import fold, sieved


def rank_order():
    return [F.col("hot").desc(), F.col("priority").desc(), F.col("updated_at").desc(), F.col("revision").desc(), F.col("id").asc()]


def ranked(facts: DataFrame) -> DataFrame:
    """``facts`` with their rank in the branch, from 1."""
    return facts.withColumn("rank", F.row_number().over(Window.partitionBy("branch_id").orderBy(*rank_order())))


#: Units of a fact's XML, and of its line, without id, type and text: no fact takes less.
LEAST_XML, LEAST_LINE = len('<fact id="" type="" p="0"></fact>'), len("-  ()")


def sieved_facts(rows: DataFrame, budget: int, sizes: dict[str, tuple[int, str | None]]) -> DataFrame:
    """The rows that can matter to a packer, in columns it reads, and counts of the others."""
    # whatever is not taken is listed by a line; lines behind the last that fits are only counted
    lead = budget // LEAST_LINE + 1 + sum(budget // LEAST_XML for _ in sizes)
    return sieved(rows, "branch_id", rank_order(), "id", budget, lead, sizes)


#: Characters above U+03FF.
_WIDE = re.compile("[\u0400-\U0010ffff]+")


def estimated_tokens(text: str) -> int:
    n = units(text)
    if not n:
        return 0
    wide = sum(units(run) for run in _WIDE.findall(text))
    return -(-n // (2 if wide / n > 0.3 else 4))


class ContextPacker:
    """First fit with skips, then an index of what did not fit, then an omission note."""

    def __init__(self, branch, budget: int = C.CONTEXT_BUDGET):
        self.branch, self.budget = branch, budget
        self.expanded: list[tuple[int, str, int, str]] = []  # rank, xml, units, index line
        self.cold: list[tuple[int, str, int]] = []  # rank, index line, units
        self.n = self.used = 0

    def add(self, fact) -> list:
        self.n += fact["standing"]
        xml, line, size = fact["xml"], fact["index_line"], fact["size"]
        if line is None:  # facts that were only counted
            return []
        after = self.used + (1 if self.expanded else 0) + (size or 0)
        if size is not None and C.ENVELOPE + after <= self.budget:
            self.expanded.append((self.n, xml, size, line))
            self.used = after
        else:
            # no more index lines than this can ever fit
            if len(self.cold) <= self.budget // 8:
                self.cold.append((self.n, line, units(line)))
        return []

    def length(self, body: int, lines: int, chars: int, left_out: int) -> int:
        size = C.ENVELOPE + body
        if lines:
            size += len(C.INDEX_HEADING) + chars + lines - 1
        if left_out:
            size += len(C.OMITTED[0]) + len(str(left_out)) + len(C.OMITTED[1])
        return size

    def choice(self) -> tuple[int, list, int] | None:
        """Facts that stay expanded, the index pool, and how many of it are listed."""
        for demoted in range(len(self.expanded) + 1):
            stay = len(self.expanded) - demoted
            pool = sorted(self.cold + [(r, line, units(line)) for r, _, _, line in self.expanded[stay:]])
            waiting = self.n - stay
            body = sum(e[2] for e in self.expanded[:stay]) + stay - 1 if stay else len(C.NOTHING_EXPANDED)
            sums = [0]
            for _, _, size in pool:
                sums.append(sums[-1] + size)
            for k in range(len(pool), -1, -1):
                if self.length(body, k, sums[k], waiting - k) <= self.budget:
                    return stay, pool, k
        return None

    def finish(self) -> list:
        found = self.choice()
        stay, pool, k = found if found else (0, [], 0)
        shown = [e[1] for e in self.expanded[:stay]]
        text = C.CONTEXT_HEADER + "\n" + ("\n".join(shown) if shown else C.NOTHING_EXPANDED)
        left_out = self.n - stay - k if found else 0
        if k:
            text += C.INDEX_HEADING + "\n".join(p[1] for p in pool[:k])
        if left_out:
            text += C.OMITTED[0] + str(left_out) + C.OMITTED[1]
        text += "\n\n" + C.CONTEXT_FOOTER
        total = units(text)
        if total > self.budget:
            raise ValueError(f"budget of {self.budget} is too small for the envelope")
        expanded = sum(e[2] for e in self.expanded[:stay])
        indexed = sum(p[2] + 1 for p in pool[:k])
        return [(self.branch, self.n, stay, k, left_out, text, expanded, indexed, max(0, total - expanded - indexed), total, estimated_tokens(text))]


CONTEXT = "branch_id string, n_facts long, n_expanded long, n_indexed long, n_omitted long, text string, expanded_chars long, index_chars long, wrapper_chars long, total_chars long, tokens long"


def _first_fit(facts: DataFrame, index_line: Column, budget: int) -> DataFrame:
    """Rows of the first fit: XML and size are null where a fact is longer than the budget by itself."""
    rows = facts.select("branch_id", "hot", "priority", "updated_at", "revision", "id", T.fact_xml().alias("xml"), index_line.alias("index_line"))
    size = T.utf16_length(F.col("xml")).cast("int")
    rows = rows.withColumn("size", F.when(size <= budget - C.ENVELOPE, size)).withColumn("xml", F.when(F.col("size").isNotNull(), F.col("xml")))
    return sieved_facts(rows, budget, {"size": (0, "xml")})


def contexts(facts: DataFrame, budget: int = C.CONTEXT_BUDGET) -> DataFrame:
    """The packed context and its cost, one row per branch."""
    rows = _first_fit(facts, F.when(F.col("hot"), T.fact_preview()).otherwise(T.fact_line()), budget)
    return fold(rows, "branch_id", rank_order(), lambda b: ContextPacker(b, budget), CONTEXT)


class GreedyPacker(ContextPacker):
    """The first pass alone: which facts are expanded."""

    def finish(self) -> list:
        return [(self.branch, self.n, len(self.expanded), sum(e[2] for e in self.expanded), self.used)]


def greedy(facts: DataFrame, budget: int = C.CONTEXT_BUDGET) -> DataFrame:
    rows = _first_fit(facts, F.lit(""), budget)
    return fold(rows, "branch_id", rank_order(), lambda b: GreedyPacker(b, budget), "branch_id string, n_facts long, n_kept long, kept_chars long, kept_joined_chars long")


class CompactionPacker:
    """Full text for hot and top-priority facts, previews for others, ids for the rest."""

    def __init__(self, branch, budget: int = C.COMPACTION_BUDGET):
        self.branch, self.budget = branch, budget
        self.full: list[str] = []
        self.previews: list[str] = []
        self.omitted: list[str] = []
        self.full_size = self.preview_size = self.n = 0
        self.frame = units(C.COMPACTION_HEADER) + units(C.COMPACTION_FOOTER)

    def add(self, fact) -> list:
        self.n += fact["standing"]
        if fact["preview"] is None:  # facts that were only counted
            return []
        size = (fact["size"] or 0) + (self.full_size + 1 if self.full else 0)
        if fact["size"] is not None and self.frame + 3 + size <= self.budget:
            self.full.append(fact["xml"])
            self.full_size = size
            return []
        size = fact["preview_size"] + (self.preview_size + 1 if self.previews else 0)
        probe = self.frame + (self.full_size if self.full else len("(none)")) + len(C.PREVIEW_HEADING) + size + 4
        if probe <= self.budget:
            self.previews.append(fact["preview"])
            self.preview_size = size
        else:
            if len(self.omitted) <= self.budget // 4:
                self.omitted.append(f"- {fact['id']} ({fact['type']})")
        return []

    def text(self, listed: int) -> str:
        lines = [C.COMPACTION_HEADER, "\n".join(self.full) or "(none)"]
        if self.previews:
            lines += ["", C.PREVIEW_HEADING, *self.previews]
        if listed:
            lines += ["", C.OMITTED_HEADING, *self.omitted[:listed]]
        return "\n".join([*lines, C.COMPACTION_FOOTER])

    def finish(self) -> list:
        base = units(self.text(0))
        sizes, total = [base], base + 2 + len(C.OMITTED_HEADING)
        for line in self.omitted:
            total += units(line) + 1
            sizes.append(total)
        fits = [k for k, size in enumerate(sizes) if size <= self.budget]
        text = self.text(max(fits)) if fits else next(x for x in C.COMPACTION_FALLBACKS if units(x) <= self.budget)
        return [(self.branch, self.n, len(self.full), len(self.previews), max(fits) if fits else 0, text, units(text))]


COMPACTION = "branch_id string, n_facts long, n_full long, n_preview long, n_listed long, text string, total_chars long"


def compactions(facts: DataFrame, budget: int = C.COMPACTION_BUDGET) -> DataFrame:
    """Per branch, what a compaction is told of its facts; XML stays where a fact is hot or of top priority and fits."""
    rows = facts.select("branch_id", "hot", "priority", "updated_at", "revision", "id", "type", F.when(F.col("hot") | (F.col("priority") >= 90), T.fact_xml()).alias("xml"), T.fact_preview().alias("preview"))
    size = T.utf16_length(F.col("xml")).cast("int")
    rows = rows.withColumns({"size": F.when(size <= budget, size), "preview_size": T.utf16_length(F.col("preview")).cast("int")}).withColumn("xml", F.when(F.col("size").isNotNull(), F.col("xml")))
    # a preview's size may be shared by facts that are shown in full
    rows = sieved_facts(rows, budget, {"size": (0, "xml"), "preview_size": (budget // LEAST_XML, None)})
    return fold(rows, "branch_id", rank_order(), lambda b: CompactionPacker(b, budget), COMPACTION)


def full_contexts(facts: DataFrame) -> DataFrame:
    """Every fact in full, in rank order; the baseline that packing is measured by.

    The text of a branch is its output row, so it is put together whole.
    """
    rows = ranked(facts).select("branch_id", "rank", T.fact_xml().alias("xml"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "xml"))), lambda x: x["xml"]), "\n")
    return rows.groupBy("branch_id").agg(F.concat(F.lit(C.CONTEXT_HEADER + "\n"), body, F.lit("\n\n" + C.CONTEXT_FOOTER)).alias("text"), F.count("*").alias("n_facts"))


def pages(facts: DataFrame, offset: int = 0, limit: int = C.PAGE_SIZE, with_text: bool = False, budget: int = C.LIST_BUDGET) -> DataFrame:
    """One page of each branch's facts, cut where the budget ends.

    Only the rows of the page are gathered, twenty at most.
    """
    limit = max(1, min(limit, C.MAX_PAGE_SIZE))
    totals = facts.groupBy("branch_id").agg(F.count("*").alias("total"), F.sum(T.utf16_length(F.col("text"))).alias("chars"))
    rows = ranked(facts).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    rows = rows.select("branch_id", "rank", T.list_entry(with_text).alias("entry")).join(totals, "branch_id")

    class Page:
        def __init__(self, branch):
            self.branch, self.shown, self.body, self.open, self.first = branch, 0, "", True, None

        def head(self, last: int) -> str:
            return f"Facts {offset + 1}-{last} of {self.total}; active total {self.total}/{C.MAX_FACTS}; {self.chars}/{C.MAX_TOTAL_CHARS} chars\n\n"

        def add(self, row) -> list:
            self.total, self.chars = row["total"], row["chars"]
            self.first = self.first or row["entry"]
            last = offset + self.shown + 1
            more = f"Next page: offset={last}\n" if last < self.total else ""
            self.open = self.open and units(self.head(last) + self.body + row["entry"] + more) <= budget
            if self.open:
                self.body += row["entry"]
                self.shown += 1
            return []

        def finish(self) -> list:
            shown = max(1, self.shown)
            after = offset + shown if offset + shown < self.total else None
            if self.shown:
                text = self.head(offset + shown) + self.body.rstrip() + (f"\nNext page: offset={after}" if after is not None else "")
            else:
                head, tail = self.head(offset + 1), "... [truncated]"
                text = head + self.first[: max(0, budget - len(head) - len(tail))] + tail
            return [(self.branch, text, shown, after)]

    return fold(rows, "branch_id", ["rank"], Page, "branch_id string, text string, returned long, next_offset long")


def totals(facts: DataFrame) -> DataFrame:
    """Active facts and characters of each branch, and whether they near the limits."""
    out = facts.groupBy("branch_id").agg(F.count("*").alias("n_facts"), F.sum(T.utf16_length(F.col("text"))).cast("long").alias("n_chars"))
    return out.withColumn("near_limit", (F.col("n_facts") >= C.WARN_FACTS) | (F.col("n_chars") >= C.WARN_CHARS))
