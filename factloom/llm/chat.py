"""Chat formatting by a finite-state machine over roles.

A declarative template names, for each role, the text before and after a turn
and whether its text is learned.  The machine validates the order of turns and
emits segments, each with a loss flag; only the bare text of learned roles
carries loss.  Control strings inside texts are broken by a backslash after
their first character, and backslashes are doubled, so reading is exact.

Conversations are dealt by id, sorted by turn and streamed: a task holds one
run of rows at a time, never a conversation, however long.

Defined cases: a null text is empty; a null or unknown role is formatted by the
generic turn, which spells the role out; rows of equal conversation and turn
are ordered by role, then text; a null conversation id is one conversation; a
null turn comes first.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``turns`` by role; ``other`` for any other, its role between its two strings."""

    begin: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST] ", " [/INST]"),
            "assistant": Turn("<ANS>", "</s>", loss=True),
        }
    )
    other: tuple[str, str, str] = ("[ROLE ", "[:] ", " [/ROLE]")
    #: Role -> roles that may follow; None is the start.
    order: dict[str | None, tuple[str, ...]] = field(default_factory=lambda: {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def controls(self) -> list[str]:
        found = {self.begin.strip(), *(x.strip() for x in self.other), *(x.strip() for t in self.turns.values() for x in (t.before, t.after))}
        return sorted(found, key=lambda x: (-len(x), x))


class Machine:
    """Validates turn order; writes and reads the template's text."""

    def __init__(self, template: Template):
        self.template = template
        controls = template.controls()
        self.risky = re.compile(r"\\|" + "|".join(f"(?={re.escape(c)})." for c in controls), re.S)
        # reading: the turns' own openings, then text without control strings up to the closing
        body = r"((?:(?!%s).)*)" % "|".join(map(re.escape, controls))
        parts = [rf"(?P<r{k}>){re.escape(t.before)}{body}{re.escape(t.after)}" for k, t in enumerate(template.turns.values())]
        a, b, c = map(re.escape, template.other)
        self.roles = list(template.turns)
        self.reader = re.compile("|".join([*parts, f"{a}{body}{b}{body}{c}"]), re.S)

    def escape(self, text: str) -> str:
        return self.risky.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def allowed(self, before: str | None, role: str) -> bool:
        return role in self.template.order.get(before, ())

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The pieces of one formatted turn and whether each carries loss."""
        turn = self.template.turns.get(role)
        if turn:
            return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]
        a, b, c = self.template.other
        return [(a + self.escape(role) + b, False), (self.escape(text), False), (c, False)]

    def read(self, formatted: str):
        """(role, text, loss) of each turn of a formatted run."""
        at = 0
        while at < len(formatted):
            m = self.reader.match(formatted, at)
            if not m:
                raise ValueError(f"no turn at character {at}")
            groups = m.groups()
            for k, role in enumerate(self.roles):
                if groups[2 * k] is not None:
                    yield role, self.unescape(groups[2 * k + 1]), self.template.turns[role].loss
                    break
            else:
                yield self.unescape(groups[-2]), self.unescape(groups[-1]), False
            at = m.end()


SEGMENTS = "conv_id long, turn long, part int, segment string, loss boolean, valid boolean"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_invalid long"


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Every formatted segment with its loss flag, and whether its turn was in order."""

    def run(batches):
        machine, current, before = Machine(template), (), None
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text"))):
                if current != (conv,):
                    current, before = (conv,), None
                    out.append((conv, turn, -1, template.begin, False, True))
                ok = machine.allowed(before, role)
                out += [(conv, turn, k, s, loss, ok) for k, (s, loss) in enumerate(machine.segments(role, text))]
                before = role
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], names=["conv_id", "turn", "part", "segment", "loss", "valid"])

    return ordered(conversations).mapInArrow(run, SEGMENTS)


class Digest:
    """Running digests of one conversation, read back from its formatted runs."""

    def __init__(self, conv, begin: str):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.invalid = 0
        self.chars = len(begin)
        self.before = None

    def add(self, machine: Machine, segments: list[tuple[str, bool]]) -> None:
        """Turns come from the formatted text alone, the loss from the segments' flags over it."""
        formatted = "".join(s for s, _ in segments)
        for role, text, _ in machine.read(formatted):
            self.n += 1
            self.invalid += not machine.allowed(self.before, role)
            self.before = role
            self.turns.update(f"{role}\n{text}\n".encode())
        at = 0
        for segment, loss in segments:
            if loss:
                text = machine.unescape(formatted[at : at + len(segment)])
                self.loss_chars += len(text)
                self.loss.update(text.encode())
            at += len(segment)
        self.chars += len(formatted)

    def row(self):
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.invalid


def digests(conversations: DataFrame, template: Template = Template(), run_turns: int = 64) -> DataFrame:
    """One row per conversation, taken from its formatted text read back."""

    def run(batches):
        machine = Machine(template)
        current: Digest | None = None
        for batch in batches:
            done, pending, waiting = [], [], 0
            for conv, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if current is None or current.conv != conv or waiting >= run_turns:
                    if current is not None and pending:
                        current.add(machine, pending)
                    pending, waiting = [], 0
                    if current is None or current.conv != conv:
                        if current is not None:
                            done.append(current.row())
                        current = Digest(conv, template.begin)
                pending += machine.segments(role, text)
                waiting += 1
            if current is not None and pending:
                current.add(machine, pending)
            if done:
                yield as_batch(done)
        if current is not None:
            yield as_batch([current.row()])
        release()

    return ordered(conversations).mapInArrow(run, DIGEST)


def as_batch(rows) -> pa.RecordBatch:
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])
