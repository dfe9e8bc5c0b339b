"""Chat formatting: a finite-state machine over roles checks turn order and emits text segments with loss flags.

A Template declares, for every role, the marks around its text and whether its text is learnt, and the allowed order
of roles. Control strings inside texts are escaped reversibly, so that parse() finds the turns in the output alone.

Every row of the table is formatted once, in order of (turn, role, text); a null turn comes first, null roles and texts
count as empty, rows without a conversation form the conversation null, and repeated rows are repeated turns. A turn
out of order or of an unknown role is formatted all the same and flagged. An empty table gives an empty result, columns
other than the named ones are ignored.

Rows are dealt by conversation, sorted within partitions and streamed: the state between two rows is the machine's
state, whatever the length of a conversation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, slices, text_of


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    learnt: bool = False


@dataclass(frozen=True)
class Template:
    """roles: marks by role; other: marks of any further role, its name between the first and `named`.

    follows: for each state the roles that may come next; a state is the last role, "" at the start.
    """

    start: str
    roles: tuple[tuple[str, Role], ...]
    other: Role
    named: str
    follows: tuple[tuple[str, frozenset[str]], ...]

    @property
    def controls(self) -> tuple[str, ...]:
        """What marks a turn, without the white space around it; longest first."""
        marks = {self.start, self.other.before, self.other.after, self.named}
        marks |= {mark for _, role in self.roles for mark in (role.before, role.after)}
        return tuple(sorted({mark.strip() for mark in marks} - {""}, key=lambda mark: (-len(mark), mark)))

    def check(self) -> None:
        """No control string may begin in a mark and end in a text, or the other way round."""
        after = [role.after for _, role in self.roles] + [self.other.after, self.named]
        before = [role.before for _, role in self.roles] + [self.other.before, self.named]
        for control in self.controls:
            if len(control) < 2 or ESCAPE in control:
                raise ValueError(f"not a control string: {control!r}")
            for at in range(1, len(control)):
                head, tail = control[:at], control[at:]
                if any(mark.startswith(tail) or tail.startswith(mark) for mark in after) or any(mark.endswith(head) or head.endswith(mark) for mark in before):
                    raise ValueError(f"{control!r} can straddle a mark and a text")


#: Escapes: of itself, and put after the first character of a control string.
ESCAPE, ESCAPED, BROKEN = "\\", "\\\\", "\\."

INSTRUCT = Template(
    start="<s>",
    roles=(
        ("system", Role("<<SYS>>\n", "\n<</SYS>>\n\n")),
        ("user", Role("[INST] ", " [/INST]")),
        ("assistant", Role("<ANS> ", " </s>", learnt=True)),
    ),
    other=Role("<ROLE>", "</ROLE>"),
    named="<SAYS>",
    follows=(("", frozenset({"system", "user"})), ("system", frozenset({"user"})), ("user", frozenset({"assistant"})), ("assistant", frozenset({"user"}))),
)


class Codec:
    """Escaping and parsing for one template."""

    def __init__(self, template: Template):
        template.check()
        self.template, self.roles, self.follows = template, dict(template.roles), dict(template.follows)
        controls = "|".join(map(re.escape, template.controls))
        self._starts = re.compile(f"(?s)(?=(?:{controls}))(.)")
        self._escapes = re.compile(r"\\([\\.])")
        self._opens = {role.before: name for name, role in template.roles} | {template.other.before: None}
        marks = {template.named, *self._opens, *(role.after for _, role in template.roles), template.other.after}
        self._marks = re.compile("|".join(map(re.escape, sorted(marks, key=len, reverse=True))))

    def escape(self, text: str) -> str:
        return self._starts.sub(lambda m: m[1] + BROKEN, text.replace(ESCAPE, ESCAPED))

    def unescape(self, text: str) -> str:
        return self._escapes.sub(lambda m: ESCAPE if m[1] == ESCAPE else "", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's (text, learnt) segments: mark, text, mark."""
        if marks := self.roles.get(role):
            return [(marks.before, False), (self.escape(text), marks.learnt), (marks.after, False)]
        marks = self.template.other
        return [(marks.before, False), (self.escape(role), False), (self.template.named, False), (self.escape(text), False), (marks.after, False)]

    def allowed(self, state: str, role: str) -> bool:
        """Whether role may follow state; after an unknown role, what may follow at the start."""
        return role in self.follows.get(state, self.follows[""])

    def parse(self, formatted: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, start, end) of each turn of a formatted text or of whole turns of it; start and end are of its escaped text."""
        at = len(self.template.start) if formatted.startswith(self.template.start) else 0
        while at < len(formatted):
            opened = self._marks.match(formatted, at)
            if not opened or opened[0] not in self._opens:
                raise ValueError(f"no turn begins at character {at}")
            role, start = self._opens[opened[0]], opened.end()
            if role is None:
                named = self._until(formatted, start, self.template.named)
                role, start = self.unescape(formatted[start:named]), named + len(self.template.named)
                after = self.template.other.after
            else:
                after = self.roles[role].after
            end = self._until(formatted, start, after)
            yield role, self.unescape(formatted[start:end]), start, end
            at = end + len(after)

    def _until(self, formatted: str, start: int, mark: str) -> int:
        end = formatted.find(mark, start)
        if end < 0:
            raise ValueError(f"{mark!r} is missing after character {start}")
        return end


#: A turn's output: its segments' texts and loss flags, in order. `first` tells that the start mark stands before it.
SEGMENTS = "conv_id long, turn long, first boolean, valid boolean, texts array<string>, learnt array<boolean>"
_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("first", pa.bool_()), ("valid", pa.bool_()), ("texts", pa.list_(pa.string())), ("learnt", pa.list_(pa.bool_()))])


def format_conversations(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """A row for each turn with its segments, conversations together and in order within a partition.

    The formatted text of a conversation is the concatenation of its rows' texts; valid is false for a turn that the
    machine doesn't allow where it stands.
    """
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text_of("role").alias("role"), text_of("text").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    Codec(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, conversation, state = Codec(template), (), ""
        for batch in slices(batches, SLICE_ROWS):
            out = []
            for conv_id, turn, role, text in zip(*(column.to_pylist() for column in batch.columns)):
                first = (conv_id,) != conversation
                if first:
                    conversation, state = (conv_id,), ""
                segments = [(template.start, False)] * first + codec.segments(role, text)
                out.append((conv_id, turn, first, codec.allowed(state, role), [part for part, _ in segments], [flag for _, flag in segments]))
                state = role
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*out), _ARROW)], schema=_ARROW)

    return rows.mapInArrow(run, SEGMENTS)
