"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

1. The turns of a conversation come sorted to one task, which reads them once and holds one turn at a time. A machine
   whose states are the roles says for each turn whether its role may follow the state before.
2. The template writes each turn as segments: markers without loss, the escaped text with the flag of its role. What a
   template writes as control strings never stands in an escaped text, so the output can be read back.
3. `read` turns a formatted conversation into its turns again; `digest` derives figures and hashes from what it reads.

Escaping: the escape character is doubled, and a control string in a text is parted behind its first character, `</s>`
to `<\\-/s>`, at every place where one starts. Templates that can't be read back are refused: control strings of under
two characters, openings of which one begins another, endings that overlap themselves.

A conversation is hashed in the order of its turns, which no machine can do in parts: its rows meet in one task. They
are streamed there, sorted by Spark (which spills), so that memory is bounded by a batch however long it is.

Defined cases
  null text                    empty
  null role                    the empty role, written like every role without markers of its own
  null conv_id                 all such rows are one conversation
  null turn                    before all others
  ties, repeated rows          turns of equal number by role, then text; each row is a turn
  unknown role, wrong order    formatted like any turn; legal is false
  very long text               one row's text is held by a task
  empty table                  empty result
  extra columns                left out, whatever their names
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE, PART = "\\", "\\-"


@dataclass(frozen=True)
class Template:
    """start: before the first turn; turns: opening and closing by role; other: of all other roles, with what parts the
    role's name from the text; moves: roles that may follow a state ("" is the first); learned: roles whose texts bear
    loss; final: roles that a conversation may end with."""

    start: str
    turns: dict[str, tuple[str, str]]
    other: tuple[str, str, str]
    moves: dict[str, tuple[str, ...]]
    learned: tuple[str, ...]
    final: tuple[str, ...]
    mark: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        controls = [self.start, *self.other, *(c for pair in self.turns.values() for c in pair)]
        openings = [self.other[0], *(a for a, _ in self.turns.values())]
        endings = [*self.other[1:], *(b for _, b in self.turns.values())]
        if any(len(c) < 2 or ESCAPE in c for c in controls):
            raise ValueError("control strings have two characters or more, without the escape character")
        if any(a != b and b.startswith(a) for a in openings for b in openings) or len(set(openings)) < len(openings):
            raise ValueError("an opening begins another")
        if any(c.endswith(c[:k]) for c in endings for k in range(1, len(c))):
            raise ValueError("an ending overlaps itself")
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in dict.fromkeys(controls))
        object.__setattr__(self, "mark", re.compile(starts))

    def escape(self, text: str) -> str:
        return self.mark.sub(lambda m: m[0] + PART, text.replace(ESCAPE, ESCAPE * 2))

    def unescape(self, text: str) -> str:
        return re.sub(r"\\([\\-])", lambda m: ESCAPE if m[1] == ESCAPE else "", text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        """(text, loss) of one turn."""
        if role in self.turns:
            opening, closing = self.turns[role]
        else:
            opening, closing = self.other[0] + self.escape(role) + self.other[1], self.other[2]
        return [*([(self.start, False)] if first else []), (opening, False), (self.escape(text), role in self.learned), (closing, False)]

    def read(self, formatted: str, first: bool = True) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns of a formatted conversation, or of a part of it that begins with a turn."""
        at = 0
        if first:
            if not formatted.startswith(self.start):
                raise ValueError("no start")
            at = len(self.start)
        while at < len(formatted):
            role = next((r for r, (opening, _) in self.turns.items() if formatted.startswith(opening, at)), None)
            if role is not None:
                opening, closing = self.turns[role]
                at += len(opening)
            elif formatted.startswith(self.other[0], at):
                at += len(self.other[0])
                to = formatted.index(self.other[1], at)
                role, closing, at = self.unescape(formatted[at:to]), self.other[2], to + len(self.other[1])
            else:
                raise ValueError(f"no opening at {at}")
            to = formatted.index(closing, at)
            yield role, self.unescape(formatted[at:to])
            at = to + len(closing)


#: Control strings are fixed values; system turns come first only, users and assistants take turns.
TEMPLATE = Template(
    start="<s>",
    turns={"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")},
    other=("[ROLE]", "[SAYS]", "[/ROLE]"),
    moves={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    learned=("assistant",),
    final=("assistant",),
)

SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, turn_no, role, legal, segments): each turn of (conv_id, turn, role, text), sorted within its partition.

    The text of a conversation is the texts of its segments, one after another.
    """
    names = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("role", pa.string()), ("legal", pa.bool_()), ("segments", SEGMENTS)])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = batches  # a conversation that no row has
        state, n = "", 0
        for batch in batches:
            numbers, legal, segments = [], [], []
            ids, roles = batch["conv_id"].to_pylist(), batch["role"].to_pylist()
            for conv, role, text in zip(ids, roles, batch["text"].to_pylist(), strict=True):
                if conv != at:
                    at, state, n = conv, "", 0
                numbers.append(n)
                legal.append(role in template.moves.get(state, ()))
                segments.append([{"text": t, "loss": loss} for t, loss in template.segments(role, text, n == 0)])
                state, n = role, n + 1
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(numbers, pa.int64()), pa.array(roles, pa.string()), pa.array(legal, pa.bool_()), pa.array(segments, SEGMENTS)], schema=names)

    whole = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = whole.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(write, "conv_id long, turn_no long, role string, legal boolean, segments array<struct<text: string, loss: boolean>>")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digest(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """DIGEST rows of conversations, read back from format_turns' own output; its partitions are read as they are."""
    columns = [c.split()[0] for c in DIGEST.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = batches
        out: list[tuple] = []

        def close() -> None:
            if at is not batches:
                out.append((at, n, turns_.hexdigest(), chars, loss.hexdigest(), formatted, legal and role in template.final))

        for batch in batches:
            for conv, fine, segments in zip(batch["conv_id"].to_pylist(), batch["legal"].to_pylist(), batch["segments"].to_pylist(), strict=True):
                if conv != at:
                    close()
                    at, n, chars, formatted, legal = conv, 0, 0, 0, True
                    turns_, loss = hashlib.sha256(), hashlib.sha256()
                whole = "".join(s["text"] for s in segments)
                for role, text in template.read(whole, first=n == 0):
                    turns_.update(f"{role}\n{text}\n".encode())
                    n += 1
                learned = template.unescape("".join(s["text"] for s in segments if s["loss"]))
                loss.update(learned.encode())
                chars, formatted, legal = chars + len(learned), formatted + len(whole), legal and fine
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*out, strict=True)), strict=True)), schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(columns, map(list, zip(*out, strict=True)), strict=True)), schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in DIGEST.split(", ")])
    return turns.select("conv_id", "legal", "segments").mapInArrow(read, DIGEST)
