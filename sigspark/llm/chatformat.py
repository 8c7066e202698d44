"""Chat formatting with a grammar round trip.

A conversation is rendered by a template whose grammar is

    conversation = { turn }        turn = begin head text end        head = mark of the role | "[ROLE]" name "[/ROLE]"

``write_turns`` renders the turns, parses the result again with the deterministic parser of that grammar and compares the
recovered turns with the source. Turns that do not come back identical are escaped (one escape character more after the first
character of every control string, with or without escape characters already) and the text is rendered and parsed again,
until it is identical. Nothing else is changed, so ``formatted`` holds most texts literally.

``format_chats`` orders the rows by ranges of (conversation, turn), so a conversation of any size is cut into parts of
whole turns (``part_chars``) by many tasks; each part is a text that parses alone, and the parts of a conversation in order are the
formatted conversation. ``digest`` reads parts back: those that hold their whole conversation where they lie, the
others, at most two a task and those of conversations beyond ``part_chars``, in order with a running checksum and bounded memory. (SHA-256 has no
parallel form: the checksum alone of one conversation is one stream.)

Cases: null text and null role are empty; an empty role has the general head with an empty name; null conversation ids are one
conversation, null turns come first; rows that share a turn are ordered by role, then text, repeated rows are each a turn; a very
long text is one part by itself; an empty table gives no part; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART_CHARS = 1_000_000
# Turns of parts that leave a task at once.
BATCH_CHARS = 4_000_000


class NotInGrammar(ValueError):
    """A text that is not a sequence of turns."""


@dataclass(frozen=True)
class Template:
    """Control strings of a chat template; ``learn`` names the roles whose texts are under the loss mask."""

    begin: str = "<s>"
    end: str = "</s>"
    marks: dict[str, str] = field(default_factory=lambda: {"user": "[INST]", "assistant": "[/INST]"})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    escape: str = "\\"
    learn: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self):
        controls = [self.begin, self.end, *self.marks.values(), *self.other]
        firsts = {c[:1] for c in controls}
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c or firsts & set(c[1:]) for c in controls) or len(set(controls)) < len(controls):
            raise ValueError("control strings must differ, have two characters or more, no escape character, and their first characters nowhere else")
        esc = re.escape(self.escape)
        some = lambda more: "|".join(f"{re.escape(c[0])}{esc}{more}(?={re.escape(c[1:])})" for c in controls)
        head = "|".join(f"({re.escape(m)})" for m in self.marks.values())
        rest = f"{re.escape(self.other[0])}(.*?){re.escape(self.other[1])}"
        put = object.__setattr__
        put(self, "_firsts", tuple(firsts))
        put(self, "_conflict", re.compile(some("*")))
        put(self, "_escaped", re.compile(some("+")))
        put(self, "_control", re.compile("|".join(map(re.escape, controls))))
        put(self, "_head", re.compile(re.escape(self.begin) + f"(?:{'|'.join(x for x in (head, rest) if x)})", re.S))

    def shield(self, text: str) -> str:
        return self._conflict.sub(lambda m: m[0] + self.escape, text) if any(c in text for c in self._firsts) else text

    def unshield(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[0][:-1], text) if self.escape in text else text

    def render(self, role: str, text: str, shielded: bool) -> tuple[str, int]:
        """(the turn, where its text begins)."""
        mark = self.marks.get(role)
        head = self.begin + (mark if mark is not None else self.other[0] + (self.shield(role) if shielded else role) + self.other[1])
        return head + (self.shield(text) if shielded else text) + self.end, len(head)

    def parse(self, formatted: str) -> list[tuple[str, str, int, int]]:
        """(role, text, start, end) of every turn; the span is that of the text as it stands."""
        names, out, at = list(self.marks), [], 0
        while at < len(formatted):
            head = self._head.match(formatted, at)
            if head is None:
                raise NotInGrammar(f"no turn at {at}")
            start, end = head.end(), formatted.find(self.end, head.end())
            body = formatted[start:end]
            role = head[len(names) + 1] if head.lastindex == len(names) + 1 else None
            if end < 0 or any(c in body for c in self._firsts) and self._control.search(body) or role and self._control.search(role):
                raise NotInGrammar(f"a turn at {at} that does not end or holds control strings")
            out.append((names[head.lastindex - 1] if role is None else self.unshield(role), self.unshield(body), start, end))
            at = end + len(self.end)
        return out


LLAMA_LIKE = Template()


def _read(template: Template, formatted: str) -> list[tuple[str, str]] | None:
    try:
        return [(role, text) for role, text, _, _ in template.parse(formatted)]
    except NotInGrammar:
        return None


def write_turns(turns: list[tuple[str, str]], template: Template = LLAMA_LIKE) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask); parsing it gives ``turns`` again, exactly."""
    shielded = [False] * len(turns)
    while True:
        pieces = [template.render(role, text, s) for (role, text), s in zip(turns, shielded, strict=True)]
        formatted = "".join(p for p, _ in pieces)
        if _read(template, formatted) == turns:
            break
        lost = [i for i, (p, _) in enumerate(pieces) if _read(template, p) != [turns[i]]]
        if not lost or all(shielded[i] for i in lost):
            raise ValueError("the template cannot carry these turns")
        for i in lost:
            shielded[i] = True
    spans, at = [], 0
    for (role, _), (piece, head) in zip(turns, pieces, strict=True):
        if role in template.learn:
            spans.append((at + head, at + len(piece) - len(template.end)))
        at += len(piece)
    return formatted, spans


def format_chats(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = LLAMA_LIKE, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, whole, n_turns, formatted, spans): ``part`` rises within a conversation; ``whole`` parts hold all of it."""
    kind = chats.schema[conv].dataType.simpleString()
    rows = chats.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the range bounds take samples to the driver: the beginning of a text is enough to order ties
    ordered = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = f"conv_id {kind}, part bigint, whole boolean, n_turns bigint, formatted string, spans array<struct<start: int, end: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, no, out, held = TaskContext.get().partitionId() << 40, 0, [], 0
        conv_type, span_type = None, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

        def part(key, turns, whole):
            formatted, spans = write_turns(turns, template)
            return key, base + no, whole, len(turns), formatted, [{"start": a, "end": b} for a, b in spans]

        def flush():
            types = [conv_type, pa.int64(), pa.bool_(), pa.int64(), pa.string(), span_type]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "part", "whole", "n_turns", "formatted", "spans"])

        key, turns, size, begins, first = None, [], 0, False, True
        for batch in batches:
            conv_type = batch.column(0).type
            for k, r, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                new = first or k != key
                if turns and (new or size + len(t) > part_chars):
                    # the first and the last conversation of a task may go on in another
                    out.append(part(key, turns, begins and new))
                    no, held, turns = no + 1, held + size, []
                    begins, size = False, 0
                    if held > BATCH_CHARS:
                        yield flush()
                        out, held = [], 0
                if new:
                    begins, key = not first, k
                first = False
                turns.append((r, t))
                size += len(t)
        if turns:
            out.append(part(key, turns, False))
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)


def digest(parts: DataFrame, template: Template = LLAMA_LIKE) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from the parts.

    ``turns_sha256``: role, newline, text, newline of every turn; ``loss_*``: the unescaped texts under the mask, nothing between.
    ``parts`` is read twice: give a written table.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def done():
            n, turns, loss_n, loss, chars = state
            return key, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

        for batch in batches:
            conv_type = batch.column(0).type
            for k, whole, formatted, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "whole", "formatted", "spans")), strict=True):
                if state is None or k != key or whole:
                    if state is not None:
                        out.append(done())
                    key, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in template.parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    learned = template.unshield(formatted[s["start"] : s["end"]])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(formatted)
            if out:
                yield rows(out, conv_type)
                out = []
        if state is not None:
            yield rows([done()], conv_type)

    def rows(found, conv_type):
        types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=schema.names)

    cols = ["conv_id", "whole", "formatted", "spans"]
    alone = parts.where("whole").select(*cols).mapInArrow(run, schema)
    open_ones = parts.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(*cols)
    return alone.unionByName(open_ones.mapInArrow(run, schema))
