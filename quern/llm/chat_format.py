"""Chat formatting: a finite-state machine over roles and a declarative template.

Each turn becomes three segments: its opening (marks and role), its text, its end. Segments carry a
loss flag. Control strings inside roles and texts are broken by a backslash after their first
character, and backslashes are doubled; ``unescape`` restores every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._bytes import slices


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles bear loss, and which role may follow which.

    Control strings begin with ``<`` or ``[`` and hold neither of them further on, so none can arise where two
    pieces meet.
    """

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    #: further strings that must not stand in a formatted text by accident
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    loss_roles: tuple[str, ...] = ("assistant",)
    #: allowed next roles by state; a state is the last role, ``""`` at the start; missing states allow nothing
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    accepting: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for c in self.control:
            if not re.fullmatch(r"[<\[][^<\[\\]+", c):
                raise ValueError(f"not a control string: {c!r}")

    @property
    def control(self) -> tuple[str, ...]:
        return (self.turn, self.body, self.end, *self.reserved)

    @property
    def pattern(self) -> re.Pattern:
        return re.compile("|".join(re.escape(c) for c in sorted(self.control, key=len, reverse=True)))


def escape(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _ordered(conversations: DataFrame) -> DataFrame:
    c = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return c.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


#: Segments and characters that wait to be handed on, at most.
HELD_ROWS, HELD_CHARS = 3000, 1 << 20
SEGMENTS = "conv_id bigint, turn_no bigint, segment int, text string, loss boolean, allowed boolean, closed boolean"


def format_conversations(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of all conversations, in order within each partition.

    conv_id, turn_no (from 0), segment (0 opening, 1 text, 2 end), text, loss, allowed (the machine takes this
    turn), closed (the conversation ends here in an accepting state, no turn before was refused; null before the last segment).

    Turns are ordered by turn (null last), ties by role and text; repeated rows are turns of their own. A
    null role or text counts as empty; turns that the machine refuses are formatted all the same and marked. Rows
    without conv_id form one conversation. A conversation is streamed turn by turn: neither its length nor that of its turns together matters for memory. Other
    columns are ignored; an empty table gives no segments.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, names = template.pattern, [x.split(" ")[0] for x in SEGMENTS.split(", ")]
        out: list[list] = []
        nothing, held = object(), 0
        conv, state, n, good = nothing, "", 0, True

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)], names)

        def close():
            if out and conv is not nothing:
                out[-1][6] = good and state in template.accepting

        for batch in slices(batches):
            for c, role, text in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if c != conv or conv is nothing:
                    close()
                    conv, state, n, good = c, "", 0, True
                allowed = role in template.follows.get(state, ())
                good, state = good and allowed, role
                if len(out) > HELD_ROWS or held > HELD_CHARS and len(out) > 3:
                    yield flush(out[:-3])  # the last turn may yet be the end of its conversation
                    out = out[-3:]
                    held = len(out[-2][3])
                held += len(text)
                out.append([c, n, 0, template.turn + escape(role, pattern) + template.body, False, allowed, None])
                out.append([c, n, 1, escape(text, pattern), role in template.loss_roles, allowed, None])
                out.append([c, n, 2, template.end, False, allowed, None])
                n += 1
        close()
        if out:
            yield flush(out)

    return _ordered(conversations).mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Conversations parsed from their segments: digests of turns and of the text under the loss mask.

    One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid.
    ``segments`` must be in the order that ``format_conversations`` gives, each partition with whole conversations. Conversations without conv_id follow each other as
    they come: the null one is one. A conversation ends at its row where ``closed`` is not null, so equal ids after that are another one. Texts are not null there; no segments give no rows.
    """
    template = template or Template()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = object()
        conv, pending, rows = nothing, "", []
        turns = loss = None
        n = loss_chars = chars = 0
        for batch in slices(batches):
            for c, text, under, closed in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("conv_id", "text", "loss", "closed")), strict=True):
                if c != conv or conv is nothing:
                    conv, pending, turns, loss, n, loss_chars, chars = c, "", hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                chars += len(text)
                pending += text
                if under:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if pending.endswith(template.end):
                    head, _, body = pending.removesuffix(template.end).partition(template.body)
                    turns.update(f"{unescape(head.removeprefix(template.turn))}\n{unescape(body)}\n".encode())
                    n, pending = n + 1, ""
                if closed is not None:
                    rows.append((c, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, closed))
                    conv = nothing
            if len(rows) > 2000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return segments.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean")
