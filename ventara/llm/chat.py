"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Conversations are streamed: rows are dealt by conversation and sorted by turn, and the machine keeps one state per conversation, so a
conversation of any length needs the memory of a turn only. Control strings inside roles and texts are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles' texts bear the loss, and which role may follow which.

    `open`, `between` and `close` stand round role and text; `order` maps a state (the last role, "" at the start) to the roles
    allowed next, `final` lists the roles a conversation may end with.
    """

    open: str = "<|im_start|>"
    between: str = "\n"
    close: str = "<|im_end|>\n"
    loss: frozenset = frozenset({"assistant"})
    order: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    final: frozenset = frozenset({"assistant"})


CHATML = Template()

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No `<|` is left: one backslash more stands between the two characters."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


#: Kinds of a segment.
HEAD, BODY, TAIL = "head", "body", "tail"
SEGMENTS = T.StructType([T.StructField(n, t) for n, t in (("turn_no", T.LongType()), ("kind", T.StringType()), ("segment", T.StringType()), ("loss", T.BooleanType()), ("fault", T.StringType()))])


def segments(df: DataFrame, template: Template = CHATML, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn_no, kind, segment, loss, fault): head, body and tail of every turn, in order within a partition.

    Turns are ordered by turn, then role, then text (nulls first), and repeated rows are turns of their own. Null roles and texts
    count as empty. Rows with a null conversation form one conversation. `fault` stands on the head of a turn that the machine does not
    allow (the role it came with after which), and on the tail of a last turn that must not be the last; the segments are written all the same.
    """
    kind = df.schema[conversation].dataType
    sorted_rows = (
        df.select(df[conversation].alias("c"), df[turn].alias("t"), df[role].alias("r"), df[text].alias("x"))
        .repartition("c")
        .sortWithinPartitions("c", "t", "r", "x")
        .select("c", F.coalesce("r", F.lit("")).alias("r"), F.coalesce("x", F.lit("")).alias("x"))
    )
    schema = T.StructType([T.StructField(conversation, kind), *SEGMENTS.fields])

    def run(batches):
        state, number, current, started = "", 0, None, False
        held = None  # the last tail, written once it is known whether its conversation goes on

        def finish():
            if held is None:
                return []
            ends = state in template.final
            return [(*held[:5], None if ends else f"ends with {state!r}")]

        for batch in batches:
            out = []
            for c, r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if not started or c != current:
                    out += finish()
                    state, number, current, started, held = "", 0, c, True, None
                if held is not None:
                    out.append(held)
                allowed = r in template.order.get(state, ())
                out.append((c, number, HEAD, template.open + escape_role(r) + template.between, False, None if allowed else f"{r!r} after {state!r}"))
                out.append((c, number, BODY, escape(x), r in template.loss, None))
                held = (c, number, TAIL, template.close, False, None)
                state, number = r, number + 1
            yield _batch(out, schema)
        yield _batch(finish(), schema)

    return sorted_rows.mapInArrow(run, schema)


def _batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), to_arrow_type(f.dataType)) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


class _Digest:
    """What is read back from the output of one conversation, segment by segment."""

    def __init__(self, template: Template):
        self.template = template
        self.turns = self.loss = self.formatted = self.faults = 0
        self.all, self.scored = hashlib.sha256(), hashlib.sha256()
        self.text = hashlib.sha256()
        self.rest = ""

    def take(self, segment: str, loss: bool, fault: str | None) -> None:
        self.formatted += len(segment)
        self.text.update(segment.encode())
        self.faults += fault is not None
        if loss:
            plain = unescape(segment)
            self.loss += len(plain)
            self.scored.update(plain.encode())
        self.rest += segment
        # whole turns are taken from the formatted text itself; no control string stands inside an escaped role or text
        while (end := self.rest.find(self.template.close)) >= 0:
            turn, self.rest = self.rest[len(self.template.open) : end], self.rest[end + len(self.template.close) :]
            role, _, text = turn.partition(self.template.between)
            self.turns += 1
            self.all.update(f"{unescape_role(role)}\n{unescape(text)}\n".encode())

    def row(self, c) -> tuple:
        return c, self.turns, self.all.hexdigest(), self.loss, self.scored.hexdigest(), self.formatted, self.text.hexdigest(), self.faults


def digests(parts: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row per conversation, read back from `segments`, whose order within partitions this keeps."""
    name, kind = parts.columns[0], parts.schema[0].dataType
    columns = [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("formatted_sha256", T.StringType()), ("n_faults", T.LongType())]
    schema = T.StructType([T.StructField(name, kind), *(T.StructField(n, t) for n, t in columns)])

    def run(batches):
        digest, current = None, None
        for batch in batches:
            out = []
            for c, segment, loss, fault in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if digest is None or c != current:
                    if digest is not None:
                        out.append(digest.row(current))
                    digest, current = _Digest(template), c
                digest.take(segment, loss, fault)
            yield _batch(out, schema)
        yield _batch([digest.row(current)] if digest else [], schema)

    return parts.select(name, "segment", "loss", "fault").mapInArrow(run, schema)
