"""Conversations as training text, by a template that is rendered as a black box.

A template is a function from turns, (role, text) pairs, to one string; nothing else is known of it. Successive prefixes of a
conversation are rendered. What the rendering of one prefix has beyond that of the prefix before is the piece of the last turn. The
text inside the piece of a turn that is learnt from is located by rendering the turn twice more with texts that differ in every
letter: what both renderings share in front and behind is the template's.

A prefix whose rendering doesn't begin with the one before shows that the template rewrites history. Its row is marked, holds the
whole rendering anew, and no span: the text of a conversation is made of the pieces from its last marked row on.

Rows are streamed in the order of conversation and turn. A template that is marked `alone` says that it renders each turn by itself;
then up to `window` turns are rendered together, and a task holds no conversation whole. Any other template may look back on every
turn, so all its prefixes are rendered whole, however long: the work for such a conversation grows with the square of its length.

Turns are ordered by turn, null first, then by role and text. Null roles and texts count as empty. Repeated rows are turns of their own.
Turns without conversation (null) form one conversation. An empty table has no pieces; an empty text is a turn with an empty span.
Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import travels

travels(__name__)

Turns = list[tuple[str, str]]

# Strings by which public chat templates mark turns.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>"]

# A control string starts with a bracket, and has no other bracket that opens. Escaped, a backslash more follows that bracket.
_MARKED = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS)
_ESCAPED = "|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROLS)
_to_escape, _to_restore = re.compile(_MARKED), re.compile(_ESCAPED)


def escape(text: str) -> str:
    """`text` without control strings: each, escaped or not, gets a backslash after its bracket."""
    if "<" not in text and "[" not in text:
        return text
    return _to_escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def restore(text: str) -> str:
    """What `escape` was given."""
    return _to_restore.sub(lambda m: m[0][0] + m[0][2:], text)


def _one_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], restore(line))


START, END = "<|im_start|>", "<|im_end|>\n"


def marked_turns(turns: Turns) -> str:
    """The template: each turn between two marks, its role on a line of its own."""
    return "".join(f"{START}{_one_line(role)}\n{escape(text)}{END}" for role, text in turns)


marked_turns.alone = True


def turns_of(text: str) -> Turns:
    """The turns that `marked_turns` rendered as `text`."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.removesuffix(END).partition("\n")
        out.append((_role_of(role), restore(body)))
    return out


@dataclass(frozen=True)
class ChatRules:
    """`learnt` are the roles whose texts are under the loss mask. Results don't depend on `window`."""

    render: Callable[[Turns], str] = marked_turns
    learnt: tuple[str, ...] = ("assistant",)
    window: int = 64


def _shared(a: str, b: str) -> int:
    """Length of the common start of two strings."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Conversation:
    """Renders the prefixes of one conversation, turn by turn."""

    def __init__(self, rules: ChatRules):
        self.rules, self.turns, self.before, self.length = rules, [], rules.render([]), 0
        # What a template puts in front of no turns at all belongs to the first piece.
        self.head = self.before

    def add(self, role: str, text: str) -> tuple:
        """(piece, start, end, loss_start, loss_end, rewritten) of the next turn."""
        render, turns = self.rules.render, self.turns
        now, before = render([*turns, (role, text)]), self.before
        if not now.startswith(before):
            self._remember(role, text, now)
            self.length, self.head = len(now), ""
            return now, None, None, None, None, True
        piece = now[len(before):]
        start = self.length + len(self.head)
        loss = self._loss(piece, role, before, start) if role in self.rules.learnt else None
        whole, self.head = self.head + piece, ""
        self.length = start + len(piece)
        self._remember(role, text, now)
        return whole, start, self.length, *(loss or (None, None)), False

    def _loss(self, piece: str, role: str, before: str, start: int) -> tuple[int, int] | None:
        probes = [self.rules.render([*self.turns, (role, letter)]) for letter in ("a", "b")]
        if not all(p.startswith(before) for p in probes):
            return None
        a, b = (p[len(before):] for p in probes)
        head, tail = _shared(a, b), _shared(a[::-1], b[::-1])
        if len(piece) < head + tail or piece[:head] != a[:head] or piece[len(piece) - tail:] != a[len(a) - tail:]:
            return None
        return start + head, start + len(piece) - tail

    def _remember(self, role: str, text: str, now: str) -> None:
        self.turns.append((role, text))
        self.before = now
        if getattr(self.rules.render, "alone", False) and len(self.turns) >= self.rules.window:
            self.turns, self.before = [], self.rules.render([])


NAMES = ["conv_id", "position", "role", "piece", "start", "end", "loss_start", "loss_end", "rewritten"]
SCHEMA = ("conv_id long, position long, role string, piece string, start long, end long, loss_start long, loss_end long, rewritten boolean")
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
BATCH_CHARS = 1 << 22


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _render(batches: Iterator[pa.RecordBatch], rules: ChatRules) -> Iterator[pa.RecordBatch]:
    now, conversation, position, held, chars = object(), None, 0, [], 0
    for batch in batches:
        for conv, role, text in zip(*[batch.column(c) for c in ("conv_id", "role", "text")]):
            conv, role, text = conv.as_py(), role.as_py(), text.as_py()
            if conversation is None or conv != now:
                now, conversation, position = conv, Conversation(rules), 0
            row = conversation.add(role, text)
            held.append((conv, position, role, *row))
            position += 1
            chars += len(row[0])
            if chars >= BATCH_CHARS:
                yield _batch(held, _TYPES, NAMES)
                held, chars = [], 0
    if held:
        yield _batch(held, _TYPES, NAMES)


def formatted(conversations: DataFrame, rules: ChatRules = ChatRules()) -> DataFrame:
    """(conv_id, position, role, piece, start, end, loss_start, loss_end, rewritten): one row for each turn.

    Spans count code points of the conversation's text, ends exclusive. Turns of one conversation come in order, in one partition.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(lambda b: _render(b, rules), SCHEMA)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reading:
    """What is read back from the pieces of one conversation."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.clear()

    def clear(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss_start: int | None, loss_end: int | None, rewritten: bool) -> None:
        if rewritten:
            self.clear()
        for role, text in turns_of(piece):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if loss_start is not None:
            learnt = restore(piece[loss_start - self.chars:loss_end - self.chars])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.chars += len(piece)

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types, names = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], [x.split()[0] for x in DIGEST.split(", ")]
    reading = None
    for batch in batches:
        rows = []
        for conv, piece, loss_start, loss_end, rewritten in zip(*[batch.column(c) for c in ("conv_id", "piece", "loss_start", "loss_end", "rewritten")]):
            if reading is None or conv.as_py() != reading.conv:
                if reading is not None:
                    rows.append(reading.row())
                reading = _Reading(conv.as_py())
            reading.add(piece.as_py(), loss_start.as_py(), loss_end.as_py(), rewritten.as_py())
        if rows:
            yield _batch(rows, types, names)
    if reading is not None:
        yield _batch([reading.row()], types, names)


def read_back(conversations: DataFrame, window: int = ChatRules.window) -> DataFrame:
    """The digest of each conversation as its formatted text, under `marked_turns`, gives it back.

    Hashes run over all turns of a conversation in order, so one task streams it; nothing of it is held but the window.
    """
    return formatted(conversations, ChatRules(window=window)).mapInArrow(_read, DIGEST)


def read_back_sql(extra: str) -> str:
    """Checking SQL over conversations and the rows `extra`: what the texts themselves give."""
    controls = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS)
    escaped = lambda x: f"length({x}) + len(regexp_extract_all({x}, '{controls}'))"
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra})),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum({len(START) + 1 + len(END)} + {escaped(role)} + {escaped("text")}) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""
