"""Chat formatting that is proven by its own grammar.

    conversation = { "<|im_start|>" role "\\n" text "<|im_end|>" "\\n" }

A turn is rendered as it is, parsed again by a deterministic parser, and compared with its source. If they differ, or the
parser rejects it, the content is escaped by one more step and tried again, until they agree. Escaping puts a backslash
before the bar of every "<|im_", and one more where backslashes stand there already; the parser takes one away. So content
without such strings is never touched, and any content can be read back. A role is escaped alike, with "\\n" for a new line.

Output is one row per turn, in order: the rendered text and the place of what the loss covers in it (all of an assistant's
text). The text of a conversation is these rows one after the other; no conversation has to fit one row or one task's memory, since
the reader streams over rows sorted by conversation and turn.

Defined cases: a null text or role is empty; turns with equal numbers are ordered by role and text; a null turn comes first; rows
with a null conversation id are one conversation; extra columns are left; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import id_key

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<(\\*)\|im_")
_ESCAPED = re.compile(r"<(\\*)\\\|im_")
FORMATTED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Malformed(ValueError):
    """A text that the grammar does not derive."""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<{m[1]}\\|im_", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|im_", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered conversation."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise Malformed(f"no turn begins at {at}")
        line = formatted.find("\n", at)
        end = formatted.find(END, line)
        if line < 0 or end < 0 or not formatted.startswith("\n", end + len(END)):
            raise Malformed(f"the turn at {at} does not end")
        role, text = formatted[at + len(START) : line], formatted[line + 1 : end]
        if START in role or END in role or START in text:
            raise Malformed(f"a control string stands inside the turn at {at}")
        turns.append((unescape_role(role), unescape(text)))
        at = end + len(END) + 1
    return turns


def render_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The rendered turn, and where its text stands in it."""
    role, text = role or "", text or ""
    for shown_role, shown in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        head = f"{START}{shown_role}\n"
        whole = f"{head}{shown}{END}\n"
        try:
            if parse(whole) == [(role, text)] and not (shown == text and _CONTROL.search(text)):
                return whole, len(head), len(head) + len(shown)
        except Malformed:
            continue
    raise Malformed(f"no escape makes this turn readable: {role!r}, {text[:80]!r}")


def format_turns(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, turn, formatted, and the loss span [loss_start, loss_end) in it, in code points."""

    def run(batches):
        for batch in batches:
            conv, turn, roles, texts = (batch.column(k) for k in range(4))
            roles, done = roles.to_pylist(), []
            for role, text in zip(roles, texts.to_pylist()):
                whole, a, b = render_turn(role, text)
                done.append((whole, a, b) if role == "assistant" else (whole, 0, 0))
            out = list(zip(*done)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([conv, turn, pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["conv_id", "turn", "formatted", "loss_start", "loss_end"])

    chosen = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chosen.mapInArrow(run, FORMATTED)


def whole_conversations(formatted: DataFrame) -> DataFrame:
    """One string per conversation, for those that fit a row."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "formatted")))
    return formatted.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["formatted"]), "").alias("formatted"))


class _Digest:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, a: int, b: int) -> None:
        for role, text in parse(formatted):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        under = unescape(formatted[a:b])
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(under)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows say, per conversation: turns and the text under the loss mask, as digests."""

    def run(batches):
        now = None
        for batch in batches:
            done = []
            for conv, text, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if now is None or conv != now.conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv)
                now.add(text, a, b)
            if done:
                yield _rows(done)
        if now is not None:
            yield _rows([now.row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions(id_key(F.col("conv_id")), F.col("conv_id").isNull(), "turn", "formatted")
    return ordered.mapInArrow(run, READ)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
