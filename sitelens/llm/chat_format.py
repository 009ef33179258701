"""Chat formatting by event-sourced reconstruction.

A log holds events ``(conv_id, seq, kind, msg, role, text)``:

* ``message``  - a whole message ``msg`` with its role and text; if there is one of that
  number, a further one of the same number, and what follows is about that;
* ``delta``    - ``text`` is appended to message ``msg`` (made empty if new);
* ``edit``     - the text of message ``msg`` becomes ``text``;
* ``regenerate`` - the text of message ``msg`` is discarded, and so are all
  messages after it; the following deltas build the new answer;
* ``delete``   - message ``msg`` goes.

The log is partitioned by conversation, sorted by ``seq`` (ties: ``kind``,
``msg``, ``role``, ``text``, so any layout gives the same result; nulls first)
and folded into the final messages, which are then rendered as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

with ``\\`` written ``\\\\`` and ``<|`` written ``<\\|`` inside roles and texts
(and a newline in a role written ``\\n``), which is reversible and leaves no
control string of the template inside a text.

Spark spreads conversations over tasks and sorts each partition with spill;
the fold reads the sorted stream.  A log is ``closed`` if no event goes back to an
earlier message (the plain turn table, streamed answers without later edits): the
same fold then hands a message on as soon as the next one begins, so even a
conversation with a third of all rows is held one message at a time.  An open log
is held a conversation at a time.  Both give the same messages.

Defined cases: a null text is empty; a null role is the empty role; rows with a
null ``conv_id`` form one conversation of their own; equal rows stay separate
turns; events of unknown kind raise an error; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bound_batches

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")
RENDERED = "conv_id bigint, turn_no bigint, role string, rendered string, loss_start bigint, loss_end bigint"
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str, role: bool = False) -> str:
    out = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the span of its text inside it."""
    head = f"{START}{escape(role, True)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def read_turn(rendered: str) -> tuple[str, str]:
    m = _TURN.fullmatch(rendered)
    if not m:
        raise ValueError("not a rendered turn")
    return unescape(m[1], True), unescape(m[2])


def _place(msg: int | None) -> tuple[bool, int]:
    """Order of message numbers, null first."""
    return msg is not None, msg or 0


class Fold:
    """Messages of one conversation by number and, under one number, by their order."""

    def __init__(self) -> None:
        self.messages: dict[tuple, list] = {}
        self.copies: dict[int | None, int] = {}

    def apply(self, kind: str, msg: int | None, role: str, text: str) -> None:
        m = self.messages
        if kind == "message":
            self.copies[msg] = self.copies.get(msg, -1) + 1
        elif kind in ("delta", "edit"):
            self.copies.setdefault(msg, 0)
        at = (*_place(msg), self.copies.get(msg, 0))
        if kind == "message":
            m[at] = [role, [text]]
        elif kind == "delta":
            own = m.setdefault(at, [role, []])
            own[0] = own[0] or role
            own[1].append(text)
        elif kind == "edit":
            m.setdefault(at, [role, []])[1] = [text]
        elif kind == "regenerate":
            for later in [k for k in m if k[:2] > at[:2]]:
                del m[later]
            if at in m:
                m[at][1] = []
        elif kind == "delete":
            for own in [k for k in m if k[:2] == at[:2]]:
                del m[own]
            self.copies.pop(msg, None)
        else:
            raise ValueError(f"unknown event kind {kind!r}")

    def turns(self) -> Iterator[tuple[str, str]]:
        for k in sorted(self.messages):
            role, parts = self.messages[k]
            yield role, "".join(parts)


def turn_events(turns: DataFrame) -> DataFrame:
    """The plain turn table as a log: every row is one closed message."""
    t = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("seq"),
                     F.lit("message").alias("kind"), F.col("turn").cast("bigint").alias("msg"),
                     F.col("role").cast("string"), F.col("text").cast("string"))
    return t


def format_events(events: DataFrame, closed: bool = False) -> DataFrame:
    """Final messages of every conversation, rendered: one row a turn, in
    ``turn_no`` order inside sorted partitions (all turns of a conversation in
    one partition).  ``loss_start``/``loss_end`` span the text under the loss
    mask inside ``rendered`` in code points (null: nothing).

    ``closed``: events come message by message, so the fold hands each on when the
    next begins; an event for an earlier message is an error.
    """
    spark = events.sparkSession
    bound_batches(spark)
    cols = ["conv_id", "seq", "kind", "msg", "role", "text"]
    ev = events.select(F.col("conv_id").cast("bigint"), F.col("seq").cast("bigint"), F.col("kind").cast("string"),
                       F.col("msg").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = ev.repartition(F.col("conv_id")).sortWithinPartitions(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = ()
        opened = None
        fold, number = Fold(), 0
        out: list[tuple] = []

        def put(conv, role, text):
            nonlocal number
            text, a, b = render(role, text)
            mask = role == "assistant"
            out.append((conv, number, role, text, a if mask else None, b if mask else None))
            number += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                columns = [list(x) for x in zip(*out)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = ["conv_id", "turn_no", "role", "rendered", "loss_start", "loss_end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)
                out.clear()

        def end():
            for role, text in fold.turns():
                put(now, role, text)
                if len(out) >= 512:
                    yield from flush()
            fold.messages = {}
            fold.copies = {}

        for b in batches:
            c = [b.column(i).to_pylist() for i in range(6)]
            for conv, _, kind, msg, role, text in zip(*c):
                if now == () or conv != now:
                    if now != ():
                        yield from end()
                    now, number, opened = conv, 0, None
                if closed and opened is not None and (kind == "message" or _place(msg) != opened):
                    if _place(msg) < opened:
                        raise ValueError(f"a closed log goes back to message {msg}")
                    yield from end()
                opened = _place(msg)
                fold.apply(kind, msg, role, text)
            yield from flush()
        if now != ():
            yield from end()
        yield from flush()

    return ordered.mapInArrow(run, RENDERED)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse rendered turns back and digest them per conversation.  Needs the
    partitions of :func:`format_events`; digests are updated turn by turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now: object = ()
        n = loss = chars = 0
        turns = lossy = None
        names = [f.split()[0] for f in DIGEST.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(kinds)],
                                             names=names)
            rows.clear()
            return got

        for b in batches:
            for conv, _, _, text, a, z in zip(*[b.column(i).to_pylist() for i in range(6)]):
                if now == () or conv != now:
                    if now != ():
                        rows.append((now, n, turns.hexdigest(), loss, lossy.hexdigest(), chars))
                    now, n, loss, chars = conv, 0, 0, 0
                    turns, lossy = hashlib.sha256(), hashlib.sha256()
                role, body = read_turn(text)
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
                chars += len(text)
                if a is not None:
                    seen = unescape(text[a:z])
                    loss += len(seen)
                    lossy.update(seen.encode())
            if len(rows) >= 512:
                yield batch()
        if now != ():
            rows.append((now, n, turns.hexdigest(), loss, lossy.hexdigest(), chars))
        if rows:
            yield batch()

    return rendered.mapInArrow(run, DIGEST)
