"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation, sorted by sequence number and folded into final messages:

- `message` opens a message (role, first text), closing the one before;
- `delta` appends to a message (the open one, unless it names another);
- `edit` replaces a message's text;
- `regenerate` drops a message's text and all messages after it, and streams anew.

A record of the log may carry further events in `parts`, in order: what a stream sent under one sequence number.

The final messages are rendered by a template that marks turns:

    <turn ROLE>
    TEXT</turn>

Backslash and `<` inside roles and texts are written as `\\\\` and `\\l`, a role's newline as `\\n`, so no text can hold a control string, and undoing that gives the
text back. The loss mask covers the text of assistant turns.

Rendering streams a conversation's turns: each is a row of its own (position, start, rendered text, loss span). Up to its last event that can reach back,
a conversation's messages are held; after it, and so in a log that is never edited, one turn at a time. One conversation stays in one task, as its
turns follow one another.

Defined cases: a null text or role is empty; records with the same sequence number stand in order of role, text and parts; repeated rows are turns of their own; a null
conversation id is a conversation; empty conversations give nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"
PARTS = "array<struct<kind:string,message:bigint,text:string>>"
TURNS = "conv_id long, position long, start long, rendered string, loss_start long, loss_end long"
OUT_BYTES = 8_000_000
DELTA = 256  # characters that a stream sends at a time
_UNDO = {"\\\\": "\\", "\\l": "<", "\\n": "\n"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\ln]", lambda m: _UNDO[m.group()], text)


def head(role: str) -> str:
    return f"<turn {escape(role).replace(chr(10), chr(92) + 'n')}>\n"


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendering, and where its text stands in it."""
    first, body = head(role), escape(text)
    return f"{first}{body}</turn>\n", len(first), len(first) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation, or of some of its turns."""
    out, at = [], 0
    while at < len(rendered):
        first, last = rendered.find("\n", at), rendered.find("<", at + 1)
        if not rendered.startswith("<turn ", at) or first < 1 or rendered[first - 1] != ">" or not rendered.startswith("</turn>\n", last):
            raise ValueError(f"not a rendered turn at {at}")
        out.append((unescape(rendered[at + 6 : first - 1]), unescape(rendered[first + 1 : last])))
        at = last + 8
    return out


def folded(records: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages (conv_id, message, role, text) of records (conv_id, seq, kind, message, role, text, parts, last_change), by conversation and sequence.

    last_change: the sequence number of the conversation's last event that can reach back; beyond it, a message leaves as the next one opens.
    """
    conv, open_, held = object(), None, []  # held: [conv_id, message, role, pieces of the text]

    def out() -> Iterator[tuple]:
        for c, message, role, pieces in held:
            yield c, message, role, "".join(pieces)

    for c, seq, kind, message, role, text, parts, last_change in records:
        if c != conv:
            yield from out()
            conv, held, open_ = c, [], None
        for kind, message, text in [(kind, message, text), *[(p["kind"], p["message"], p["text"]) for p in parts or ()]]:
            text = text or ""
            if kind == "message":
                if held and (last_change is None or seq is not None and seq > last_change):
                    yield from out()
                    held = []
                held.append([c, message, role or "", [text]])
                open_ = held[-1]
                continue
            target = next((x for x in reversed(held) if x[1] == message), None) if message is not None else open_
            if target is None:  # the log's head is lost: the event opens the message it names
                held.append([c, message, role or "", [text]])
                open_ = held[-1]
            elif kind == "delta":
                target[3].append(text)
            elif kind == "edit":
                target[3] = [text]
            elif kind == "regenerate":
                del held[next(i for i, x in enumerate(held) if x is target) + 1 :]
                target[3], open_ = [text], target
            else:
                raise ValueError(f"unknown event kind {kind!r}")
    yield from out()


def formatted(events: DataFrame) -> DataFrame:
    """Rendered turns (TURNS), each conversation's in order, in one partition."""
    parts = F.col("parts") if "parts" in events.columns else F.lit(None)
    read = events.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in EVENTS.split(", "))], parts.cast(PARTS).alias("parts"))
    reach = ((F.col("kind") != "message") & F.col("message").isNotNull()) | F.coalesce(F.exists("parts", lambda p: p["message"].isNotNull()), F.lit(False))
    changes = read.where(reach).groupBy(F.col("conv_id").alias("_conv")).agg(F.max("seq").alias("last_change"))
    read = read.join(changes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    read = read.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "role", "text", "parts")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                yield from zip(*[c.to_pylist() for c in batch.slice(i, 256).columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out, size, conv, position, start = [x.split()[0] for x in TURNS.split(", ")], [], 0, object(), 0, 0

        def sent() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for c, _, role, text in folded(rows(batches)):
            if c != conv:
                conv, position, start = c, 0, 0
            body, a, b = render(role, text)
            loss = (start + a, start + b) if role == "assistant" else (None, None)
            out.append((c, position, start, body, *loss))
            position, start, size = position + 1, start + len(body), size + len(body)
            if size > OUT_BYTES or len(out) >= 2000:
                yield sent()
                out, size = [], 0
        if out:
            yield sent()

    return read.mapInArrow(run, TURNS)


def whole(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: conversations as one text each, for those that fit into one cell."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("formatted"))


def digest(turns: DataFrame) -> DataFrame:
    """What is read back from `formatted`: one row per conversation. turns: as formatted() leaves them, in their partitions and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

        def closed() -> list:
            return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out = []
            for c, position, start, body, loss_start, loss_end in zip(*[x.to_pylist() for x in batch.columns]):
                if c != conv:
                    if state:
                        out.append(closed())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                [(role, text)] = parse(body)
                if (position, start) != (state[0], state[4]):
                    raise ValueError(f"turn {position} of conversation {c} stands out of order")
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(body)
                if loss_start is not None:
                    masked = unescape(body[loss_start - start : loss_end - start])
                    state[2] += len(masked)
                    state[3].update(masked.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(closed(), kinds)], names)

    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log that would have streamed them: an assistant's message opens empty, its first delta is regenerated, and the text comes in
    deltas; any other opens with half of its first piece, which an edit completes, and goes on in deltas. All of them act on the open message."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{DELTA}}}"), F.lit(0))
    first = F.coalesce(F.get(pieces, F.lit(0)), F.lit(""))

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("long").alias("message"), said.alias("text"))

    def deltas(some: Column) -> Column:
        return F.transform(some, lambda p: event("delta", p))

    spoken = F.concat(F.array(event("delta", first), event("regenerate", F.lit(""))), deltas(pieces))
    typed = F.concat(F.array(event("edit", first)), deltas(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))))
    assistant = F.coalesce(F.col("role").cast("string") == "assistant", F.lit(False))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), F.lit("message").alias("kind"), F.col("turn").cast("long").alias("message"),
        F.col("role").cast("string").alias("role"), F.when(assistant, "").otherwise(F.substring(first, F.lit(1), F.floor(F.length(first) / 2).cast("int"))).alias("text"),
        F.when(assistant, spoken).otherwise(typed).cast(PARTS).alias("parts"),
    )
