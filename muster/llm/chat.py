r"""Chat formatting from an event log.

A log holds, for each conversation, events on its messages: `message` opens one, `delta` adds to
its text, `edit` puts another text in its place, `regenerate` drops what was said so far. Folding
the events of a message in their sequence gives its final text; rendering marks turns:

    <turn>role
    text</turn>

A backslash in a text, and the `<` of a turn mark in it, get a backslash before them, so that no
text can open or close a turn, and reading back gives the exact texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"
_TO_ESCAPE = re.compile(r"\\|<(?=/?turn>)")
_TURN = re.compile(
    r"<turn>((?:[^\\\n<]++|\\.|<(?!/?turn>))*+)\n((?:[^\\<]++|\\.|<(?!/?turn>))*+)</turn>\n", re.DOTALL
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
KINDS = ("message", "delta", "edit", "regenerate")

SEGMENTS = (
    "conv_id {key}, segment long, formatted string, n_turns long, loss array<struct<start: int, end: int>>"
)


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    """As a text, and with line feeds as backslash and n: the first line feed ends the role."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends in it."""
    head = f"{OPEN}{escape_role(role)}\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the text stands, of each turn of a rendered text."""
    at = 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        yield unescape_role(match[1]), unescape(match[2]), match.start(2), match.end(2)
        at = match.end()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in range(0, batch.num_rows, 1000):
            yield from batch.slice(part, 1000).to_pylist()


def fold(rows: Iterator[dict]) -> Iterator[tuple[object, str, str]]:
    """Conversation, role and final text of each message of a sorted log.

    Only one message is held at a time. Events on a turn before its first `message` open it, and
    a second `message` on a turn opens another message. An event of another kind raises.
    """
    place, role, said = None, "", None
    for row in rows:
        here = (row["conv_id"], row["turn"])
        kind = row["kind"]
        if kind not in KINDS:
            raise ValueError(f"no such event: {kind}")
        text = row["text"] or ""
        if said is None or here != place or kind == "message":
            if said is not None:
                yield place[0], role, "".join(said)
            place, role, said = here, row["role"] or "", []
        role = role or row["role"] or ""
        if kind in ("edit", "regenerate"):
            said = []
        said.append(text)
    if said is not None:
        yield place[0], role, "".join(said)


def format_log(
    events: DataFrame, *, trained: tuple[str, ...] = ("assistant",), segment_chars: int = 1 << 20
) -> DataFrame:
    """Rendered conversations: conv_id, segment (from 0), formatted, n_turns, and the loss mask,
    spans of `formatted` that hold texts of the roles in `trained`.

    `events` has conv_id, turn, sequence, kind, role and text; other columns are not read. Turns
    are in order of `turn`, and events of a turn in order of `sequence`; ties go by whether they
    open a message, then by role and text. A null conv_id is a conversation, a null turn the
    first, a null text or role empty. A log without rows gives no rows. Repeated events count as
    often as they are there.

    A conversation is one segment unless it has more than `segment_chars` characters. The log is
    range partitioned by conversation and turn, so a conversation that holds much of the log is
    dealt to many tasks, each folding and rendering its part as segments of their own. No task
    holds more than one message and one segment. `part` numbers those tasks; segments are in
    order of part and segment.
    """
    schema = SEGMENTS.format(key=events.schema["conv_id"].dataType.simpleString()) + ", part int"
    sizes = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    opens = F.coalesce(F.col("kind") == "message", F.lit(False))
    order = ["conv_id", "turn", "sequence", F.desc("opens"), "role", "text"]
    # a message's events stay together, as they share conversation and turn
    ranged = (
        events.select("conv_id", "turn", "sequence", "kind", "role", "text")
        .withColumn("opens", opens)
        .repartitionByRange(sizes, "conv_id", "turn")
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id())
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa_schema
        parts = {}

        def rows() -> Iterator[dict]:
            for row in _rows(batches):
                parts["now"] = row["part"]
                yield row

        def segment(key, number, pieces, turns, spans):
            return {
                "conv_id": key,
                "segment": number,
                "formatted": "".join(pieces),
                "n_turns": turns,
                "loss": [{"start": a, "end": b} for a, b in spans],
                "part": parts["now"],
            }

        out: list[dict] = []
        held = 0
        current, number, pieces, length, turns, spans = None, 0, [], 0, 0, []
        for key, role, text in fold(rows()):
            piece, a, b = render(role, text)
            if pieces and (key != current or length + len(piece) > segment_chars):
                out.append(segment(current, number, pieces, turns, spans))
                held += length
                number = number + 1 if key == current else 0
                pieces, length, turns, spans = [], 0, 0, []
            current = key
            if role in trained:
                spans.append((length + a, length + b))
            pieces.append(piece)
            length += len(piece)
            turns += 1
            if held > segment_chars or len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema=target)
                out, held = [], 0
        if pieces:
            out.append(segment(current, number, pieces, turns, spans))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = events.sparkSession.createDataFrame([], schema)
    pa_schema = to_arrow_schema(empty.schema)
    return ranged.mapInArrow(write, schema)


def read_back(segments: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """What rendered conversations say: conv_id, n_turns, turns_sha256 (of role, line feed, text,
    line feed for each turn), loss_chars and loss_sha256 (of all text under the loss mask), and
    formatted_chars.

    A digest is of a conversation's texts in order, so its segments meet in one task, which reads
    them one after another and holds one at a time.
    """
    kind = segments.schema["conv_id"].dataType
    schema = (
        f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long"
    )
    count = partitions or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        segments.select("conv_id", "part", "segment", "formatted", "loss")
        .repartition(count, "conv_id")
        .sortWithinPartitions("conv_id", "part", "segment")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        current: list | None = None

        def close() -> None:
            key, n, turns, chars, loss, length = current
            out.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, pa_schema, strict=True)], schema=pa_schema
            )

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if current is None or current[0] != row["conv_id"]:
                    if current is not None:
                        close()
                    current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                masked = {(x["start"], x["end"]) for x in row["loss"]}
                for role, text, a, b in read_turns(row["formatted"]):
                    current[1] += 1
                    current[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if (a, b) in masked:
                        current[3] += len(text)
                        current[4].update(text.encode("utf-8", "surrogatepass"))
                current[5] += len(row["formatted"])
                if len(out) >= 1000:
                    yield flush()
        if current is not None:
            close()
        if out:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    pa_schema = to_arrow_schema(segments.sparkSession.createDataFrame([], schema).schema)
    return ordered.mapInArrow(digest, schema)


def message_events(rows: DataFrame) -> DataFrame:
    """A table of final messages as a log: every row opens a message that says its text."""
    return rows.select(
        "conv_id",
        "turn",
        F.lit(0).cast("long").alias("sequence"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


DRAFT = "</turn> draft "


def dealt_events(rows: DataFrame) -> DataFrame:
    """A table of final messages as a log in which they come about step by step.

    A hash of conversation and turn decides how: said at once, streamed in deltas, edited after a
    draft, or regenerated after a streamed draft. What is left at the end is the row's text, empty
    for null. Rows of one turn are messages in order of role and text. No rows give no events.
    """
    number = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    text = F.coalesce("text", F.lit(""))
    third = F.floor(F.length(text) / 3).cast("int")
    first, second = F.substr(text, F.lit(1), third), F.substr(text, third + 1, third)
    last, rest = F.substr(text, 2 * third + 1), F.substr(text, third + 1)

    def steps(*said: tuple[str, Column]) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("step"), F.lit(k).alias("kind"), t.alias("text")) for i, (k, t) in enumerate(said)))

    draft = F.lit(DRAFT)
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    log = (
        F.when(way == 0, steps(("message", text)))
        .when(way == 1, steps(("message", first), ("delta", second), ("delta", last)))
        .when(way == 2, steps(("message", draft), ("edit", first), ("delta", rest)))
        .otherwise(steps(("message", first), ("delta", draft), ("regenerate", first), ("delta", second), ("delta", last)))
    )
    return rows.select("conv_id", "turn", "role", number.alias("number"), F.explode(log).alias("event")).select(
        "conv_id",
        "turn",
        (F.col("number").cast("long") * 8 + F.col("event.step")).alias("sequence"),
        "event.kind",
        "role",
        "event.text",
    )
