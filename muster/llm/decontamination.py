"""Benchmark decontamination: one automaton over all windows of the benchmark, one scan of a text.

Texts are normalised to words parted by single spaces. The Aho-Corasick automaton holds every
window as " w1 w2 ... ", so one pass over a text finds all occurrences of all windows. Positions in
the normalised text become word numbers, and these offsets in the original.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from muster.llm.frames import durable, free_name, over_texts, with_fields

# Every byte of a UTF-8 text to its normal form: A-Z lower-cased, other bytes of no word a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
# Of windows of ten words, this much text made an automaton of about 215 MB (measured: 433 MB for 1 MB).
_BLOCK_BYTES = 512 << 10
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")



def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def windows_of(text: str | None, width: int) -> set[str]:
    """The windows of an item as the automaton's keys; bytes stand as Latin-1 characters."""
    words = normal_words(text)
    if not words:
        return set()
    last = max(1, len(words) - width + 1)
    return {(b" " + b" ".join(words[i : i + width]) + b" ").decode("latin-1") for i in range(last)}


class Scanner:
    """The automaton over items (id, text). Windows that items share have all their ids."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        owners: dict[str, set[str]] = {}
        for item_id, text in items:
            for window in windows_of(text, width):
                ids = owners.setdefault(window, set())
                if item_id is not None:
                    ids.add(item_id)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word(window, (len(window), tuple(sorted(ids))))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, tuple[str, ...]]]]:
        """The number of words, and for each occurrence its first word, last word and items."""
        words = normal_words(text)
        if not words:
            return 0, []
        normal = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = []
        if self.any:
            seen = at = 0
            for end, (length, ids) in self.automaton.iter(normal):
                # the words before the closing space, counted on from the last occurrence
                seen += normal.count(" ", at, end)
                at = end
                inside = normal.count(" ", end - length + 1, end)
                found.append((seen - inside, seen - 1, ids))
        return len(words), found


def merged(found: list[tuple[int, int, tuple[str, ...]]]) -> list[tuple[int, int]]:
    """Runs of hit words, in order, overlapping or touching occurrences joined."""
    runs: list[list[int]] = []
    for first, last, _ in sorted(found, key=lambda x: x[:2]):
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs]


def original_offsets(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where runs of words begin and end in the text, in code points."""
    if not runs:
        return []
    ends = {n: None for run in runs for n in run}
    for n, match in enumerate(_WORD.finditer(text)):
        if n in ends:
            ends[n] = match.span()
        if n >= runs[-1][1]:
            break
    return [(ends[a][0], ends[b][1]) for a, b in runs]


_FIELDS = (
    "n_words: long, n_hit: long, items: array<string>, "
    "spans: array<struct<start: int, end: int, first_word: int, last_word: int>>"
)
_NAMES = ("n_words", "n_hit", "items", "spans")


def find_benchmark(
    df: DataFrame,
    text: str,
    items: DataFrame,
    *,
    width: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """The frame with n_words, n_hit, items (ids of items with occurring windows, as sorted
    strings) and spans (of each run of hit words, its start and end in the original, in code
    points, and its first and last word).

    Columns of these names are replaced; one row out for each row in. Null and empty texts have
    no words. Items with null or wordless text have no windows; an item with a null id hits words
    and is not listed; repeated items count once. Without items nothing is hit.

    Different items are sent to the executors as one block while their texts are within
    `block_bytes`. A larger benchmark is dealt into blocks of about that size, each with its own
    automaton and its own scan; the hits so far are kept in a checkpoint between scans. An automaton
    has up to `width` times as many nodes as its block has characters, of 40 bytes or so each, in
    every Python worker. An item is never cut, so one that is longer than a block makes a larger one.
    """
    found, hits = _scanned(df, text, items, width, item_id, item_text, block_bytes)
    return with_fields(found, F.col(hits), *_NAMES).drop(hits)


def without_benchmark(
    df: DataFrame,
    text: str,
    items: DataFrame,
    *,
    width: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = _BLOCK_BYTES,
) -> DataFrame:
    """The rows whose text holds no window of an item, with the columns they have."""
    found, hits = _scanned(df, text, items, width, item_id, item_text, block_bytes)
    return found.where(F.col(hits)["n_hit"] == 0).drop(hits)


def _scanned(
    df: DataFrame, text: str, items: DataFrame, width: int, item_id: str, item_text: str, block_bytes: int
) -> tuple[DataFrame, str]:
    """The frame with the hits of each row in a struct, and the name of that column."""
    rows = items.select(
        F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{item_text}`").alias("text")
    ).where(F.col("text").isNotNull()).distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    blocks = max(1, -(-total // block_bytes))
    if blocks > 1:
        rows = durable(rows)
    found, column = df, F.col(f"`{text}`")
    before: list[str] = []
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        pairs = [(r["item_id"], r["text"]) for r in part.collect()]
        name = free_name(found, "hits")
        found = found.withColumn(name, _scan(pairs, width)(column))
        if before:
            both = free_name(found, "both")
            found = found.withColumn(both, _join_hits(F.col(before[0]), F.col(name))).drop(name, before[0])
            name = both
        before = [name]
        if blocks > 1:
            found = durable(found)
    return found, before[0]


def _scan(pairs: list[tuple[str | None, str | None]], width: int):
    def prepare():
        scanner = Scanner(pairs, width)

        def one(value: str | None) -> dict:
            n, hits = scanner.scan(value)
            runs = merged(hits)
            ends = original_offsets(value, runs) if runs else []
            spans = [(*places, *run) for places, run in zip(ends, runs, strict=True)]
            found = (n, _length(runs), sorted({i for hit in hits for i in hit[2]}), _dicts(spans))
            return dict(zip(_NAMES, found, strict=True))

        return lambda batch: [one(v.as_py()) for v in batch]

    return over_texts(prepare, f"struct<{_FIELDS}>")


def _join_hits(one: Column, other: Column) -> Column:
    """The hits of two scans of the same text as one."""
    kind = to_arrow_type(DataType.fromDDL(f"struct<{_FIELDS}>"))

    def join(a: dict, b: dict) -> dict:
        both = [*a["spans"], *b["spans"]]
        starts = {s["first_word"]: s["start"] for s in both}
        stops = {s["last_word"]: s["end"] for s in both}
        runs = merged([(s["first_word"], s["last_word"], ()) for s in both])
        spans = [(starts[first], stops[last], first, last) for first, last in runs]
        found = (a["n_words"], _length(runs), sorted({*a["items"], *b["items"]}), _dicts(spans))
        return dict(zip(_NAMES, found, strict=True))

    @F.arrow_udf(f"struct<{_FIELDS}>")
    def compute(ones: pa.Array, others: pa.Array) -> pa.Array:
        pairs = zip(ones.to_pylist(), others.to_pylist(), strict=True)
        return pa.array([join(a, b) for a, b in pairs], kind)

    return compute(one, other)


def _length(runs: list[tuple[int, int]]) -> int:
    return sum(last - first + 1 for first, last in runs)


def _dicts(spans: list[tuple[int, int, int, int]]) -> list[dict[str, int]]:
    return [dict(zip(("start", "end", "first_word", "last_word"), span, strict=True)) for span in spans]
