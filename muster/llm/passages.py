"""Substring dedup by repeated-phrase automata.

Passages recur if a window of words stands in two documents. Candidates are found by winnowing: of
the short word runs in a window the one of least hash is its anchor, so equal windows have equal
anchors, and only windows whose anchor occurs in two documents are read on. Such windows meet by
hash, which confirms what recurs and names an earlier document for each later one. The earlier
document's words there, in segments of bounded length, are compiled into Aho-Corasick automata, one
for each shard of documents, and the shard's documents are streamed through it: every occurrence is
located by a tile of it and grown word by word, so the result depends on words, not on hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from muster.functions.columns import own_columns
from muster.llm import bitmaps
from muster.llm.frames import durable, free_name, sent_if_small

_BASE = np.uint64(0x9E3779B97F4A7C15)
_OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
#: A task remembers the first document of so many windows before it passes them on.
_HELD_WINDOWS = 300_000


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class _Runs:
    """Hashes of runs of words, from sums of powers of an odd base modulo 2^64."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, words: np.ndarray, width: int) -> np.ndarray:
        size = len(words)
        if len(self.powers) < size:
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * size, self.base)]))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * size, self.inverse)]))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(words * self.powers[:size])])
        runs = (sums[width:] - sums[:-width]) * self.inverses[: size - width + 1]
        runs ^= runs >> np.uint64(31)
        runs *= _OTHER_BASE
        return runs ^ (runs >> np.uint64(29))


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive values, by windows of doubled width."""
    least, reached = values, 1
    while reached * 2 <= width:
        least = np.minimum(least[:-reached], least[reached:])
        reached *= 2
    rest = width - reached
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def window_anchors(words: list[bytes], window: int, hashes: _Words, runs: _Runs) -> np.ndarray:
    """For each window of a text the hash of its anchor, a run of half as many words."""
    if len(words) < window:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = max(1, window // 2)
    return least_of_each(runs.of(each, width), window - width + 1)


def joined_runs(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of places covered by windows that start at these places, in order."""
    if len(starts) == 0:
        return []
    cuts = np.flatnonzero(np.diff(starts) > width) + 1
    firsts, lasts = starts[np.append(0, cuts)], starts[np.append(cuts - 1, len(starts) - 1)]
    return list(zip(firsts.tolist(), (lasts + width).tolist(), strict=True))


def before(one, other) -> bool:
    """Whether a key comes before another; a null key comes last."""
    return one is not None and (other is None or one < other)


def repeated_passages(df: DataFrame, key: str, text: str, *, window: int = 50, bits: int = 27) -> DataFrame:
    """key, same, runs: the words of each text that stand in a document with a smaller key.

    Words lie between ASCII white space and are compared unchanged. A window is `window`
    consecutive words of one text; it repeats if its words also start in a text with a smaller
    key, whatever else is removed there. `runs` are the first word and the one after the last of
    each stretch that repeated windows cover, in order and apart; texts without any have no row.
    `same` is Spark's xxhash64 of the text and tells texts of one key apart.

    Null and empty texts, and those of fewer words than a window, repeat nothing. A null key is
    larger than every other and not smaller than any. Rows equal in key do not repeat each other. An
    empty table gives no rows. Other columns are not read.

    A text that equals one with a smaller key is repeated as a whole and read no further. The
    anchors of two documents are held in a bitmap of 2^`bits` bits (16 MB by default) in every task;
    where it fills up, more is compared and nothing is lost.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(
        F.octet_length("text") >= 2 * window - 1
    )
    rows = rows.select("key", F.xxhash64("text").alias("same"), "text")
    later = durable(_copies(rows))
    whole = _whole_runs(rows, later, window, kind)
    first = _joined(rows, later, "left_anti")

    anchors = durable(_recurring_anchors(first, window, kind))
    bitmap = bitmaps.with_hashes(bitmaps.empty(bits), anchors, F.col("anchor"))
    regions = durable(_regions(first, bitmap, window, kind))

    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = durable(_routes(regions, window, kind, shards))
    segments = _segments(regions, wanted, window, kind)
    return whole.unionByName(_located(regions, segments, window, kind, shards))


_RUNS = "array<struct<first: int, after: int>>"


def _copies(rows: DataFrame) -> DataFrame:
    """own_key and own_same of texts that equal a text with a smaller key."""
    narrow = rows.select("key", "same", F.md5("text").alias("digest"))
    least = narrow.groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1")
    later = F.col("least").isNotNull() & (F.col("key").isNull() | (F.col("key") > F.col("least")))
    found = narrow.join(least.drop("n"), "digest").where(later)
    return found.select(F.col("key").alias("own_key"), F.col("same").alias("own_same")).distinct()


def _joined(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    at = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("same") == F.col("own_same"))
    return rows.join(sent_if_small(chosen), at, how)


def _whole_runs(rows: DataFrame, later: DataFrame, window: int, kind: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words_of(value.as_py())) for value in batch.column("text")]
            runs = [[(0, n)] if n >= window else None for n in sizes]
            yield _run_batch(batch.column("key"), batch.column("same"), runs)

    copies = _joined(rows, later, "left_semi")
    return copies.mapInArrow(read, f"key {kind}, same long, runs {_RUNS}").where(F.col("runs").isNotNull()).distinct()


def _run_batch(keys, sames, runs: list[list[tuple[int, int]] | None]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
    shown = [None if r is None else [{"first": a, "after": b} for a, b in r] for r in runs]
    return pa.RecordBatch.from_arrays([keys, sames, pa.array(shown, kind)], names=["key", "same", "runs"])


def _recurring_anchors(rows: DataFrame, window: int, kind: str) -> DataFrame:
    """anchor: those of documents with different keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, runs = _Words(), _Runs(_BASE)
        for batch in batches:
            owners, out = [], []
            size = 0
            for owner, value in enumerate(batch.column("text")):
                anchors = window_anchors(words_of(value.as_py()), window, hashes, runs)
                if len(anchors):
                    # one after the other are mostly equal
                    anchors = np.unique(anchors[np.append(True, anchors[1:] != anchors[:-1])])
                    owners.append(np.full(len(anchors), owner, np.int32))
                    out.append(anchors)
                    size += len(anchors)
                if out and (size > 100_000 or owner == batch.num_rows - 1):
                    yield _taken(batch.column("key"), owners, out)
                    owners, out, size = [], [], 0
            if out:
                yield _taken(batch.column("key"), owners, out)

    found = rows.select("key", "text").mapInArrow(emit, f"anchor long, key {kind}")
    several = (F.col("least") < F.col("most")) | (F.col("least").isNotNull() & F.col("open"))
    return (
        found.groupBy("anchor")
        .agg(F.min("key").alias("least"), F.max("key").alias("most"), F.max(F.col("key").isNull()).alias("open"))
        .where(several)
        .select("anchor")
    )


def _taken(keys: pa.Array, owners: list[np.ndarray], out: list[np.ndarray]) -> pa.RecordBatch:
    anchors = pa.array(np.concatenate(out).view(np.int64))
    return pa.RecordBatch.from_arrays(
        [anchors, keys.take(pa.array(np.concatenate(owners)))], names=["anchor", "key"]
    )


def _regions(rows: DataFrame, bitmap: np.ndarray, window: int, kind: str) -> DataFrame:
    """key, same, start, words: the stretches of texts whose windows have a recurring anchor."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sums = _Words(), _Runs(_BASE)
        for batch in batches:
            owners, starts, texts = [], [], []
            size = 0
            for owner, value in enumerate(batch.column("text")):
                words = words_of(value.as_py())
                anchors = window_anchors(words, window, hashes, sums)
                usual = np.flatnonzero(bitmaps.held(shared.value, anchors))
                for first, after in joined_runs(usual, window):
                    owners.append(owner)
                    starts.append(first)
                    texts.append(b" ".join(words[first:after]))
                    size += len(texts[-1])
                if size > 4 << 20:
                    yield _stretches(batch, owners, starts, texts)
                    owners, starts, texts, size = [], [], [], 0
            if owners:
                yield _stretches(batch, owners, starts, texts)

    return rows.mapInArrow(read, f"key {kind}, same long, start int, words binary")


def _stretches(batch: pa.RecordBatch, owners: list[int], starts: list[int], texts: list[bytes]) -> pa.RecordBatch:
    take = pa.array(owners, pa.int32())
    columns = [batch.column("key").take(take), batch.column("same").take(take)]
    columns += [pa.array(starts, pa.int32()), pa.array(texts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "same", "start", "words"])


def _stride(window: int) -> int:
    """From one segment's first word to the next one's; segments are a window less one longer."""
    return 3 * window + 1


def _routes(regions: DataFrame, window: int, kind: str, shards: int) -> DataFrame:
    """shard, source, segment: the segments of earlier documents that a shard's documents need.

    A window goes to where its equals go once from each task, as its first document there; the
    later ones of the task need that one, and of the tasks' documents all but the first need the
    first. So a window that very many documents have is one row for each task.
    """
    stride = _stride(window)
    window_row = f"h1 long, h2 int, key {kind}, segment int, source {kind}, source_segment int"
    schema = to_arrow_schema(DataType.fromDDL(window_row))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, one, two = _Words(), _Runs(_BASE), _Runs(_OTHER_BASE)
        seen: dict[tuple[int, int], tuple] = {}
        for batch in batches:
            keys, _, starts, texts = batch.columns
            routes: set[tuple] = set()
            for key, start, value in zip(keys.to_pylist(), starts.to_pylist(), texts, strict=True):
                words = value.as_py().split(b" ")
                each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                h1 = one.of(each, window).view(np.int64).tolist()
                h2 = (two.of(each, window) >> np.uint64(33)).tolist()
                for at, pair in enumerate(zip(h1, h2, strict=True)):
                    segment = (start + at) // stride
                    had = seen.setdefault(pair, (key, segment))
                    if before(had[0], key):
                        routes.add((key, *had))
                    elif before(key, had[0]):
                        routes.add((had[0], key, segment))
                        seen[pair] = (key, segment)
                if len(seen) > _HELD_WINDOWS:
                    yield from _windows(seen, schema)
                    seen = {}
            if routes:
                yield _passed(routes, schema)
        yield from _windows(seen, schema)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first = None, None
        for batch in batches:
            routes: set[tuple] = set()
            for h1, h2, key, segment, source, source_segment in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if source_segment is not None:
                    routes.add((key, source, source_segment))
                elif (h1, h2) != current:
                    current, first = (h1, h2), (key, segment)
                elif before(first[0], key):
                    routes.add((key, *first))
            if routes:
                ones, sources, places = zip(*routes, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ones, batch.schema.field("key").type), pa.array(sources, batch.schema.field("key").type),
                     pa.array(places, pa.int32())],
                    names=["key", "source", "segment"],
                )

    met = (
        regions.mapInArrow(emit, window_row)
        .repartition(shards, "h1", "h2")
        .sortWithinPartitions("h1", "h2", F.col("key").asc_nulls_last(), "segment")
        .mapInArrow(link, f"key {kind}, source {kind}, segment int")
    )
    return met.select(_shard("key", shards), "source", "segment").distinct()


def _shard(key: str, shards: int):
    return F.pmod(F.xxhash64(F.col(key), F.lit(29)), F.lit(shards)).cast("int").alias("shard")


def _windows(seen: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if not seen:
        return
    ones, twos = zip(*seen, strict=True)
    keys, segments = zip(*seen.values(), strict=True)
    yield _six(ones, twos, keys, segments, [None] * len(keys), [None] * len(keys), schema)


def _passed(routes: set[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Routes that a task has found, as rows that only pass by; their hashes spread them."""
    keys, sources, segments = zip(*routes, strict=True)
    spread = [xxhash.xxh3_64_intdigest(repr(route)) - (1 << 63) for route in routes]
    return _six(spread, [0] * len(keys), keys, [0] * len(keys), sources, segments, schema)


def _six(h1, h2, keys, segments, sources, source_segments, schema: pa.Schema) -> pa.RecordBatch:
    columns = (h1, h2, keys, segments, sources, source_segments)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names
    )


def _segments(regions: DataFrame, wanted: DataFrame, window: int, kind: str) -> DataFrame:
    """shard, source, words: the text of each wanted segment, once for each shard that needs it."""
    stride, length = _stride(window), _stride(window) + window - 1
    own = durable(wanted.select(F.col("source").alias("own_key"), "segment").distinct())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, numbers, texts = [], [], []
            for owner, (start, value) in enumerate(zip(batch.column("start").to_pylist(), batch.column("words"), strict=True)):
                words = value.as_py().split(b" ")
                end = start + len(words)
                for number in range(start // stride, (end - window) // stride + 1):
                    first, after = max(start, number * stride), min(end, number * stride + length)
                    if after - first >= window:
                        owners.append(owner)
                        numbers.append(number)
                        texts.append(b" ".join(words[first - start : after - start]))
            if owners:
                columns = [batch.column("key").take(pa.array(owners, pa.int32()))]
                columns += [pa.array(numbers, pa.int32()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "number", "words"])

    sources = durable(own.select("own_key").distinct())
    texts = (
        regions.join(sent_if_small(sources), F.col("key") == F.col("own_key"), "left_semi")
        .select("key", "start", "words")
        .mapInArrow(cut, f"key {kind}, number int, words binary")
    )
    return (
        wanted.join(texts, (F.col("source") == F.col("key")) & (F.col("segment") == F.col("number")))
        .select("shard", "source", "words")
    )


def tiles(words: list[bytes], window: int) -> Iterator[tuple[int, str]]:
    """Where the tiles of a segment begin, and their text. Any window holds a whole one."""
    width = max(1, window // 2)
    for at in range(0, len(words) - width + 1, width):
        yield at, (b" " + b" ".join(words[at : at + width]) + b" ").decode("latin-1")


class Segments:
    """The automaton over the tiles of a shard's segments (source, words)."""

    def __init__(self, window: int) -> None:
        self.window, self.width = window, max(1, window // 2)
        self.sources: list = []
        self.words: list[list[bytes]] = []
        self.owners: dict[str, list[tuple[int, int]]] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def add(self, source, text: bytes) -> None:
        words = text.split(b" ")
        for at, tile in tiles(words, self.window):
            self.owners.setdefault(tile, []).append((len(self.words), at))
        self.sources.append(source)
        self.words.append(words)

    def close(self) -> None:
        if self.owners:
            self.automaton = ahocorasick.Automaton()
            for tile, owners in self.owners.items():
                self.automaton.add_word(tile, owners)
            self.automaton.make_automaton()
        self.owners = {}

    def runs(self, key, text: bytes) -> list[tuple[int, int]]:
        """Stretches of words covered by windows of segments of earlier keys."""
        if self.automaton is None:
            return []
        words = text.split(b" ")
        normal = (b" " + text + b" ").decode("latin-1")
        reached: dict[tuple[int, int], int] = {}
        found = []
        seen = at = 0
        for end, owners in self.automaton.iter(normal):
            seen += normal.count(" ", at, end)
            at = end
            place = seen - self.width  # of the tile's first word
            for which, offset in owners:
                if not before(self.sources[which], key):
                    continue
                line = (which, place - offset)
                if reached.get(line, -1) > place:
                    continue
                other = self.words[which]
                first, after = place, place + self.width
                shift = offset - place
                while first > 0 and first + shift > 0 and words[first - 1] == other[first + shift - 1]:
                    first -= 1
                while after < len(words) and after + shift < len(other) and words[after] == other[after + shift]:
                    after += 1
                reached[line] = after
                if after - first >= self.window:
                    found.append((first, after))
        return merged(found)


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for first, after in sorted(found):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], after))
        else:
            runs.append((first, after))
    return runs


def _located(regions: DataFrame, segments: DataFrame, window: int, kind: str, shards: int) -> DataFrame:
    """key, same, runs. A shard's segments come before its documents, which are read one by one."""
    documents = regions.select(
        _shard("key", shards), F.lit(None).cast(kind).alias("source"), F.lit(1).alias("turn"), "key", "same", "start", "words"
    )
    compiled = segments.select(
        "shard", "source", F.lit(0).alias("turn"), F.lit(None).cast(kind).alias("key"),
        F.lit(0).cast("long").alias("same"), F.lit(0).alias("start"), "words",
    )
    needed = segments.select("shard").distinct()
    dealt = (
        compiled.unionByName(documents.join(needed, "shard", "left_semi"))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "turn")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, automaton, open_ = None, None, False
        for batch in batches:
            rows, runs = [], []
            shown, sources, turns, keys, starts = (
                batch.column(c).to_pylist() for c in ("shard", "source", "turn", "key", "start")
            )
            for i, value in enumerate(batch.column("words")):
                if shown[i] != current:
                    current, automaton, open_ = shown[i], Segments(window), True
                if turns[i] == 0:
                    automaton.add(sources[i], value.as_py())
                    continue
                if open_:
                    automaton.close()
                    open_ = False
                found = automaton.runs(keys[i], value.as_py())
                if found:
                    rows.append(i)
                    runs.append([(starts[i] + a, starts[i] + b) for a, b in found])
            if rows:
                take = pa.array(rows, pa.int32())
                yield _run_batch(batch.column("key").take(take), batch.column("same").take(take), runs)

    found = dealt.mapInArrow(scan, f"key {kind}, same long, runs {_RUNS}")
    # a text's stretches lie apart; those of repeated rows are the same
    return found.groupBy("key", "same").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"))


def with_kept_words(df: DataFrame, key: str, text: str, *, kept: str = "kept", **terms: int) -> DataFrame:
    """The frame with n_words, n_removed and `kept`: the words of the text that stay, joined by single spaces.

    Columns of these names are replaced; one row out for each row in. Null texts have no words and keep
    nothing (an empty text). See `repeated_passages` for what goes.
    """
    found = durable(repeated_passages(df, key, text, **terms))
    names = {"key": free_name(df, "own_key"), "same": free_name(df, "own_same"), "runs": free_name(df, "runs")}
    found = found.withColumnsRenamed(names)
    at = F.col(f"`{key}`").eqNullSafe(F.col(names["key"])) & (F.xxhash64(F.col(f"`{text}`")) == F.col(names["same"]))

    @F.arrow_udf("struct<n_words: long, n_removed: long, kept: string>")
    def rest(texts: pa.Array, removed: pa.Array) -> pa.Array:
        sizes, gone, left = [], [], []
        for value, runs in zip(texts, removed, strict=True):
            words = words_of(value.as_py())
            sizes.append(len(words))
            parts, last = [], 0
            for run in runs.as_py() or ():
                parts += words[last : run["first"]]
                last = run["after"]
            parts += words[last:]
            gone.append(len(words) - len(parts))
            left.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        columns = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(left, pa.string())]
        return pa.StructArray.from_arrays(columns, names=["n_words", "n_removed", "kept"])

    taken = {"n_words", "n_removed", kept.lower()}
    others = [c for c, name in zip(own_columns(df), df.columns, strict=True) if name.lower() not in taken]
    packed = free_name(df, "packed")
    joined = df.join(sent_if_small(found), at, "left")
    return joined.select(*others, F.explode(F.array(rest(F.col(f"`{text}`"), F.col(names["runs"])))).alias(packed)).select(
        *others,
        F.col(packed)["n_words"].alias("n_words"),
        F.col(packed)["n_removed"].alias("n_removed"),
        F.col(packed)["kept"].alias(kept),
    )
