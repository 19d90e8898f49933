"""Line dedup by a deletion neighbourhood.

Two lines are near if one word inserted, deleted or replaced makes them equal. Every line with a
word left out is a variant of it, and near lines have a variant in common (or one is a variant of
the other). Variants are emitted as hashed keys and joined; what meets is compared word by word,
and of near or equal lines the earliest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.columns import own_columns
from muster.llm.frames import durable, free_name, sent_if_small, tidied
from muster.llm.stars import star_rows

_OCCURRENCE = "key {key}, same long, line int, h1 long, h2 long, halves array<long>"
_VARIANT = "variant long, at int, key {key}, same long, line int, h1 long, h2 long"
_PAIR = "late1 long, late2 long, early1 long, early2 long"


def words_of(line: str) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return line.lower().encode("utf-8", "surrogatepass").split()


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def line_hash(norm: bytes) -> tuple[int, int]:
    both = xxhash.xxh3_128_intdigest(norm)
    return _signed(both >> 64), _signed(both & ((1 << 64) - 1))


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and of the last half of a line's words, and of a line one word shorter.

    Of two near lines, of m or m + 1 words each, the one edit spares the first or the last m // 2
    words, so they have one of these in common.
    """
    found = set()
    for m in {len(words) // 2, (len(words) - 1) // 2}:
        found.add(_signed(xxhash.xxh3_64_intdigest(b"<" + b" ".join(words[:m]))))
        found.add(_signed(xxhash.xxh3_64_intdigest(b">" + b" ".join(words[len(words) - m :]))))
    return sorted(found)


def variants(norm: bytes) -> Iterator[tuple[int, int]]:
    """The hash of the line as it is, at -1, and without its i-th word, at i."""
    yield _signed(xxhash.xxh3_64_intdigest(norm)), -1
    start, i = 0, 0
    while start <= len(norm):
        end = norm.find(b" ", start)
        if end < 0:
            end = len(norm)
        rest = norm[:start] + norm[end + 1 :] if end < len(norm) else norm[: max(start - 1, 0)]
        yield _signed(xxhash.xxh3_64_intdigest(rest)), i
        start, i = end + 1, i + 1


def within_one_edit(one: list[bytes], other: list[bytes]) -> bool:
    """Whether the edit distance in words is 1 or 0."""
    if abs(len(one) - len(other)) > 1:
        return False
    i = 0
    while i < min(len(one), len(other)) and one[i] == other[i]:
        i += 1
    rest, rest_of_other = one[i:], other[i:]
    return rest[1:] == rest_of_other[1:] or rest[1:] == rest_of_other or rest == rest_of_other[1:]


def repeated_lines(
    df: DataFrame, key: str, text: str, *, min_words: int = 1, min_near_words: int = 4
) -> DataFrame:
    """Lines to drop: key, same (a hash of the text), line (from 0), near (else an exact repeat).

    Lines are parted by line feeds and compared by their lower-cased words. Of equal lines of at
    least `min_words` words the earliest stays, by key, then the text's hash, then its place.
    A line of at least `min_near_words` is also dropped, wherever it stands, if a line with an
    earlier first place is near it, whether that one is dropped or not. Null keys come first. Null and
    empty texts have no such lines; an empty table gives no rows. Rows equal in key and text are
    one document. Other columns are not read.

    Only lines that share half of their words with another line can be near one; these few alone
    are brought back as text and emit variants. No group is collected: equal variants are read in
    order of first place, so the earliest comes first and the others meet it.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("same"), F.col(f"`{text}`").alias("text")
    ).where(F.col("text").isNotNull())
    occurrences = durable(_occurrences(rows, kind, min_words, min_near_words))
    lines = durable(
        occurrences.groupBy("h1", "h2").agg(
            F.min(F.struct("key", "same", "line")).alias("first"),
            F.count("*").alias("times"),
            F.first("halves").alias("halves"),
        )
    )
    near = _near_lines(rows, lines, kind)
    marked = durable(
        lines.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
        .where("times > 1 or near")
        .select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    )
    place = F.struct("key", "same", "line")
    return (
        occurrences.select("key", "same", "line", "h1", "h2")
        .join(sent_if_small(marked), ["h1", "h2"])
        .where(F.col("near") | ~F.col("first").eqNullSafe(place))
        .select("key", "same", "line", "near")
        .distinct()
    )


def _occurrences(rows: DataFrame, kind: str, min_words: int, min_near_words: int) -> DataFrame:
    schema = pa.schema(
        [("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("halves", pa.list_(pa.int64()))]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sames, texts = batch.columns
            owners, out = [], []
            for owner, value in enumerate(texts):
                for number, line in enumerate(value.as_py().split("\n")):
                    words = words_of(line)
                    if len(words) >= min_words:
                        near = halves(words) if len(words) >= min_near_words else []
                        owners.append(owner)
                        out.append((number, *line_hash(b" ".join(words)), near))
                if len(out) > 20_000:
                    yield _with_owners(keys, sames, owners, out, schema)
                    owners, out = [], []
            if out:
                yield _with_owners(keys, sames, owners, out, schema)

    return rows.mapInArrow(tidied(read), _OCCURRENCE.format(key=kind))


def _with_owners(keys, sames, owners, out, schema) -> pa.RecordBatch:
    take = pa.array(owners, pa.int32())
    columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays([keys.take(take), sames.take(take), *columns], names=["key", "same", *schema.names])


def _near_lines(rows: DataFrame, lines: DataFrame, kind: str) -> DataFrame:
    """h1 and h2 of the lines that an earlier line is near."""
    shared = star_rows(
        lines.select(
            F.explode("halves").alias("key"),
            F.lit(0).cast("long").alias("size"),
            F.col("h1").alias("node"),
        )
    )
    active = durable(shared.select(F.col("node").alias("h1")).distinct())
    candidates = durable(
        lines.join(sent_if_small(active), "h1").select(
            "h1", "h2", F.col("first.key").alias("key"), F.col("first.same").alias("same"), F.col("first.line").alias("line")
        )
    )
    known = durable(_line_texts(rows, candidates))

    emitted = known.mapInArrow(tidied(_emit), _VARIANT.format(key=kind))
    sizes = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = emitted.repartition(sizes, "variant").sortWithinPartitions("variant", "key", "same", "line", "at")
    pairs = ordered.select("variant", "at", "h1", "h2").mapInArrow(tidied(_meet), _PAIR).distinct()

    texts = known.select("h1", "h2", "norm")
    late = texts.withColumnsRenamed({"h1": "late1", "h2": "late2", "norm": "late"})
    early = texts.withColumnsRenamed({"h1": "early1", "h2": "early2", "norm": "early"})

    @F.arrow_udf("boolean")
    def verify(one: pa.Array, other: pa.Array) -> pa.Array:
        pairs = zip(one.to_pylist(), other.to_pylist(), strict=True)
        return pa.array((within_one_edit(a.split(b" "), b.split(b" ")) for a, b in pairs), pa.bool_())

    return (
        pairs.join(late, ["late1", "late2"])
        .join(early, ["early1", "early2"])
        .where(verify("late", "early"))
        .select(F.col("late1").alias("h1"), F.col("late2").alias("h2"))
        .distinct()
    )


def _line_texts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates with their normal form, read again where they stand first."""
    wanted = durable(
        candidates.groupBy(F.col("key").alias("own_key"), F.col("same").alias("own_same")).agg(
            F.collect_set("line").alias("numbers")
        )
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sames, texts, numbers = batch.columns
            owners, out = [], []
            for owner, (value, chosen) in enumerate(zip(texts, numbers, strict=True)):
                split = value.as_py().split("\n")
                for number in sorted(chosen.as_py()):
                    norm = b" ".join(words_of(split[number]))
                    owners.append(owner)
                    out.append((number, *line_hash(norm), norm))
            if out:
                yield _with_owners(keys, sames, owners, out, schema)

    schema = pa.schema([("line", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("norm", pa.binary())])
    kind = rows.schema["key"].dataType.simpleString()
    return (
        rows.join(
            sent_if_small(wanted),
            F.col("key").eqNullSafe(F.col("own_key")) & (F.col("same") == F.col("own_same")),
        )
        .select("key", "same", "text", "numbers")
        .mapInArrow(tidied(read), f"key {kind}, same long, line int, h1 long, h2 long, norm binary")
        .dropDuplicates(["h1", "h2"])
    )


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("variant", pa.int64()), ("at", pa.int32())])
    for batch in batches:
        owners, out = [], []
        for owner, norm in enumerate(batch.column("norm")):
            for found in variants(norm.as_py()):
                owners.append(owner)
                out.append(found)
            if len(out) > 50_000 or owner == batch.num_rows - 1:
                take = pa.array(owners, pa.int32())
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                columns += [batch.column(name).take(take) for name in ("key", "same", "line", "h1", "h2")]
                yield pa.RecordBatch.from_arrays(columns, names=["variant", "at", "key", "same", "line", "h1", "h2"])
                owners, out = [], []


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a line and an earlier one, of rows in order of variant and first place.

    Lines that lack a word at the same place differ in that word alone; a line that is itself the
    variant differs by one word from each that has it as one. For each of these the earliest line
    of the variant is kept in mind.
    """
    names = ["late1", "late2", "early1", "early2"]
    current, first, whole, by_place = None, None, None, {}
    for batch in batches:
        out = []
        columns = [c.to_pylist() for c in batch.columns]
        for variant, at, h1, h2 in zip(*columns, strict=True):
            line = (h1, h2)
            if variant != current:
                current, first, whole, by_place = variant, line, None, {}
            if at < 0:
                if first != line:
                    out.append((*line, *first))
                whole = line
            else:
                for earlier in {by_place.get(at), whole} - {None, line}:
                    out.append((*line, *earlier))
                by_place.setdefault(at, line)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names
            )


def without_repeated_lines(df: DataFrame, key: str, text: str, **limits: int) -> DataFrame:
    """The frame with repeated and near lines taken out of its texts.

    A text that loses lines and has no word left goes with its row: all it said stands in earlier
    rows. Every other row stays, with all its columns.
    """
    dropped = durable(
        repeated_lines(df, key, text, **limits)
        .groupBy(F.col("key").alias("dropped_key"), F.col("same").alias("dropped_same"))
        .agg(F.collect_set("line").alias("dropped_lines"))
    )
    names = {n: free_name(df, n) for n in dropped.columns}
    dropped = dropped.withColumnsRenamed(names)
    column = F.col(f"`{text}`")

    def remains(value: str | None, numbers: list[int] | None) -> str | None:
        if numbers is None:
            return None
        gone = set(numbers)
        return "\n".join(x for i, x in enumerate(value.split("\n")) if i not in gone)

    @F.arrow_udf("string")
    def rest(texts: pa.Array, lines: pa.Array) -> pa.Array:
        pairs = zip(texts, lines, strict=True)
        return pa.array((remains(v.as_py(), n.as_py()) for v, n in pairs), pa.string())

    numbers = F.col(names["dropped_lines"])
    remaining = free_name(dropped, free_name(df, "remaining"))
    joined = df.join(
        sent_if_small(dropped),
        F.col(f"`{key}`").eqNullSafe(F.col(names["dropped_key"]))
        & (F.xxhash64(column) == F.col(names["dropped_same"])),
        "left",
    ).withColumn(remaining, rest(F.when(numbers.isNotNull(), column), numbers))
    kept = [
        F.coalesce(F.col(remaining), column).alias(text) if name == text else c
        for c, name in zip(own_columns(df), df.columns, strict=True)
    ]
    return joined.where(F.col(remaining).isNull() | F.col(remaining).rlike(r"\S")).select(*kept)
