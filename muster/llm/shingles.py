"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are different shingle sets, columns are shingles. Two rows link if
100 * overlap >= percent * union. The product is taken in blocks of columns, which are shuffle
partitions, and only over the columns that size bounds leave: of a row's n entries any partner must
share ceil(percent * n / 100), so of its first n - that + 1 + m columns, in any fixed order, at least
m + 1 are shared. A row with fewer has no partner; pairs that meet in too few of them don't link; of
what is left, full rows are multiplied to exact overlaps. Most pairs that can't link are told before
by marks of a few bits for each column, which bound the overlap from above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.frames import durable, free_name, freed, sent_if_small, tidied
from muster.llm.stars import components, star_rows

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _Words(dict):
    """Hashes of words, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def shingle_set(text: str | None, width: int, hashes: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the different runs of `width` words; of fewer words, of them all."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    n = min(width, len(words))
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    runs = np.full(len(words) - n + 1, len(words) if n < width else 0, np.uint64)
    for i in range(n):
        runs = (runs ^ each[i : len(words) - n + 1 + i]) * _POWERS[0]
        runs ^= runs >> np.uint64(29)
    runs = runs * _POWERS[1]
    runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def least_overlap(size: int, percent: int) -> int:
    """How many entries a row of this size shares with any partner at least."""
    return -(-percent * size // 100)


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    small, large = (one, other) if len(one) <= len(other) else (other, one)
    if len(small) == 0 or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    overlap = int((large[at] == small).sum())
    return 100 * overlap >= percent * (len(one) + len(other) - overlap)


def extra(size: int) -> int:
    """How many columns the product takes beyond the first that must be shared: the m above."""
    return size // 24


def rarest(sets: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The columns of a row that the product needs: those not known as common first, by hash."""
    need = len(sets) - least_overlap(len(sets), percent) + 1 + extra(len(sets))
    if len(sets) == 0:
        return sets
    if len(common):
        at = np.minimum(np.searchsorted(common, sets), len(common) - 1)
        usual = common[at] == sets
        sets = np.concatenate([sets[~usual], sets[usual]])
    return sets[:need]


def _common_columns(rows: DataFrame, width: int, one_in: int, least: int, most: int) -> np.ndarray:
    """Shingles that many of the documents have, by a sample of them: only an order of columns.

    The product is exact with any order. This one keeps columns that much of the corpus has out
    of the candidate search where rarer ones do. At most `most` hashes come to the driver.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            for value in batch.column("text"):
                found = shingle_set(value.as_py(), width, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["shingle"])

    drawn = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(one_in)) == 0).select("text")
    counted = (
        drawn.mapInArrow(tidied(emit), "shingle long")
        .groupBy("shingle")
        .count()
        .where(F.col("count") >= least)
        .orderBy(F.desc("count"), "shingle")
        .limit(most)
        .select("shingle")
    )
    return np.sort(counted.toArrow()["shingle"].to_numpy().astype(np.int64).view(np.uint64))


def incidence(df: DataFrame, key: str, text: str, *, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """key, same (the text's hash), node (a hash of the set), size, and the columns the product
    needs. Columns are null where the task has met the set before, so that copies are not
    multiplied. Two different sets are one node with a probability of 2^-64.
    """
    rows = df.select(
        F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("same"), F.col(f"`{text}`").alias("text")
    )
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(common)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, met = _Words(), set()
        known = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                nodes, sizes, chosen = [], [], []
                for value in part.column("text"):
                    found = shingle_set(value.as_py(), width, hashes)
                    node = xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0
                    nodes.append(node)
                    sizes.append(len(found))
                    if len(found) == 0 or node in met:
                        chosen.append(None)
                    else:
                        if len(met) < 1_000_000:
                            met.add(node)
                        chosen.append(rarest(found, known, percent).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("same"),
                        pa.array(np.array(nodes, np.uint64).view(np.int64)),
                        pa.array(sizes, pa.int64()),
                        pa.array(chosen, pa.list_(pa.int64())),
                    ],
                    names=["key", "same", "node", "size", "columns"],
                )

    return rows.mapInArrow(tidied(read), f"key {kind}, same long, node long, size long, columns array<long>")


def _entries(matrix: DataFrame) -> DataFrame:
    """The entries of the product, with the column as key: key, size, node."""
    return matrix.where(F.col("columns").isNotNull()).select(F.explode("columns").alias("key"), "size", "node")


def marks_of(sets: np.ndarray) -> np.ndarray:
    """A row's columns as marks in a field of 4 to 8 bits for each, as bytes."""
    bits = max(6, int(4 * len(sets) - 1).bit_length())
    marked = np.zeros(1 << bits, np.uint8)
    marked[sets >> np.uint64(64 - bits)] = 1
    return np.packbits(marked)


def most_overlap(one: np.ndarray, size: int, other: np.ndarray, other_size: int) -> int:
    """No less than the overlap of two rows with these marks.

    A mark that the other row lacks is of at least one column that it lacks. The longer field is
    folded to the length of the shorter first: a mark there stands for the marks beside each other.
    """
    while len(one) > len(other):
        one = _folded(one)
    while len(other) > len(one):
        other = _folded(other)
    return min(
        size - int(np.bitwise_count(one & ~other).sum()), other_size - int(np.bitwise_count(other & ~one).sum())
    )


def _folded(marks: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(marks)
    return np.packbits(bits[::2] | bits[1::2])


def _marks(texts: DataFrame, width: int) -> DataFrame:
    """node, size and marks of the rows with these texts."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        for batch in batches:
            found = [shingle_set(value.as_py(), width, hashes) for value in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([marks_of(f).tobytes() for f in found], pa.binary()),
                ],
                names=["node", "size", "marks"],
            )

    return texts.select("node", "text").mapInArrow(tidied(mark), "node long, size long, marks binary")


def _overlapping(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (one, other) that can link by their marks: texts are then dealt to few others."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, sizes, marks_one, others, other_sizes, marks_other = batch.columns
            keep = []
            for n, a, m, b in zip(sizes.to_pylist(), marks_one, other_sizes.to_pylist(), marks_other, strict=True):
                one, other = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
                keep.append((100 + percent) * most_overlap(one, n, other, m) >= percent * (n + m))
            chosen = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([ones.filter(chosen), others.filter(chosen)], names=["one", "other"])

    return (
        pairs.join(marks.withColumnsRenamed({"node": "one", "marks": "marks_one"}), "one")
        .join(marks.withColumnsRenamed({"node": "other", "size": "other_size", "marks": "marks_other"}), "other")
        .select("one", "size", "marks_one", "other", "other_size", "marks_other")
        .mapInArrow(tidied(compare), "one long, other long")
    )


def _needed(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of these nodes, so that a join deals out no others."""
    return texts.join(sent_if_small(durable(nodes.distinct())), "node", "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (one, other) whose rows of the matrix link. `texts` has node and text."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        hub, row = None, None
        for batch in batches:
            out = []
            ones, others, texts_one, texts_other = batch.columns
            for i, (a, b) in enumerate(zip(ones.to_pylist(), others.to_pylist(), strict=True)):
                if b != hub:
                    hub, row = b, shingle_set(texts_other[i].as_py(), width, hashes)
                if linked(shingle_set(texts_one[i].as_py(), width, hashes), row, percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["one", "other"]
                )

    pairs = durable(pairs)
    texts = _needed(texts, pairs.select(F.explode(F.array("one", "other")).alias("node")))
    return (
        pairs.join(texts.withColumnsRenamed({"node": "one", "text": "text_one"}), "one")
        .join(texts.withColumnsRenamed({"node": "other", "text": "text_other"}), "other")
        .select("one", "other", "text_one", "text_other")
        .mapInArrow(tidied(multiply), "one long, other long")
    )


def near_duplicates(
    df: DataFrame, key: str, text: str, *, width: int = 5, percent: int = 75, sample_one_in: int = 16, crowd: int = 256
) -> DataFrame:
    """key, same, size (different shingles), component: for each row the least key that links reach.

    A row reaches itself, rows with the same set of shingles, and by links any number of steps.
    Null and empty texts have no shingles and reach themselves only, as do texts of fewer words
    than `width` but the ones with the same words. A null key is never the least: a component
    with null keys alone is null. Repeated rows reach each other. An empty table gives no rows.
    Other columns are not read.

    Groups are never expanded into all pairs. In each column every row is paired with a hub, first
    with the smallest row, then with one drawn by hash. What belongs to different components even
    then is compared in the end: where rows meet in columns that at most `crowd` rows have, pairs
    that can have as many columns as links need. Rows that meet in columns of more alone are
    multiplied in blocks of about `crowd` rows, without the pairs that are of one component already
    and without kinds of rows, by size and number of such columns, that can't link on those alone.
    """
    placed = durable(
        _placed(df, key, text, width=width, percent=percent, sample_one_in=sample_one_in, crowd=crowd)
    )
    some = placed.where("size > 0")
    least = some.groupBy("component").agg(F.min("key").alias("least"))
    return (
        some.join(least, "component")
        .select("key", "same", "size", F.col("least").alias("component"))
        .unionByName(
            placed.where("size = 0").select("key", "same", "size", F.col("key").alias("component"))
        )
    )


def _placed(
    df: DataFrame, key: str, text: str, *, width: int = 5, percent: int = 75, sample_one_in: int = 16, crowd: int = 256
) -> DataFrame:
    """key, same, size and component, a node of the row's component."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    common = _common_columns(rows, width, sample_one_in, 3, 1 << 20)
    spark = df.sparkSession
    matrix = durable(incidence(rows, "key", "text", width=width, percent=percent, common=common))
    met = durable(star_rows(_entries(matrix)).select("key", "node", "size"))
    members = durable(matrix.drop("columns"))
    del matrix
    freed(spark)
    # a node's columns are those of one text, so counting them in a window holds no more than that
    shared = F.count("*").over(Window.partitionBy("node"))
    enough = met.withColumn("shared", shared).where("shared > size div 24").drop("shared")
    groups = durable(star_rows(enough))
    del met, enough
    active = groups.select("node").distinct()
    texts = durable(_texts_of(df, key, text, members, durable(active)))
    freed(spark)

    stars = _fewest(_counted(groups).where(_can_link(percent, "count")), 3)
    links = durable(_verified(stars, texts, width, percent))
    found = components(links)
    mixed = _mixed(groups, found)
    del groups, active, stars
    freed(spark)
    if mixed.limit(1).count():
        marks = durable(_marks(texts, width))
        again = star_rows(mixed, F.xxhash64("node", "key"))
        more = _fewest(_apart(_counted(again), found).where(_can_link(percent)), 16)
        links = links.unionByName(durable(_verified(_overlapping(more, marks, percent), texts, width, percent)))
        freed(spark)
        found = components(links)
        mixed = _mixed(mixed, found)
        del again, more
        freed(spark)
        usual, crowded = _by_crowd(mixed, crowd)
        across = _overlapping(_across(usual, percent), marks, percent)
        last = durable(_verified(across, texts, width, percent))
        del usual, across
        freed(spark)
        if crowded.limit(1).count():
            last = last.unionByName(_block_product(crowded, texts, width, percent, crowd))
        if last.limit(1).count():
            found = components(links.unionByName(last))
    return members.join(found, "node", "left").select(
        "key", "same", "size", F.coalesce("component", "node").alias("component")
    )


def without_near_duplicates(df: DataFrame, key: str, text: str, **terms: int) -> DataFrame:
    """The frame with one row of each component, the one of least key, then least hash of its text.

    Rows with null keys come last. Rows without shingles all stay. Of rows equal in key and text
    that would stay, any one does.
    """
    placed = durable(_placed(df, key, text, **terms).where("size > 0"))
    place = F.struct(F.col("key").isNull().alias("last"), "key", "same")
    first = placed.groupBy("component").agg(F.min(place).alias("first"))
    others = durable(
        placed.join(first, "component")
        .where(~F.struct("key", "same").eqNullSafe(F.struct("first.key", "first.same")))
        .select(F.col("key").alias("own_key"), F.col("same").alias("own_same"))
        .distinct()
    )
    repeated = durable(
        placed.groupBy(F.col("key").alias("own_key"), F.col("same").alias("own_same"))
        .count()
        .where("count > 1")
        .select("own_key", "own_same")
    )

    hidden = {name: free_name(df, name) for name in ("own_key", "own_same")}
    others, repeated = others.withColumnsRenamed(hidden), repeated.withColumnsRenamed(hidden)

    def matched() -> Column:
        return F.col(f"`{key}`").eqNullSafe(F.col(hidden["own_key"])) & (
            F.xxhash64(F.col(f"`{text}`")) == F.col(hidden["own_same"])
        )

    kept = df.join(sent_if_small(others), matched(), "left_anti")
    if not repeated.limit(1).count():
        return kept
    again = sent_if_small(repeated)
    once = kept.join(again, matched(), "left_semi").dropDuplicates([key, text])
    return kept.join(again, matched(), "left_anti").unionByName(once)


def _counted(groups: DataFrame) -> DataFrame:
    """Pairs (one, other) of a node and its hubs, with their sizes and in how many columns they
    are such a pair."""
    return (
        groups.where("node <> hub")
        .groupBy(F.col("node").alias("one"), F.col("hub").alias("other"), "size", F.col("hub_size").alias("other_size"))
        .count()
    )


def _can_link(percent: int, count: str | None = None) -> Column:
    """Whether rows of these sizes can link, given the number of product columns they share.

    In the order of columns, one of the two rows' columns end first. To there, all that both rows
    have is counted, so the overlap is at most the count and what that row has beyond them.
    """

    def rest(size: Column) -> Column:  # of a row, without its product columns
        return F.ceil(size * percent / 100) - 1 - F.floor(size / 24)

    one, other = F.col("size"), F.col("other_size")
    sizes = (one * 100 >= other * percent) & (other * 100 >= one * percent)
    if count is None:
        return sizes
    need = F.ceil((one + other) * percent / (100 + percent))
    return sizes & (F.col(count) >= need - F.greatest(rest(one), rest(other)))


def _fewest(pairs: DataFrame, most: int) -> DataFrame:
    """Of each node's pairs those with most columns; the others are left to a later step."""
    best = Window.partitionBy("one").orderBy(F.desc("count"), "other")
    return durable(
        pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most).select("one", "other")
    )


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose nodes are of different components as yet."""
    mine = found.select(F.col("node").alias("one"), F.col("component").alias("own"))
    theirs = found.select(F.col("node").alias("other"), F.col("component").alias("their"))
    return (
        pairs.join(mine, "one", "left")
        .join(theirs, "other", "left")
        .where(F.coalesce("own", "one") != F.coalesce("their", "other"))
        .drop("own", "their")
    )


def _mixed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of columns that hold more than one component: key, node, size, component."""
    placed = groups.select("key", "node", "size").join(found, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    several = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("key")
    )
    return durable(placed.join(several, "key", "left_semi"))


def _across(usual: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that meet in these columns and can share as many as rows of
    their sizes must, if they also share all the crowded columns that both can."""
    other = usual.select(
        "key",
        F.col("node").alias("other"),
        F.col("size").alias("other_size"),
        F.col("component").alias("other_component"),
        F.col("crowded").alias("other_crowded"),
    )
    return durable(
        usual.select("key", F.col("node").alias("one"), "size", "component", "crowded")
        .join(other, "key")
        .where((F.col("component") < F.col("other_component")) & _can_link(percent))
        .groupBy("one", "other", "size", "other_size", "crowded", "other_crowded")
        .count()
        .withColumn("shared", F.col("count") + F.least("crowded", "other_crowded"))
        .where(_can_link(percent, "shared"))
        .select("one", "other")
    )


def _by_crowd(mixed: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The rows of columns that at most `crowd` nodes have, with how many other columns their nodes
    have (`crowded`), and the rows of those others.

    A pair that meets in an uncrowded column is found there. One that doesn't shares crowded
    columns alone, no more of them than either node has.
    """
    many = mixed.groupBy("key").count().where(F.col("count") > crowd).select("key")
    many = durable(many)
    crowded = durable(mixed.join(many, "key", "left_semi"))
    own = crowded.groupBy("node").agg(F.count("*").alias("crowded"))
    usual = mixed.join(many, "key", "left_anti").join(own, "node", "left")
    return durable(usual.withColumn("crowded", F.coalesce("crowded", F.lit(0)))), crowded


def _block_product(crowded: DataFrame, texts: DataFrame, width: int, percent: int, crowd: int) -> DataFrame:
    """Links between nodes of different components that meet in crowded columns alone."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = durable(_block_tasks(crowded, percent, crowd))
    dealt = (
        tasks.join(_needed(texts, tasks.select("node")), "node")
        .select("task", "node", "component", "text")
        .repartition(partitions, "task")
        .sortWithinPartitions("task", "node")
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Words()
        task, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for here, node, component, value in zip(*columns, strict=True):
                if here != task:
                    yield from _product(rows, percent)
                    task, rows = here, []
                rows.append((node, component, shingle_set(value, width, hashes)))
        yield from _product(rows, percent)

    return durable(dealt.mapInArrow(tidied(multiply), "one long, other long"))


def _block_tasks(crowded: DataFrame, percent: int, crowd: int) -> DataFrame:
    """task, node and component: the nodes of the blocks that a task of the product multiplies.

    Nodes that crowded columns connect form a cluster. Its nodes are dealt into blocks of about
    `crowd` of the same kind: alike in size and number of crowded columns, and of one component
    where that is large. Two blocks, not both of one component, are a task if rows of their kinds
    can link without an uncrowded column in common; of pages made from one template, few or none can.
    """
    edges = star_rows(crowded).where("node <> hub").select(F.col("node").alias("one"), F.col("hub").alias("other"))
    clusters = components(edges.distinct()).select("node", F.col("component").alias("cluster"))
    each = crowded.groupBy("node", "component", "size").agg(F.count("*").alias("crowded"))
    nodes = durable(each.join(clusters, "node"))
    large = nodes.groupBy("cluster", "component").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd)
    likeness = F.struct(
        F.floor(F.log("size") / math.log(1.03)).alias("sizes"), F.floor(F.log("crowded") / math.log(1.25)).alias("shares")
    )
    pooled = F.struct(F.coalesce("pool", F.lit(0)).alias("pool"), F.col("pool").isNull().alias("mixed"), "likeness")
    sorted_out = nodes.join(
        large.select("cluster", "component", F.col("component").alias("pool")), ["cluster", "component"], "left"
    ).select("node", "component", "cluster", "size", "crowded", likeness.alias("likeness"), "pool")
    sorted_out = durable(sorted_out.withColumn("kind", pooled).drop("likeness", "pool"))
    kinds = durable(
        sorted_out.groupBy("cluster", "kind").agg(
            F.ceil(F.count("*") / crowd).alias("blocks"),
            F.min("size").alias("low"),
            F.max("size").alias("high"),
            F.max("crowded").alias("most"),
        )
    )
    with_kinds = kinds.withColumnsRenamed({c: f"other_{c}" for c in ("kind", "blocks", "low", "high", "most")})
    apart = F.col("kind.mixed") | F.col("other_kind.mixed") | (F.col("kind.pool") != F.col("other_kind.pool"))
    block, other = F.struct("kind", "block").alias("place"), F.struct(F.col("other_kind").alias("kind"), F.col("other_block").alias("block"))
    tasks = (
        kinds.join(with_kinds, "cluster")
        .where((F.col("kind") <= F.col("other_kind")) & apart & _kinds_can_link(percent))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("other_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_blocks") - 1)))
        .where("kind <> other_kind or block <= other_block")
        .select(
            "cluster",
            F.xxhash64("cluster", "kind", "block", "other_kind", "other_block").alias("task"),
            F.explode(F.array_distinct(F.array(block, other))).alias("place"),
        )
    )
    placed = sorted_out.join(kinds.select("cluster", "kind", "blocks"), ["cluster", "kind"]).select(
        "cluster", "node", "component", F.struct("kind", F.pmod(F.xxhash64("node"), "blocks").alias("block")).alias("place")
    )
    return tasks.join(placed, ["cluster", "place"]).select("task", "node", "component")


def _kinds_can_link(percent: int) -> Column:
    """Whether a row of one kind can link with one of the other and share crowded columns only.

    As in `_can_link`, for the sizes from `low` to `high` and at most `most` crowded columns.
    """

    def rest(low: str, high: str) -> Column:
        return F.ceil(F.col(high) * percent / 100) - 1 - F.floor(F.col(low) / 24)

    need = F.ceil((F.col("low") + F.col("other_low")) * percent / (100 + percent))
    least = need - F.greatest(rest("low", "high"), rest("other_low", "other_high"))
    near = (F.col("high") * 100 >= F.col("other_low") * percent) & (F.col("other_high") * 100 >= F.col("low") * percent)
    return near & (F.least("most", "other_most") >= least)


def _product(rows: list[tuple[int, int, np.ndarray]], percent: int) -> Iterator[pa.RecordBatch]:
    """The links of a block of the matrix: overlaps of each row with all later ones at once."""
    if not rows:
        return
    nodes = np.array([r[0] for r in rows])
    parts = np.array([r[1] for r in rows])
    sizes = np.array([len(r[2]) for r in rows])
    entries = np.concatenate([r[2] for r in rows])
    owners = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(entries, kind="stable")
    entries, owners = entries[order], owners[order]
    out: list[tuple[int, int]] = []
    for i, (_, part, own) in enumerate(rows):
        low = np.searchsorted(entries, own, "left")
        lengths = np.searchsorted(entries, own, "right") - low
        starts = np.repeat(low - np.append(0, np.cumsum(lengths)[:-1]), lengths)
        overlap = np.bincount(owners[starts + np.arange(lengths.sum())], minlength=len(rows))
        found = 100 * overlap >= percent * (sizes + sizes[i] - overlap)
        found[: i + 1] = False
        out += [(int(nodes[i]), int(nodes[j])) for j in np.flatnonzero(found & (parts != part))]
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["one", "other"]
        )


def _texts_of(df: DataFrame, key: str, text: str, members: DataFrame, active: DataFrame) -> DataFrame:
    """node and text of the active nodes, from one row that has the node's set."""
    wanted = durable(
        members.join(active, "node")
        .groupBy("node")
        .agg(F.min(F.struct("key", "same")).alias("at"))
        .select("node", F.col("at.key").alias("own_key"), F.col("at.same").alias("own_same"))
    )
    return (
        df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
        .join(
            sent_if_small(wanted),
            F.col("key").eqNullSafe(F.col("own_key")) & (F.xxhash64("text") == F.col("own_same")),
        )
        .select("node", "text")
        .dropDuplicates(["node"])
    )
