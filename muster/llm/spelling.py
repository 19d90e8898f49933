"""Spelling variants by pivotal grams: words that differ by one code point, and which form is usual.

One edit spares at least one of two disjoint bigrams of a word. The two are its pivots: of the
word's gram prefix (its three rarest bigrams and what ties with them) those of least summed
frequency, by dynamic programming. Where word s has a gram prefix that reaches as far in the order
of rarity as that of word r, a spared pivot of r is in the prefix of s, moved by one place at most.
So pivots are joined with prefix grams, together with the letters that the edit leaves alone on
their sides, and what meets is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.frames import durable

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: A task's counts are passed on when they are of so many words.
_HELD_WORDS = 300_000
_ROW = "key long, word string, n long, reach int"


def count_words(
    df: DataFrame,
    key: str,
    text: str,
    *,
    letters: str = "A-Za-zÀ-ÿ",
    least_length: int = 7,
    least_count: int = 2,
    damage_one_in: int = 31,
) -> DataFrame:
    """word, n: how often the words of at least `least_length` code points occur in all texts.

    A word is a maximal run of `letters`, A-Z in lower case. Where `damage_one_in` divides the
    crc32 of `<key>:<run>`, the run has lost the code point at that crc32 modulo its length; 0
    damages none. Words with fewer than `least_count` occurrences are left out. Null and empty
    texts have no words, a null key reads as `None`, and every one of repeated rows counts.
    """
    runs = re.compile(f"[{letters}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            keys, texts = batch.columns
            for row, owner in enumerate(keys.to_pylist()):
                before = zlib.crc32(f"{owner}:".encode())
                for run, n in Counter(runs.findall(texts[row].as_py())).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    if damage_one_in:
                        h = zlib.crc32(word.encode("utf-8"), before)
                        if h % damage_one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    held[word] += n
                if len(held) > _HELD_WORDS:
                    yield _counts(held)
                    held = Counter()
        if held:
            yield _counts(held)

    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return (
        rows.where(F.col("text").isNotNull())
        .mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= least_count)
    )


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
    )


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Bigrams of the words by rarity, from 0. At most as many as pairs of letters reach the driver."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(
        F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram")
    )
    counted = grams.groupBy("gram").count().orderBy("count", "gram").collect()
    return {row["gram"]: rank for rank, row in enumerate(counted)}


def gram_prefix(word: str, ranks: dict[str, int]) -> tuple[list[int], int]:
    """Where the grams of a word's prefix begin, in order of place, and the highest of their ranks."""
    own = [ranks[word[i : i + 2]] for i in range(len(word) - 1)]
    reach = sorted(own)[min(2, len(own) - 1)]
    return [i for i, rank in enumerate(own) if rank <= reach], reach


def pivots(word: str, places: list[int], ranks: dict[str, int]) -> tuple[int, int]:
    """The two disjoint grams of the prefix with the least sum of ranks, the first such from the left.

    `least` is the lightest gram that ends before the one in hand.
    """
    weights = [ranks[word[i : i + 2]] for i in places]
    least = chosen = None
    behind = 0
    for at, weight in zip(places, weights, strict=True):
        while places[behind] <= at - 2:
            if least is None or weights[behind] < least[0]:
                least = (weights[behind], places[behind])
            behind += 1
        if least is not None and (chosen is None or least[0] + weight < chosen[0]):
            chosen = (least[0] + weight, least[1], at)
    return chosen[1], chosen[2]


def pivot_keys(word: str, first: int, second: int) -> list[str]:
    """What is left of a word wherever one edit may strike: a pivot, and letters beside the edit.

    In turn: left of the first pivot, between the pivots, right of the second; within the second;
    within the first.
    """
    size = len(word)
    keys = [f"1{word[first:]}", f"3{word[: first + 2]} {word[second:]}", f"5{word[: second + 2]}"]
    behind = size - second - 2
    if behind >= 2:
        keys.append(f"4{word[: first + 2]} {word[-2:]}")
    elif behind == 1:
        keys.append(f"6{word[:-3]} {word[-1]}")
    else:
        keys.append(f"6{word[:-2]}")
    if first >= 2:
        keys.append(f"2{word[:2]} {word[second:]}")
    elif first == 1:
        keys.append(f"7{word[0]} {word[3:]}")
    else:
        keys.append(f"7{word[2:]}")
    return keys


def prefix_keys(word: str, places: list[int]) -> set[str]:
    """The keys by which the pivots of another word may find this one.

    An edit moves a gram by one place at most, and makes the word longer or shorter by one at most.
    """
    keys = set()
    for i in places:
        keys |= {f"1{word[i:]}", f"5{word[: i + 2]}", f"4{word[: i + 2]} {word[-2:]}", f"2{word[:2]} {word[i:]}"}
        keys |= {f"3{word[: i + 2]} {word[j:]}" for j in places if j >= i + 2}
    for gone in (1, 2, 3):
        keys |= {f"6{word[:-gone]}", f"7{word[gone:]}"}
        keys |= {f"6{word[: -gone - 1]} {word[-1]}", f"7{word[0]} {word[gone + 1 :]}"}
    return keys


def _keyed(words: DataFrame, ranks: dict[str, int], keys_of: Callable) -> DataFrame:
    """The words once for each of their keys, with how far their prefix reaches."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2_000):
                part = batch.slice(start, 2_000)
                owners, hashes, reaches = [], [], []
                for owner, word in enumerate(part.column("word").to_pylist()):
                    places, reach = gram_prefix(word, ranks)
                    for key in keys_of(word, places, ranks):
                        owners.append(owner)
                        hashes.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
                        reaches.append(reach)
                rows = part.take(pa.array(owners, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes, pa.int64()), rows["word"], rows["n"], pa.array(reaches, pa.int32())],
                    names=["key", "word", "n", "reach"],
                )

    return words.mapInArrow(emit, _ROW)


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: each two words that one edit parts, both ways and once.

    `words` has word (each once, of four code points or more) and n. An edit inserts, deletes or
    replaces a code point. Keys are hashes; what they bring together is verified, so a collision
    costs time only. An empty table gives no rows.
    """
    ranks = gram_ranks(words)
    emitted = _keyed(words, ranks, lambda word, places, ranks: pivot_keys(word, *pivots(word, places, ranks)))
    indexed = _keyed(words, ranks, lambda word, places, _: prefix_keys(word, places))
    one, other = emitted.alias("one"), indexed.alias("other")
    met = (
        (F.col("one.key") == F.col("other.key"))
        & (F.col("other.reach") >= F.col("one.reach"))
        & (F.col("one.word") != F.col("other.word"))
        & (F.abs(F.length("one.word") - F.length("other.word")) <= 1)
        & (F.levenshtein("one.word", "other.word", 1) == 1)
    )
    pairs = one.join(other, met).select(
        F.col("one.word").alias("word"),
        F.col("one.n").alias("n"),
        F.col("other.word").alias("other"),
        F.col("other.n").alias("other_n"),
    )
    turned = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(
            F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")
        ),
    )
    return pairs.select(F.explode(turned).alias("pair")).select("pair.*").distinct()


def spelling_variants(words: DataFrame, *, dominance: int = 10, most_rounds: int = 64) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of `words` (word, n).

    `n_near` counts the words one edit away. `form` is the most frequent of these, the first in code
    point order of several, if it occurs `dominance` times as often as the word; else null. `root`
    is where forms lead to, the word itself if it has none. Counts grow along forms, so they end.
    """
    words = durable(words.select("word", "n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = durable(
        near_words(words)
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    )
    placed = words.join(near, "word", "left")
    usual = F.col("form_n") >= dominance * F.col("n")
    placed = durable(
        placed.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(usual, F.col("form")).alias("form"),
            F.when(usual, F.col("form_n")).alias("form_n"),
        )
    )
    steps = durable(placed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    for _ in range(most_rounds):
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = durable(
            steps.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), "beyond")
        )
        steps = moved.select("word", "root")
        if not moved.where(F.col("beyond").isNotNull()).limit(1).count():
            break
    else:
        raise RuntimeError(f"forms not followed in {most_rounds} rounds")
    return placed.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))
