"""Phrase collocations by Toivonen's method: a sample proposes, full passes count and correct.

Frequent phrases of a sample, at a lowered threshold, are proposed level by level. A full pass counts
them and their negative border exactly: every phrase that is not proposed though all its parts are.
Where a phrase of the border turns out frequent, the pass may have missed longer ones. A frequent phrase
that was not counted holds such a failure, as the least of its parts that is out of reach is one. So the
failures join the proposals, and a further pass counts all that holds one of them and was not in reach
before, taking what it newly finds further at once: after it the border is closed.

What is proposed is held as a bitmap of fixed size, in every task. A bit that two phrases share makes
a pass count more than it must, never less: the counts are exact for any size of bitmap and corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.bitmaps import empty, held, with_hashes
from muster.llm.frames import durable

# Where a text parts into pieces (0xFF is in no UTF-8 text) and a piece into words.
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BLANKS = b" \t"
_NORMAL = bytes(0xFF if b in _BREAKS else 32 if b in _BLANKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = b"\xff"

_HELD_TOKENS = 1_000_000
_COUNTS = "lang string, phrase string, n long"


def tokens_of(text: str | None) -> list[bytes]:
    """Words in lower case, with a break between pieces."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).replace(_BREAK, b" \xff ").split()


def _mixed(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    mixed = (one * np.uint64(0x9E3779B97F4A7C15)) ^ other
    mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xC2B2AE3D27D4EB4F)


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hash(phrase: str, lang: str) -> int:
    """The hash of a phrase in the bitmap: that of all but its last word, mixed with the last's."""
    hashes = _word_hashes(phrase.encode("utf-8", "surrogatepass").split(b" "), lang)
    found = hashes[:1]
    for i in range(1, len(hashes)):
        found = _mixed(found, hashes[i : i + 1])
    return int(found.view(np.int64)[0])


def _near(tokens: np.ndarray, hashes: np.ndarray, added: np.ndarray, longest: int) -> np.ndarray:
    """The tokens that a phrase of up to `longest` words around an added one may have, with breaks
    for the others. What comes into reach by additions holds one of them."""
    inside = tokens != 0
    ok, mixed = inside, hashes[tokens]
    edges = np.zeros(len(tokens) + 1, np.int64)
    for size in range(1, longest):
        if size > 1:
            ok, mixed = ok[:-1] & inside[size - 1 :], _mixed(mixed[:-1], hashes[tokens[size - 1 :]])
        at = np.flatnonzero(ok & held(added, mixed))
        edges += np.bincount(np.maximum(at - (longest - size), 0), minlength=len(edges))
        edges -= np.bincount(np.minimum(at + longest, len(tokens)), minlength=len(edges))
    near = np.where(np.cumsum(edges[:-1]) > 0, tokens, 0)
    return near[(near != 0) | np.append(True, near[:-1] != 0)]


class _Held:
    """The tokens of one language that a task has read and not counted yet."""

    def __init__(self, lang: str) -> None:
        self.lang = lang
        self.ids: dict[bytes, int] = {_BREAK: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str | None) -> None:
        words = tokens_of(text)
        if words:
            ids = self.ids
            found = [ids.setdefault(w, len(ids)) for w in words]
            found.append(0)
            self.parts.append(np.array(found, np.int64))
            self.size += len(found)

    def counted(
        self, levels: range, now: np.ndarray, before: np.ndarray | None
    ) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Phrases and their counts of each level, those within reach now and not before.

        A phrase is in reach if both its parts, without its last and without its first word, are in
        reach and in the bitmap. Ids of parts stand for them, so nothing but equal words is counted
        together.
        """
        tokens = np.concatenate(self.parts)
        names = list(self.ids)
        words = pa.array(names, pa.binary())
        self.ids, self.parts, self.size = {_BREAK: 0}, [], 0
        hashes = _word_hashes(names, self.lang)
        if before is not None:
            tokens = _near(tokens, hashes, now & ~before, levels.stop - 1)

        # of each place: the id of the phrase that begins there, and whether it may be part of more
        ids = tokens
        told, phrases, mixed = np.bincount(tokens, minlength=len(names)), words, hashes
        reach = np.ones(len(names), bool)
        reach[0] = False
        reach_before = np.zeros(len(names), bool) if before is None else reach.copy()
        for level in range(1, levels.stop):
            if level in levels:
                shown = np.flatnonzero((told > 0) & reach & ~reach_before)
                if len(shown):
                    yield phrases.take(pa.array(shown)), told[shown]
            if level == levels.stop - 1:
                break
            part = reach & held(now, mixed)
            if before is not None:  # what is new here is taken further in the same pass
                part |= reach & ~reach_before
            part_before = reach_before & held(before, mixed) if before is not None else np.zeros(len(part), bool)
            here = part[ids[:-1]] & (tokens[level:] != 0)
            here &= part[ids[1:]]
            places = np.flatnonzero(here)
            keys, first, back, told = np.unique(
                (ids[places] << np.int64(32)) | tokens[places + level], return_index=True, return_inverse=True, return_counts=True
            )
            if len(keys) == 0:
                break
            starts = places[first]
            last = tokens[starts + level]
            mixed = _mixed(mixed[ids[starts]], hashes[last])
            reach_before = part_before[ids[starts]] & part_before[ids[starts + 1]]
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(ids[starts])), words.take(pa.array(last)), b" ")
            # id 0 is no phrase
            phrases = pa.concat_arrays([pa.array([b""], phrases.type), phrases])
            told, mixed = np.append(0, told), np.append(np.uint64(0), mixed)
            reach = np.append(False, np.ones(len(keys), bool))
            reach_before = np.append(False, reach_before)
            next_ids = np.zeros(len(tokens) - level, np.int64)
            next_ids[places] = back + 1
            ids = next_ids


def _counted(
    rows: DataFrame, levels: range, now: np.ndarray, before: np.ndarray | None = None
) -> DataFrame:
    """lang, phrase, n: exact counts of the phrases of these lengths within reach of `now` and not
    of `before`. `rows` has lang and text."""
    context = rows.sparkSession.sparkContext
    sent, sent_before = context.broadcast(now), context.broadcast(before)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = sent.value, sent_before.value
        waiting: dict[str, _Held] = {}

        def flushed(which: _Held) -> Iterator[pa.RecordBatch]:
            if not which.size:
                return
            for phrases, told in which.counted(levels, now, before):
                for start in range(0, len(phrases), 50_000):
                    shown = phrases.slice(start, 50_000).cast(pa.string())
                    lang = pa.array([which.lang], pa.string()).take(pa.array(np.zeros(len(shown), np.int64)))
                    n = pa.array(told[start : start + 50_000], pa.int64())
                    yield pa.RecordBatch.from_arrays([lang, shown, n], names=["lang", "phrase", "n"])

        for batch in batches:
            langs, texts = batch.columns
            for lang, text in zip(langs.to_pylist(), texts, strict=True):
                own = waiting.setdefault(lang, _Held(lang))
                own.add(text.as_py())
                if sum(h.size for h in waiting.values()) >= _HELD_TOKENS:
                    yield from flushed(max(waiting.values(), key=lambda h: h.size))
        for own in waiting.values():
            yield from flushed(own)

    return rows.mapInArrow(count, _COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _hash() -> Column:
    @F.arrow_udf("long")
    def hashed(langs: pa.Array, phrases: pa.Array) -> pa.Array:
        pairs = zip(phrases.to_pylist(), langs.to_pylist(), strict=True)
        return pa.array((phrase_hash(phrase, lang) for phrase, lang in pairs), pa.int64())

    return hashed("lang", "phrase")


def _marked(bitmap: np.ndarray, phrases: DataFrame) -> np.ndarray:
    return with_hashes(bitmap, phrases.select(_hash().alias("hash")), F.col("hash"))


def _unmarked(bitmap: np.ndarray, phrases: DataFrame) -> DataFrame:
    """The phrases that are not in the bitmap."""
    sent = phrases.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def absent(hashes: pa.Array) -> pa.Array:
        return pa.array(~held(sent.value, hashes.to_numpy().view(np.uint64)))

    return phrases.where(absent(_hash()))


def _length(phrase: str) -> Column:
    return F.size(F.split(phrase, " ", -1))


def frequent_phrases(
    df: DataFrame,
    text: str,
    lang: str,
    *,
    least: int = 30,
    most_words: int = 4,
    sample_one_in: int = 8,
    bits: int = 26,
) -> tuple[DataFrame, DataFrame]:
    """The phrases of one to `most_words` words that occur `least` times in a language (lang,
    phrase, n), and each language's number of words (lang, n).

    Texts are in lower case (A-Z), cut into pieces at `.,;:!?` and line ends and into words at
    spaces and tabs; phrases lie within a piece, and overlapping occurrences all count. A null
    language is `und`; null and empty texts have no words; each of repeated rows counts. An empty
    table gives no rows. Other columns are not read.

    The sample is one text in `sample_one_in`, by hash; it is only what the first pass starts from.
    The bitmap has 2^`bits` bits (8 MB by default).
    """
    rows = df.select(
        F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")
    ).where(F.octet_length("text") > 0)
    sample = durable(rows.where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(sample_one_in)) == 0))
    lowered = max(1, -(-least // (2 * sample_one_in)))
    proposed = empty(bits)
    for level in range(1, most_words):
        found = _counted(sample, range(level, level + 1), proposed)
        proposed = _marked(proposed, found.where(F.col("n") >= lowered))

    # words below the threshold only count for the sum
    counted = _counted(rows, range(1, most_words + 1), proposed)
    single = ~F.col("phrase").contains(" ")
    kept = durable(
        counted.where((F.col("n") >= least) | single)
        .groupBy("lang", F.when(F.col("n") >= least, F.col("phrase")).alias("phrase"), single.alias("single"))
        .agg(F.sum("n").alias("n"))
    )
    totals = kept.where("single").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = kept.where(F.col("phrase").isNotNull()).select("lang", "phrase", "n")
    failed = durable(_unmarked(proposed, frequent.where(_length("phrase") < most_words)))
    if failed.limit(1).count():
        more = _counted(rows, range(2, most_words + 1), _marked(proposed, failed), proposed)
        frequent = frequent.unionByName(durable(more.where(F.col("n") >= least)))
    return frequent, totals


def collocations(
    df: DataFrame,
    text: str,
    lang: str,
    *,
    least: int = 30,
    most_words: int = 4,
    inside_percent: int = 80,
    scale: int = 2_000_000,
    top: int = 2_000,
    **terms: int,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language.

    Candidates are frequent phrases of two words or more, a their count. Of the cuts of a phrase in
    two, with counts l and r, the one with the least floor(scale * a / (l + r)) counts, the first
    of several; that is its score. A candidate inside a longer one with at least `inside_percent`
    of its count goes. n is the number of words in the language. Order: score and a descending,
    then the phrase by its bytes. Products are decimals of 38 digits. See `frequent_phrases` for
    hard rows.
    """
    frequent, totals = frequent_phrases(df, text, lang, least=least, most_words=most_words, **terms)
    frequent = durable(frequent)
    words = F.split("phrase", " ", -1)
    candidates = frequent.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).where(F.size("words") > 1)

    def joined(part: Column) -> Column:
        return F.array_join(part, " ")

    cut = candidates.select(
        "lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k",
        joined(F.slice("words", F.lit(1), F.col("k"))).alias("first"),
        joined(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest"),
    )
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    score = F.call_function("div", a * F.lit(scale).cast("decimal(10,0)"), l + r)
    scored = (
        cut.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.size("words") - 1),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: joined(F.slice("words", i, size))
            ),
        )
    )
    within = (
        candidates.where(F.size("words") > 2)
        .select("lang", "a", F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    stays = F.col("longer").isNull() | (
        F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * inside_percent
    )
    ranked = (
        scored.join(within, ["lang", "phrase"], "left")
        .where(stays)
        .select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (
        ranked.withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= top)
        .join(totals, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    )
