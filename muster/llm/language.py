"""Language identification by compression.

A language is known by a dictionary of sample text. A text is encoded once with each dictionary,
and the language whose dictionary leaves it smallest is its language.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.frames import durable, over_texts, sent_if_small, with_fields

#: Anything but letters (category L) and the marks (M) that follow one.
_NO_LETTERS = regex.compile(r"(?:[^\p{L}\p{M}]++\p{M}*+|^\p{M}++)+")
_SPREAD = 1 << 30
FIELDS = "struct<lang: string, score: double, margin: double, accepted: boolean>"


@dataclass(frozen=True)
class LanguageModel:
    """Raw-content dictionaries by language, each at most texts x bytes of the fit."""

    dictionaries: dict[str, bytes]


def letters_of(text: str) -> bytes:
    """Lower-cased letters with their marks, anything between them one space."""
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def fit_languages(
    df: DataFrame,
    text: str,
    lang: str,
    *,
    texts_per_language: int = 32,
    bytes_per_text: int = 1024,
    max_bytes: int = 200 * 32 * 1024,
) -> LanguageModel:
    """Dictionaries from a bounded sample of the labelled rows.

    The sample of a language are the different texts of lowest hash, `texts_per_language` of
    them, each adding `bytes_per_text` bytes at most, from a place in it that its hash chooses;
    copies count once and row order doesn't matter. Rows without text, letters or language are not
    used. An empty table gives a model that knows no language. All dictionaries have `max_bytes`
    together: with many languages each has fewer texts, then shorter ones, of one letter at least.
    """
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    digest = F.xxhash64("text")
    texts = durable(rows.groupBy("lang").agg(F.approx_count_distinct(digest).alias("texts")))
    counts = {r["lang"]: r["texts"] for r in texts.collect()}
    if not counts:
        return LanguageModel({})
    each = max(1, max_bytes // len(counts))
    bytes_per_text = min(bytes_per_text, each)
    texts_per_language = min(texts_per_language, max(1, each // bytes_per_text))
    # four times what is needed, for chance and what is estimated
    needed = F.lit(4.0 * texts_per_language) / F.col("texts")
    shares = texts.select(
        F.col("lang").alias("shared_lang"), F.ceil(F.least(F.lit(1.0), needed) * _SPREAD).alias("share")
    )
    # from a place that leaves enough of the text behind it; lower-cased letters are at most three
    # times as long in characters as in bytes
    place = F.pmod(F.xxhash64("text", F.lit("place")), F.greatest(F.length("text") - bytes_per_text, F.lit(0)) + 1)
    part = F.substring("text", place.cast("int") + 1, F.lit(3 * bytes_per_text))
    lettered = F.when(part.rlike(r"\p{L}"), part).otherwise(F.regexp_replace("text", r"^\P{L}+", ""))
    sample = (
        rows.join(sent_if_small(shares), F.col("lang") == F.col("shared_lang"))
        .where(F.pmod(digest, F.lit(_SPREAD)) < F.col("share"))
        .groupBy("lang", digest.alias("digest"))
        .agg(F.min(F.substring(lettered, 1, 3 * bytes_per_text)).alias("text"))
    )
    pieces: dict[str, list[bytes]] = {name: [] for name in counts}
    for r in sample.orderBy("digest").limit(16 * texts_per_language * len(counts)).collect():
        if len(pieces[r["lang"]]) < texts_per_language:
            pieces[r["lang"]].append(letters_of(r["text"])[:bytes_per_text])
    return LanguageModel({name: b" ".join(found) for name, found in sorted(pieces.items()) if found})


class Encoders:
    """One encoder for each language. Long texts are encoded in pieces, so that a dictionary
    counts for their end as for their start; every piece of the text is encoded."""

    def __init__(self, model: LanguageModel, piece: int = 2048, level: int = 6) -> None:
        self.piece = piece
        self.encoders = {}
        for name, content in model.dictionaries.items():
            settings = zstandard.ZstdCompressionParameters.from_level(
                level,
                source_size=piece,
                dict_size=len(content),
                min_match=3,
                write_content_size=False,
                write_dict_id=False,
                format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            self.encoders[name] = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)

    def sizes(self, data: bytes) -> dict[str, int]:
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        return {name: sum(len(e.compress(p)) for p in pieces) for name, e in self.encoders.items()}


def decide(sizes: dict[str, int], length: int, min_margin: float) -> tuple[str, float, float, bool]:
    """The smallest (of equal ones the first by name), its share of belief, margin, acceptance.

    The margin is what the next best needs more, as a part of the text's length. Belief falls by
    e for each 1/50 of the length that a language needs more than the best.
    """
    order = sorted((size, name) for name, size in sizes.items())
    best, name = order[0]
    margin = (order[1][0] - best) / length if len(order) > 1 else 1.0
    score = 1 / sum(math.exp(-50 * (size - best) / length) for size, _ in order)
    return name, score, margin, margin >= min_margin


def language_of(text: Column, model: LanguageModel, *, min_margin: float = 0.004, unknown: str = "und") -> Column:
    """A struct of lang, score, margin and accepted (false where the margin is narrow).

    Without text, letters or known languages: `unknown`, score and margin 0, not accepted.
    """

    def prepare():
        encoders = Encoders(model)

        def one(value: str | None) -> dict:
            data = letters_of(value) if value is not None else b""
            if data and encoders.encoders:
                found = decide(encoders.sizes(data), len(data), min_margin)
            else:
                found = (unknown, 0.0, 0.0, False)
            return dict(zip(("lang", "score", "margin", "accepted"), found, strict=True))

        return lambda batch: [one(v.as_py()) for v in batch]

    return over_texts(prepare, FIELDS)(text)


def identify_languages(df: DataFrame, text: str, model: LanguageModel, *, min_margin: float = 0.004) -> DataFrame:
    """The frame with lang, score, margin and accepted; columns of these names are replaced.

    One row out for each row in; other columns pass unread by Python.
    """
    return with_fields(
        df,
        language_of(F.col(f"`{text}`"), model, min_margin=min_margin),
        "lang",
        "score",
        "margin",
        "accepted",
    )
