"""Licence scans: texts whose canonical form is that of a known licence, by a join on digests.

Only DataFrame functions. A unit of text is matched as a whole; units are the text itself, each of
its lines, so that a notice standing alone on a line is found as well, and runs of its paragraphs,
so that a whole licence or a wrapped notice inside a longer text is.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Wordings of licences and of the notices that refer to them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in "
        "all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
        "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT "
        "OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
)

# Headings under which whole licences stand.
HEADINGS = {
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
}

# Where the parts of a long licence begin that may be left out before or after it.
_TERMS_END = "END OF TERMS AND CONDITIONS"
_BEFORE = {"CC0-1.0": "CC0 1.0 Universal", "CC-BY-SA-4.0": "Creative Commons Attribution-ShareAlike 4.0 International Public"}

# Spellings taken as equal, in the order in which they are replaced.
SPELLINGS = (
    ("licence", "license"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
)

COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
# A statement of copyright up to the licence words on its line. One without sign or year begins a
# paragraph; other lines that begin with the word are of a wrapped text.
_STATEMENT = (
    r"(?m)^(?:[ \t/*#;-]*(?:copyright[ \t:]+(?=\(c\)|[©\[<{\d])|\(c\)(?=[ \t]*\d)|©)"
    r"|(?<![^\n]\n)[ \t/*#;-]*copyright(?=[ \t:])(?![ \t]+(?:notice|holder|owner|license|and|law)))[^\n]*?"
    r"(?=$|\b(?:licen[sc]ed|released|distributed|dedicated|permission|redistribution|this (?:work|software|program))\b)"
)
_STATED = r"(?i)copyright|\(c\)|©|all rights reserved"
_LINE_STATED = r"(?i)^[ \t/*#;-]*(?:copyright|\(c\)|©)"
_RESERVED = r"all rights reserved\.?"
_BLANK_LINE = r"\n[ \t\r]*\n"
NOT_WORD = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Lower case, copyright lines removed, anything but letters and digits one space, spellings
    brought to one form. Null gives the empty text."""
    return _plain(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, ""))


def wording(text: Column) -> Column:
    """As `canonical`, but of a line with a statement of copyright what follows that statement
    stays, and a line that only begins with the word, as wrapped licences have them, stays whole."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _STATEMENT, "")
    return _plain(F.regexp_replace(plain, _RESERVED, ""))


def _plain(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(text, NOT_WORD, " "))
    for variant, usual in SPELLINGS:
        plain = F.replace(plain, F.lit(variant), F.lit(usual))
    return plain


def _line_form(line: Column) -> Column:
    return F.when(line.rlike(_LINE_STATED), wording(line)).otherwise(canonical(line))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def whole_licences() -> list[tuple[str, str]]:
    """Whole licences, in the forms they are given in: with and without headings, items of lists
    numbered or not, parted by blank lines or not, and long ones without what may be left out."""
    forms = []
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        found = [text]
        if name.startswith("BSD"):
            found += [text.replace("\n\n2.", "\n2.").replace("\n\n3.", "\n3.")]
            found += [t.replace("met:\n\n1.", "met:\n1.") for t in found]
            found += [t.replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* ") for t in found]
            found += [t.replace("HOLDER OR CONTRIBUTORS", "OWNER OR CONTRIBUTORS") for t in found]
        if name == "ISC":
            found += [text.replace("AUTHOR ", "AUTHORS "), text.replace("and/or", "and")]
        if _TERMS_END in text:
            found += [text[: text.index(_TERMS_END)], text[: text.index(_TERMS_END)] + _TERMS_END]
        if name in _BEFORE:
            found.append(text[text.index(_BEFORE[name]) :])
        found += [f"{head}\n\n{t}" for head in HEADINGS.get(name, ()) for t in found]
        forms += [(name, t) for t in dict.fromkeys(found)]
    return forms


def known_notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*NOTICES, *whole_licences()], "license string, text string")


def _paragraphs(text: Column) -> Column:
    """The paragraphs that have words: the digest of their wording, and whether they have several
    lines besides statements of copyright."""
    units = F.transform(
        F.split(text, _BLANK_LINE),
        lambda p: F.struct(
            F.sha2(wording(p), 256).alias("digest"),
            F.regexp_replace(F.lower(p), COPYRIGHT_LINE, "").rlike(r"\S\s*\n\s*\S").alias("lines"),
        ),
    )
    return F.filter(units, lambda u: u["digest"] != F.sha2(F.lit(""), 256))


def _passages(rows: DataFrame, known: DataFrame) -> DataFrame:
    """passage_key, passage_same, passage_names and passages of texts with blank lines: the licences
    of runs of their paragraphs, and how many such runs there are.

    Paragraphs join on digests those of known texts; a run is there if all paragraphs of a known
    text follow each other. Runs of a single line are left to the lines.
    """
    parted = known.where(F.col("license").isNotNull()).select(
        F.col("license").alias("found"), F.md5("text").alias("form"), _paragraphs(F.col("text")).alias("units")
    )
    wanted = parted.select(
        "found", "form", F.size("units").alias("n"), F.posexplode("units").alias("known_at", "unit")
    ).select("found", "form", "n", "known_at", F.col("unit.digest").alias("known_digest"))
    given = (
        rows.where(F.col("text").rlike(_BLANK_LINE))
        .select("key", "same", F.posexplode(_paragraphs(F.col("text"))).alias("at", "unit"))
        .select("key", "same", "at", "unit.digest", "unit.lines")
    )
    runs = (
        given.join(wanted, F.col("digest") == F.col("known_digest"))
        .groupBy("key", "same", "found", "form", "n", (F.col("at") - F.col("known_at")).alias("start"))
        .agg(F.count_distinct("known_at").alias("met"), F.max("lines").alias("lines"))
        .where("met = n and (n > 1 or lines)")
    )
    # forms of one licence may be part of each other
    each = runs.groupBy("key", "same", "found", "form").agg(F.count("*").alias("times"))
    most = each.groupBy("key", "same", "found").agg(F.max("times").alias("times"))
    return most.groupBy(F.col("key").alias("passage_key"), F.col("same").alias("passage_same")).agg(
        F.collect_set("found").alias("passage_names"), F.sum("times").alias("passages")
    )


def scan_licenses(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """One row for each row: key, text_sha256 of the canonical text, license of the whole text
    (null: none), line_licenses (those of its lines and passages, sorted, joined by commas),
    n_license_lines (how many lines and passages these are).

    `known` has license and text; where one digest has several licences, the first by name counts.
    Known texts with no word, and units with none, match nothing. Null texts are empty texts.
    Keys may be null or repeat: rows are told apart by key and text, and rows equal in both have
    the same result. Other columns of `df` are not read.

    Joins are on digests. Lines that are no licence are dropped before anything is shuffled.
    """
    empty = F.sha2(F.lit(""), 256)
    forms = F.array(digest(F.col("text")), F.sha2(wording(F.col("text")), 256))
    digests = (
        known.where(F.col("license").isNotNull())
        .select(F.col("license").alias("found"), F.explode(forms).alias("known_digest"))
        .where(F.col("known_digest") != empty)
        .groupBy("known_digest")
        .agg(F.min("found").alias("found"))
    )
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    same = F.md5("text")
    lines = (
        rows.select("key", same.alias("same"), F.explode(F.split("text", "\n")).alias("line"))
        .select("key", "same", F.sha2(_line_form(F.col("line")), 256).alias("line_digest"))
        .join(digests, F.col("line_digest") == F.col("known_digest"))
        .groupBy("key", "same")
        .agg(F.array_sort(F.collect_set("found")).alias("names"), F.count("*").alias("lines"))
        .withColumnsRenamed({"key": "line_key", "same": "line_same"})
    )
    passages = _passages(rows.select("key", same.alias("same"), "text"), known)
    stated = F.when(F.col("text").rlike(_STATED), F.sha2(wording(F.col("text")), 256))
    whole = rows.select(
        "key", same.alias("same"), digest(F.col("text")).alias("text_sha256"), stated.alias("wording_sha256")
    )
    # rows equal in key and text count each line as often as they repeat
    repeats = whole.groupBy("key", "same").agg(
        F.count("*").alias("repeats"),
        F.min("text_sha256").alias("text_sha256"),
        F.min("wording_sha256").alias("wording_sha256"),
    )
    by_wording = digests.select(F.col("known_digest").alias("known_wording"), F.col("found").alias("worded"))
    names = F.array_sort(F.array_union(*(F.coalesce(n, F.array().cast("array<string>")) for n in ("names", "passage_names"))))
    found = (
        repeats.join(digests, F.col("text_sha256") == F.col("known_digest"), "left")
        .join(by_wording, F.col("wording_sha256") == F.col("known_wording"), "left")
        .join(
            passages,
            F.col("key").eqNullSafe(F.col("passage_key")) & (F.col("same") == F.col("passage_same")),
            "left",
        )
        .join(
            lines,
            F.col("key").eqNullSafe(F.col("line_key")) & (F.col("same") == F.col("line_same")),
            "left",
        )
        .select(
            F.col("key").alias(key),
            "text_sha256",
            F.coalesce("found", "worded").alias("license"),
            F.array_join(names, ",").alias("line_licenses"),
            F.expr("coalesce(lines div repeats, 0) + coalesce(passages, 0)").cast("long").alias("n_license_lines"),
            F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"),
        )
    )
    return found.drop("copy")
