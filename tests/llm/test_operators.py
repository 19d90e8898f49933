"""Each operator against a plain version of itself, on small tables with hard rows."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from muster.llm import chat, decontamination, fingerprints, language, licences, lines, packing
from muster.llm import quality, queries, sharding, shingles, stars

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None):
    """A table of documents with an extra column that clashes with names operators add."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS + ", score int")


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# --- language -----------------------------------------------------------------------------------

ENGLISH = ["the house of the old man stands near the river and the wood", "they that were with the others there"]
GERMAN = ["das haus des alten mannes steht an dem fluss und dem wald", "die mit den anderen dort waren und sind"]


def test_languages_are_told_apart(spark):
    known = [(t, "en") for t in ENGLISH] + [(t, "de") for t in GERMAN] + [(None, "en"), ("x", None), ("12", "fr")]
    model = language.fit_languages(spark.createDataFrame(known, "text string, lang string"), "text", "lang")
    assert sorted(model.dictionaries) == ["de", "en"]
    asked = ["the man of the wood and the river " * 3, "der alte mann und das haus an dem fluss " * 3, None, "", "1 2!"]
    frame = documents(spark, asked)
    found = language.identify_languages(frame, "text", model).orderBy("doc_id").collect()
    assert [r["lang"] for r in found] == ["en", "de", "und", "und", "und"]
    assert [r["accepted"] for r in found] == [True, True, False, False, False]
    assert all(0 <= r["score"] <= 1 for r in found)
    assert found[0]["source"] == "s"


def test_no_language_is_known_without_rows(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = language.fit_languages(empty, "text", "lang")
    assert model.dictionaries == {}
    found = language.identify_languages(documents(spark, ["a text"]), "text", model).first()
    assert (found["lang"], found["score"]) == ("und", 0.0)


def test_only_letters_and_their_marks_count(spark):
    for text in ("½ ²", "Ⅷ", "①", "_ 1 ٣", "\u0301 \u0301", "1\u0301"):
        assert language.letters_of(text) == b"", text
    assert language.letters_of("हिन्दी, ²भाषा") == "हिन्दी भाषा".encode()
    assert language.letters_of("e\u0301a1\u0301b") == "e\u0301a b".encode()
    model = language.fit_languages(spark.createDataFrame([(t, "en") for t in ENGLISH], "text string, lang string"), "text", "lang")
    found = language.identify_languages(documents(spark, ["½ ²", "Ⅷ", "①"]), "text", model).collect()
    assert [(r["lang"], r["score"]) for r in found] == [("und", 0.0)] * 3


def test_sizes_are_those_of_a_plain_encoder(spark):
    model = language.LanguageModel({"de": GERMAN[0].encode(), "en": ENGLISH[0].encode()})
    rng = random.Random(4)
    encoders = language.Encoders(model)
    for n in (1, 300, 40_000):
        data = language.letters_of(" ".join(rng.choice((ENGLISH[0] + " " + GERMAN[0]).split()) for _ in range(n)))
        wanted = {}
        for name, content in model.dictionaries.items():
            terms = zstandard.ZstdCompressionParameters.from_level(
                6, source_size=2048, dict_size=len(content), min_match=3, write_content_size=False,
                write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            wanted[name] = 0
            for i in range(0, len(data), 2048):
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                plain = zstandard.ZstdCompressor(dict_data=known, compression_params=terms)
                wanted[name] += len(plain.compress(data[i : i + 2048]))
        got = encoders.sizes(data)
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) <= 0.02 * wanted[k] + 8 for k in got)
    long = ENGLISH[0] + " and " + ("the old man and the river " * 80_000)
    assert language.identify_languages(documents(spark, [long]), "text", model).first()["lang"] == "en"


def test_narrow_margins_are_not_accepted():
    assert language.decide({"a": 50, "b": 50}, 100, 0.004)[0] == "a"
    assert language.decide({"b": 50, "a": 51}, 1000, 0.004)[3] is False
    assert language.decide({"b": 50, "a": 60}, 1000, 0.004)[3] is True


def test_copies_fill_a_dictionary_once(spark):
    rows = [(ENGLISH[0], "en")] * 500 + [(ENGLISH[1], "en")]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert len(model.dictionaries["en"]) <= sum(map(len, ENGLISH)) + 1


def test_dictionaries_are_not_of_headings_and_any_number_of_languages_fits(spark):
    rng = random.Random(2)
    rows = [("heading " * 400 + f"{words(rng, 40)} river " * 90, "en") for _ in range(20)]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert b"river" in model.dictionaries["en"]
    many = spark.range(300).select(F.lit("some words of a text").alias("text"), F.col("id").cast("string").alias("lang"))
    model = language.fit_languages(many, "text", "lang", max_bytes=1500)
    assert len(model.dictionaries) == 300
    assert 300 <= sum(map(len, model.dictionaries.values())) <= 1500


# --- licences -----------------------------------------------------------------------------------


def test_licences_by_canonical_text(spark):
    notice = "Released under the MIT Licence!"
    texts = [f"© 2020 Someone\n  RELEASED under the mit license  ", f"words\n{notice}\nmore\n{notice}", None, "", "©"]
    found = licences.scan_licenses(documents(spark, texts), "doc_id", "text", licences.known_notices(spark))
    got = {r["doc_id"]: (r["license"], r["line_licenses"], r["n_license_lines"]) for r in found.collect()}
    assert got == {0: ("MIT", "MIT", 1), 1: (None, "MIT", 2), 2: (None, "", 0), 3: (None, "", 0), 4: (None, "", 0)}


def test_licences_keep_repeated_rows_and_null_keys(spark):
    text = "a\nReleased under the MIT License."
    found = licences.scan_licenses(
        documents(spark, [text, text, text], [None, 7, 7]), "doc_id", "text", licences.known_notices(spark)
    )
    assert Counter((r["doc_id"], r["n_license_lines"]) for r in found.collect()) == {(None, 1): 1, (7, 1): 2}
    empty = documents(spark, [])
    assert licences.scan_licenses(empty, "doc_id", "text", licences.known_notices(spark)).count() == 0


def test_whole_licences_are_found(spark):
    folder = Path(licences.__file__).parent / "licence_texts"
    text = {p.stem: p.read_text(encoding="utf-8") for p in folder.glob("*.txt")}
    holder = "Copyright (c) 2020, Someone. All rights reserved."
    mit = text["MIT"]
    stated = {n: [p for p in re.split(r"\n\s*\n", t) if p.strip()] for n, t in text.items()}
    texts = {
        f"{n} {width}": holder + "\n\n" + "\n\n".join(p if "Copyright (C)" in p else textwrap.fill(p.strip(), width) for p in ps)
        for n, ps in stated.items() for width in (61, 9999)
    }
    texts |= {f"{name} as it is": t for name, t in text.items()}
    texts |= {"MIT headed": f"MIT License\n\n{holder}\n\n{mit}", "BSD-3-Clause headed": f"BSD 3-Clause License\n\n{holder}\n{text['BSD-3-Clause']}"}
    texts |= {"MIT line": "Copyright (c) 2020 X. Licensed under the MIT License."}
    texts |= {"none": holder, "none cut": mit[: len(mit) // 2], "none inside": f"words\n\n{holder}\n\n{mit}\n\nmore", "none notice": "words\n\n© 2020 X\nReleased under\nthe MIT License.\n\nmore"}
    names = list(texts)
    found = licences.scan_licenses(documents(spark, list(texts.values())), "doc_id", "text", licences.known_notices(spark))
    got = {names[r["doc_id"]]: r for r in found.collect()}
    assert {n: r["license"] for n, r in got.items()} == {n: None if n.startswith("none") else n.split()[0] for n in names}
    passages = {n: (got[n]["line_licenses"], got[n]["n_license_lines"]) for n in names if n.startswith("none") or n == "MIT line"}
    assert passages == {"none": ("", 0), "none cut": ("", 0), "none inside": ("MIT", 1), "none notice": ("MIT", 1), "MIT line": ("MIT", 1)}


# --- decontamination ----------------------------------------------------------------------------


def plain_hits(text, items, width):
    found = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    hit, ids = set(), set()
    for item_id, item in items:
        own = [w.lower() for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", item or "")]
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for at in range(len(found) - size + 1):
                if found[at : at + size] == own[i : i + size]:
                    hit |= set(range(at, at + size))
                    if item_id is not None:
                        ids.add(str(item_id))
    return len(found), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [1 << 24, 40])
def test_windows_are_found_as_by_search(spark, block_bytes):
    rng = random.Random(3)
    items = [(i, words(rng, rng.randrange(1, 9), 6)) for i in range(12)] + [(3, "w1 W2-w3"), (None, "zz"), (5, None), (6, " ,")]
    texts = [words(rng, rng.randrange(0, 40), 6) for _ in range(40)] + [None, "", "é zz! É", "W1,w2 w3"]
    frame = documents(spark, texts).withColumnRenamed("score", "n_hit")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_benchmark(frame, "text", bench, width=4, block_bytes=block_bytes)
    for r in found.collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == plain_hits(r["text"], items, 4)
        got = [(s["last_word"] - s["first_word"] + 1) for s in r["spans"]]
        assert sum(got) == r["n_hit"]
        for s in r["spans"]:
            part = r["text"][s["start"] : s["end"]]
            assert len(decontamination.normal_words(part)) == s["last_word"] - s["first_word"] + 1
    kept = decontamination.without_benchmark(frame, "text", bench, width=4)
    assert kept.columns == frame.columns
    clean = sum(plain_hits(t, items, 4)[1] == 0 for t in texts)
    assert kept.count() == clean


def test_a_repeated_item_is_sent_once(spark, monkeypatch):
    sent, scan = [], decontamination._scan
    monkeypatch.setattr(decontamination, "_scan", lambda pairs, width: sent.append(pairs) or scan(pairs, width))
    rows = [("often", "a b c d")] * 200 + [("once", "e f g h")]
    items = spark.createDataFrame(rows, "item_id string, text string")
    found = decontamination.find_benchmark(documents(spark, ["x a b c d y", "e f"]), "text", items, width=3, block_bytes=20)
    assert [(r["n_hit"], r["items"]) for r in found.orderBy("doc_id").collect()] == [(4, ["often"]), (0, [])]
    assert sorted(p for pairs in sent for p in pairs) == [("often", "a b c d"), ("once", "e f g h")]


def test_no_items_hit_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontamination.find_benchmark(documents(spark, ["some words"]), "text", bench).first()
    assert (found["n_words"], found["n_hit"], found["items"], found["spans"]) == (2, 0, [], [])


# --- chat ---------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.text("ab\\<turn>/\n", max_size=12), st.text("ab\\<turn>/\n#", max_size=30)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_rendering_is_reversible(turns):
    formatted = "".join(chat.render(role, text)[0] for role, text in turns)
    read = [(role, text) for role, text, _, _ in chat.read_turns(formatted)]
    assert read == turns
    for role, text in turns:
        whole, a, b = chat.render(role, text)
        assert chat.unescape(whole[a:b]) == text


def test_events_fold_to_final_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "hel"), (1, 0, 1, "delta", None, "lo"),
        (1, 1, 2, "message", "assistant", "bad"), (1, 1, 3, "regenerate", None, None),
        (1, 1, 4, "delta", None, "good "), (1, 1, 5, "delta", None, "day"), (1, 0, 6, "edit", None, "hi"),
        (None, 0, 0, "message", None, None), (2, 0, 0, "delta", "user", "late"),
        (2, 0, 1, "message", "user", "again"), (2, 0, 1, "message", "user", "again"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, sequence long, kind string, role string, text string")
    segments = chat.format_log(events.repartition(5), segment_chars=40)
    got = {}
    for r in sorted(segments.collect(), key=lambda r: (r["part"], r["segment"])):
        got.setdefault(r["conv_id"], []).extend((a, b) for a, b, _, _ in chat.read_turns(r["formatted"]))
    assert got == {
        1: [("user", "hi"), ("assistant", "good day")],
        None: [("", "")],
        2: [("user", "late"), ("user", "again"), ("user", "again")],
    }
    digests = {r["conv_id"]: r for r in chat.read_back(segments).collect()}
    assert digests[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\ngood day\n").hexdigest()
    assert digests[1]["loss_sha256"] == hashlib.sha256(b"good day").hexdigest()
    assert (digests[1]["loss_chars"], digests[2]["n_turns"]) == (8, 3)
    assert chat.read_back(chat.format_log(events.limit(0))).count() == 0


def test_a_long_conversation_is_many_segments_in_order(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"text {i} </turn>" * (i % 7)) for i in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_log(chat.message_events(table.repartition(7)), segment_chars=500)
    assert segments.count() > 100 and segments.select("part").distinct().count() > 1
    found = chat.read_back(segments).first()
    said = "".join(f"{r}\n{t}\n" for _, _, r, t in rows)
    assert found["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert found["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()


def test_a_log_of_drafts_ends_in_the_given_texts(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c}é\\{t}" * (c % 5)) for c in range(12) for t in range(6)]
    rows += [(0, 1, "assistant", "twice"), (0, 1, "assistant", "twice"), (3, None, "user", None), (None, 2, None, "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.dealt_events(table.withColumn("number", F.lit(1)))
    assert {r["kind"] for r in events.select("kind").distinct().collect()} == set(chat.KINDS)
    read = {}
    for r in chat.format_log(events.repartition(5)).orderBy("conv_id", "part", "segment").collect():
        read.setdefault(r["conv_id"], []).extend((a, b) for a, b, _, _ in chat.read_turns(r["formatted"]))
    wanted = {}
    for c, _, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        wanted.setdefault(c, []).append((role or "", text or ""))
    assert read == wanted
    assert chat.dealt_events(table.limit(0)).count() == 0


# --- packing ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block_items", [16384, 7])
def test_packing_holds_every_byte_once(spark, block_items):
    rng = random.Random(5)
    texts = [("é" if i % 3 else "x") * rng.randrange(0, 90) for i in range(60)] + [None, "", "", "ü" * 333]
    lengths = packing.Lengths((16, 32, 64))
    packed = packing.pack_documents(documents(spark, texts), "doc_id", "text", lengths, block_items=block_items).collect()
    parts = {}
    for r in packed:
        assert r["used"] == sum(r["n_bytes"]) + len(r["keys"]) <= r["capacity"] in lengths.permitted
        assert r["capacity"] == lengths.least(r["used"])
        for key, start, text in zip(r["keys"], r["starts"], r["texts"], strict=True):
            parts.setdefault(key, []).append((start, text))
    assert {k: "".join(t for _, t in sorted(v)) for k, v in parts.items()} == {i: t or "" for i, t in enumerate(texts)}
    assert len({r["sequence_id"] for r in packed}) == len(packed)
    assert packing.pack_documents(documents(spark, []), "doc_id", "text", lengths).count() == 0


def test_packing_does_not_depend_on_how_rows_are_parted(spark):
    rng = random.Random(3)
    frame = documents(spark, [words(rng, rng.randrange(1, 400)) for _ in range(200)])
    one, many = (
        packing.pack_documents(frame.repartition(n), "doc_id", "text").agg(F.sum("capacity"), F.sum("used")).first()
        for n in (1, 40)
    )
    assert one == many


def test_the_packing_query_reads_the_sequences(spark, monkeypatch):
    packed = []
    monkeypatch.setattr(queries, "pack_documents", lambda *a, **k: packed.append(packing.pack_documents(*a, **k)) or packed[-1])
    found = queries.op5_packing(spark, "/root/testdata/sf0.001")
    texts = packed[0].select(F.explode("texts").alias("text"))
    assert texts.where("text is null").count() == 0
    sizes = [sorted(r[0] for r in f.collect()) for f in (found.select("n_bytes"), texts.select(F.octet_length("text")))]
    assert sizes[0] == sizes[1] and sizes[0]


def plain_best_fit(sizes, lengths):
    after, bins = sum(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        after -= sizes[i]
        fitting = [b for b in bins if b[0] >= sizes[i]]
        if fitting:
            best = min(fitting, key=lambda b: b[0])
        else:
            best = [lengths.to_open(sizes[i], after), []]
            bins.append(best)
        best[0] -= sizes[i]
        best[1].append(i)
    return [b[1] for b in bins]


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_that_of_a_plain_search(sizes):
    lengths = packing.Lengths((16, 32, 64), fixed=4, pairs=1 / 256)
    bins, cost = packing.best_fit(sizes, lengths)
    assert bins == plain_best_fit(sizes, lengths)
    chosen = packing.pack_items(sizes, lengths)
    assert sorted(i for b in chosen for i in b) == list(range(len(sizes)))
    assert sum(lengths.cost(lengths.least(sum(sizes[i] for i in b))) for b in chosen) <= cost + 1e-9


# --- quality ------------------------------------------------------------------------------------


def test_quality_is_learned_and_scored(spark):
    rng = random.Random(7)
    good = [words(rng, rng.randrange(30, 200)) for _ in range(60)]
    bad = [" ".join(f"w{rng.randrange(9)}***" for _ in range(rng.randrange(30, 200))) for _ in range(60)]
    frame = documents(spark, good + bad)
    labels = spark.createDataFrame(
        [(i, int(i < 60)) for i in range(0, 120, 2)] + [(None, 1), (3, None), (5, 9)], "doc_id long, quality int"
    )
    model = quality.learned_quality(frame, labels)
    scored = frame.select("doc_id", quality.quality_score(F.col("text"), model).alias("s")).collect()
    assert all((r["s"] >= 0.5) == (r["doc_id"] < 60) for r in scored)
    hard = documents(spark, [None, "", "x" * 300_000])
    assert all(0 <= r["s"] <= 1 for r in hard.select(quality.quality_score(F.col("text"), model).alias("s")).collect())


def test_discriminant_equals_the_plain_formula(spark):
    rng = np.random.default_rng(1)
    p = len(quality.STATISTICS)
    x = np.concatenate([rng.normal(0, 1, (80, p)), rng.normal(0.7, 2, (50, p))])
    y = [0] * 80 + [1] * 50
    frame = spark.createDataFrame([(v.tolist(), k) for v, k in zip(x, y, strict=True)], "v array<double>, k int")
    model = quality.fit_quality(frame, "v", "k", shrinkage=0.2, floor=0.01)
    covariances = [np.cov(x[np.array(y) == k].T, bias=True) for k in (0, 1)]
    pooled = np.diag(np.diag(covariances[0] * 80 + covariances[1] * 50) / 130)
    logs = []
    for k, n in ((0, 80), (1, 50)):
        s = 0.8 * covariances[k] + 0.2 * pooled + 0.01 * np.eye(p)
        d = x - x[np.array(y) == k].mean(axis=0)
        logs.append(np.log(n / 130) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.sum(d @ np.linalg.inv(s) * d, axis=1))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_without_two_classes(spark):
    frame = documents(spark, ["one text", "another"])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learned_quality(frame, none).scores(np.zeros((2, 12))).tolist() == [0.5, 0.5]
    good = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    assert quality.learned_quality(frame, good).scores(np.zeros((1, 12))).tolist() == [1.0]


# --- sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_contiguous_and_balanced(spark, shards):
    rng = random.Random(11)
    texts = ["same text here"] * 300 + ["é" * rng.randrange(0, 80) for _ in range(300)] + [None, "", None]
    ids = [*range(601), None, 7]
    found = sharding.shard_by_bytes(documents(spark, texts, ids).repartition(6), "doc_id", "text", shards).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(ids)
    by_shard = {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r)
    assert set(by_shard) <= set(range(shards))
    for rows in by_shard.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    total, largest = sum(r["size"] for r in found), max(r["size"] for r in found)
    for shard in range(shards):
        assert abs(sum(r["size"] for r in by_shard.get(shard, [])) - total / shards) <= largest
    order = sorted(found, key=lambda r: (r["shard"], r["slot"]))
    keys = [(r["text_crc32"] is not None, r["text_crc32"] or 0) for r in order]
    assert keys == sorted(keys)
    assert sharding.shard_by_bytes(documents(spark, []), "doc_id", "text", shards).count() == 0


# --- lines --------------------------------------------------------------------------------------


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_repeats(rows, min_words, min_near):
    first = {}
    for doc_id, text in sorted(rows):
        for number, line in enumerate(text.split("\n")):
            norm = tuple(line.lower().split())
            if len(norm) >= min_words:
                first.setdefault(norm, (doc_id, number))
    near = {
        a for a in first for b in first
        if min(len(a), len(b)) >= min_near and first[b] < first[a] and plain_distance(a, b) == 1
    }
    out = set()
    for doc_id, text in rows:
        for number, line in enumerate(text.split("\n")):
            norm = tuple(line.lower().split())
            if norm in first and (norm in near or first[norm] != (doc_id, number)):
                out.add((doc_id, number, norm in near))
    return out


def test_repeated_and_near_lines_are_those_of_a_plain_search(spark):
    rng = random.Random(13)
    pool = [words(rng, rng.randrange(1, 9), 5).split() for _ in range(25)]
    texts = []
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randrange(2)] = rng.choice([[], [f"w{rng.randrange(5)}"]])
            text.append(" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line))
        texts.append("\n".join(text))
    frame = documents(spark, texts)
    found = lines.repeated_lines(frame, "doc_id", "text", min_words=2, min_near_words=4).collect()
    got = {(r["key"], r["line"], r["near"]) for r in found}
    assert got == plain_repeats(list(enumerate(texts)), 2, 4) and len(got) == len(found)
    kept = lines.without_repeated_lines(frame, "doc_id", "text", min_words=2, min_near_words=4)
    assert kept.columns == frame.columns
    gone = {(k, n) for k, n, _ in got}
    for r in kept.collect():
        wanted = [x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if (r["doc_id"], n) not in gone]
        assert r["text"] == "\n".join(wanted)
    lost = set(range(60)) - {r["doc_id"] for r in kept.collect()}
    assert all(all((k, n) in gone or not x.strip() for n, x in enumerate(texts[k].split("\n"))) for k in lost)


def test_lines_by_the_defaults(spark):
    rng = random.Random(8)
    texts = ["\n".join(words(rng, rng.randrange(7), 6) for _ in range(5)) for _ in range(60)]
    texts += ["hello there\nx y z a b c d", "les.\nhello there", "les.\nx y z a b c e"]
    found = lines.repeated_lines(documents(spark, texts), "doc_id", "text").collect()
    got = {(r["key"], r["line"], r["near"]) for r in found}
    assert got == plain_repeats(list(enumerate(texts)), 1, 4) and len(got) == len(found)
    assert {(61, 1, False), (62, 0, False), (62, 1, True)} <= got


def test_lines_of_hard_rows(spark):
    text = "one two three four\nx"
    frame = documents(spark, [text, text, None, "", text, "\n\n"], [None, 1, 2, 3, 1, 4])
    found = lines.repeated_lines(frame, "doc_id", "text").collect()
    assert {(r["key"], r["line"]) for r in found} == {(1, 0), (1, 1)}
    kept = lines.without_repeated_lines(frame, "doc_id", "text").collect()
    assert Counter(r["text"] for r in kept) == {text: 1, None: 1, "": 1, "\n\n": 1}
    assert lines.repeated_lines(documents(spark, []), "doc_id", "text").count() == 0


def test_the_pipeline_drops_short_lines_too(spark):
    texts = ["a b c d e f g h\nles.\nr s t u", "new\nA b c d e f g h\nles.\nr s t w\nt u v", "les.", "t u v\n\nt u w"]
    kept = corpus_pipeline.line_dedup(spark, documents(spark, texts), "").collect()
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept}
    assert got == {0: (texts[0], len(texts[0])), 1: ("new\nt u v", 9), 3: ("\nt u w", 6)}


@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.lists(st.sampled_from("abc"), min_size=1, max_size=7))
@settings(max_examples=300, deadline=None)
def test_edits_halves_and_variants(a, b):
    one, other = [x.encode() for x in a], [x.encode() for x in b]
    near = plain_distance(a, b) <= 1
    assert lines.within_one_edit(one, other) == near
    if near:
        assert set(lines.halves(one)) & set(lines.halves(other))
        first, second = (dict(map(reversed, lines.variants(b" ".join(x)))) for x in (one, other))
        assert set(first.values()) & set(second.values())


# --- fingerprints -------------------------------------------------------------------------------


def plain_chunks(data, c):
    ends, start, state = [], 0, []
    for i in range(len(data)):
        h = 0
        for back in range(min(16, i + 1)):
            h += int(fingerprints.GEAR[data[i - back]]) << back
        state.append(h % (1 << 32))
    while start < len(data):
        end = min(start + c.most, len(data))
        for p in range(start + c.least, end + 1):
            bits = c.rare_bits if p - start < c.usual else c.frequent_bits
            if p < len(data) and state[p - 1] >> (32 - bits) == 0:
                end = p
                break
        if len(data) - start <= c.least:
            end = len(data)
        ends.append(end)
        start = end
    return ends


@given(st.text("abcdé \n", max_size=600))
@settings(max_examples=150, deadline=None)
def test_cuts_are_those_of_a_byte_by_byte_hash(text):
    c = fingerprints.Chunking()
    data = text.encode()
    assert fingerprints.cut_points(data, c) == plain_chunks(data, c)


def test_fingerprints_follow_the_next_document(spark):
    rng = random.Random(17)
    texts = [words(rng, rng.randrange(0, 300)) for _ in range(400)]
    texts[5], texts[6], texts[9] = texts[4], None, "é"
    order = list(range(400))
    rng.shuffle(order)
    frame = documents(spark, [texts[i] for i in order], order).repartition(5)
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(frame, "doc_id", "text").collect()}
    assert len(found) == 400
    c = fingerprints.Chunking()
    for i, r in found.items():
        own, following = texts[i] or "", texts[(i + 1) % 400] or ""
        q = len(own) // 4
        changed = own[: len(own) - q] + following[:q]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprints.printed(fingerprints.chunk_set(changed, c))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert found[4]["near_next"] == 1.0 and found[4]["fingerprint"] == found[5]["fingerprint"]
    long = [r for r in found.values() if r["n_chars"] > 400 and r["doc_id"] not in (3, 4)]
    assert min(r["near_edited"] for r in long) > 0.5 and max(r["near_next"] for r in long) < 0.1


def test_fingerprints_of_hard_tables(spark):
    one = fingerprints.fingerprint_documents(documents(spark, ["a b c d"]), "doc_id", "text").first()
    assert one["edited_sha256"] == hashlib.sha256(b"a b c a").hexdigest()
    assert fingerprints.fingerprint_documents(documents(spark, []), "doc_id", "text").count() == 0
    rows = documents(spark, ["x", "x", None, "y" * 100_000], [None, None, 2, 2])
    assert fingerprints.fingerprint_documents(rows, "doc_id", "text").count() == 4


# --- shingles -----------------------------------------------------------------------------------


def plain_components(rows, percent=75):
    sets = []
    for _, text in rows:
        w = (text or "").split(" ") if text else []
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), key), key)
    return {key: (len(sets[i]), least[root(i)]) for i, (key, _) in enumerate(rows)}


@pytest.mark.parametrize("crowd", [256, 3])
def test_components_are_those_of_all_pairs(spark, crowd):
    rng = random.Random(19)
    passage = words(rng, 40)
    rows = []
    for group in range(30):
        base = words(rng, rng.randrange(1, 120)).split(" ")
        for _ in range(rng.randrange(1, 14)):
            near = list(base)
            for _ in range(rng.randrange(0, 1 + len(near) // 30)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(1000)}"
            text = " ".join(near) + (" " + passage if group % 4 == 0 else "")
            rows.append((len(rows) * 7 % 1009, text))
    rows += [(2000, None), (2001, ""), (2002, ""), (2003, "a b"), (2004, "a b"), (2005, "b a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = shingles.near_duplicates(frame, "doc_id", "text", sample_one_in=2, crowd=crowd).collect()
    got = {r["key"]: (r["size"], r["component"]) for r in found}
    assert got == plain_components(rows) and len(found) == len(rows)
    kept = {r["doc_id"] for r in shingles.without_near_duplicates(frame, "doc_id", "text", crowd=crowd).collect()}
    assert kept == {key for key, (size, least) in got.items() if key == least}


def test_pages_of_one_template_are_not_multiplied(spark, monkeypatch):
    tasks, plain = [], shingles._block_product

    def counted(crowded, texts, width, percent, crowd):
        tasks.append(shingles._block_tasks(crowded, percent, crowd).count())
        return plain(crowded, texts, width, percent, crowd)

    monkeypatch.setattr(shingles, "_block_product", counted)
    rng = random.Random(23)
    template = words(rng, 90)
    rows = [(i, template + " " + words(rng, 26)) for i in range(600)]
    near = rows[7][1].replace(rows[7][1].split(" ")[100], "z")
    rows.append((900, near))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = shingles.near_duplicates(frame, "doc_id", "text").collect()
    assert {r["key"]: r["component"] for r in found} == {i: 7 if i == 900 else i for i, _ in rows}
    assert sum(tasks) == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 300), st.floats(0, 1), st.integers(0, 99))
def test_marks_bound_the_overlap(size, other_size, share, seed):
    rng = np.random.default_rng(seed)
    same = rng.integers(0, 2**64, int(share * min(size, other_size)), np.uint64)
    one, other = (
        np.unique(np.append(same, rng.integers(0, 2**64, n - len(same), np.uint64))) for n in (size, other_size)
    )
    most = shingles.most_overlap(shingles.marks_of(one), len(one), shingles.marks_of(other), len(other))
    assert len(np.intersect1d(one, other)) <= most <= min(len(one), len(other))


def test_pairs_that_share_a_passage_only_get_no_texts(spark, monkeypatch):
    dealt, plain = [], shingles._verified

    def counted(pairs, texts, width, percent):
        dealt.append(pairs.count())
        return plain(pairs, texts, width, percent)

    monkeypatch.setattr(shingles, "_verified", counted)
    rng = random.Random(29)
    passage = words(rng, 50)
    rows = [(i, passage + " " + words(rng, 50)) for i in range(40)]
    rows += [(i, passage + " " + words(rng, 190)) for i in range(40, 60)]
    rows.append((90, rows[7][1].replace(rows[7][1].split(" ")[70], "z")))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = shingles.near_duplicates(frame, "doc_id", "text").collect()
    assert {r["key"]: r["component"] for r in found} == {i: 7 if i == 90 else i for i, _ in rows}
    assert sum(dealt) < 10


def test_kinds_that_can_link_on_crowded_columns_are_multiplied(spark):
    rows = [(k, 112, n, n) for n in range(300) for k in range(30)] + [
        (k, 112, n, n) for n in range(300, 600) for k in range(7)
    ]
    crowded = spark.createDataFrame(rows, "key long, size long, node long, component long")
    dealt = shingles._block_tasks(crowded, 75, 256).collect()
    assert {r["node"] for r in dealt} == set(range(300))
    met = Counter(pair for t in {r["task"] for r in dealt} for pair in _pairs(t, dealt))
    assert len(met) == 300 * 299 // 2


def _pairs(task, dealt):
    nodes = sorted(r["node"] for r in dealt if r["task"] == task)
    return [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1 :]]


def test_components_of_hard_rows(spark):
    text = "one two three four five six"
    frame = documents(spark, [text, text, text, None, text.upper()], [5, 5, None, 1, 9])
    found = shingles.near_duplicates(frame, "doc_id", "text").collect()
    assert Counter((r["key"], r["component"]) for r in found) == {(5, 5): 2, (None, 5): 1, (9, 5): 1, (1, 1): 1}
    kept = shingles.without_near_duplicates(frame, "doc_id", "text")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5]
    assert shingles.near_duplicates(documents(spark, []), "doc_id", "text").count() == 0
    assert shingles.without_near_duplicates(documents(spark, []), "doc_id", "text").count() == 0


def test_a_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901)], "one long, other long")
    found = {r["node"]: r["component"] for r in stars.components(links).collect()}
    assert found == {i: 0 for i in range(201)} | {900: 900, 901: 900}


def test_rounds_do_not_add_up_guesses_of_size(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "one long, other long")
    found = stars.components(links)
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size) < 1 << 80


def test_stars_have_the_first_of_each_group_as_hub(spark):
    rng = random.Random(23)
    rows = [(rng.randrange(300), rng.randrange(5), rng.randrange(2000)) for _ in range(900)] + [(7, 0, i) for i in range(999)]
    sizes = {n: s for _, s, n in rows}
    rows = [(k, sizes[n], n) for k, _, n in rows]
    frame = spark.createDataFrame(rows, "key long, size long, node long").repartition(3)
    groups = {}
    for k, s, n in rows:
        groups.setdefault(k, set()).add((s, n))
    wanted = {(k, n, s, min(g)[1], min(g)[0]) for k, g in groups.items() if len(g) > 1 for s, n in g}
    found = [tuple(r) for r in stars.star_rows(frame).collect()]
    assert set(found) == wanted and len(found) == len(wanted)


def test_pairwise_is_what_statistics_use():
    assert quality.statistics_of("a a b")[5] == pytest.approx(np.log(3 / 4))
    assert len(set(pairwise("a a b".split()))) == 2
