"""A whole run of the pipeline over small tables with hard rows."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(f"word{rng.randrange(3000)}" for _ in range(n)) + "."


def junk(rng, n):
    return " ".join("#!$ %" * rng.randrange(1, 4) for _ in range(n))


def write_tables(spark, folder, rows, items):
    frame = spark.createDataFrame(rows, DOCS + ", own_key string, n_words int, quality string, keys string")
    frame.repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(r[0], int("#!$" not in (r[1] or "#!$")), 0) for r in rows if r[0] is not None and r[0] < 80]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def row(key, text):
    return (key, text, None, None, None if text is None else len(text), "a", 1, "b", "c")


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(31)
    item = prose(rng, 14)
    good = [prose(rng, rng.randrange(60, 120)) for _ in range(40)]
    rows = [row(i, text) for i, text in enumerate(good)]
    rows += [row(40 + i, junk(rng, 60)) for i in range(40)]
    rows += [row(100, good[3]), row(100, good[3]), row(101, good[4].replace("word1", "word2", 1) + " end")]
    rows += [row(110, prose(rng, 50) + " " + item + " " + prose(rng, 50)), row(120, None), row(121, ""), row(None, None)]
    rows += [row(None, prose(rng, 80)), row(130, prose(rng, 200_000))]
    write_tables(spark, str(tmp_path), rows, [("i1", item), ("i2", None), (None, "")])
    return str(tmp_path), good


def test_a_whole_run_keeps_what_is_clean_and_drops_what_is_planted(spark, tables):
    folder, good = tables
    sequences = corpus_pipeline.run(spark, folder).collect()
    kept = [key for r in sequences for key in r["doc_ids"]]
    # every good document stays once, also with a null key or a text of more than a megabyte
    assert set(range(40)) <= set(kept) and 130 in kept and None in kept
    assert not set(range(40, 80)) & set(kept)  # junk
    assert 100 not in kept and 101 not in kept  # an exact and a near copy
    assert 110 not in kept  # with a benchmark item
    joined = {}
    for r in sequences:
        for key, start, text in zip(r["doc_ids"], r["starts"], r["texts"], strict=True):
            joined.setdefault(key, []).append((start, text))
    for key in range(40):
        assert "".join(text for _, text in sorted(joined[key])) == good[key]


def test_a_whole_run_over_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    empty = str(tmp_path / "empty")
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    # nothing is a benchmark item and nothing is labelled: no document is lost to either
    half = str(tmp_path / "half")
    spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5").write.parquet(f"{half}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{empty}/{name}.parquet").write.parquet(f"{half}/{name}.parquet")
    found = corpus_pipeline.run(spark, half).collect()
    assert sorted(key for r in found for key in r["doc_ids"]) == [0, 1, 2, 3, 4]
