from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from muster.operators.compare import same_rows
from muster.operators.ledger import (
    cluster_rows,
    duplicate_sequences,
    latest_report,
    open_clusters,
)
from muster.sources.ledger import dead_letters, good_reports, ledger_lines, parse_reports, read_reports
from muster.sources.locations import AccessPolicy, Location
from muster.streaming.ledger import ingest_reports, ingest_until, ingested, ingested_batches, ingested_reports

TICK = '{"params":{"sequence":1,"clusters":[]}}'
TWO = (
    '{"params":{"sequence":2,"clusters":[{"id":"c1","stopped_at":null},'
    '{"id":"c2","stopped_at":"2026-01-01T00:00:00Z"}]}}'
)
CUT = '{"params":{"sequ'
THREE = '{"params":{"sequence":3,"clusters":[{"id":"c1","stopped_at":null}]}}'
LINES = [TICK, "", TWO, CUT, THREE, '{"nope":1}', "[1]"]


@pytest.fixture
def ledger(tmp_path):
    folder = tmp_path / "ledger"
    folder.mkdir()
    (folder / "report.0.jsonl").write_text("\n".join(LINES[:4]) + "\n")
    (folder / "report.1.jsonl").write_text("\r\n".join(LINES[4:]))
    (folder / "notes.txt").write_text("not a report\n")
    return folder


def parse(spark, lines, **options):
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    return parse_reports(df, **options)


def test_reports_of_the_files(spark, ledger):
    place = Location.local(str(ledger))
    reports = read_reports(spark, place, missing_params="route")
    found = {r.line: (r.sequence, [c.stopped_at for c in r.clusters]) for r in reports.collect()}
    assert found == {
        TICK: (1, []),
        TWO: (2, [None, "2026-01-01T00:00:00Z"]),
        THREE: (3, [None]),
    }


def test_folder_without_reports(spark, tmp_path):
    assert read_reports(spark, Location.local(str(tmp_path))).isEmpty()


def test_dead_letters(spark, ledger):
    parsed = parse_reports(ledger_lines(spark, Location.local(str(ledger))), missing_params="route")
    assert {tuple(row) for row in dead_letters(parsed).collect()} == {
        (CUT, "bad_json"),
        ('{"nope":1}', "no_params"),
        ("[1]", "no_params"),
    }


def test_missing_params_fail_by_default(spark, ledger):
    with pytest.raises(Exception, match="a report has no params"):
        read_reports(spark, Location.local(str(ledger))).collect()
    assert good_reports(parse(spark, [TICK, CUT, " "])).count() == 1
    with pytest.raises(ValueError):
        parse(spark, [], missing_params="ignore")


def test_local_scans_can_be_refused(spark, ledger):
    with pytest.raises(PermissionError):
        read_reports(spark, Location.local(str(ledger)), policy=AccessPolicy(allow_local_scans=False))


@pytest.mark.parametrize(
    "line",
    [
        TICK + TICK,
        TICK + " x",
        TICK + ",null",
        TICK + "]",
        TICK + "] x",
        TICK + ",1] x",
        TICK[:-1],
        "{'params':{}}",
        '{"params":{"sequence":01}}',
        "[",
        "[1",
        ",",
        '{"params":',
        '{"params":{"a":1}',
        '"',
        "nope",
    ],
)
def test_only_one_whole_document_is_a_report(spark, line):
    with pytest.raises(json.JSONDecodeError):
        json.loads(line)
    assert parse(spark, [line]).first().reason == "bad_json"


def test_damaged_lines_are_judged_like_a_json_parser(spark):
    draw = random.Random(5)
    whole = [TWO, THREE, '{"nope":[1,2.5e3,{"a":"b\\n"}]}', '[1,{"params":{}}]', '"x \\" y"', "-1.5"]
    bits = ["{", "}", "[", "]", ",", ":", '"', "\\", "null", "1", "-", ".", "e", " ", "\t", "0", "]]"]
    lines = set()
    while len(lines) < 4000:
        line = draw.choice(whole)
        for _ in range(draw.randrange(4)):
            start = draw.randrange(len(line) + 1)
            stop = start + draw.randrange(12)
            line = draw.choice(
                [
                    line[:start],
                    line[:start] + line[stop:],
                    line[:stop] + line[start:],
                    line[:start] + draw.choice(bits) + line[start:],
                ]
            )
        lines.add(line)
    wanted = {line: judged(line) for line in lines if line.strip()}
    assert {"bad_json", "no_params", "clusters_malformed", "sequence_missing", None} <= set(wanted.values())
    found = parse(spark, list(wanted), missing_params="route").collect()
    assert {row.line: row.reason for row in found} == wanted


def judged(line):
    def refuse(constant):
        raise json.JSONDecodeError(constant, line, 0)

    try:
        document = json.loads(line, parse_constant=refuse)
    except json.JSONDecodeError:
        return "bad_json"
    if not isinstance(document, dict) or not isinstance(document.get("params"), dict):
        return "no_params"
    sequence, clusters = document["params"].get("sequence"), document["params"].get("clusters")
    if sequence is None:
        return "sequence_missing"
    if isinstance(sequence, bool):
        return "sequence_boolean"
    if isinstance(sequence, str):
        return "sequence_text"
    if isinstance(sequence, float):
        return "sequence_fraction"
    if not isinstance(sequence, int):
        return "sequence_nested"
    if not -(2**63) <= sequence < 2**63:
        return "sequence_oversized"
    if clusters is None:
        return "clusters_missing"
    if not isinstance(clusters, list):
        return "clusters_not_list"
    if not all(isinstance(c, dict) and "stopped_at" in c for c in clusters):
        return "clusters_malformed"
    return None


@pytest.mark.parametrize("line", ["5", '"x"', "null", "true", "[]", "{}", '{"Params":{}}', "[1,2]"])
def test_documents_without_params(spark, line):
    assert parse(spark, [line], missing_params="route").first().reason == "no_params"


@pytest.mark.parametrize("blank", ["", "  ", "\t", "  ", " ", "\r", "\x0b"])
def test_blank_lines(spark, blank):
    assert not blank.strip()
    assert parse(spark, [blank]).isEmpty()


def nested(depth):
    return "[" * depth + "]" * depth


TYPES = {
    '"sequence":"3","clusters":[]': "sequence_text",
    '"sequence":1.9,"clusters":[]': "sequence_fraction",
    '"sequence":3.0,"clusters":[]': "sequence_fraction",
    '"sequence":3e0,"clusters":[]': "sequence_fraction",
    '"sequence":true,"clusters":[]': "sequence_boolean",
    '"sequence":null,"clusters":[]': "sequence_missing",
    '"clusters":[]': "sequence_missing",
    "": "sequence_missing",
    '"sequence":99999999999999999999,"clusters":[]': "sequence_oversized",
    '"sequence":9223372036854775808,"clusters":[]': "sequence_oversized",
    '"sequence":[3],"clusters":[]': "sequence_nested",
    '"sequence":3': "clusters_missing",
    '"sequence":3,"clusters":null': "clusters_missing",
    '"sequence":3,"clusters":7': "clusters_not_list",
    '"sequence":3,"clusters":{"stopped_at":null}': "clusters_not_list",
    '"sequence":3,"clusters":[7,null,{}]': "clusters_malformed",
    '"sequence":3,"clusters":[null]': "clusters_malformed",
    '"sequence":3,"clusters":[{"id":1}]': "clusters_malformed",
    '"sequence":9223372036854775807,"clusters":[{"stopped_at":null}]': None,
    '"sequence":-1,"clusters":[{"stopped_at":5,"x":' + nested(1500) + "}]": None,
}


def test_types_of_fields(spark):
    lines = {f'{{"params":{{{fields}}}}}': reason for fields, reason in TYPES.items()}
    # a repeated or very long field beside them changes nothing
    lines |= {'{"twice":1,"twice":2,' + line[1:]: reason for line, reason in lines.items()}
    lines |= {'{"long":"' + "x" * 3_000_000 + '",' + line[1:]: r for line, r in list(lines.items())[:12]}
    found = parse(spark, list(lines)).collect()
    assert {row.line: row.reason for row in found} == lines
    assert {row.sequence for row in found} == {None, -1, 2**63 - 1}


def test_each_line_is_parsed_once(spark):
    reports = good_reports(parse(spark, LINES[:5]))
    plan = open_clusters(reports)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(sequence,VariantType") == 1


def test_latest(spark):
    reports = good_reports(parse(spark, [THREE, TWO, TICK]))
    latest = latest_report(reports)
    assert latest.columns == reports.columns
    assert [row.line for row in latest.collect()] == [THREE]
    assert [row.open_count for row in open_clusters(latest).collect()] == [1]


def test_no_latest_before_the_second_tick(spark):
    assert latest_report(good_reports(parse(spark, [TICK]))).isEmpty()
    assert latest_report(good_reports(parse(spark, [CUT]))).isEmpty()


def test_latest_of_equal_sequences_is_always_the_same(spark):
    other = THREE.replace("c1", "c9")
    for lines in ([THREE, other], [other, THREE]):
        assert latest_report(good_reports(parse(spark, lines))).first().line == other


def test_latest_needs_no_sort_of_all_rows(spark):
    reports = good_reports(parse(spark, LINES[:5]))
    plan = latest_report(reports)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Window" not in plan and "partial_max_by" in plan


def test_duplicates(spark):
    lines = [TWO, TWO, THREE, '{"params":{}}', '{"params":{}}']
    found = duplicate_sequences(good_reports(parse(spark, lines))).collect()
    assert list(map(tuple, found)) == [(2, 2)]


def test_open_clusters_and_rows(spark):
    reports = good_reports(parse(spark, [TICK, TWO]))
    counts = {(r.sequence, r.cluster_count, r.open_count) for r in open_clusters(reports).collect()}
    assert counts == {(1, 0, 0), (2, 2, 1)}
    rows = cluster_rows(reports).select("sequence", "position", "cluster.stopped_at").collect()
    assert {tuple(r) for r in rows} == {
        (1, None, None),
        (2, 0, None),
        (2, 1, "2026-01-01T00:00:00Z"),
    }


def run_ingest(spark, ledger, target, **options):
    query = ingest_reports(
        spark,
        Location.local(str(ledger)),
        Location.local(str(target / "table")),
        Location.local(str(target / "progress")),
        missing_params="route",
        **options,
    )
    query.awaitTermination()


def test_stream_equals_batch(spark, ledger, tmp_path):
    run_ingest(spark, ledger, tmp_path, files_per_trigger=1)
    place = Location.local(str(tmp_path / "table"))
    batch = parse_reports(ledger_lines(spark, Location.local(str(ledger))), missing_params="route")
    assert same_rows(ingested(spark, place), batch)
    assert same_rows(ingested_reports(spark, place), good_reports(batch))


def test_stream_reads_each_file_once(spark, ledger, tmp_path):
    place = Location.local(str(tmp_path / "table"))
    run_ingest(spark, ledger, tmp_path)
    assert ingested_reports(spark, place).count() == 3
    four = THREE.replace('"sequence":3', '"sequence":4')
    with (ledger / "report.1.jsonl").open("a") as file:
        file.write("\n" + four)
    run_ingest(spark, ledger, tmp_path)
    assert ingested_reports(spark, place).count() == 3
    (ledger / "report.2.jsonl").write_text(four + "\n")
    run_ingest(spark, ledger, tmp_path)
    assert ingested_reports(spark, place).count() == 4
    assert latest_report(ingested_reports(spark, place)).first().sequence == 4


def test_stream_goes_on_at_an_interval(spark, ledger, tmp_path):
    query = ingest_reports(
        spark,
        *(Location.local(str(p)) for p in (ledger, tmp_path / "table", tmp_path / "progress")),
        missing_params="route",
        interval="200 milliseconds",
    )
    try:
        query.processAllAvailable()
        (ledger / "report.2.jsonl").write_text(THREE + "\n")
        query.processAllAvailable()
    finally:
        query.stop()
    assert ingested_reports(spark, Location.local(str(tmp_path / "table"))).count() == 4


def test_stream_prunes_dead_letters(spark, ledger, tmp_path):
    run_ingest(spark, ledger, tmp_path)
    reports = ingested_reports(spark, Location.local(str(tmp_path / "table")))
    assert {r["_metadata"] for r in reports.select(F.lit(1).alias("_metadata")).collect()} == {1}
    plan = reports._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_stream_fails_on_missing_params_by_default(spark, ledger, tmp_path):
    query = ingest_reports(
        spark,
        Location.local(str(ledger)),
        Location.local(str(tmp_path / "table")),
        Location.local(str(tmp_path / "progress")),
    )
    with pytest.raises(Exception, match="no params"):
        query.awaitTermination()


def test_stream_policy(spark, ledger, tmp_path):
    places = [Location.local(str(p)) for p in (ledger, tmp_path / "t", tmp_path / "p")]
    for policy in (AccessPolicy(allow_local_scans=False), AccessPolicy(allow_local_sinks=False)):
        with pytest.raises(PermissionError):
            ingest_reports(spark, *places, policy=policy)


def test_documents_of_any_size_and_depth(spark):
    good = '{"params":{"sequence":7,"clusters":[]},'
    lines = {
        good + '"long":"' + "x" * 21_000_000 + '"}': None,
        good + '"twice":1,"twice":2}': None,
        good + '"deep":' + nested(1100) + "}": None,
        good + '"deep":' + nested(5000) + "}": None,
        nested(5000): "no_params",
        '"' + "x" * 21_000_000 + '"': "no_params",
        '{"twice":1,"twice":2}': "no_params",
        nested(5000)[:-1]: "bad_json",
        good + '"twice":1,"twice":2} {}': "bad_json",
        '1,"k":2': "bad_json",
        "1,2": "bad_json",
        '1],"q":[2': "bad_json",
        '1},{"v":2': "bad_json",
        '{}],[{"__mark":1}': "bad_json",
    }
    found = parse(spark, list(lines), missing_params="route").collect()
    assert {row.line: row.reason for row in found} == lines


def until(spark, ledger, target, sequence, **options):
    return ingest_until(
        spark,
        Location.local(str(ledger)),
        Location.local(str(target / "table")),
        Location.local(str(target / "progress")),
        sequence=sequence,
        missing_params="route",
        files_per_trigger=1,
        interval="0 seconds",
        **options,
    )


@pytest.fixture
def growing(tmp_path):
    """A ledger of five files, a report each, written one after the other."""
    folder = tmp_path / "growing"
    folder.mkdir()
    for number in range(1, 6):
        file = folder / f"report.{number}.jsonl"
        file.write_text(f'{{"params":{{"sequence":{number},"clusters":[]}}}}\n{CUT}\n')
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    return folder


def test_ingest_stops_with_the_wanted_report(spark, growing, tmp_path):
    place = Location.local(str(tmp_path / "table"))
    first = until(spark, growing, tmp_path, 3)
    assert (first.found, first.batch, first.latest.first().sequence) == (True, 2, 3)
    stored = ingested_batches(spark, place)
    assert {(r.batch, r.sequence) for r in stored.where("reason is null").collect()} == {(0, 1), (1, 2), (2, 3)}
    assert stored.where("reason = 'bad_json'").count() == 3
    # nothing to do, then on to the next
    again = until(spark, growing, tmp_path, 2)
    assert (again.found, again.batch) == (True, 2)
    assert ingested_batches(spark, place).count() == 6
    later = until(spark, growing, tmp_path, 4)
    assert (later.found, later.batch, later.latest.first().sequence) == (True, 3, 4)
    assert ingested_batches(spark, place).where("reason is null").count() == 4


def test_ingest_gives_up_in_time(spark, growing, tmp_path):
    ended = until(spark, growing, tmp_path, 99, seconds=20)
    assert (ended.found, ended.batch, ended.latest.first().sequence) == (False, None, 5)
    empty = tmp_path / "empty"
    empty.mkdir()
    nothing = until(spark, empty, tmp_path / "other", 1, seconds=1)
    assert not nothing.found and nothing.latest.isEmpty()


def test_batch_that_runs_again_adds_nothing(spark, growing, tmp_path):
    until(spark, growing, tmp_path, 3)

    def stored():
        rows = ingested_batches(spark, Location.local(str(tmp_path / "table"))).collect()
        return sorted((r.batch, r.line, r.sequence or 0, r.reason or "") for r in rows)

    rows = stored()
    # as if the attempt had died before Spark recorded the batch
    (tmp_path / "progress" / "commits" / "2").unlink()
    (tmp_path / "progress" / "commits" / ".2.crc").unlink()
    for name in ("lines", "latest"):
        (tmp_path / "table" / name / "batch=2" / "_SUCCESS").unlink()
    assert until(spark, growing, tmp_path, 3).batch == 2
    assert stored() == rows and len(rows) == 6
