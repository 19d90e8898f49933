from __future__ import annotations

import pytest

from muster.functions.requests import accepted_requests, rejected_requests, validate_requests
from muster.operators.compare import same_rows
from muster.sources.locations import Location, scan_stream

ACCEPTED = {
    '{"amount":3}': (3, None, None),
    '{"amount":0}': (0, None, None),
    '{"amount":-0}': (0, None, None),
    '{"amount":2,"workers_to_keep":["worker-1","worker-1"]}': (2, ["worker-1"], None),
    '{"amount":2,"workers_to_keep":null,"x":1}': (2, None, None),
    '{"amount":2,"workers_to_keep":[]}': (2, [], None),
    '{"amount":2,"workers_to_delete":["b","a","b"],"workers_to_keep":[""]}': (2, [""], ["b", "a"]),
    '{"amount":2,"workers_to_delete":["3","true"]}': (2, None, ["3", "true"]),
    ' { "amount" : 9223372036854775807 } ': (9223372036854775807, None, None),
    # what is not read may be of any size and depth and repeated; of what is read the last counts
    '{"x":1,"amount":3,"x":2}': (3, None, None),
    '{"amount":1,"amount":2}': (2, None, None),
    '{"amount":4,"x":"' + "x" * 21_000_000 + '"}': (4, None, None),
    '{"amount":5,"x":' + "[" * 1100 + "]" * 1100 + "}": (5, None, None),
    '{"amount":6,"x":' + "[" * 5000 + "]" * 5000 + "}": (6, None, None),
}

REJECTED = {
    '{"amount":-1}': ["amount:greater_than_equal"],
    '{"amount":"3"}': ["amount:int_type"],
    '{"amount":1.0}': ["amount:int_type"],
    '{"amount":true}': ["amount:int_type"],
    '{"amount":1e0}': ["amount:int_type"],
    '{"amount":null}': ["amount:int_type"],
    '{"amount":[3]}': ["amount:int_type"],
    "{}": ["amount:missing"],
    '{"Amount":3}': ["amount:missing"],
    '{"amount":2,"workers_to_keep":[1]}': ["workers_to_keep:string_type"],
    '{"amount":2,"workers_to_keep":["a",null]}': ["workers_to_keep:string_type"],
    '{"amount":2,"workers_to_keep":[null]}': ["workers_to_keep:string_type"],
    '{"amount":2,"workers_to_keep":["a",1]}': ["workers_to_keep:string_type"],
    '{"amount":2,"workers_to_keep":[["a"]]}': ["workers_to_keep:string_type"],
    '{"amount":2,"workers_to_delete":[{"a":1}]}': ["workers_to_delete:string_type"],
    '{"amount":2,"workers_to_delete":"w"}': ["workers_to_delete:set_type"],
    '{"amount":2,"workers_to_keep":{"a":1}}': ["workers_to_keep:set_type"],
    '{"workers_to_keep":5,"workers_to_delete":[1]}': [
        "amount:missing",
        "workers_to_keep:set_type",
        "workers_to_delete:string_type",
    ],
    "nope": ["json_invalid"],
    "": ["json_invalid"],
    '{"amount":3} x': ["json_invalid"],
    '{"amount":3}{"amount":4}': ["json_invalid"],
    '{"amount":3': ["json_invalid"],
    "[1]": ["model_type"],
    "5": ["model_type"],
    "null": ["model_type"],
    '[{"amount":3}]': ["model_type"],
    # stricter than it need be: beyond 64 bits
    '{"amount":99999999999999999999}': ["amount:int_type"],
    '{"amount":1,"amount":"2"}': ["amount:int_type"],
    "[" * 5000 + "]" * 5000: ["model_type"],
    '{"amount":3,"x":' + "[" * 5000 + "]" * 4999 + "}": ["json_invalid"],
}


@pytest.fixture(scope="module")
def bodies(spark):
    return spark.createDataFrame([(b,) for b in [*ACCEPTED, *REJECTED]], "body string")


def test_accepted(bodies):
    rows = accepted_requests(validate_requests(bodies)).collect()
    assert {r.body: (r.amount, r.workers_to_keep, r.workers_to_delete) for r in rows} == ACCEPTED


def test_rejected(bodies):
    rows = rejected_requests(validate_requests(bodies)).collect()
    assert {row.body: row.reasons for row in rows} == REJECTED


def test_null_body_is_rejected(spark):
    df = spark.createDataFrame([(1, None)], "id int, body string")
    assert validate_requests(df).first().reasons == ["json_invalid"]


def test_columns_are_kept_and_not_overwritten(spark):
    df = spark.createDataFrame([(1, '{"amount":3}')], "id int, text string")
    assert validate_requests(df, "text").columns == [
        "id",
        "text",
        "amount",
        "workers_to_keep",
        "workers_to_delete",
        "reasons",
    ]
    with pytest.raises(ValueError):
        validate_requests(df.withColumnRenamed("id", "amount"), "text")


def test_no_python_and_no_shuffle(bodies):
    plan = accepted_requests(validate_requests(bodies))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    assert "Python" not in text and "Exchange" not in text
    wanted = "StructField(amount,VariantType"
    assert validate_requests(bodies)._jdf.queryExecution().optimizedPlan().toString().count(wanted) == 1


def test_stream_equals_batch(spark, bodies, tmp_path):
    place = Location.local(str(tmp_path)).child("in")
    bodies.write.parquet(place.uri)
    stream = validate_requests(scan_stream(spark, place, schema="body string"))
    query = (
        stream.writeStream.format("memory").queryName("validated").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert same_rows(spark.table("validated"), validate_requests(bodies))
