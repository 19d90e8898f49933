"""Validation of scale requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions.columns import own_columns, refuse_columns
from muster.functions.json import computed_once, with_object

_NAME_SETS = ("workers_to_keep", "workers_to_delete")
_FIELDS = f"amount: variant, {', '.join(f'{name}: variant' for name in _NAME_SETS)}"


def _reason(test: Column, name: str) -> Column:
    return F.when(test, F.lit(name)).otherwise(F.lit(""))


def validate_requests(requests: DataFrame, body: str = "body") -> DataFrame:
    """Add the parts of each JSON body and the reasons to reject it; works on streams too.

    Adds `amount`, `workers_to_keep`, `workers_to_delete` (distinct names, null where not given)
    and `reasons`, which is empty for an accepted request. A body must be one JSON object, its
    amount a JSON integer of at most 64 bits that is not negative, and each set of names absent,
    null or an array of strings. Other fields are not read: they may be of any size and depth and
    repeat their keys. Of a field here that is repeated the last counts.
    """
    refuse_columns(requests, "amount", *_NAME_SETS, "reasons")
    documents = with_object(requests, body, _FIELDS, "__doc").select(
        *own_columns(requests),
        F.col("__doc.whole").alias("__valid"),
        F.col("__doc.object").alias("__fields"),
    )
    # The types are looked up by name: casts to bigint and string accept other JSON types too.
    fields = computed_once(
        documents,
        F.struct(
            F.schema_of_variant(F.col("__fields.amount")).alias("amount_type"),
            F.try_variant_get("__fields.amount", "$", "bigint").alias("amount"),
            *(
                F.schema_of_variant(F.col(f"__fields.{name}")).alias(f"{name}_type")
                for name in _NAME_SETS
            ),
            *(
                F.array_distinct(
                    F.try_variant_get(f"__fields.{name}", "$", "array<string>")
                ).alias(name)
                for name in _NAME_SETS
            ),
        ),
        "__read",
    )

    valid, is_object = F.col("__valid"), F.col("__fields").isNotNull()
    amount_type, amount = F.col("__read.amount_type"), F.col("__read.amount")
    reasons = [
        _reason(~valid, "json_invalid"),
        _reason(valid & ~is_object, "model_type"),
        _reason(is_object & amount_type.isNull(), "amount:missing"),
        _reason(amount_type != "BIGINT", "amount:int_type"),
        _reason((amount_type == "BIGINT") & (amount < 0), "amount:greater_than_equal"),
    ]
    for name in _NAME_SETS:
        kind, names = F.col(f"__read.{name}_type"), F.col(f"__read.{name}")
        is_array = kind.startswith("ARRAY<")
        strings = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(names, F.isnull)
        reasons += [
            _reason((kind != "VOID") & ~is_array, f"{name}:set_type"),
            _reason(is_array & ~strings, f"{name}:string_type"),
        ]
    accepted = F.size("reasons") == 0
    return fields.withColumn("reasons", F.array_remove(F.array(*reasons), "")).select(
        *own_columns(requests),
        *(F.when(accepted, F.col(f"__read.{n}")).alias(n) for n in ("amount", *_NAME_SETS)),
        "reasons",
    )


def accepted_requests(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") == 0).drop("reasons")


def rejected_requests(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("reasons") > 0).drop("amount", *_NAME_SETS)
