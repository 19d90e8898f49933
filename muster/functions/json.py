"""Strict reading of JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column that later filters do not compute again.

    A filter on a plain column is pushed below its computation, which is then done twice. Filters
    are not pushed below `explode`, here of one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


# No limit on what a document holds, and nothing but JSON.
_NO_LIMITS = {
    "maxStringLen": "2147483647",
    "maxNestingDepth": "2147483647",
    "maxNumLen": "2147483647",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


def _is_document(text: str) -> Column:
    """Whether a text is exactly one JSON value, of any size and depth.

    It is put into an object and into an array. What closes the one does not close the other, and
    what may follow a comma in the one may not in the other, so nothing but one value fits both.
    The parser skips the value and copies none of it. An element in which it met an error is null.
    """
    mark = F.xxhash64(F.col(text)).cast("string")
    wrapped = F.concat(
        F.lit('[{"v":'), F.col(text), F.lit('},{"v":['), F.col(text), F.lit(']},{"__mark":'), mark, F.lit("}]")
    )
    parts = F.from_json(wrapped, "array<struct<__mark: bigint>>", _NO_LIMITS)
    last = F.try_element_at(parts, F.lit(3))["__mark"]
    clean = (F.size(parts) == 3) & ~F.exists(parts, lambda part: part.isNull())
    return F.coalesce(clean & (last.cast("string") == mark), F.lit(False))


def with_object(df: DataFrame, text: str, fields: str, name: str) -> DataFrame:
    """Add a struct of `whole`, whether the text is exactly one JSON document, and `object`, the
    wanted fields of a document that is an object (else null).

    Only these fields are read. The parser skips all others, so their size, depth and repeated keys
    do not matter; of a wanted key that is repeated the last counts. Give a field the type variant
    to see its JSON type. A wanted field that does not have its type is null.
    """
    is_object = F.col(text).rlike(r"^[ \t\n\r]*\{")
    checked = computed_once(df, _is_document(text), "__whole")
    read = F.when(F.col("__whole") & is_object, F.from_json(F.col(text), f"struct<{fields}>", _NO_LIMITS))
    return computed_once(checked, F.struct(F.col("__whole").alias("whole"), read.alias("object")), name).drop("__whole")


def read_again(text: str, fields: str) -> Column:
    """A second reading of a document, of other fields."""
    return F.from_json(F.col(text), f"struct<{fields}>", _NO_LIMITS)
