"""Reading JSON text without coercion.

``from_json`` and ``try_variant_get`` turn a JSON number into text when asked for a string. A field of
the wrong JSON type must read as NULL here, so every getter checks the stored type first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.vectors import let


def parsed(text: Column) -> Column:
    """JSON text as a variant, NULL where the text as a whole is not JSON.

    The parser stops after the first value and ignores what follows it, so the text is parsed inside an
    array. That misreads two kinds of texts: several values with commas between, which make an array of
    more than one item, and texts that close the array themselves. Only texts that hold a ``]`` can do
    the latter; they are parsed once more, inside an object, which they cannot close as well.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    sound = F.when(text.contains("]"), in_object.isNotNull()).otherwise(F.lit(True))

    def only(array: Column) -> Column:
        one = F.try_variant_get(array, "$[1]", "variant").isNull() & sound
        return F.when(one, F.try_variant_get(array, "$[0]", "variant"))

    return let(in_array, only)


def checked(value: Column, text: Column, what: str = "text") -> Column:
    """``value``, parsed from ``text``; fails the job where there is text that was not JSON."""
    refused = F.raise_error(F.concat(F.lit(f"{what} is not JSON: "), text)).cast("variant")
    return F.when(text.isNotNull() & value.isNull(), refused).otherwise(value)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds costly columns that later filters read instead of computing them again.

    Catalyst moves a filter below a projection and repeats there whatever the filter reads. It leaves
    filters above a projection that has a column whose value depends on the task.
    """
    return df.withColumns(columns | {"_task": F.spark_partition_id()}).filter(F.col("_task") >= 0).drop("_task")


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def text_at(doc: Column, path: str) -> Column:
    """The string at ``path``; NULL when absent or not a JSON string."""
    return F.when(
        F.schema_of_variant(_at(doc, path)) == "STRING", F.try_variant_get(doc, path, "string")
    )


def long_at(doc: Column, path: str) -> Column:
    """The integer at ``path``; NULL when absent, a string, or a number with a fraction part."""
    return F.when(
        F.schema_of_variant(_at(doc, path)) == "BIGINT", F.try_variant_get(doc, path, "bigint")
    )


def int_at(doc: Column, path: str) -> Column:
    """Like :func:`long_at`, NULL outside the 32-bit range."""
    return long_at(doc, path).try_cast("int")


def texts_at(doc: Column, path: str) -> Column:
    """The non-empty strings of the array at ``path``; empty when there is no array."""
    shape = F.schema_of_variant(_at(doc, path))
    mixed = F.transform(
        F.filter(F.try_variant_get(doc, path, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
        lambda x: F.try_variant_get(x, "$", "string"),
    )
    # An array of nothing but strings is read in one step; only a mixed one is looked at item by item.
    found = F.when(shape == "ARRAY<STRING>", F.try_variant_get(doc, path, "array<string>")).otherwise(mixed)
    return F.coalesce(F.filter(found, lambda s: s != ""), F.expr("cast(array() as array<string>)"))


def json_or_string(text: Column) -> Column:
    """JSON text as it is; any other text as a quoted JSON string."""
    text = F.coalesce(text, F.lit(""))
    quoted = F.to_json(F.array(text))
    return F.when(parsed(text).isNotNull(), text).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )
