"""Replies of an annotator as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_fields(rows: DataFrame, reply: str, error: str, fields: dict[str, str], error_name: str, empty: Column, longest: int = 200) -> DataFrame:
    """rows with one column per field of a JSON reply (name to type): numbers and
    text as they are, null for lists and objects. An error's text is cut to
    `longest` characters into error_name. Where `empty` holds, nothing was asked:
    eval_error says so and all else is null."""
    parsed = rows.withColumn("_v", F.try_parse_json(reply))
    kind = lambda name: F.schema_of_variant(F.variant_get("_v", f"$.{name}", "variant"))
    scalar = lambda name: ~(kind(name).startswith("ARRAY") | kind(name).startswith("OBJECT"))
    asked = ~empty
    columns = [F.when(asked & scalar(name), F.try_variant_get("_v", f"$.{name}", type_)).alias(name) for name, type_ in fields.items()]
    return parsed.select(*rows.columns, F.when(empty, "empty_transcripts").alias("eval_error"), *columns, F.when(asked, F.left(F.col(error), F.lit(longest))).alias(error_name))
