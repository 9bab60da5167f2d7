"""Type-strict reads from a JSON payload held as VARIANT.

A text read returns a value only when the JSON value is a string: a number or a
boolean in its place counts as missing, as does anything below a non-object.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(json_text: Column | str) -> Column:
    return F.try_parse_json(json_text)


def node(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def type_name(doc: Column, path: str = "$") -> Column:
    """STRING, BIGINT, BOOLEAN, VOID (JSON null), OBJECT<..>, ARRAY<..>; NULL when absent."""
    # the value itself needs no walk, which would copy it
    return F.schema_of_variant(doc if path == "$" else node(doc, path))


def text(doc: Column, path: str) -> Column:
    return F.when(type_name(doc, path) == "STRING", F.try_variant_get(doc, path, "string"))


def filled_text(doc: Column, path: str) -> Column:
    return F.nullif(text(doc, path), F.lit(""))


def is_object(doc: Column, path: str = "$") -> Column:
    return F.coalesce(type_name(doc, path).startswith("OBJECT"), F.lit(False))


def is_array(doc: Column, path: str) -> Column:
    return F.coalesce(type_name(doc, path).startswith("ARRAY"), F.lit(False))


def is_boolean(doc: Column, path: str) -> Column:
    return F.coalesce(type_name(doc, path) == "BOOLEAN", F.lit(False))


def is_present(doc: Column, path: str) -> Column:
    """True for a value other than JSON null."""
    return F.coalesce(type_name(doc, path) != "VOID", F.lit(False))


def json_text(doc: Column, path: str) -> Column:
    return F.to_json(node(doc, path))


def elements(doc: Column, path: str) -> Column:
    """The array at ``path`` as ARRAY<VARIANT>, or NULL when it is not an array."""
    return F.when(is_array(doc, path), F.try_variant_get(doc, path, "array<variant>"))


def is_truthy(doc: Column, path: str) -> Column:
    """Whether the value is neither null, false, zero nor empty."""
    rendered = json_text(doc, path)
    return is_present(doc, path) & ~rendered.isin("false", '""', "[]", "{}") & ~rendered.rlike(r"\A-?0(\.0*)?([eE][-+]?\d+)?\z")
