"""JSON access on operation bodies and preference payloads.

Functions here and in ``text`` take and give SQL expressions as text: a whole rule then
reaches Spark as one expression instead of hundreds of calls.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from chainalerts.schemas import BODY


def value_map(body: str = "body") -> str:
    """``body.value`` as a map of key -> scalar text or raw JSON of a nested node."""
    return f"from_json({body}, '{BODY}').value"


def value_field(name: str, kind: str) -> str:
    """A field of a landed value (``chainalerts.sources.shredded``), read as ``kind``."""
    path = "$['" + name + "']"
    return f"""try_variant_get(val, "{path}", '{kind}')"""


def value_fields(names: Iterable[str] | None) -> str:
    """``value_map`` of a landed value: of the fields that are named, or of all.

    A name that cannot be put into a path makes it all of them.
    """
    if names is None or any(set(name) & set("'\"\\") for name in names):
        return "try_variant_get(val, '$', 'map<string,string>')"
    entries = ", ".join(f"'{name}', {value_field(name, 'string')}" for name in sorted(names))
    return f"map({entries})" if entries else "CAST(map() AS MAP<STRING,STRING>)"


def from_text(value: str, kind: str) -> str:
    """JSON text read as ``kind``, where a field of a landed value is not of that kind."""
    return f"try_variant_get(try_parse_json({value}), '$', '{kind}')"


def node(value: str, key: str) -> str:
    """Member ``key`` of a JSON text, whether it was a node or JSON inside a string."""
    return f"get_json_object({value}, '$.{key}')"


def first_element(value: str) -> str:
    """First element of a JSON array as text, NULL when there is none."""
    return f"try_element_at(from_json({value}, 'array<string>'), 1)"


def variant_at(document: str, path: str) -> str:
    return f"try_variant_get({document}, '{path}', 'variant')"


# Names of JSON types by the first word of a variant's schema.
JSON_TYPES = (
    "map('OBJECT', 'object', 'ARRAY', 'array', 'STRING', 'string', 'BOOLEAN', 'boolean', "
    "'VOID', 'null', 'BIGINT', 'number', 'DECIMAL', 'number', 'DOUBLE', 'number', "
    "'FLOAT', 'number')"
)


def json_type(variant: str) -> str:
    """JSON type name of a variant: object, array, string, number, boolean or null."""
    return f"{JSON_TYPES}[regexp_extract(schema_of_variant({variant}), '^[A-Z]+', 0)]"


def object_entries(variant: str) -> str:
    """Members of a JSON object as ``ARRAY<STRUCT<key STRING, value VARIANT>>``."""
    return f"map_entries(try_variant_get({variant}, '$', 'map<string,variant>'))"


def bind(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {use})[0]"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def fenced(frame: DataFrame, **columns: str) -> DataFrame:
    """Add columns that are computed once per row.

    A later filter on a plain projection is pushed below it with the expression copied
    in, so costly parses would run again in every filter. Filters on the output of a
    generator stay above it.
    """
    return frame.selectExpr("*", f"inline_outer(array({struct(**columns)}))")
