"""Typed attribute values: names of types, coercion, inference, SQL types."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import timestamps

# fixed values: names of attribute types in object-centric logs, and the Spark and SQL types they become
SPARK_TYPES = {"string": "string", "time": "timestamp", "integer": "bigint", "float": "double", "boolean": "boolean"}
SQL_TYPES = {"string": "TEXT", "time": "TIMESTAMP", "integer": "BIGINT", "float": "DOUBLE", "boolean": "BOOLEAN"}
FROM_SQL = {"TEXT": "string", "VARCHAR": "string", "REAL": "float", "FLOAT": "float", "DOUBLE": "float", "DOUBLE PRECISION": "float", "INTEGER": "integer", "BIGINT": "integer", "BOOLEAN": "boolean", "TIMESTAMP": "time"}


def coerce(value: Column, to: str) -> Column:
    """A text value as a type of the dictionary; null where it doesn't fit."""
    if to == "time":
        return timestamps.parse(value)
    return value.try_cast(SPARK_TYPES.get(to, "string"))


def strictly(value: Column, kind: Column) -> Column:
    """A text as XML logs keep it for a declared type: what isn't one of the type's values is null, a float ``null`` is NaN."""
    whole = value.rlike(r"^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull()
    part = value.rlike(r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$")
    return (
        F.when(kind == "integer", F.when(whole, value))
        .when(kind == "float", F.when(part, value).when(value == "null", F.lit("NaN")))
        .when(kind == "boolean", F.when(value.isin("true", "false"), value))
        .when(kind == "time", F.when(timestamps.parse(value).isNotNull(), value))
        .otherwise(value)
    )


def infer(value: Column) -> Column:
    """The narrowest type name of a text: boolean, integer, float, time, string."""
    return (
        F.when(F.lower(value).isin("true", "false"), "boolean")
        .when(value.rlike(r"^[+-]?\d{1,18}$"), "integer")
        .when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), "float")
        .when(timestamps.parse(value).isNotNull(), "time")
        .otherwise("string")
    )


def joined_type(types: Column) -> Column:
    """The least type that holds all of an array of type names: equal ones stay, integer and float give float, else string."""
    t = F.array_distinct(types)
    return F.when(F.size(t) == 1, t[0]).when(F.size(F.array_except(t, F.array(F.lit("integer"), F.lit("float")))) == 0, "float").otherwise("string")


def typed(value: str | None, kind: str):
    """A stored text as a Python value of its type, for writers."""
    if value is None:
        return None
    if kind == "integer":
        return int(value)
    if kind == "float":
        return float(value)
    if kind == "boolean":
        return value.lower() == "true"
    return value


def name_of(value) -> str:
    """Type name of a JSON value."""
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    return "float" if isinstance(value, float) else "string"


def text_of(value) -> str | None:
    """A JSON value as stored text."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value)


def sql_name(name: str) -> str:
    """A type's name as part of a table's name."""
    return name.translate(str.maketrans("'\\", "__"))


def node_name(name: str) -> str:
    """A type's name as a graph label."""
    return "".join(c if c.isalnum() else "_" for c in name.replace(" ", ""))
