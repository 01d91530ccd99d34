"""Avro schemas and Spark types, each made from the other; values checked against a schema.  Driver-side only."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

#: Names of types as callers write them.
NAMES = {"string": "string", "str": "string", "integer": "int", "int": "long", "long": "long", "float": "double", "double": "double", "boolean": "boolean", "bool": "boolean", "bytes": "bytes", "null": "null"}
_SPARK = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "bytes": T.BinaryType(), "null": T.NullType()}


def to_avro(kind: T.DataType, name: str = "record") -> Any:
    """Every field is a union with null."""
    if isinstance(kind, T.StructType):
        return {"type": "record", "name": name, "fields": [{"name": f.name, "type": ["null", to_avro(f.dataType, f"{name}_{f.name}")], "default": None} for f in kind.fields]}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": ["null", to_avro(kind.elementType, f"{name}_item")]}
    if isinstance(kind, T.MapType):
        return {"type": "map", "values": ["null", to_avro(kind.valueType, f"{name}_value")]}
    if isinstance(kind, T.DateType):
        return {"type": "int", "logicalType": "date"}
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return {"type": "long", "logicalType": "timestamp-micros"}
    if isinstance(kind, T.DecimalType):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    small = {T.ByteType: "int", T.ShortType: "int"}
    return small.get(type(kind)) or next((n for n, t in _SPARK.items() if isinstance(kind, type(t))), "string")


def to_spark(schema: Any) -> T.DataType:
    if isinstance(schema, list):
        return to_spark(next((s for s in schema if s != "null"), "null"))
    if isinstance(schema, str):
        return _SPARK[schema]
    logical = {"date": T.DateType(), "timestamp-micros": T.TimestampType(), "timestamp-millis": T.TimestampType()}.get(schema.get("logicalType", ""))
    if logical:
        return logical
    if schema.get("logicalType") == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    match schema["type"]:
        case "record":
            return T.StructType([T.StructField(f["name"], to_spark(f["type"]), isinstance(f["type"], list)) for f in schema["fields"]])
        case "array":
            return T.ArrayType(to_spark(schema["items"]))
        case "map":
            return T.MapType(T.StringType(), to_spark(schema["values"]))
        case "enum" | "fixed":
            return T.StringType() if schema["type"] == "enum" else T.BinaryType()
        case other:
            return to_spark(other)


def infer(record: dict[str, Any], name: str = "record") -> Any:
    """A schema from one record: every field a union with null."""

    def of(value: Any, at: str) -> Any:
        match value:
            case bool():
                return "boolean"
            case int():
                return "long"
            case float():
                return "double"
            case bytes():
                return "bytes"
            case dict():
                return infer(value, at)
            case list():
                return {"type": "array", "items": of(value[0], f"{at}_item") if value else "string"}
            case _:
                return "string"

    return {"type": "record", "name": name, "fields": [{"name": k, "type": ["null", of(v, f"{name}_{k}")], "default": None} for k, v in record.items()]}


def faults(schema: Any) -> list[str]:
    """What is wrong with a record schema."""
    if not isinstance(schema, dict):
        return ["schema must be a dictionary"]
    out = [f"schema has no {k!r}" for k in ("type", "name", "fields") if k not in schema]
    for f in schema.get("fields", []):
        if not isinstance(f, dict) or "name" not in f or "type" not in f:
            out.append(f"field without name or type: {f}")
            continue
        try:
            to_spark(f["type"])
        except (KeyError, TypeError):
            out.append(f"field {f['name']!r}: unknown type {f['type']!r}")
    return out


def coerce(value: Any, schema: Any) -> Any:
    """A value as the schema's type; what can't be becomes null in a union, else raises."""
    if isinstance(schema, list):
        if value is None:
            return None
        try:
            return coerce(value, next(s for s in schema if s != "null"))
        except (TypeError, ValueError):
            return None
    if isinstance(schema, dict):
        if schema["type"] == "record":
            return {f["name"]: coerce(value.get(f["name"]), f["type"]) for f in schema["fields"]}
        if schema["type"] == "array":
            return [coerce(v, schema["items"]) for v in value]
        return value
    made = {"string": str, "int": int, "long": int, "float": float, "double": float, "boolean": bool, "bytes": lambda v: v if isinstance(v, bytes) else str(v).encode()}
    return made[schema](value) if schema in made else None
