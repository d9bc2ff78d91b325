"""What a write must satisfy, and the rows that don't.

Checks over whole collections are aggregates and joins; the checks of one
record are also available for documents, batch by batch.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import InvalidInput
from larkspur.functions import variants as V
from larkspur.functions.pointers import parse_pointer
from larkspur.operators.write import check_target

_KINDS = {
    "array": lambda v: isinstance(v, list),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float, Decimal)) and not isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "string": lambda v: isinstance(v, str),
}


def _same(a: Any, b: Any) -> bool:
    a, b = (float(x) if isinstance(x, Decimal) else x for x in (a, b))
    return type(a) is type(b) and a == b


def schema_error(value: Any, schema: dict, path: str = "") -> str | None:
    """The first way in which a value breaks the schema: a subset of JSON Schema.

    enum, type, required (dotted paths; null counts as missing), properties,
    additionalProperties false (where there are properties), minLength,
    maxLength, minimum and maximum.
    """
    at = path or "record"
    if "enum" in schema and not any(_same(value, e) for e in schema["enum"]):
        return f"{at} is not one of the allowed values"
    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        if not any(n in _KINDS and _KINDS[n](value) for n in names):
            return f"{at} is not of type {'/'.join(names)}"
    for name in schema.get("required", []):
        found = value
        for part in name.split("."):
            found = found.get(part) if isinstance(found, dict) else None
        if found is None:
            return f"{path + '.' if path else ''}{name} is required"
    if isinstance(value, dict) and isinstance(schema.get("properties"), dict):
        for key, child in value.items():
            if key in schema["properties"]:
                error = schema_error(child, schema["properties"][key], f"{path}.{key}" if path else key)
                if error:
                    return error
            elif schema.get("additionalProperties") is False and not (not path and key == "_id"):
                return f"{path + '.' if path else ''}{key} is not allowed"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", float("inf")):
            return f"{at} has a length out of bounds"
    if _KINDS["number"](value) and not schema.get("minimum", float("-inf")) <= value <= schema.get("maximum", float("inf")):
        return f"{at} is out of bounds"
    return None


def reference_error(record: dict, relationships: dict[str, dict]) -> str | None:
    """1:1 and M:1 fields hold a pointer into their target, M:M fields an array of such."""
    for field, rule in relationships.items():
        if field not in record or rule.get("type") not in ("1:1", "M:1", "M:M"):
            continue
        values = record[field]
        if rule["type"] == "M:M" and not isinstance(values, list):
            return f"{field} must be an array of pointers"
        for value in values if rule["type"] == "M:M" else [values]:
            found = parse_pointer(value) if isinstance(value, str) and value.startswith("@") else None
            if found is None:
                return f"{field} must hold pointers"
            try:
                check_target(field, rule, found[0])
            except InvalidInput as wrong:
                return str(wrong)
    return None


def scalar_key(doc: Column, path: str) -> Column:
    """(kind, text) of a scalar, null included; null for missing values, arrays and objects."""
    value = V.get(doc, path.split("."))
    kind = F.when(V.is_number(value), "n").when(V.kind(value) == "STRING", "s").when(V.kind(value) == "BOOLEAN", "b").when(V.kind(value) == "VOID", "0")
    text = F.when(kind == "n", V.as_type(value, "double").cast("string")).otherwise(V.as_type(value, "string"))
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(":"), F.coalesce(text, F.lit(""))))


def duplicate_keys(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n): values that more than one row has; null keys are free."""
    return rows.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def taken_keys(batch: DataFrame, old: DataFrame, key: Column) -> DataFrame:
    """(key, n): values of the batch's rows that another of its rows has, or a row of ``old`` that is not replaced.

    Only the batch's keys are grouped; of ``old`` the rows that have one of them are looked up.
    """
    mine = batch.select(key.alias("key")).where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("mine"))
    theirs = old.select("_id", key.alias("key")).where("key IS NOT NULL").join(mine, "key", "left_semi").join(batch.select("_id"), "_id", "left_anti")
    theirs = theirs.groupBy("key").agg(F.count("*").alias("theirs"))
    return mine.join(theirs, "key", "left").select("key", (F.col("mine") + F.coalesce("theirs", F.lit(0))).alias("n")).where("n > 1")


def document_errors(rows: DataFrame, schema: dict, relationships: dict[str, dict] | None = None, doc: str = "doc") -> DataFrame:
    """``rows`` (documents) that break the schema or a declared reference, with ``error``."""

    @F.pandas_udf("string")
    def first(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else schema_error(V.loads(t), schema) or reference_error(V.loads(t), relationships or {}))

    return rows.withColumn("error", first(V.text(F.col(doc)))).where("error IS NOT NULL")


def unique_violations(rows: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """(key, field): rows of a typed collection whose value another row has too."""
    again = duplicate_keys(rows, F.col(field)).select(F.col("key").alias("_dup"))
    return rows.join(again, rows[field] == F.col("_dup"), "left_semi").select(key, field)


def required_violations(rows: DataFrame, fields: list[str], key: str = "_id") -> DataFrame:
    """(key): rows that lack any of the fields."""
    missing = F.lit(False)
    for f in fields:
        missing = missing | F.col(f).isNull()
    return rows.where(missing).select(key)


def schema_violations(rows: DataFrame, schema: dict, key: str = "_id") -> DataFrame:
    """(key): rows of a typed collection that break the schema, as one built-in predicate."""
    bad = F.lit(False)
    for name in schema.get("required", []):
        bad = bad | F.col(name).isNull()
    names = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        for c in rows.columns:
            if c not in names and c != key:
                bad = bad | F.col(c).isNotNull()
    for name, rule in names.items():
        if name not in rows.columns:
            continue
        col, kind = F.col(name), rows.schema[name].dataType
        broken = F.lit(False)
        if "enum" in rule:
            broken = broken | ~col.isin(rule["enum"])
        if "type" in rule:
            allowed = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
            fits = isinstance(kind, T.StringType) and "string" in allowed or isinstance(kind, T.NumericType) and "number" in allowed
            fits = fits or isinstance(kind, T.IntegralType) and "integer" in allowed or isinstance(kind, T.BooleanType) and "boolean" in allowed
            fits = fits or isinstance(kind, T.ArrayType) and "array" in allowed or isinstance(kind, T.StructType) and "object" in allowed
            broken = broken | F.lit(not fits)
        if isinstance(kind, T.StringType):
            broken = broken | (F.length(col) < rule.get("minLength", 0))
            if "maxLength" in rule:
                broken = broken | (F.length(col) > rule["maxLength"])
        if isinstance(kind, T.NumericType):
            if "minimum" in rule:
                broken = broken | (col < rule["minimum"])
            if "maximum" in rule:
                broken = broken | (col > rule["maximum"])
        bad = bad | (col.isNotNull() & F.coalesce(broken, F.lit(False)))
    return rows.where(bad).select(key)
