"""Reading documents in VARIANT columns with the kind of each value in view."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(parts: list[str]) -> str:
    """A path through objects; keys may hold any character."""
    return "$" + "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in parts)


def get(doc: Column, parts: list[str]) -> Column:
    """The variant at a path, null if it is missing; arrays are not traversed."""
    return F.variant_get(doc, json_path(parts), "variant") if parts else doc


def item(value: Column, i: int) -> Column:
    return F.variant_get(value, f"$[{i}]", "variant")


def kind(value: Column) -> Column:
    """null (missing), VOID, BOOLEAN, STRING, BIGINT, DECIMAL..., DOUBLE, ARRAY..., OBJECT..."""
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return F.substring(kind(value), 1, 3).isin("BIG", "DEC", "DOU", "FLO", "INT", "SMA", "TIN")


def is_integer(value: Column) -> Column:
    """Whole numbers as written: BIGINT, or beyond it an unsigned 64-bit number."""
    k = kind(value)
    wide = k.rlike(r"^DECIMAL\((19|20),0\)$") & (as_type(value, "decimal(20,0)") > F.lit(Decimal(2**63 - 1)))
    return (k == "BIGINT") | F.coalesce(wide, F.lit(False))


def as_type(value: Column, name: str) -> Column:
    return F.try_variant_get(value, "$", name)


# Texts that keep the kind of every number ---------------------------------------
#
# to_json writes the decimal 1.0 as 1, which reads back as a whole number.


def fractional(doc: Column) -> Column:
    """``doc`` where it may hold numbers that to_json would write as whole ones, else null."""
    return F.when(kind(doc).rlike("DECIMAL|VARIANT"), doc)


def loads(text: str, stored: Any = None) -> Any:
    """A JSON text as Python values, fractions as Decimal; ``stored`` is its :func:`fractional` variant, if any."""
    value = json.loads(text, parse_float=Decimal)
    return value if stored is None or isinstance(stored, float) else _kept(value, stored.toPython())


def _kept(value: Any, stored: Any) -> Any:
    if isinstance(value, dict):
        return {k: _kept(v, stored.get(k)) for k, v in value.items()} if isinstance(stored, dict) else value
    if isinstance(value, list):
        return [_kept(v, s) for v, s in zip(value, stored, strict=True)] if isinstance(stored, list) and len(stored) == len(value) else value
    whole = isinstance(value, int) and not isinstance(value, bool) and isinstance(stored, Decimal)
    return Decimal(f"{value}.0") if whole and stored.as_tuple().exponent < 0 else value


def dumps(value: Any) -> str:
    """The JSON text of a value that may hold Decimals."""
    try:
        return json.dumps(value)
    except TypeError:
        pass
    if isinstance(value, dict):
        return "{" + ", ".join(f"{json.dumps(str(k))}: {dumps(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(dumps, value)) + "]"
    if isinstance(value, Decimal):
        return str(value) if value.as_tuple().exponent else f"{value}.0"
    raise TypeError(f"no JSON for {type(value).__name__}")


def text(doc: Column) -> Column:
    """A document's JSON text; only those with fractions go through Python."""
    plain = F.to_json(doc)

    @F.pandas_udf("string")
    def exact(texts: pd.Series, stored: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else dumps(loads(t, s)) for t, s in zip(texts, stored, strict=True)], dtype=object)

    return F.coalesce(exact(plain, fractional(doc)), plain)
