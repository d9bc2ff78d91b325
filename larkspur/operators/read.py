"""Ordering, pages, cursors, projection and result shapes.

All of it stays one lazy DataFrame; only a cursor's own row, the kind that
orders mixed documents, and page metadata need an action, of one row each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.errors import InvalidInput
from larkspur.functions import variants as V
from larkspur.functions.pointers import pointer_to
from larkspur.plans.options import Options


@dataclass
class Page:
    """One page: its rows and, as the reference of the next, a cursor."""

    rows: DataFrame
    page_size: int
    page: int | None
    has_more: bool
    next_cursor: str | None


def _order_value(df: DataFrame, path: str, doc: str | None) -> Column:
    """What rows are ordered by; null where it is missing or of another kind.

    Documents are ordered by the kind of the first value that can be ordered,
    first by ``_seq``: bool, number or string.
    """
    if doc is None or path == "_id":
        parts = path.split(".")
        if parts[0] not in df.columns:
            return F.lit(None).cast("string")
        kind: T.DataType = df.schema[parts[0]].dataType
        for part in parts[1:]:
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return F.lit(None).cast("string")
            kind = kind[part].dataType
        return F.col(path) if isinstance(kind, T.AtomicType) else F.lit(None).cast("string")
    value = V.get(F.col(doc), path.split("."))
    kind = F.when(V.is_number(value), "double").when(V.kind(value) == "STRING", "string").when(V.kind(value) == "BOOLEAN", "boolean")
    place = F.col("_seq") if "_seq" in df.columns else F.col("_id")
    first = df.select(kind.alias("k"), place.alias("p")).where("k IS NOT NULL").agg(F.min_by("k", "p")).first()[0]
    return F.when(kind == first, V.as_type(value, first)) if first else F.lit(None).cast("string")


def ordered(df: DataFrame, order_by: str, direction: str | None = None, doc: str | None = None) -> DataFrame:
    """Missing values last in either direction; ties by ``_id`` in the same direction."""
    down = direction == "desc"
    keys = [_order_value(df, order_by, doc)]
    out = keys[0].desc_nulls_last() if down else keys[0].asc_nulls_last()
    ties = [c for c in ("_id", "_seq") if c in df.columns and c != order_by]
    return df.orderBy(out, *[F.col(c).desc_nulls_last() if down and c == "_id" else F.col(c).asc_nulls_last() for c in ties])


def modified(df: DataFrame, options: Options, doc: str | None = None) -> DataFrame:
    """``order_by``, then ``offset``, then ``limit``; with paging, the page's rows."""
    if options.pages:
        return page(df, options, doc).rows
    if options.order_by:
        df = ordered(df, options.order_by, options.order_direction, doc)
    elif "_seq" in df.columns and (options.limit is not None or options.offset is not None):
        df = df.orderBy("_seq")
    if options.offset:
        df = df.offset(options.offset)
    return df if options.limit is None else df.limit(options.limit)


def page(df: DataFrame, options: Options, doc: str | None = None) -> Page:
    """A page by number or after a cursor; one row more than it tells whether there are more."""
    size = options.check_pages()
    down = options.order_direction == "desc"
    if options.cursor is not None:
        df = _after(df, options, doc)
    sorted_rows = ordered(df, options.order_by, options.order_direction, doc)
    if options.cursor is None and options.page and options.page > 1:
        sorted_rows = sorted_rows.offset((options.page - 1) * size)
    seen = [r[0] for r in sorted_rows.limit(size + 1).select("_id").collect()]  # a page of ids
    cursor = None
    if len(seen) > size and seen[size - 1] is not None:
        cursor = json.dumps({"order_by": options.order_by, "order_direction": "desc" if down else "asc", "id": seen[size - 1]})
    number = None if options.cursor is not None else options.page or 1
    return Page(sorted_rows.limit(size), size, number, len(seen) > size, cursor)


def _after(df: DataFrame, options: Options, doc: str | None) -> DataFrame:
    """Rows that come after the cursor's, by a predicate on (value, _id)."""
    try:
        cursor = json.loads(options.cursor)
        order_by, direction, key = cursor["order_by"], cursor["order_direction"], cursor["id"]
    except (ValueError, KeyError, TypeError) as bad:
        raise InvalidInput("malformed cursor") from bad
    down = options.order_direction == "desc"
    if (order_by, direction) != (options.order_by, "desc" if down else "asc"):
        raise InvalidInput("the cursor belongs to another order")
    value = _order_value(df, order_by, doc)
    found = df.where(F.col("_id") == F.lit(key)).select(value.alias("v")).limit(1).collect()
    if not found:
        raise InvalidInput("the cursor's record is no longer in the result")
    at, later_id = found[0][0], F.col("_id") < F.lit(key) if down else F.col("_id") > F.lit(key)
    if at is None:
        return df.where(value.isNull() & later_id)
    beyond = value < F.lit(at) if down else value > F.lit(at)
    return df.where(value.isNull() | beyond | ((value == F.lit(at)) & later_id))


def count(df: DataFrame, options: Options, doc: str | None = None) -> int:
    """Number of rows, or of the selected page."""
    if options.pages:
        return page(df, options, doc).rows.count()
    n = df.count()
    n = max(0, n - (options.offset or 0))
    return n if options.limit is None else min(n, options.limit)


# Projection -------------------------------------------------------------------


def _split(projection: list[str]) -> tuple[bool, list[str]]:
    """(exclusive, paths): one entry with - or ! makes the whole list exclusive."""
    out = [p[1:].strip() for p in projection if p[:1] in ("-", "!")]
    return (True, out) if out else (False, list(projection))


def projected(df: DataFrame, projection: list[str] | None, doc: str | None = None) -> DataFrame:
    """Dotted paths to keep (``_id`` stays) or, with - or !, to leave out; arrays by element."""
    if not projection:
        return df
    if doc is not None:
        return _projected_documents(df, projection, doc)
    exclusive, paths = _split(projection)
    kept = [(c, _prune(F.col(f"`{c}`"), df.schema[c].dataType, c, exclusive, paths)) for c in df.columns]
    return df.select(*[col.alias(name) for name, col in kept if col is not None])


def _prune(col: Column, kind: T.DataType, path: str, exclusive: bool, paths: list[str]) -> Column | None:
    """The column without what projection leaves out; None if nothing is left."""
    inner = any(p.startswith(path + ".") for p in paths)
    if exclusive:
        if path in paths:
            return None
        if not inner:
            return col
    else:
        if path == "_id" or path in paths or any(path.startswith(p + ".") for p in paths):
            return col
        if not inner:
            return None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(col, lambda x: _prune_struct(x, kind.elementType, path, exclusive, paths))
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), _prune_struct(col, kind, path, exclusive, paths))
    return col


def _prune_struct(col: Column, kind: T.StructType, path: str, exclusive: bool, paths: list[str]) -> Column:
    parts = [(f.name, _prune(col.getField(f.name), f.dataType, f"{path}.{f.name}", exclusive, paths)) for f in kind.fields]
    left = [c.alias(n) for n, c in parts if c is not None]
    return F.struct(*left) if left else F.struct(F.lit(None).cast("string").alias("_"))


def prune_value(value: Any, exclusive: bool, paths: list[str], prefix: str = "") -> Any:
    """The same on a decoded JSON value."""
    if isinstance(value, list):
        return [prune_value(v, exclusive, paths, prefix) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, child in value.items():
        path = f"{prefix}.{key}" if prefix else key
        inner = any(p.startswith(path + ".") for p in paths)
        if exclusive:
            if path not in paths:
                out[key] = prune_value(child, exclusive, paths, path) if inner else child
        elif path == "_id" or path in paths or any(path.startswith(p + ".") for p in paths):
            out[key] = child
        elif inner:
            out[key] = prune_value(child, exclusive, paths, path)
    return out


def edit_documents(df: DataFrame, doc: str, edit, *more: str) -> DataFrame:
    """``df`` with each document replaced by ``edit(value, *others)``, Arrow batch by batch.

    VARIANT has no functions that remove or replace a nested field.  Numbers
    keep their kind: fractions come and go as Decimal.
    """

    @F.pandas_udf("string")
    def edited(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if row[0] is None else V.dumps(edit(V.loads(*row[:2]), *row[2:])) for row in zip(*batch, strict=True)], dtype=object)

    text = edited(F.to_json(F.col(doc)), V.fractional(F.col(doc)), *[F.col(c) for c in more] or [F.lit("")])
    return df.withColumn(doc, F.parse_json(text))


def document_fields(df: DataFrame, doc: str, names: list[str], exclusive: bool) -> DataFrame:
    """Documents with only the fields ``names``, or without them, all in built-in functions."""
    if exclusive:
        every = F.try_variant_get(F.col(doc), "$", "map<string,variant>")
        kept = F.map_filter(every, lambda k, v: ~k.isin(names))
    else:
        entries = [x for n in dict.fromkeys(names) for x in (F.lit(n), V.get(F.col(doc), [n]))]
        kept = F.map_filter(F.create_map(*entries), lambda k, v: v.isNotNull())
    return df.withColumn(doc, F.to_variant_object(kept))


def _projected_documents(df: DataFrame, projection: list[str], doc: str) -> DataFrame:
    exclusive, paths = _split(projection)
    if not any("." in p for p in paths):
        return document_fields(df, doc, paths if exclusive else ["_id", *paths], exclusive)
    return edit_documents(df, doc, lambda value, _: prune_value(value, exclusive, paths))


# Result shapes ----------------------------------------------------------------


def pointers(df: DataFrame, collection: str) -> DataFrame:
    """Pointers of rows; those without an id are left out."""
    return df.where(F.col("_id").isNotNull()).select(pointer_to(collection, F.col("_id")).alias("pointer"))


def exists(df: DataFrame) -> bool:
    return not df.limit(1).isEmpty()


#: Up to so many keys go to the scan as a list.
LISTED_KEYS = 1000


def typed_keys(kind: T.DataType, texts: list[str]) -> list | None:
    """The keys whose text is one of ``texts``; None for kinds whose text does not tell."""
    if isinstance(kind, T.StringType):
        return texts
    if isinstance(kind, T.IntegralType):
        bits = {"byte": 8, "short": 16, "integer": 32}.get(kind.typeName(), 64)
        found = [int(t) for t in texts if re.fullmatch(r"0|-?[1-9]\d{0,18}", t)]
        return [k for k in found if -(1 << bits - 1) <= k < 1 << bits - 1]
    return None


def by_key_of(df: DataFrame, expected: Any, key: str | None) -> DataFrame:
    """``df`` cut down to rows whose ``key`` can have the ``_id`` that a query asks for, in a form that scans take.

    The condition on ``_id`` itself, a text of the key, would read every row.
    """
    texts = [expected] if isinstance(expected, str) else None
    if isinstance(expected, dict):
        texts = [expected["$eq"]] if isinstance(expected.get("$eq"), str) else expected.get("$in") if isinstance(expected.get("$in"), list) else None
    plain = key and texts and len(texts) <= LISTED_KEYS and all(isinstance(t, str) and not set(t) & set("%@/:") and not t.startswith("lnk_") for t in texts)
    found = typed_keys(df.schema[key].dataType, texts) if plain else None
    return df if found is None else df.where(F.col(f"`{key}`").isin(found) if len(found) > 1 else F.col(f"`{key}`") == F.lit(found[0]) if found else F.lit(False))


def by_pointers(df: DataFrame, keys: list[str], key: str | None = None) -> DataFrame:
    """Rows of ``keys`` in their order; keys without a row are left out, repeated ones repeat.

    The request's own keys are the small side.  ``key`` names the typed column
    whose text is ``_id``, so that the scan can skip what is not asked for.
    """
    if key:
        df = by_key_of(df, {"$in": keys}, key)
    wanted = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], "_pos long, _want string")
    side = F.broadcast(wanted) if len(keys) <= 100_000 else wanted
    return df.join(side, df["_id"] == F.col("_want")).orderBy("_pos").drop("_pos", "_want")


def secondary_lookup(df: DataFrame, field: str, key: str, doc: str | None = None) -> DataFrame:
    """Rows whose field equals a key; one that reads as a whole number matches numbers too.

    With ``doc`` the field is a dotted path in documents of that column.
    """
    if doc is not None:
        value = V.get(F.col(doc), field.split("."))
        same = (V.kind(value) == "STRING") & (V.as_type(value, "string") == F.lit(key))
        if re.fullmatch(r"-?\d{1,18}", key):
            same = same | (V.is_integer(value) & (V.as_type(value, "long") == F.lit(int(key))))
        return df.where(F.coalesce(same, F.lit(False)))
    kind = df.schema[field].dataType
    if isinstance(kind, T.NumericType):
        try:
            return df.where(F.col(field) == F.lit(int(key)))
        except ValueError:
            return df.where(F.lit(False))
    return df.where(F.col(field) == F.lit(key))
