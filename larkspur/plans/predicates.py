"""A query object as one Column: predicates, ANDed.

There are two tiers.  Typed fields are Parquet columns, so that plain
comparisons reach the scan; there a null counts as missing.  Documents are
VARIANT columns, where kinds are guarded and null differs from missing.  A
predicate on a missing path is false, whatever it says.
"""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions import pointers as P
from larkspur.functions import variants as V
from larkspur.plans.filters import validate


def _all(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: Iterable[Column]) -> Column:
    parts = list(parts)
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def wildcard(value: Column, pattern: str) -> Column:
    """``%`` stands for any text at any place; nothing else is special."""
    if "%" not in pattern:
        return value == F.lit(pattern)
    escaped = pattern.replace("^", "^^").replace("_", "^_")
    return F.like(value, F.lit(escaped), F.lit("^"))


def number(value: int | float) -> Column:
    """A literal; whole numbers beyond 64 bits are decimals."""
    if isinstance(value, int) and not -(2**63) <= value < 2**63:
        return F.lit(Decimal(value)) if abs(value) < 10**38 else F.lit(float(value))
    return F.lit(value)


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


class Typed:
    """A typed column and what may be asked of it."""

    def __init__(self, col: Column, kind: T.DataType, pointer: bool = False):
        self.col, self.type, self.pointer = col, kind, pointer

    @property
    def kind(self) -> str:
        if isinstance(self.type, T.BooleanType):
            return "bool"
        if isinstance(self.type, T.NumericType):
            return "number"
        if isinstance(self.type, T.StringType):
            return "string"
        if isinstance(self.type, T.ArrayType):
            return "array"
        if isinstance(self.type, (T.StructType, T.MapType)):
            return "object"
        return "other"  # dates, times, binary: kinds that documents don't have

    def present(self) -> Column:
        return self.col.isNotNull()

    def is_kind(self, name: str) -> Column:
        return self.present() if self.kind == name else F.lit(False)

    def scalar(self, name: str) -> Column:
        return self.col

    def exact_number(self, value: int | float) -> Column:
        return self.col == number(value)

    def child(self, name: str) -> Typed | None:
        if isinstance(self.type, T.StructType) and name in self.type.names:
            return Typed(self.col.getField(name), self.type[name].dataType)
        if isinstance(self.type, T.MapType) and isinstance(self.type.keyType, T.StringType):
            return Typed(self.col.getItem(name), self.type.valueType)
        return None

    def item(self, i: int) -> Typed:
        return Typed(F.get(self.col, F.lit(i)), self.type.elementType)

    def size(self) -> Column:
        return F.size(self.col)


class Document:
    """A value within a VARIANT document."""

    pointer = True

    def __init__(self, value: Column):
        self.value = value

    def present(self) -> Column:
        return V.kind(self.value).isNotNull()

    def is_kind(self, name: str) -> Column:
        if name == "number":
            return V.is_number(self.value)
        if name in ("array", "object"):
            return F.startswith(V.kind(self.value), F.lit(f"{name.upper()}<"))
        return V.kind(self.value) == {"null": "VOID", "bool": "BOOLEAN", "string": "STRING"}[name]

    def scalar(self, name: str) -> Column:
        return V.as_type(self.value, {"number": "double", "string": "string", "bool": "boolean"}[name])

    def exact_number(self, value: int | float) -> Column:
        if isinstance(value, int):
            return V.is_integer(self.value) & (V.as_type(self.value, "decimal(20,0)") == number(value))
        return ~V.is_integer(self.value) & (V.as_type(self.value, "double") == F.lit(value))

    def child(self, name: str) -> Document:
        return Document(V.get(self.value, [name]))

    def item(self, i: int) -> Document:
        return Document(V.item(self.value, i))

    def size(self) -> Column:
        return F.size(V.as_type(self.value, "array<variant>"))


class Compiler:
    """Turns query objects into predicates over one collection's DataFrame."""

    def __init__(self, df: DataFrame, collection: str = "", namespace: str | None = None, doc: str | None = None, pointers: Iterable[str] = (), targets: dict[str, str] | None = None):
        """``doc`` names the VARIANT column of a document collection.

        ``pointers`` are typed fields that hold pointers (their values equal
        bare keys in ``$in``); ``targets`` are declared target collections.
        """
        self.df, self.collection, self.namespace, self.doc = df, collection, namespace, doc
        self.pointers, self.targets = set(pointers), targets or {}

    def compile(self, query: dict) -> Column:
        """True or false for every row."""
        return F.coalesce(self.condition(query), F.lit(False))

    def condition(self, query: dict) -> Column:
        """The same with null for false here and there: what a filter needs, in a form that scans take."""
        validate(query)
        return _all(self._field(name, value) for name, value in query.items())

    def resolve(self, path: str) -> Typed | Document | None:
        """The value at a dotted path; None if the schema has no such path."""
        parts = path.split(".")
        if self.doc:
            if path == "_id" and "_id" in self.df.columns:
                return Typed(F.col("_id"), T.StringType())
            return Document(V.get(F.col(self.doc), parts))
        if parts[0] not in self.df.columns:
            return None
        at: Typed | None = Typed(F.col(f"`{parts[0]}`"), self.df.schema[parts[0]].dataType, path in self.pointers)
        for part in parts[1:]:
            at = at.child(part) if at else None
        return at

    def _field(self, path: str, expected: Any) -> Column:
        actual = self.resolve(path)
        if actual is None:
            return F.lit(False)
        found = self._matches(path, actual, expected)
        # Kinds are told apart by looking at the value, which tells that it is there too.
        guarded = isinstance(actual, Document) and not (isinstance(expected, dict) and expected.keys() & {"$ne", "$in"} or expected == {})
        return found if guarded else actual.present() & found

    def _target(self, path: str) -> str:
        if path == "_id":
            return self.collection
        return self.targets.get(path) or P.inferred_collection(path.rpartition(".")[2])

    def _matches(self, path: str, actual: Typed | Document, expected: Any) -> Column:
        kind = _kind(expected)
        if kind == "string":
            return actual.is_kind("string") & wildcard(actual.scalar("string"), expected) if self._can(actual, "string") else F.lit(False)
        if kind == "null":
            return actual.is_kind("null") if isinstance(actual, Document) else F.lit(False)
        if kind == "bool":
            return actual.is_kind("bool") & (actual.scalar("bool") == F.lit(expected)) if self._can(actual, "bool") else F.lit(False)
        if kind == "number":
            return actual.is_kind("number") & actual.exact_number(expected) if self._can(actual, "number") else F.lit(False)
        if kind == "array":
            if not self._can(actual, "array"):
                return F.lit(False)
            items = [self._nested(path, actual.item(i), v) for i, v in enumerate(expected)]
            return actual.is_kind("array") & (actual.size() == len(expected)) & _all(items)
        if any(k.startswith("$") for k in expected):
            return _all(self._operator(path, actual, op, v) for op, v in expected.items())
        if len(expected) == 1 and isinstance(expected.get("_id"), str):
            wanted = P.normalize(self._target(path), expected["_id"], self.namespace)
            return actual.is_kind("string") & (actual.scalar("string") == F.lit(wanted)) if self._can(actual, "string") else F.lit(False)
        if not self._can(actual, "object"):
            return F.lit(False)
        children = [(actual.child(k), v) for k, v in expected.items()]
        if any(c is None for c, _ in children):
            return F.lit(False)
        return actual.is_kind("object") & _all(self._nested(f"{path}.{k}", c, v) for (c, v), k in zip(children, expected, strict=True))

    def _nested(self, path: str, actual: Typed | Document, expected: Any) -> Column:
        return F.coalesce(actual.present() & self._matches(path, actual, expected), F.lit(False))

    @staticmethod
    def _can(actual: Typed | Document, kind: str) -> bool:
        return isinstance(actual, Document) or actual.kind == kind

    def _compare(self, actual: Typed | Document, op: str, expected: Any) -> Column:
        """Scalars of one kind by order; different kinds don't compare."""
        kind = _kind(expected)
        if kind == "null":
            return actual.is_kind("null") if op in ("$eq", "$gte", "$lte") and isinstance(actual, Document) else F.lit(False)
        if kind in ("array", "object") or not self._can(actual, kind):
            return F.lit(False)
        value = actual.scalar(kind)
        wanted = F.lit(float(expected)) if kind == "number" and isinstance(actual, Document) else number(expected) if kind == "number" else F.lit(expected)
        by = {"$eq": value == wanted, "$gt": value > wanted, "$gte": value >= wanted, "$lt": value < wanted, "$lte": value <= wanted}
        return actual.is_kind(kind) & by[op]

    def _operator(self, path: str, actual: Typed | Document, op: str, expected: Any) -> Column:
        if op == "$in":
            return self._in(path, actual, expected)
        if op == "$ne":
            if isinstance(actual, Typed) and _kind(expected) == actual.kind and actual.kind in ("number", "string", "bool"):
                return actual.col != (number(expected) if actual.kind == "number" else F.lit(expected))
            return ~F.coalesce(self._compare(actual, "$eq", expected), F.lit(False))
        if not op.startswith("$"):
            return F.lit(False)
        return self._compare(actual, op, expected)

    def _in(self, path: str, actual: Typed | Document, candidates: list) -> Column:
        plain = [c for c in candidates if self._plain(actual, c)]
        parts = [actual.col.isin(plain)] if plain else []
        for c in candidates:
            if self._plain(actual, c):
                continue
            if isinstance(c, str) and self._can(actual, "string"):
                value, target = actual.scalar("string"), self._target(path)
                found = P.parse_pointer(c)
                same = [wildcard(value, c), P.pointer_key(value) == F.lit(found[1] if found else c)]
                same.append(P.normalized(value, target, self.namespace) == F.lit(P.normalize(target, c, self.namespace)))
                parts.append(actual.is_kind("string") & _any(same))
            elif isinstance(c, dict) and not (len(c) == 1 and isinstance(c.get("_id"), str)):
                parts.append(self._same(actual, c))
            elif isinstance(c, list):
                parts.append(self._same(actual, c))
            elif isinstance(c, dict):
                parts.append(self._matches(path, actual, c))
            else:
                parts.append(self._compare(actual, "$eq", c))
        return parts[0] if plain and len(parts) == 1 else _any(F.coalesce(p, F.lit(False)) for p in parts)

    def _plain(self, actual: Typed | Document, c: Any) -> bool:
        """Candidates that can go to the scan as IN."""
        if not isinstance(actual, Typed) or _kind(c) != actual.kind:
            return False
        return not isinstance(c, str) or not (actual.pointer or set(c) & set("%@/") or c.startswith("lnk_"))

    def _same(self, actual: Typed | Document, expected: Any) -> Column:
        """Deep equality: no wildcards, no further keys."""
        kind = _kind(expected)
        if kind == "string":
            return actual.is_kind("string") & (actual.scalar("string") == F.lit(expected)) if self._can(actual, "string") else F.lit(False)
        if kind == "array":
            if not self._can(actual, "array"):
                return F.lit(False)
            items = [F.coalesce(self._same(actual.item(i), v), F.lit(False)) for i, v in enumerate(expected)]
            return actual.is_kind("array") & (actual.size() == len(expected)) & _all(items)
        if kind == "object":
            if not self._can(actual, "object"):
                return F.lit(False)
            children = [(actual.child(k), v) for k, v in expected.items()]
            if any(c is None for c, _ in children):
                return F.lit(False)
            keys = F.lit(True)
            if isinstance(actual, Document):
                keys = F.size(F.map_keys(V.as_type(actual.value, "map<string,variant>"))) == len(expected)
            elif isinstance(actual.type, T.StructType) and len(actual.type) != len(expected):
                keys = F.size(F.array_compact(F.array(*[F.when(actual.col.getField(n).isNotNull(), F.lit(1)) for n in actual.type.names]))) == len(expected)
            return actual.is_kind("object") & keys & _all(F.coalesce(self._same(c, v), F.lit(False)) for c, v in children)
        return self._matches("", actual, expected)


def where(df: DataFrame, query: dict, **options: Any) -> DataFrame:
    """Rows of ``df`` that match ``query``; empty ranges fold to an empty plan."""
    if _empty_range(query):
        return df.where(F.lit(False))
    return df.where(Compiler(df, **options).condition(query))


def _empty_range(query: dict) -> bool:
    """A lower bound above the upper one of the same field."""
    for value in query.values():
        if isinstance(value, dict):
            low = max((v for k, v in value.items() if k in ("$gt", "$gte") and _kind(v) == "number"), default=None)
            high = min((v for k, v in value.items() if k in ("$lt", "$lte") and _kind(v) == "number"), default=None)
            if low is not None and high is not None and low > high:
                return True
    return False
