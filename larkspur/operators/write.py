"""Writes as DataFrames: what a collection looks like after them."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.errors import InvalidInput
from larkspur.functions import pointers as P


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last of a batch wins."""
    latest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth")


def replaced(old: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys, and added where there are none."""
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*old.columns))


def merged(old: DataFrame, where: Column, changes: dict[str, Column | Any]) -> DataFrame:
    """``old`` with fields set where the predicate holds; ``_id`` never changes."""
    hit = F.coalesce(where, F.lit(False))
    out = old
    for name, value in changes.items():
        if name != "_id":
            value = value if isinstance(value, Column) else F.lit(value)
            out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return out


def created_if_missing(old: DataFrame, where: Column, record: DataFrame) -> DataFrame:
    """``old``, and ``record`` too if nothing matches; decided in the plan, by an anti-join on a one-row count."""
    found = old.where(F.coalesce(where, F.lit(False))).agg((F.count("*") > 0).alias("_found"))
    return old.unionByName(record.join(F.broadcast(found), F.col("_found"), "left_anti").select(*old.columns))


def without(old: DataFrame, where: Column) -> DataFrame:
    """Survivors of a delete: rows for which the predicate is not true."""
    return old.where(~F.coalesce(where, F.lit(False)))


def without_keys(old: DataFrame, keys: DataFrame, key: str = "_id") -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def set_null(rows: DataFrame, field: str, gone: DataFrame, key: str = "_id") -> DataFrame:
    """``rows`` with ``field`` emptied where it refers to a row of ``gone``."""
    mark = gone.select(F.col(key).alias("_gone")).distinct()
    out = rows.join(mark, rows[field] == mark["_gone"], "left")
    return out.withColumn(field, F.when(F.col("_gone").isNull(), F.col(field))).drop("_gone")


# Records of one request -----------------------------------------------------


def record_id(record: dict, drawer: str) -> str:
    """A record's key: its ``_id`` without a pointer into its own collection, or a new one."""
    given = record.get("_id")
    if given is None:
        return uuid.uuid4().hex
    if not isinstance(given, str) or not given:
        raise InvalidInput("_id must be a text")
    return P.clean_key(given)


def target_of(record: dict, drawer: str | None) -> str:
    """The collection of a record: that of the filter, or of its own pointer or ``@collection`` id."""
    given = record.get("_id")
    own = None
    if isinstance(given, str):
        if given.startswith("@") and ":" not in given:
            own = given[1:]
            del record["_id"]
        else:
            found = P.parse_pointer(given)
            own = found[0] if found else None
    if drawer and own and drawer != own:
        raise InvalidInput(f"conflicting collections: {drawer} and {own}")
    if not (drawer or own):
        raise InvalidInput("the record names no collection")
    return drawer or own


def allowed_targets(rule: dict) -> list[str]:
    """The collections that a declared field may point into; none means any."""
    return [t for t in (rule.get("target_drawer"), *(rule.get("target_drawers") or ())) if t]


def check_target(field: str, rule: dict, collection: str | None) -> None:
    allowed = allowed_targets(rule)
    if allowed and not any(collection == t or (collection or "").endswith(f"_{t}") for t in allowed):
        raise InvalidInput(f"{field} must point into {' or '.join(allowed)}, not {collection}")


def decompose(record: dict, drawer: str, metas: dict[str, dict], namespace: str | None = None) -> list[tuple[str, dict]]:
    """A record and the records nested in it, children first, as (collection, record).

    A nested object with an ``_id`` becomes a pointer if its id is one or its
    field has a declared target, and a child record of its own if it has other
    fields too; without one it stays.  Children of 1:M fields get the field
    ``mapped_by`` that points back, and nothing is stored with the parent.
    Plain ids in a declared field become pointers into its target.  A pointer
    into another collection than the declared ``target_drawer`` or one of
    ``target_drawers`` is refused.
    """
    rules = metas.get(drawer, {}).get("relationships", {})
    record = dict(record)
    record["_id"] = record_id(record, drawer)
    own = P.format_pointer(drawer, record["_id"])
    children: list[tuple[str, dict]] = []

    def reference(value: dict, field: str, rule: dict, back: str | None) -> Any:
        target = rule.get("target_drawer")
        given = value.get("_id")
        found = P.parse_pointer(given) if isinstance(given, str) else None
        named = given[1:] if isinstance(given, str) and given.startswith("@") and ":" not in given else None
        collection = found[0] if found else named or target
        check_target(field, rule, collection)
        if given is None and not (back and target) or collection is None:
            return walk(value, field, top=False)
        child = dict(value)
        child.pop("_id", None)
        if not (given is None or named):
            child["_id"] = P.clean_key(given)
        if back:
            child[back] = own
        if set(child) - {"_id"}:
            inner = decompose(child, collection, metas, namespace)
            children.extend(inner)
            key = inner[-1][1]["_id"]
        else:
            key = child["_id"]
        return P.format_pointer(P.scoped(collection, namespace), key)

    def walk(value: Any, path: str, top: bool) -> Any:
        if isinstance(value, dict):
            out = {}
            for key, v in value.items():
                at = key if top else f"{path}.{key}"
                rule = rules.get(at, {})
                if rule.get("type") == "1:M":
                    for item in v if isinstance(v, list) else [v]:
                        if isinstance(item, dict):
                            reference(item, at, rule, rule.get("mapped_by"))
                    continue
                out[key] = step(v, at, rule)
            return out
        return value

    def step(value: Any, path: str, rule: dict) -> Any:
        if isinstance(value, dict):
            return reference(value, path, rule, None) if "_id" in value else walk(value, path, top=False)
        if isinstance(value, list):
            return [step(v, path, rule) for v in value]
        if isinstance(value, str):
            found = P.parse_pointer(value) if value.startswith("@") else None
            if found:
                check_target(path, rule, found[0])
                return P.format_pointer(P.scoped(found[0], namespace), found[1])
            if rule.get("target_drawer") and str(rule.get("type", "")).lower() != "polymorphic" and not value.startswith("@"):
                return P.normalize(rule["target_drawer"], value, namespace)
        return value

    body = walk({k: v for k, v in record.items() if k != "_id"}, "", top=True)
    return [*children, (drawer, {"_id": record["_id"], **body})]
