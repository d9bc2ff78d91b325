"""Deletes with rules: what else goes, what is refused, what is emptied.

References are an edge table (parent, child, child_id, field); the closure is
a loop over its frontier, each step one join per level whatever the number of
records, and only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import Restricted

NODE = "drawer string, _id string"


@dataclass(frozen=True)
class Rule:
    """``action`` is Cascade, Restrict or SetNull.

    An inverse rule watches the children in ``child`` whose ``field`` points at
    a deleted parent in ``parent``; a forward rule (Cascade) deletes what
    ``field`` of a deleted record in ``parent`` points at.
    """

    action: str
    parent: str
    child: str
    field: str
    forward: bool = False


def rules_of(metas: dict[str, dict]) -> list[Rule]:
    """Delete rules of collections' metadata; untracked relationships are passed over."""
    out = []
    for parent, meta in metas.items():
        for field, rule in meta["delete_rules"].items():
            related = meta["relationships"].get(field, {})
            if related.get("inverse_tracking") is False:
                continue
            if related.get("type") == "1:M" and related.get("target_drawer") and related.get("mapped_by"):
                out.append(Rule(rule["action"], parent, related["target_drawer"], related["mapped_by"]))
            elif rule["action"] == "Cascade":
                out.append(Rule("Cascade", parent, "", field, forward=True))
    return out


def held_back(edges: dict[Rule, DataFrame], there: DataFrame) -> DataFrame | None:
    """References (parent_drawer, parent_id, child, child_id) for which Restrict rules refuse records of ``there`` (parent_drawer, parent_id)."""
    out = None
    for rule, found in edges.items():
        if rule.action == "Restrict":
            part = found.join(there, ["parent_drawer", "parent_id"], "left_semi").select("parent_drawer", "parent_id", "child", "child_id")
            out = part if out is None else out.unionByName(part)
    return out


def closure(
    spark: SparkSession,
    start: DataFrame,
    rules: list[Rule],
    edges: Callable[[Rule], DataFrame],
    keep: Callable[[DataFrame], DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """(doomed, emptied): all records that go, and (drawer, _id, field, parent) to be emptied.

    ``edges`` gives a rule's references as (parent_drawer, parent_id, child,
    child_id), ``keep`` stores a step's result.  Restrict is checked on every
    record reached, before anything is changed; cycles end by themselves.
    """
    doomed = frontier = keep(start.select("drawer", "_id").distinct())
    found = {r: keep(edges(r)) for r in rules}
    emptied = None
    while True:
        here = frontier.select(F.col("drawer").alias("parent_drawer"), F.col("_id").alias("parent_id"))
        there = frontier.select(F.col("drawer").alias("child"), F.col("_id").alias("child_id"))
        refused = held_back(found, here)
        held = refused.limit(1).collect() if refused is not None else []
        if held:
            raise Restricted(f"@{held[0].parent_drawer}:{held[0].parent_id} is referred to by @{held[0].child}:{held[0].child_id}")
        steps = []
        for rule in rules:
            if rule.action == "Cascade" and rule.forward:
                steps.append(found[rule].join(there, ["child", "child_id"], "left_semi").select(F.col("parent_drawer").alias("drawer"), F.col("parent_id").alias("_id")))
            elif rule.action == "Cascade":
                steps.append(found[rule].join(here, ["parent_drawer", "parent_id"], "left_semi").select(F.col("child").alias("drawer"), F.col("child_id").alias("_id")))
            elif rule.action == "SetNull":
                hit = found[rule].join(here, ["parent_drawer", "parent_id"], "left_semi")
                hit = hit.select(F.col("child").alias("drawer"), F.col("child_id").alias("_id"), F.lit(rule.field).alias("field"), F.concat(F.lit("@"), "parent_drawer", F.lit(":"), "parent_id").alias("parent"))
                emptied = hit if emptied is None else emptied.unionByName(hit)
        if not steps:
            break
        reached = steps[0]
        for s in steps[1:]:
            reached = reached.unionByName(s)
        frontier = keep(reached.distinct().join(doomed, ["drawer", "_id"], "left_anti"))
        if frontier.isEmpty():
            break
        doomed = keep(doomed.unionByName(frontier))
    if emptied is None:
        emptied = spark.createDataFrame([], "drawer string, _id string, field string, parent string")
    return doomed, emptied.join(doomed, ["drawer", "_id"], "left_anti").distinct()


def emptied_value(value: object, gone: set[str]) -> object | None:
    """A field without pointers that are gone: None if nothing is left; objects stay as they are."""
    if isinstance(value, str):
        return None if value in gone else value
    if isinstance(value, list):
        left = [v for v in value if not (isinstance(v, str) and v in gone)]
        return left or None
    return value
