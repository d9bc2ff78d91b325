"""Relationships: references become joins.

Typed collections are joined on declared fields, so the plan shows what it
reads; documents are resolved level by level, each level one equi-join on the
pointers that are still open.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.errors import InvalidInput
from larkspur.functions import pointers as P
from larkspur.functions import variants as V
from larkspur.operators.read import edit_documents

@dataclass(frozen=True)
class Relationship:
    """A declared rule: ``type`` is 1:1, M:1, M:M or 1:M.

    1:M fields are virtual: they hold the records of ``target`` whose
    ``mapped_by`` points at the parent.
    """

    field: str
    type: str
    target: str | None = None
    mapped_by: str | None = None
    inverse_tracking: bool = True


def hydrate(df: DataFrame, field: str, target: DataFrame, prefix: str | None = None, key: str = "_id", pointer_of: str | None = None) -> DataFrame:
    """``df`` with the record that ``field`` refers to, as columns ``<prefix><name>``.

    A left join on the target's unique key: a reference without a record keeps
    its text and has nulls.  ``field`` holds keys, or with ``pointer_of``
    pointers, of which those into another collection miss.
    """
    prefix = f"{field}_" if prefix is None else prefix
    right = target.select(*[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in target.columns])
    on = F.col(f"`{field}`") == F.col(f"`{prefix}{key}`")
    if pointer_of is not None:
        same = F.coalesce(P.pointer_collection(F.col(field)), F.lit(pointer_of)) == F.lit(pointer_of)
        on = F.when(same, P.pointer_key(F.col(field))) == F.col(f"`{prefix}{key}`")
    return df.join(right, on, "left")


def hydrate_polymorphic(df: DataFrame, field: str, targets: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """References into several collections: one join per collection, one column per name.

    ``columns`` maps an output name to the source column of each target, as
    ``{"name": {"supplier": "s_name", ...}}``.
    """
    out = df
    for collection, target in targets.items():
        wanted = [F.col("_id").alias(f"_{collection}_id")] + [F.col(by[collection]).alias(f"_{collection}_{name}") for name, by in columns.items() if collection in by]
        key = F.when(P.pointer_collection(F.col(field)) == F.lit(collection), P.pointer_key(F.col(field)))
        out = out.join(target.select(*wanted), key == F.col(f"_{collection}_id"), "left")
    values = [F.coalesce(*[F.col(f"_{c}_{name}") for c in targets if c in by]).alias(name) for name, by in columns.items()]
    return out.select(*df.columns, *values)


def hydrate_array(df: DataFrame, field: str, target: DataFrame, record: Column, key: str = "_id", row_key: str = "_id") -> DataFrame:
    """``field``, an array of pointers, with each replaced by (pos, pointer, record).

    Order is kept and references without a record keep their pointer.
    """
    each = df.select(row_key, F.posexplode_outer(field).alias("_pos", "_ptr"))
    right = target.select(F.col(key).alias("_key"), record.alias("_record"))
    met = each.join(right, P.pointer_key(F.col("_ptr")) == F.col("_key"), "left").where("_pos IS NOT NULL")
    lists = met.groupBy(row_key).agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("pos"), F.col("_ptr").alias("pointer"), F.col("_record").alias("record")))).alias("_list"))
    lists = lists.withColumnRenamed(row_key, "_row")
    out = df.join(lists, df[row_key] == F.col("_row"), "left")
    filled = F.when(F.col(field).isNotNull(), F.coalesce(F.col("_list"), F.array().cast(lists.schema["_list"].dataType)))
    return out.withColumn(field, filled).drop("_list", "_row")


def virtual_children(df: DataFrame, collection: str, children: DataFrame, mapped_by: str, field: str, record: Column, order: str = "_id", pointers: bool = True) -> DataFrame:
    """``df`` with the array of its children, empty where it has none."""
    parent = P.pointer_key(F.col(mapped_by)) if pointers else F.col(mapped_by)
    mine = children.where(P.pointer_collection(F.col(mapped_by)) == F.lit(collection)) if pointers else children
    lists = mine.select(parent.alias("_parent"), F.struct(F.col(order).alias("_o"), record.alias("_r")).alias("_s"))
    lists = lists.where("_parent IS NOT NULL").groupBy("_parent").agg(F.array_sort(F.collect_list("_s")).alias("_c"))
    lists = lists.select("_parent", F.col("_c._r").alias(field))
    out = df.join(lists, df["_id"].cast("string") == lists["_parent"].cast("string"), "left").drop("_parent")
    return out.withColumn(field, F.coalesce(F.col(field), F.array().cast(lists.schema[field].dataType)))


def child_summary(df: DataFrame, children: DataFrame, mapped_by: str, *aggregates: Column) -> DataFrame:
    """``df`` with aggregates over its children: grouped before the join, so nothing is collected."""
    sums = children.groupBy(F.col(mapped_by).alias("_parent")).agg(*aggregates)
    return df.join(sums, df["_id"] == F.col("_parent"), "left").drop("_parent")


def edges(children: DataFrame, child: str, field: str) -> DataFrame:
    """(parent, child, child_id, field): who refers to whom; arrays count by element."""
    value = F.col(field)
    rows = children.select("_id", F.explode(value).alias("_v")) if dict(children.dtypes)[field].startswith("array") else children.select("_id", value.alias("_v"))
    return rows.where("_v IS NOT NULL").select(F.col("_v").alias("parent"), F.lit(child).alias("child"), F.col("_id").alias("child_id"), F.lit(field).alias("field"))


def referring(children: DataFrame, field: str, parents: DataFrame, key: str = "_id") -> DataFrame:
    """Rows of ``children`` that refer to any of ``parents``: a semi-join."""
    return children.join(parents.select(F.col(key).alias("_parent")), F.col(field) == F.col("_parent"), "left_semi")


# Documents ----------------------------------------------------------------


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in the shared checkpoint folder; only a single process without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise InvalidInput("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint()


def pointers_in(value: object, excluded: frozenset[str] = frozenset(), path: str = "") -> Iterator[str]:
    """Pointers at any depth, but in fields excluded by name or by dotted path."""
    if isinstance(value, str):
        if value.startswith("@") and P.parse_pointer(value):
            yield value
    elif isinstance(value, list):
        for v in value:
            yield from pointers_in(v, excluded, path)
    elif isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            if k not in excluded and at not in excluded:
                yield from pointers_in(v, excluded, at)


def _pointer_column(doc: Column, excluded: frozenset[str]) -> Column:
    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({P.format_pointer(*P.parse_pointer(p)) for p in pointers_in(json.loads(t), excluded)}) if t else [])

    return found(F.to_json(doc))


def substitute(value: object, records: dict[str, dict], excluded: frozenset[str], with_ids: bool, depth: int | None, active: tuple[str, ...] = (), path: str = "") -> object:
    """``value`` with pointers replaced by records, unless they are on the way already."""
    if isinstance(value, str) and value.startswith("@"):
        parsed = P.parse_pointer(value)
        pointer = P.format_pointer(*parsed) if parsed else None
        if pointer in records and pointer not in active and (depth is None or len(active) <= depth):
            record = records[pointer]
            inner = substitute(record, records, excluded, with_ids, depth, (*active, pointer))
            return inner if with_ids else {k: v for k, v in inner.items() if k != "_id"}
        return value
    if isinstance(value, list):
        return [substitute(v, records, excluded, with_ids, depth, active, path) for v in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            at = f"{path}.{k}" if path else k
            out[k] = v if k in excluded or at in excluded else substitute(v, records, excluded, with_ids, depth, active, at)
        return out
    return value


def hydrate_documents(df: DataFrame, collection: str, every: Callable[[list[str]], DataFrame | None], exclude: list[str] | None = None, with_ids: bool = True, depth: int | None = None) -> DataFrame:
    """Documents (_id, _seq, doc) with their references resolved, all or to ``depth``.

    ``every`` gives (pointer, doc) of the named collections, None if none of
    them is there.  Each level joins the pointers that are open once with the
    collections they lead to, and reads no others; a record's tree is then put
    together where it is.
    References to missing records, and back to a record on the way, stay text.
    Levels are kept as they are reached, until one opens no new pointer.
    """
    if depth == 0:
        return df
    excluded = frozenset(exclude or ())
    frontier = df.select("_id", F.explode(_pointer_column(F.col("doc"), excluded)).alias("pointer")).distinct()
    found = None
    seen = frontier = checkpointed(frontier)
    level = 0
    while depth is None or level < depth:
        names = [r[0] for r in frontier.select(P.pointer_collection(F.col("pointer"))).distinct().collect()]  # collections
        targets = every(names) if names else None
        if targets is None:
            break
        got = frontier.join(targets, "pointer").select("_id", "pointer", F.col("doc"))
        got = checkpointed(got.select("_id", "pointer", V.text(F.col("doc")).alias("text"))).withColumn("doc", F.parse_json("text"))
        part = got.select("_id", F.struct("pointer", "text").alias("hit"))
        found = part if found is None else found.unionByName(part)
        level += 1
        if depth is None or level < depth:
            opened = got.select("_id", F.explode(_pointer_column(F.col("doc"), frozenset(e for e in excluded if "." not in e))).alias("pointer")).distinct()
            frontier = checkpointed(opened.join(seen, ["_id", "pointer"], "left_anti"))
            seen = seen.unionByName(frontier)
    if found is None:
        return df
    lists = found.groupBy(F.col("_id").alias("_row")).agg(F.to_json(F.map_from_entries(F.collect_set("hit"))).alias("_hits"))
    met = df.join(lists, df["_id"] == F.col("_row"), "left")

    def edit(value: dict, hits: str | None, own: str) -> dict:
        records = {k: V.loads(v) for k, v in json.loads(hits).items()} if hits else {}
        return substitute(value, records, excluded, with_ids, depth, (own,))

    met = met.withColumn("_own", F.concat(F.lit(f"@{collection}:"), F.col("_id")))
    return edit_documents(met, "doc", edit, "_hits", "_own").select(*df.columns)


def attach_virtual(df: DataFrame, collection: str, rule: Relationship, children: DataFrame, shown: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Documents with a 1:M field: the children whose ``mapped_by`` is the parent's pointer, in stored order.

    ``shown`` leaves out of the children what readers don't see, such as the back-link itself.
    """
    value = V.get(F.col("doc"), rule.mapped_by.split("."))
    parent = F.when(V.kind(value) == "STRING", V.as_type(value, "string"))
    key = F.when(P.pointer_collection(parent) == F.lit(collection), P.pointer_key(parent))
    mine = shown(children.withColumn("_row", key).where("_row IS NOT NULL"))
    lists = mine.select("_row", F.struct("_seq", V.text(F.col("doc")).alias("t")).alias("s"))
    lists = lists.groupBy("_row").agg(F.to_json(F.array_sort(F.collect_list("s")).getField("t")).alias("_kids"))
    met = df.join(lists, df["_id"] == F.col("_row"), "left")

    def edit(doc: dict, kids: str | None) -> dict:
        return {**doc, rule.field: [V.loads(k) for k in json.loads(kids)] if kids else []}

    return edit_documents(met, "doc", edit, "_kids").select(*df.columns)
