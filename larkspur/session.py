"""The engine: one object with the verbs of the interface.

``Engine.attach`` makes any DataFrame a read-only typed collection; with a root
folder there are also stored document collections, under database/schema.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.config import Config
from larkspur.errors import ConstraintViolation, InvalidInput, NotFound
from larkspur.functions import pointers as P
from larkspur.functions import variants as V
from larkspur.operators import constraints, delete, read, relate, write
from larkspur.plans.filters import Filter, Selection
from larkspur.plans.options import Options
from larkspur.plans.predicates import where
from larkspur.sources.store import Store, new_entry, new_meta

KINDS = ("index", "key", "constraint", "trigger", "relationship", "cascade-delete", "timestamp")


class Upserted:
    """What a request stored: pointers in its order.

    Those of a query's changes, which may be very many, are a frame (pointer,
    place), held by the store until its next collection of garbage; asking for
    ``pointers`` brings them to the driver.
    """

    def __init__(self, pointers: list[str] | None = None, created: bool = True, frame: DataFrame | None = None):
        self._pointers, self.created, self.frame = pointers, created, frame

    @property
    def pointers(self) -> list[str]:
        if self._pointers is None:
            self._pointers = [r[0] for r in self.frame.orderBy("place").select("pointer").collect()]
        return self._pointers


class Engine:
    """Entry point: ``Engine(spark)`` for typed reads, ``Engine(spark, root)`` to store documents, with settings as in ``Config``."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: Any = None):
        self.spark, self.config = spark, Config.of(config)
        root = root or self.config.root
        self.store = Store(spark, root, self.config) if root else None
        self._typed: dict[str, tuple[DataFrame, dict]] = {}
        self._keys: dict[str, str] = {}

    # Typed collections

    def attach(self, name: str, df: DataFrame, key: str | None = None, pointers: tuple[str, ...] = (), targets: dict[str, str] | None = None) -> Engine:
        """``df`` as collection ``name``; its ``_id`` is the text of ``key``."""
        if key is not None:
            df = df.withColumn("_id", F.col(key).cast("string"))
            self._keys[name] = key
        self._typed[name] = (df, {"pointers": pointers, "targets": targets or {}})
        return self

    def frame(self, name: str) -> DataFrame:
        if name not in self._typed:
            raise NotFound(f"no collection {name}")
        return self._typed[name][0]

    def read(self, selection: Any, options: Any = None, **more: Any) -> Any:
        """Records of a typed collection: a DataFrame, a Page, or a bool for ``exists``."""
        chosen, opts = Selection.of(selection), Options.of(options, **more)
        name = chosen.target()
        df = self._selected(chosen, name)
        shape = opts.shape(chosen)
        if shape == "exists":
            return read.exists(df)
        if opts.pages and shape == "records":
            page = read.page(df, opts)
            page.rows = read.projected(page.rows, opts.projection)
            return page
        df = read.modified(df, opts)
        if shape == "pointers":
            return read.pointers(df, name)
        if shape == "record":
            df = df.limit(1)
        return read.projected(df, opts.projection)

    def count(self, selection: Any, options: Any = None, **more: Any) -> int:
        chosen = Selection.of(selection)
        return read.count(self._selected(chosen, chosen.target()), Options.of(options, **more))

    def _selected(self, chosen: Selection, name: str) -> DataFrame:
        df = self.frame(name)
        key = self._keys.get(name)
        if chosen.pointers:
            df = read.by_pointers(df, [P.parse_pointer(p)[1] for p in chosen.pointers], key)
        if chosen.query:
            df = read.by_key_of(df, chosen.query.get("_id"), key)
            df = where(df, chosen.query, collection=name, **self._typed[name][1])
        return df

    # Stored collections

    def scope(self, path: str, tenant: str | None = None, namespace: str | None = None) -> Scope:
        """The collections of ``database/schema``, perhaps a tenant's, perhaps by a name prefix."""
        database, _, schema = path.rpartition("/")
        if tenant is not None:
            database = self.store.tenant_database(tenant, database)
        return Scope(self, database, schema, namespace)

    def create(self, database: str, schema: str | None = None, drawer: str | None = None) -> dict:
        return self.store.create(database, schema, drawer)

    def drop(self, database: str, schema: str | None = None, drawer: str | None = None) -> dict:
        return self.store.drop(database, schema, drawer)

    def status(self, what: str | None = None, *at: str) -> Any:
        """All of it, or one part; ``attached`` counts the typed collections held by this engine."""
        if what == "attached":
            return len(self._typed)
        return self.store.status() if what is None else self.store.show(what, *at)

    def compact(self, path: str) -> dict:
        """Compact all collections of ``database[/schema[/collection]]``."""
        database, _, _ = self.store.locate(path)
        done = [self.scope(f"{database}/{s}").compact(d) for s, d, _ in self.store.entries(path)]
        return {"collections": len(done), "bytes_before": sum(d["bytes_before"] for d in done[:1]), "bytes_after": sum(d["bytes_after"] for d in done[-1:])}

    def structure(self, database: str | None = None, schema: str | None = None) -> DataFrame:
        return self.store.structure(database, schema)

    def backup(self, destination: str, database: str, schema: str | None = None, drawer: str | None = None) -> dict:
        return self.store.backup(destination, database, schema, drawer)

    def restore(self, source: str, scope: str | None = None) -> dict:
        return self.store.restore(source, scope)

    def grant(self, username: str, permission_scope: str) -> dict:
        return self.store.access("grant_permission", {"username": username, "permission_scope": permission_scope})

    def revoke(self, username: str, permission_scope: str) -> dict:
        return self.store.access("revoke_permission", {"username": username, "permission_scope": permission_scope})


class Scope:
    """Stored document collections of one schema."""

    def __init__(self, engine: Engine, database: str, schema: str, namespace: str | None = None):
        self.engine, self.store, self.spark = engine, engine.store, engine.spark
        self.database, self.schema, self.namespace = database, schema, namespace

    def _state(self) -> tuple[dict, dict]:
        m = self.store.manifest()
        return m, self.store._drawers(m, self.database, self.schema)

    def _name(self, drawer: str) -> str:
        return P.scoped(drawer, self.namespace)

    @contextmanager
    def _work(self) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Keeps frames, written to a folder of this request alone, until it is over: later steps see fixed rows."""
        folder = f"{self.store.root}/_work/{uuid.uuid4().hex}"

        def keep(df: DataFrame) -> DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        try:
            yield keep
        finally:
            self.store.files.delete(folder)

    # Reads

    def documents(self, drawer: str) -> DataFrame:
        """(_id, _seq, doc) of a collection, empty where it has no records."""
        drawers = self._state()[1]
        return self.store.read(drawers.get(self._name(drawer)))

    def read(self, selection: Any, options: Any = None, **more: Any) -> Any:
        """Documents as a DataFrame (_id, _seq, doc), a Page, pointers, or a bool.

        Queries are ordered and paged before references are resolved; reading a
        whole collection resolves them first, so that it can be ordered by them.
        Reads by pointer leave ids out of the documents.
        """
        chosen, opts = Selection.of(selection), Options.of(options, **more)
        drawers = self._state()[1]
        names = [self._name(P.parse_pointer(p)[0]) for p in chosen.pointers]
        name = self._name(chosen.drawer) if chosen.drawer else None
        if chosen.pointers and chosen.query is None and len(set(names)) > 1:
            return self._many(chosen, opts, drawers)
        name = name or self._name(chosen.target())
        if drawers and name not in drawers:
            raise NotFound(f"no collection {name}")
        df = self._selected(chosen, name, drawers)
        shape = opts.shape(chosen)
        if shape == "exists":
            return read.exists(df)
        if shape == "pointers":
            return read.pointers(read.modified(df, opts, "doc"), name)
        bare = chosen.query is None and not chosen.pointers
        by_pointer = bool(chosen.pointers)
        page = None
        if bare:
            df = self._resolved(df, name, drawers, opts, True)
        if opts.pages:
            page = read.page(df, opts, "doc")
            df = page.rows
        else:
            df = read.modified(df, opts, "doc")
        if not bare:
            df = self._resolved(df, name, drawers, opts, not by_pointer)
        df = self._visible(df, drawers.get(name), keep_id=not by_pointer)
        df = read.projected(df, opts.projection, "doc")
        if shape == "record":
            df = df.limit(1)
        if page is not None:
            page.rows = df
            return page
        return df

    def _many(self, chosen: Selection, opts: Options, drawers: dict) -> DataFrame:
        """Pointers into several collections: each read, in the order of the request."""
        out = None
        for i, p in enumerate(chosen.pointers):
            part = self.read(Filter.pointer(p), opts).withColumn("_pos", F.lit(i))
            out = part if out is None else out.unionByName(part)
        return out.orderBy("_pos").drop("_pos")

    def _selected(self, chosen: Selection, name: str, drawers: dict) -> DataFrame:
        df = self.store.read(drawers.get(name))
        if chosen.pointers:
            df = read.by_pointers(df, [P.parse_pointer(p)[1] for p in chosen.pointers])
        if chosen.query:
            rules = drawers.get(name, {"meta": new_meta()})["meta"]["relationships"]
            targets = {f: r["target_drawer"] for f, r in rules.items() if r.get("target_drawer")}
            df = where(df, chosen.query, collection=name, namespace=self.namespace, doc="doc", targets=targets)
        return df

    def _resolved(self, df: DataFrame, name: str, drawers: dict, opts: Options, with_ids: bool) -> DataFrame:
        if opts.hydrate is False:
            return df
        excluded = opts.exclude_hydration or []

        def every(names: list[str]) -> DataFrame | None:
            out = None
            for drawer in names:
                entry = drawers.get(drawer)
                if entry and entry["path"]:
                    part = self.store.read(entry).select(F.concat(F.lit(f"@{drawer}:"), F.col("_id")).alias("pointer"), "doc")
                    out = part if out is None else out.unionByName(part)
            return out

        meta = drawers.get(name, {"meta": new_meta()})["meta"]
        for f, rule in meta["relationships"].items():
            if rule.get("type") == "1:M" and rule.get("mapped_by") and f not in excluded:
                child = drawers.get(rule["target_drawer"])
                related = relate.Relationship(f, "1:M", rule["target_drawer"], rule["mapped_by"])
                df = relate.attach_virtual(df, name, related, self.store.read(child), lambda rows, child=child: self._visible(rows, child))
        return relate.hydrate_documents(df, name, every, excluded, with_ids, opts.depth)

    def _visible(self, df: DataFrame, entry: dict | None, keep_id: bool = True) -> DataFrame:
        """Without back-links that only the store knows of, and for pointer reads without the id."""
        meta = entry["meta"] if entry else new_meta()
        shown = meta["schema"].get("properties", {})
        hidden = {h for h in meta["hidden"] if h not in shown} | (set() if keep_id else {"_id"})
        if not hidden:
            return df
        if hidden == {"_id"}:
            return read.document_fields(df, "doc", ["_id"], True)

        def strip(value: Any, _: Any = None, top: bool = True) -> Any:
            if isinstance(value, dict):
                drop = hidden if top else hidden - {"_id"}
                return {k: strip(v, top=False) for k, v in value.items() if k not in drop}
            return [strip(v, top=False) for v in value] if isinstance(value, list) else value

        return read.edit_documents(df, "doc", strip)

    def count(self, selection: Any, options: Any = None, **more: Any) -> int:
        chosen, drawers = Selection.of(selection), self._state()[1]
        name = self._name(chosen.target())
        if drawers and name not in drawers:
            raise NotFound(f"no collection {name}")
        return read.count(self._selected(chosen, name, drawers), Options.of(options, **more), "doc")

    def lookup(self, drawer: str, field_name: str, key: str) -> DataFrame:
        """Documents whose ``field_name`` is the scalar that ``key`` reads as: a secondary key's lookup."""
        drawers = self._state()[1]
        name = self._name(drawer)
        if name not in drawers:
            raise NotFound(f"no collection {name}")
        return read.secondary_lookup(self.store.read(drawers[name]), field_name, key, "doc")

    # Writes

    def upsert(self, payload: Any, selection: Any = None, options: Any = None, **more: Any) -> Upserted:
        """Store records: one, a list (one commit), or with a query the changes of what matches.

        Records replace those with their id.  With ``atomic=False`` each record
        is a commit of its own and the first refused one ends the request.
        """
        chosen, opts = Selection.of(selection), Options.of(options, **more)
        if chosen.query is not None:
            return self._upsert_query(payload, chosen, opts)
        records = payload if isinstance(payload, list) else [payload]
        if not all(isinstance(r, dict) for r in records):
            raise InvalidInput("records must be JSON objects")
        drawer = chosen.drawer
        if chosen.pointers:
            at, key = P.parse_pointer(chosen.pointers[0])
            if drawer not in (None, at):
                raise InvalidInput(f"conflicting collections: {drawer} and {at}")
            drawer, records = at, [{**r, "_id": key} for r in records]
        if opts.atomic is False:
            return Upserted([p for r in records for p in self._store([r], drawer)])
        return Upserted(self._store(records, drawer))

    def _upsert_query(self, payload: dict, chosen: Selection, opts: Options) -> Upserted:
        if not isinstance(payload, dict):
            raise InvalidInput("a query upsert takes one JSON object")
        name = self._name(chosen.target())
        df = self._selected(chosen, name, self._state()[1])
        ids = [r[0] for r in df.select("_id").limit(2).collect()]
        if not ids:
            if opts.create_if_missing is False:
                return Upserted([], False)
            return Upserted(self._store([payload], name))
        if len(ids) > 1 and not opts.multi:
            raise InvalidInput("the query matches several records; set multi to change them all")
        changes = {k: v for k, v in payload.items() if k != "_id"}
        with self._work() as keep:
            changed = read.edit_documents(df, "doc", lambda value, _: {**value, **changes})
            staged = keep(changed.select(F.lit(name).alias("drawer"), "_id", F.col("_seq").alias("pos"), "doc"))
            self._commit(staged, keep)
            path = f"{self.store.root}/_results/{uuid.uuid4().hex}"
            staged.select(P.pointer_to(name, F.col("_id")).alias("pointer"), F.col("pos").alias("place")).write.parquet(path)
        return Upserted(created=False, frame=self.spark.read.schema("pointer string, place long").parquet(path))

    def _store(self, records: list[dict], drawer: str | None) -> list[str]:
        drawers = self._state()[1]
        metas = {n: e["meta"] for n, e in drawers.items()}
        staged, out = [], []
        for record in records:
            record = dict(record)
            name = self._name(write.target_of(record, drawer))
            parts = write.decompose(record, name, metas, self.namespace)
            staged += [(self._name(n), r["_id"], V.dumps(r), len(staged) + i) for i, (n, r) in enumerate(parts)]
            out.append(P.format_pointer(name, parts[-1][1]["_id"]))
        rows = self.spark.createDataFrame(staged, "drawer string, _id string, text string, pos long")
        with self._work() as keep:
            self._commit(rows.select("drawer", "_id", "pos", F.parse_json("text").alias("doc")), keep)
        return out

    def upsert_frame(self, rows: DataFrame, drawer: str, order: str | None = None) -> int:
        """Store many records at once: ``rows`` has _id and doc (VARIANT), in any number.

        Records nested in them are stored too and plain ids of declared fields
        become pointers, as for :meth:`upsert`; only rows for which that may
        matter are looked at in Python.  Of rows with one id that with the
        largest ``order`` wins, and among equals, or without an order, the one
        whose text comes last.  Returns the number of rows.
        """
        name = self._name(drawer)
        with self._work() as keep:
            last = rows.select("_id", "doc", (F.col(order) if order else F.lit(0)).alias("_order"))
            latest = Window.partitionBy("_id").orderBy(F.col("_order").desc(), F.to_json("doc").desc())
            last = keep(last.withColumn("_nth", F.row_number().over(latest)))
            staged = last.where("_nth = 1 OR _id IS NULL").repartitionByRange("_order", "_id").sortWithinPartitions("_order", "_id")
            staged = keep(staged.select(F.lit(name).alias("drawer"), "_id", F.monotonically_increasing_id().alias("pos"), "doc"))
            self._commit(self._decomposed(staged, name, keep), keep)
            return last.count()

    def _decomposed(self, staged: DataFrame, name: str, keep: Callable) -> DataFrame:
        """``staged`` with nested records as rows of their own and references as pointers."""
        metas = {n: e["meta"] for n, e in self._state()[1].items()}
        namespace = self.namespace
        nested = F.regexp_count(F.to_json("doc"), F.lit('"_id":')) > 1
        involved = F.lit(bool(metas.get(name, {}).get("relationships"))) | nested | F.col("_id").isNull() | ~F.col("_id").rlike("^[^@:/]+$") | F.startswith("_id", F.lit("lnk_"))

        def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for key, pos, text in zip(batch["_id"], batch["pos"], batch["text"], strict=True):
                    record = V.loads(text)
                    if key is not None:
                        record["_id"] = key
                    out += [(P.scoped(n, namespace), r["_id"], pos, V.dumps(r)) for n, r in write.decompose(record, name, metas, namespace)]
                yield pd.DataFrame(out, columns=["drawer", "_id", "pos", "text"])

        some = staged.where(involved)
        if some.isEmpty():
            return staged
        taken = some.select("_id", "pos", V.text(F.col("doc")).alias("text")).mapInPandas(parts, "drawer string, _id string, pos long, text string")
        return keep(staged.where(~involved).unionByName(taken.select("drawer", "_id", "pos", F.parse_json("text").alias("doc"))))

    def _commit(self, staged: DataFrame, keep: Callable) -> None:
        """Check the batch against every collection it touches, then publish all of it at once.

        Of each collection only the batch's records are written, once all are
        checked.
        """
        m, drawers = self._state()
        names = sorted(r[0] for r in staged.select("drawer").distinct().collect())  # collections, not rows
        written: dict[str, tuple[dict, DataFrame]] = {}
        for name in names:
            entry = drawers.get(name) or new_entry()
            meta = entry["meta"]
            old = self.store.read(entry)
            batch = write.last_of_each(staged.where(F.col("drawer") == name), "_id", "pos").select("_id", "pos", "doc")
            if meta["timestamps"]:
                batch = self._stamped(batch, old)
            batch = keep(batch)
            self._check_records(batch, meta, name)
            self._check_unique(batch, old, meta, name)
            # Only the batch's ids are looked up among all.
            kept = old.select("_id", F.col("_seq").alias("_kept")).join(batch.select("_id"), "_id", "left_semi")
            place = F.coalesce("_kept", F.col("pos") + self.store.next_place(entry)).alias("_seq")
            written[name] = entry, batch.join(kept, "_id", "left").select("_id", place, "doc")
        for name, (entry, rows) in written.items():
            self.store.change(m, entry, rows)
            drawers[name] = entry
            self._note_aliases(staged, name, entry["meta"])
            for parent in list(drawers.values()):
                for rule in parent["meta"]["relationships"].values():
                    if rule.get("type") == "1:M" and rule.get("target_drawer") == name and rule.get("mapped_by") not in entry["meta"]["hidden"]:
                        entry["meta"]["hidden"].append(rule["mapped_by"])
        self.store.commit(m)

    def _note_aliases(self, staged: DataFrame, name: str, meta: dict) -> None:
        """Undeclared top-level fields that hold pointers are remembered, not enforced."""

        @F.pandas_udf("array<string>")
        def fields(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: [k for k, v in json.loads(t).items() if isinstance(v, str) and v.startswith("@") and P.parse_pointer(v)])

        # Names of fields: they go into the manifest, all of them.
        found = staged.where(F.col("drawer") == name).select(F.explode(fields(F.to_json("doc"))).alias("f")).distinct().collect()
        for f in sorted(row.f for row in found):
            if f not in meta["relationships"]:
                meta["aliases"].setdefault(f, {"type": "M:1", "polymorphic": True})

    def _stamped(self, batch: DataFrame, old: DataFrame) -> DataFrame:
        """created_at is the old record's or the caller's; updated_at is now unless a new record brings its own."""
        now = self.spark.sql("SELECT date_format(to_utc_timestamp(current_timestamp(), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")").first()[0]
        before = old.select(F.col("_id").alias("_old"), F.to_json("doc").alias("_before"))
        met = batch.join(before, batch["_id"] == before["_old"], "left")

        def edit(value: dict, text: str | None) -> dict:
            if text is None:
                return {**value, "created_at": value.get("created_at", now), "updated_at": value.get("updated_at", now)}
            created = json.loads(text).get("created_at", value.get("created_at", now))
            return {**value, "created_at": created, "updated_at": now}

        return read.edit_documents(met, "doc", edit, "_before").select("_id", "pos", "doc")

    def _check_records(self, batch: DataFrame, meta: dict, name: str) -> None:
        schema, rules = meta["schema"], meta["relationships"]
        if not schema and not rules:
            return

        bad = constraints.document_errors(batch, schema, rules).orderBy("_id").limit(1).collect()
        if bad:
            raise ConstraintViolation(f"@{name}:{bad[0]._id}: {bad[0].error}")

    def _check_unique(self, batch: DataFrame, old: DataFrame, meta: dict, name: str) -> None:
        one_to_one = [f for f, r in meta["relationships"].items() if r.get("type") == "1:1"]
        for path in [*meta["unique"], *one_to_one]:
            again = constraints.taken_keys(batch, old, constraints.scalar_key(F.col("doc"), path)).limit(1).collect()
            if again:
                raise ConstraintViolation(f"{name}.{path} must be unique; {again[0].key[2:]!r} comes {again[0].n} times")

    # Deletes

    def delete(self, selection: Any, options: Any = None, **more: Any) -> int:
        """Delete by pointers or by a query, with its rules; returns how many records were addressed.

        A query ``Filter.query({})`` in a collection deletes all of it; a bare
        collection is refused.  Options are accepted and change nothing.
        """
        Options.of(options, **more)
        chosen = Selection.of(selection)
        m, drawers = self._state()
        if not chosen.pointers and chosen.query is None:
            raise InvalidInput("a delete needs pointers or a query")
        if chosen.query is None:
            nodes = [(self._name(d), k) for d, k in map(P.parse_pointer, chosen.pointers)]
            for drawer, _ in nodes:
                if drawer not in drawers:
                    raise NotFound(f"no collection {drawer}")
            wanted = self.spark.createDataFrame(nodes, delete.NODE).distinct()
            start = None
            for drawer in sorted({n[0] for n in nodes}):
                there = self.store.read(drawers[drawer]).select(F.lit(drawer).alias("drawer"), "_id").join(wanted, ["drawer", "_id"], "left_semi")
                start = there if start is None else start.unionByName(there)
        else:
            name = self._name(chosen.target())
            if name not in drawers:
                return 0
            start = self._selected(chosen, name, drawers).select(F.lit(name).alias("drawer"), "_id")
        with self._work() as keep:
            return self._delete(start, m, drawers, keep)

    def _delete(self, start: DataFrame, m: dict, drawers: dict, keep: Callable) -> int:
        start = keep(start)
        addressed = start.count()
        if not addressed:
            return 0
        rules = delete.rules_of({n: e["meta"] for n, e in drawers.items()})
        doomed, emptied = delete.closure(self.spark, start, rules, lambda r: self._edges(r, drawers), keep)
        doomed, emptied = keep(doomed), keep(emptied)
        touched = {r[0] for r in doomed.select("drawer").distinct().collect()} | {r[0] for r in emptied.select("drawer").distinct().collect()}
        for name in sorted(touched & drawers.keys()):
            marks = emptied.where(F.col("drawer") == name).groupBy(F.col("_id").alias("_row"))
            marks = marks.agg(F.to_json(F.collect_list(F.struct("field", "parent"))).alias("_marks"))
            rows = self.store.read(drawers[name])
            cut = read.edit_documents(rows.join(marks, rows["_id"] == marks["_row"]), "doc", _emptied, "_marks").select("_id", "_seq", "doc")
            self.store.change(m, drawers[name], cut, doomed.where(F.col("drawer") == name).select("_id"))
        self.store.commit(m)
        return addressed

    def _edges(self, rule: delete.Rule, drawers: dict) -> DataFrame:
        """(parent_drawer, parent_id, child, child_id) of a rule's references, at any depth of its field."""
        child = rule.parent if rule.forward else rule.child
        rows = self.store.read(drawers.get(child))
        value = V.get(F.col("doc"), rule.field.split("."))
        ptr = F.explode(relate._pointer_column(F.parse_json(F.concat(F.lit('{"v":'), F.coalesce(F.to_json(value), F.lit("null")), F.lit("}"))), frozenset())).alias("p")
        refs = rows.select("_id", ptr)
        out = refs.select(P.pointer_collection(F.col("p")).alias("parent_drawer"), P.pointer_key(F.col("p")).alias("parent_id"), F.lit(child).alias("child"), F.col("_id").alias("child_id"))
        return out if rule.forward else out.where(F.col("parent_drawer") == rule.parent)

    # Definition and upkeep

    def alter(self, drawer: str, action: str, kind: str, field_name: str = "", payload: dict | None = None) -> dict:
        """Add, remove or rebuild an index, key, constraint, trigger, relationship, cascade-delete or timestamp.

        Indexes and triggers are kept as declarations: snapshots are clustered
        by id, and triggers never run.  A cascade-delete may name another action.
        """
        m, drawers = self._state()
        name = self._name(drawer)
        if name not in drawers:
            raise NotFound(f"no collection {name}")
        verb, kind, payload = action.lower(), kind.lower().replace("_", "-"), payload or {}
        kind = {"timestamps": "timestamp", "cascade": "cascade-delete"}.get(kind, kind)
        if verb not in ("add", "remove", "rebuild") or kind not in KINDS:
            raise InvalidInput(f"Unknown schema {'action: ' + action if kind in KINDS else 'type: ' + kind}")
        if kind == "timestamp":
            field_name = field_name or "timestamps"
        if not field_name.strip():
            raise InvalidInput("a field is needed")
        meta, add = drawers[name]["meta"], verb != "remove"
        constraint = str(payload.get("constraint") or payload.get("type") or "").lower()
        unique = kind == "constraint" and (constraint == "unique" or not add and not constraint)
        required = kind == "constraint" and (constraint in ("required", "not_null", "not-null") or not add and not constraint)
        if kind == "constraint" and add and not (unique or required):
            raise InvalidInput(f"Unknown constraint: {constraint}")
        if kind == "key":
            primary = str(payload.get("key_type", "secondary")).lower() == "primary"
            if primary and add and field_name != "_id":
                raise InvalidInput(f"primary key is fixed to '_id' and cannot be changed to '{field_name}'")
            unique = not primary
        if unique and verb != "rebuild":
            if add and field_name not in meta["unique"]:
                rows = self.store.read(drawers[name])
                self._check_unique(rows, rows, {"unique": [field_name], "relationships": {}}, name)
                meta["unique"].append(field_name)
            elif not add and field_name in meta["unique"]:
                meta["unique"].remove(field_name)
        if required and verb != "rebuild":
            have = meta["schema"].setdefault("required", [])
            if add and field_name not in have:
                have.append(field_name)
            elif not add and field_name in have:
                have.remove(field_name)
        if kind == "relationship":
            meta["relationships"].update({field_name: payload}) if add else meta["relationships"].pop(field_name, None)
        if kind == "cascade-delete":
            meta["delete_rules"].update({field_name: {"action": payload.get("action", "Cascade")}}) if add else meta["delete_rules"].pop(field_name, None)
        if kind == "timestamp":
            meta["timestamps"] = add
        if kind in ("index", "key", "constraint", "trigger", "timestamp"):
            kept = meta["extensions"].setdefault(kind, {})
            kept.update({field_name: payload}) if add else kept.pop(field_name, None)
        self.store.commit(m)
        return {"drawer": name, "action": verb, "type": kind, "field": field_name, "payload": payload}

    def set_schema(self, drawer: str, schema: dict) -> None:
        """Records written from now on must fit ``schema``."""
        m, drawers = self._state()
        drawers.setdefault(self._name(drawer), new_entry())["meta"]["schema"] = schema
        self.store.commit(m)

    def inspect(self, drawer: str) -> dict:
        drawers = self._state()[1]
        entry = drawers.get(self._name(drawer))
        if entry is None:
            raise NotFound(f"no collection {drawer}")
        size, files = self.store.size(entry)
        return {"drawer": self._name(drawer), "record_count": self.store.read(entry).count(), "bytes": size, "files": files, "fragmentation": None, "meta": entry["meta"]}

    def compact(self, drawer: str | None = None) -> dict:
        """Rewrite snapshots into fewer files and delete old ones; old ``lnk_`` prefixes go."""
        m, drawers = self._state()
        before = self.store.files.size(f"{self.store.root}/data")[0]
        for name in [self._name(drawer)] if drawer else sorted(drawers):
            if name not in drawers:
                raise NotFound(f"no collection {name}")
            if drawers[name]["path"]:
                rows = self.store.read(drawers[name]).withColumn("_id", P.without_legacy_prefix(F.col("_id")))
                drawers[name].update(path=self.store.write(m, _migrated(rows)), changes=[])
        self.store.commit(m)
        self.store.collect_garbage()
        return {"bytes_before": before, "bytes_after": self.store.files.size(f"{self.store.root}/data")[0]}


def _migrated(rows: DataFrame) -> DataFrame:
    """Documents without the ``lnk_`` of old stores in ids and pointers, at any depth; others pass as they are."""
    old = F.to_json("doc").rlike('"(@[^":]+:)?lnk_')

    def fresh(value: Any) -> Any:
        if isinstance(value, dict):
            return {k: fresh(v) for k, v in value.items()}
        if isinstance(value, list):
            return [fresh(v) for v in value]
        found = P.parse_pointer(value) if isinstance(value, str) and value.startswith("@") else None
        return P.format_pointer(*found) if found else value

    def edit(doc: dict, _: Any) -> dict:
        out = fresh(doc)
        if isinstance(out.get("_id"), str):
            out["_id"] = out["_id"].removeprefix("lnk_")
        return out

    return rows.where(~old).unionByName(read.edit_documents(rows.where(old), "doc", edit).select(*rows.columns))


def _emptied(doc: dict, marks: str) -> dict:
    """A document without pointers to records that are gone."""
    gone: dict[str, set[str]] = {}
    for mark in json.loads(marks):
        gone.setdefault(mark["field"], set()).add(mark["parent"])
    out = dict(doc)
    for name, parents in gone.items():
        if name in out:
            left = delete.emptied_value(out.pop(name), parents)
            if left is not None:
                out[name] = left
    return out


def local_engine(spark: SparkSession) -> Engine:
    """An engine in a temporary folder, for trying things out in one process."""
    if not spark.sparkContext.master.startswith("local"):
        raise InvalidInput("a store on a cluster needs a folder that all executors share")
    return Engine(spark, tempfile.mkdtemp(prefix="larkspur-store-"))
