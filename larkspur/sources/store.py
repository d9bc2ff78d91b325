"""Collections as immutable Parquet snapshots under one numbered manifest.

A collection is a base snapshot and the changes since, oldest first; reading
merges them.  A commit writes what it changes of every collection and then one
new manifest file; whoever opens the store sees either all of it or nothing.
Two writers from the same manifest can't both commit.  Changes are merged with
one another when they are many, and with the base only when they have a share
of its size, so a commit costs in proportion to what it changes.
"""

from __future__ import annotations

import copy
import json
import re
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.config import Config
from larkspur.errors import ConstraintViolation, InvalidInput, NotFound
from larkspur.sources.files import Files

ARCHIVE_FORMAT = "larkspur-archive-v1"
SCHEMA = "_id string, _seq long, doc variant"
#: A changed or, with ``_gone``, a deleted record.
CHANGES = f"{SCHEMA}, _gone boolean"
RIGHTS = "ruid"


def check_token(name: str, label: str) -> str:
    """Names of schemas, collections and tenants: one plain segment."""
    name = name.strip()
    if not name or re.search(r"[/\\]", name) or name in (".", "..", ".catalog") or name.endswith(("_index", "_meta")):
        raise InvalidInput(f"Invalid {label} name: {name}")
    return name


def check_database(name: str) -> str:
    """A database's name may have several segments."""
    name = name.strip()
    if not name or name.startswith("/") or "\\" in name or any(s in ("", ".", "..", ".catalog") for s in name.split("/")):
        raise InvalidInput(f"Invalid database name: {name}")
    return name


def new_meta() -> dict[str, Any]:
    return {"schema": {}, "unique": [], "relationships": {}, "aliases": {}, "delete_rules": {}, "hidden": [], "timestamps": False, "extensions": {}}


def new_entry() -> dict[str, Any]:
    return {"path": None, "changes": [], "next": 0, "meta": new_meta()}


def paths_of(entry: dict | None) -> list[str]:
    """The folders of a collection: its base and its changes."""
    return [p for p in ((entry or {}).get("path"), *((entry or {}).get("changes") or [])) if p]


class Store:
    """One root folder with its manifests, snapshots and registries."""

    #: Manifests that stay when garbage is collected: older ones only make finding the last one slow.
    kept_manifests = 100

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        config = config or Config()
        self.most_changes, self.share, self.log = config.most_changes, config.merge_share, config.logging.logger()
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
        # Inferred shredding would store 3 beside 5.5 as a decimal and lose that it was whole.
        spark.conf.set("spark.sql.variant.inferShreddingSchema", "false")

    # Manifests

    def manifest(self) -> dict[str, Any]:
        names = [n for n in self.files.names(f"{self.root}/_manifest") if re.fullmatch(r"\d{10}\.json", n)]
        if not names:
            return {"version": 0, "databases": {}, "tenants": {}, "users": {}, "operations": []}
        return json.loads(self.files.read(f"{self.root}/_manifest/{names[-1]}"))

    def commit(self, manifest: dict[str, Any]) -> dict[str, Any]:
        """Publish a manifest that was derived from the one before it."""
        out = copy.deepcopy(manifest)
        out["version"] += 1
        if not self.files.write(f"{self.root}/_manifest/{out['version']:010d}.json", json.dumps(out)):
            self.log.warning("commit lost", extra={"fields": {"version": out["version"]}})
            raise ConstraintViolation("another commit came first; read again and retry")
        self.log.info("commit", extra={"fields": {"version": out["version"]}})
        return out

    # Catalog

    def create(self, database: str, schema: str | None = None, drawer: str | None = None) -> dict:
        """Register a name; its parents must be there, and a name that is there stays."""
        m = self.manifest()
        check_database(database)
        if schema is None:
            m["databases"].setdefault(database, {})
        else:
            schemas = self._schemas(m, database)
            check_token(schema, "schema")
            if drawer is None:
                schemas.setdefault(schema, {})
            else:
                self._drawers(m, database, schema).setdefault(check_token(drawer, "drawer"), new_entry())
        self.commit(m)
        return {"ok": True, "action": "create", "path": "/".join(p for p in (database, schema, drawer) if p)}

    def drop(self, database: str, schema: str | None = None, drawer: str | None = None) -> dict:
        """Forget a name and all below it; what it held stays for readers until :meth:`collect_garbage`."""
        m = self.manifest()
        where = m["databases"] if schema is None else m["databases"].get(database, {})
        name = database if schema is None else schema
        if drawer is not None:
            where, name = where.get(schema, {}), drawer
        removed = where.pop(name, None) is not None
        self.commit(m)
        return {"ok": True, "action": "drop", "path": "/".join(p for p in (database, schema, drawer) if p), "removed": removed}

    def _schemas(self, m: dict, database: str) -> dict:
        if database not in m["databases"]:
            raise NotFound(f"no database {database}")
        return m["databases"][database]

    def _drawers(self, m: dict, database: str, schema: str) -> dict:
        schemas = self._schemas(m, database)
        if schema not in schemas:
            raise NotFound(f"no schema {database}/{schema}")
        return schemas[schema]

    def clone(self, database: str, to: str) -> dict:
        """A new database with the collections of another as they are now; snapshots are shared, no data is copied."""
        m = self.manifest()
        if to in m["databases"]:
            raise InvalidInput(f"database {to} is there already")
        m["databases"][check_database(to)] = copy.deepcopy(self._schemas(m, database))
        self.commit(m)
        return {"ok": True, "action": "clone", "path": to}

    def create_tenant(self, tenant: str, location: str) -> dict:
        """Route a tenant to the databases below a location."""
        m = self.manifest()
        m["tenants"][check_token(tenant, "tenant")] = check_database(location)
        self.commit(m)
        return {"ok": True, "action": "create_tenant", "tenant": tenant, "location": location}

    def tenant_database(self, tenant: str, database: str) -> str:
        m = self.manifest()
        if tenant not in m["tenants"]:
            raise NotFound(f"no tenant {tenant}")
        full = f"{m['tenants'][tenant]}/{database}"
        if full not in m["databases"]:
            raise NotFound(f"tenant {tenant} has no database {database}")
        return full

    # Snapshots

    def read(self, entry: dict | None) -> DataFrame:
        """A collection's rows: (_id, _seq, doc), the latest of each."""
        if not entry or not entry["path"]:
            return self.spark.createDataFrame([], "_id string, _seq long, d string").select("_id", "_seq", F.parse_json("d").alias("doc"))
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{entry['path']}")
        if not entry.get("changes"):
            return rows
        last = self._latest(entry["changes"])
        return rows.join(last.select("_id"), "_id", "left_anti").unionByName(last.where("NOT _gone").select("_id", "_seq", "doc"))

    def _latest(self, changes: list[str]) -> DataFrame:
        """The last of each record's changes, which are given oldest first."""
        each = [self.spark.read.schema(CHANGES).parquet(f"{self.root}/{p}") for p in changes]
        if len(each) == 1:
            return each[0]
        rows = reduce(DataFrame.unionByName, [r.withColumn("_at", F.lit(i)) for i, r in enumerate(each)])
        last = Window.partitionBy("_id").orderBy(F.col("_at").desc())
        return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", "_at")

    def change(self, manifest: dict, entry: dict, changed: DataFrame, gone: DataFrame | None = None) -> None:
        """Put records (_id, _seq, doc) in place of those with their ids, and drop those of ``gone`` (_id)."""
        if not entry["path"]:
            path = entry["path"] = self.write(manifest, changed)
        else:
            rows = changed.select("_id", "_seq", "doc", F.lit(False).alias("_gone"))
            if gone is not None:
                none = F.parse_json(F.lit("null"))
                rows = rows.unionByName(gone.select("_id", F.lit(None).cast("long").alias("_seq"), none.alias("doc"), F.lit(True).alias("_gone")))
            path = self.new_path(manifest)
            rows.write.parquet(f"{self.root}/{path}")
        highest = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{path}").agg(F.max("_seq")).first()[0]
        entry["next"] = max(self.next_place(entry), 0 if highest is None else highest + 1)
        if path == entry["path"]:
            return
        changes = [*(entry.get("changes") or []), path]
        if sum(self.files.size(f"{self.root}/{p}")[0] for p in changes) > self.share * self.files.size(f"{self.root}/{entry['path']}")[0]:
            merged = self.read({**entry, "changes": changes})
            entry["path"], entry["changes"] = self.write(manifest, merged), []
        elif len(changes) > self.most_changes:
            path = self.new_path(manifest)
            self._latest(changes).write.parquet(f"{self.root}/{path}")
            entry["changes"] = [path]
        else:
            entry["changes"] = changes

    def next_place(self, entry: dict) -> int:
        """A ``_seq`` that no record has yet, nor any after it."""
        if "next" in entry:
            return entry["next"]
        highest = self.read(entry).agg(F.max("_seq")).first()[0]
        return 0 if highest is None else highest + 1

    def size(self, entry: dict) -> tuple[int, int]:
        """(bytes, files) of a collection."""
        sizes = [self.files.size(f"{self.root}/{p}") for p in paths_of(entry)]
        return sum(s[0] for s in sizes), sum(s[1] for s in sizes)

    @staticmethod
    def new_path(manifest: dict) -> str:
        """A folder of its own for a snapshot made from ``manifest``, whatever it belongs to."""
        return f"data/{manifest['version']:010d}-{uuid.uuid4().hex}"

    def write(self, manifest: dict, rows: DataFrame) -> str:
        """A new snapshot, clustered by id so that lookups skip row groups."""
        path = self.new_path(manifest)
        rows.select("_id", "_seq", "doc").repartitionByRange("_id").sortWithinPartitions("_id").write.parquet(f"{self.root}/{path}")
        return path

    def collect_garbage(self) -> list[str]:
        """Delete snapshots that the manifest does not name, and old manifests.

        Those made from the current version stay: their writer may yet commit.
        Whoever wrote from an older one can't.
        """
        self.files.delete(f"{self.root}/_results")
        m = self.manifest()
        for name in self.files.names(f"{self.root}/_manifest"):
            if re.fullmatch(r"\d{10}\.json", name) and int(name[:10]) <= m["version"] - self.kept_manifests:
                self.files.delete(f"{self.root}/_manifest/{name}")
        named = {p for schemas in m["databases"].values() for drawers in schemas.values() for e in drawers.values() for p in paths_of(e)}
        gone = []
        for name in self.files.names(f"{self.root}/data"):
            made = re.match(r"(\d{10})-", name)
            if f"data/{name}" not in named and made and int(made[1]) < m["version"]:
                self.files.delete(f"{self.root}/data/{name}")
                gone.append(f"data/{name}")
        return gone

    # Status

    def inventory(self) -> DataFrame:
        """A row per collection: database, schema, drawer, records, bytes, files."""
        rows = []
        for db, schemas in self.manifest()["databases"].items():
            for schema, drawers in schemas.items():
                for drawer, entry in drawers.items():
                    size, files = self.size(entry)
                    n = self.read(entry).count() if entry["path"] else 0
                    rows.append((db, schema, drawer, n, size, files))
        return self.spark.createDataFrame(rows, "database string, schema string, drawer string, record_count long, bytes long, files long")

    def structure(self, database: str | None = None, schema: str | None = None) -> DataFrame:
        """Names of databases; of a database's schemas; or the inventory of a schema's collections."""
        m = self.manifest()
        if database is None:
            return self.spark.createDataFrame([(d,) for d in sorted(m["databases"])], "name string")
        if schema is None:
            return self.spark.createDataFrame([(s,) for s in sorted(self._schemas(m, database))], "name string")
        self._drawers(m, database, schema)
        return self.inventory().where((F.col("database") == database) & (F.col("schema") == schema))

    def status(self) -> dict:
        m = self.manifest()
        size, files = self.files.size(self.root)
        schemas = [s for d in m["databases"].values() for s in d.values()]
        names = sorted(f"{d}/{s}/{c}" for d, x in m["databases"].items() for s, y in x.items() for c in y)
        return {
            "path": self.root, "version": m["version"], "tenants": sorted(m["tenants"]), "databases": sorted(m["databases"]),
            "schemas": len(schemas), "drawers": names, "storage": {"bytes": size, "files": files}, "storage_by_kind": self.breakdown(),
        }

    def breakdown(self) -> dict[str, int]:
        """Bytes by kind: collections, catalog, work in progress, and whatever else lies in the root."""
        sizes = {kind: self.files.size(f"{self.root}/{folder}")[0] for kind, folder in (("data", "data"), ("manifest", "_manifest"), ("work", "_work"))}
        return sizes | {"other": self.files.size(self.root)[0] - sum(sizes.values())}

    def locate(self, path: str) -> tuple[str, str | None, str | None]:
        """(database, schema, collection) of ``database[/schema[/collection]]``; databases may have several segments."""
        m, parts = self.manifest(), path.strip("/").split("/")
        for n in range(len(parts), 0, -1):
            database, rest = "/".join(parts[:n]), parts[n:]
            if database in m["databases"] and len(rest) <= 2:
                return database, *(rest + [None, None])[:2]
        raise NotFound(f"no database in {path}")

    def entries(self, path: str) -> list[tuple[str, str, dict]]:
        """(schema, collection, entry) of all that lies below a path."""
        database, schema, drawer = self.locate(path)
        found = [(s, d, e) for s, x in self._schemas(self.manifest(), database).items() for d, e in x.items() if schema in (None, s) and drawer in (None, d)]
        if schema is not None:
            x = self._drawers(self.manifest(), database, schema)
            if drawer is not None and drawer not in x:
                raise NotFound(f"no collection {path}")
        return found

    def check_path(self, path: str) -> dict:
        """What a path names, and the folders that hold it: whether each is there, its files and bytes."""
        database, schema, drawer = self.locate(path)
        rows = []
        for s, d, entry in self.entries(path):
            for at in paths_of(entry):
                size, files = self.files.size(f"{self.root}/{at}")
                rows.append({"collection": f"{database}/{s}/{d}", "folder": at, "exists": self.files.exists(f"{self.root}/{at}"), "files": files, "bytes": size})
        return {"path": path.strip("/"), "kind": "drawer" if drawer else "schema" if schema else "database", "entries": rows}

    def discover(self) -> DataFrame:
        """(folder, collection, files, bytes) of every snapshot folder there is; no collection for what no manifest names."""
        named = {p: f"{db}/{s}/{d}" for db, x in self.manifest()["databases"].items() for s, y in x.items() for d, e in y.items() for p in paths_of(e)}
        rows = []
        for name in self.files.names(f"{self.root}/data"):
            size, files = self.files.size(f"{self.root}/data/{name}")
            rows.append((f"data/{name}", named.get(f"data/{name}"), files, size))
        return self.spark.createDataFrame(rows, "folder string, collection string, files long, bytes long")

    def verify(self) -> dict:
        """Whether manifests follow one another without a gap and the last one's folders are all there."""
        versions = [int(n[:10]) for n in self.files.names(f"{self.root}/_manifest") if re.fullmatch(r"\d{10}\.json", n)]
        lost = [p for db in self.manifest()["databases"].values() for x in db.values() for e in x.values() for p in paths_of(e) if not self.files.exists(f"{self.root}/{p}")]
        gapless = versions == list(range(versions[0], versions[-1] + 1)) if versions else True
        return {"versions": len(versions), "gapless": gapless, "lost": lost, "ok": gapless and not lost}

    def show(self, what: str, *at: str) -> Any:
        """One part of the status: tenants, databases, schemas, drawers, drawer_names, storage, log, or a path's check."""
        m = self.manifest()
        names = sorted(f"{d}/{s}/{c}" for d, x in m["databases"].items() for s, y in x.items() for c in y)
        if what == "storage":
            kinds = self.breakdown()
            return {"bytes": sum(kinds.values()), **{f"{k}_bytes": v for k, v in kinds.items()}, "drawer_count": len(names), "drawers": names, "status": "ok" if names else "empty"}
        forms = {
            "tenants": lambda: sorted(m["tenants"]), "databases": lambda: sorted(m["databases"]), "schemas": lambda: sorted(self._schemas(m, *at)),
            "drawers": lambda: sorted(self._drawers(m, *at)), "drawer_names": lambda: names, "log": self.verify, "path": lambda: self.check_path(*at),
        }
        if what not in forms:
            raise InvalidInput(f"unknown status: {what}")
        return forms[what]()

    # Archives

    def backup(self, destination: str, database: str, schema: str | None = None, drawer: str | None = None) -> dict:
        """Copy snapshots and their metadata to a new folder."""
        m = self.manifest()
        chosen = {s: {d: e for d, e in x.items() if drawer in (None, d)} for s, x in self._schemas(m, database).items() if schema in (None, s)}
        if schema is not None and not chosen or drawer is not None and not chosen[schema]:
            raise NotFound("nothing to back up")
        scope = "drawer" if drawer else "schema" if schema else "database"
        for x in chosen.values():
            for e in x.values():
                for path in paths_of(e):
                    self.files.copy(f"{self.root}/{path}", f"{destination}/{path}")
        body = {"format": ARCHIVE_FORMAT, "scope": scope, "database": database, "schemas": chosen}
        if not self.files.write(f"{destination}/archive.json", json.dumps(body)):
            raise InvalidInput(f"{destination} holds an archive already")
        return {"format": ARCHIVE_FORMAT, "scope": scope, "collections": sum(len(x) for x in chosen.values())}

    def restore(self, source: str, scope: str | None = None) -> dict:
        """Put an archive's collections back, in place of those with their names."""
        if not self.files.exists(f"{source}/archive.json"):
            raise NotFound(f"no archive in {source}")
        body = json.loads(self.files.read(f"{source}/archive.json"))
        if body.get("format") != ARCHIVE_FORMAT:
            raise InvalidInput(f"unsupported archive format: {body.get('format')}")
        if scope not in (None, body["scope"]):
            raise InvalidInput(f"the archive's scope is {body['scope']}")
        m, db = self.manifest(), body["database"]
        if body["scope"] == "database":
            m["databases"][db] = {}
        for schema, drawers in body["schemas"].items():
            target = m["databases"].setdefault(db, {}).setdefault(schema, {})
            if body["scope"] == "schema":
                target.clear()
            for drawer, entry in drawers.items():
                at = {path: self.new_path(m) for path in paths_of(entry)}
                for path, to in at.items():
                    self.files.copy(f"{source}/{path}", f"{self.root}/{to}")
                target[drawer] = {**entry, "path": at.get(entry["path"]), "changes": [at[p] for p in entry.get("changes") or []]}
        self.commit(m)
        size, files = self.files.size(source)
        return {"scope": body["scope"], "file_count": files, "byte_count": size}

    # Users: kept, not enforced

    def access(self, action: str, payload: dict) -> dict:
        """create_user, drop_user, grant_permission, revoke_permission; other actions are noted.

        A permission is ``path:rights`` with rights from r, u, i, d, each once.
        """
        m = self.manifest()
        user = payload.get("username") or payload.get("user")
        verb = action.strip().lower()
        known = ("create_user", "drop_user", "grant_permission", "revoke_permission")
        if verb in known and not user:
            raise InvalidInput("a username is needed")
        out = {"ok": True, "action": verb, "username": user or "unknown"}
        if verb == "create_user":
            m["users"].setdefault(user, {"username": user, "permissions": []})
        elif verb == "drop_user":
            out["removed"] = m["users"].pop(user, None) is not None
        elif verb in known:
            scope = payload.get("permission_scope") or payload.get("scope") or ""
            path, _, rights = scope.rpartition(":")
            if not path or not rights or set(rights) - set(RIGHTS) or len(set(rights)) != len(rights):
                raise InvalidInput(f"invalid permission: {scope}")
            held = m["users"].setdefault(user, {"username": user, "permissions": []})["permissions"]
            if verb == "grant_permission" and scope not in held:
                held.append(scope)
            elif verb == "revoke_permission" and scope in held:
                held.remove(scope)
            out["permission_scope"] = scope
        else:
            m["operations"].append({"action": action, "username": out["username"], "payload": payload})
        self.commit(m)
        return out
