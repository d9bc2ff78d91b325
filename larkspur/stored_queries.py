"""Registered queries over stored documents, each through ``Engine`` and ``Scope`` and with its SQL twin.

A store with four of the driver's tables as documents is loaded once for a
session and folder.  Queries that change something work on a clone of it, which
shares its snapshots.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.errors import ConstraintViolation, InvalidInput, NotFound, Restricted
from larkspur.functions import pointers as P
from larkspur.operators import constraints, measure
from larkspur.plans.filters import Filter, Selection
from larkspur.session import Engine, Scope, local_engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: What the stored collections hold: key, further fields, references.
STORED = {
    "region": ("r_regionkey", ["r_name"], {}),
    "nation": ("n_nationkey", ["n_name"], {"region": "n_regionkey"}),
    "supplier": ("s_suppkey", ["s_name", "s_acctbal"], {"nation": "s_nationkey"}),
    "customer": ("c_custkey", ["c_name", "c_acctbal", "c_mktsegment"], {"nation": "c_nationkey"}),
}
_ENGINES: dict[tuple[str, str], Engine] = {}


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return register


def new_engine(spark: SparkSession) -> Engine:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return Engine(spark, f"{shared}/larkspur-store-{uuid.uuid4().hex}") if shared else local_engine(spark)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_documents(rows: DataFrame, key: Column, **fields: Column) -> DataFrame:
    """(_id, doc) with the given fields."""
    named = [key.cast("string").alias("_id"), *[c.alias(n) for n, c in fields.items()]]
    return rows.select(named[0], F.parse_json(F.to_json(F.struct(*named))).alias("doc"))


def base(spark: SparkSession, sf_dir: str) -> Engine:
    """The engine whose database ``base`` holds the stored tables."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _ENGINES:
        engine = new_engine(spark)
        engine.create("base")
        engine.create("base", "main")
        scope = engine.scope("base/main")
        for name, (key, plain, references) in STORED.items():
            fields = {f: F.col(f) for f in (key, *plain)} | {f: P.pointer_to(f, F.col(c).cast("string")) for f, c in references.items()}
            scope.upsert_frame(as_documents(load(spark, sf_dir, name), F.col(key), **fields), name)
        _ENGINES[at] = engine
    return _ENGINES[at]


def stored(spark: SparkSession, sf_dir: str) -> Scope:
    return base(spark, sf_dir).scope("base/main")


def cloned(spark: SparkSession, sf_dir: str) -> Scope:
    """The stored tables in a database of their own, to be changed."""
    engine, name = base(spark, sf_dir), f"clone-{uuid.uuid4().hex}"
    engine.store.clone("base", name)
    return engine.scope(f"{name}/main")


def fields(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """Paths of documents as columns: name=(path, type)."""
    return df.select(*[F.try_variant_get("doc", f"$.{path}", kind).alias(name) for name, (path, kind) in wanted.items()])


def refused(call: Callable[[], object]) -> bool:
    """Whether the engine refuses a request, by one of its own errors."""
    try:
        call()
    except (ConstraintViolation, InvalidInput, NotFound, Restricted):
        return True
    return False


def cases(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    """(name, outcome): outcomes as JSON texts."""
    return spark.createDataFrame([(n, json.dumps(v, sort_keys=True, separators=(",", ":"))) for n, v in rows], "name string, outcome string")


def cases_sql(rows: dict[str, str]) -> str:
    """SQL of :func:`cases`, an expression for each outcome."""
    return " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({e} AS VARCHAR) AS outcome" for n, e in rows.items())


# Reading ------------------------------------------------------------------------

SUPPLIER_PATHS = {"s_suppkey": ("s_suppkey", "long")}


@query("document_chain", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def document_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References are resolved until none is open."""
    return fields(stored(spark, sf_dir).read("supplier"), **SUPPLIER_PATHS, n_name=("nation.n_name", "string"), r_name=("nation.region.r_name", "string"))


@query("document_depth", "SELECT s_suppkey, n_name, '@region:' || n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def document_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(stored(spark, sf_dir).read("supplier", depth=1), **SUPPLIER_PATHS, n_name=("nation.n_name", "string"), region=("nation.region", "string"))


@query("document_exclude_hydration", "SELECT s_suppkey, n_name, '@region:' || n_regionkey AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def document_exclude_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded fields stay pointers."""
    read = stored(spark, sf_dir).read("supplier", exclude_hydration=["region"])
    return fields(read, **SUPPLIER_PATHS, n_name=("nation.n_name", "string"), region=("nation.region", "string"))


@query("document_no_hydration", "SELECT c_custkey, '@nation:' || c_nationkey AS nation FROM customer")
def document_no_hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(stored(spark, sf_dir).read("customer", hydrate=False), c_custkey=("c_custkey", "long"), nation=("nation", "string"))


@query("document_cycle", "SELECT a.n_nationkey, b.n_nationkey AS next, CASE WHEN b.n_nationkey IS NOT NULL THEN '@ring:' || a.n_nationkey END AS back FROM nation a LEFT JOIN nation b ON b.n_nationkey = a.n_nationkey // 2 * 2 + (a.n_nationkey + 1) % 2")
def document_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that refer to each other: the way back stays a pointer, and so does one to a record that is missing."""
    scope = cloned(spark, sf_dir)
    other = F.expr("n_nationkey div 2 * 2 + (n_nationkey + 1) % 2")
    scope.upsert_frame(as_documents(load(spark, sf_dir, "nation"), F.col("n_nationkey"), n_nationkey=F.col("n_nationkey"), next=P.pointer_to("ring", other.cast("string"))), "ring")
    return fields(scope.read("ring"), n_nationkey=("n_nationkey", "int"), next=("next.n_nationkey", "int"), back=("next.next", "string"))


@query("document_virtual_children", "SELECT n_nationkey, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def document_virtual_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 1:M field lists the children that point back."""
    scope = cloned(spark, sf_dir)
    scope.alter("nation", "add", "relationship", "suppliers", {"type": "1:M", "target_drawer": "supplier", "mapped_by": "nation"})
    children = F.try_variant_get("doc", "$.suppliers", "array<variant>")
    return scope.read("nation", exclude_hydration=["region"]).select(F.variant_get("doc", "$.n_nationkey", "int").alias("n_nationkey"), F.size(children).cast("long").alias("suppliers"))


@query("document_hidden_fields", "SELECT s_suppkey, false AS shown, '@nation:' || s_nationkey AS kept FROM supplier")
def document_hidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-links of nested children are stored but not shown."""
    scope = cloned(spark, sf_dir)
    scope.alter("nation", "add", "relationship", "suppliers", {"type": "1:M", "target_drawer": "supplier", "mapped_by": "nation"})
    scope.upsert_frame(scope.documents("supplier").select("_id", "doc"), "supplier")
    shown = fields(scope.read("supplier", hydrate=False), **SUPPLIER_PATHS, seen=("nation", "string"))
    kept = fields(scope.documents("supplier"), k=("s_suppkey", "long"), kept=("nation", "string"))
    return shown.join(kept, F.col("s_suppkey") == F.col("k")).select("s_suppkey", F.col("seen").isNotNull().alias("shown"), "kept")


@query("document_pointer_read", "SELECT n_nationkey, n_name, false AS has_id FROM nation WHERE n_nationkey IN (3, 7)")
def document_pointer_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads by pointer leave ids out of the documents."""
    read = stored(spark, sf_dir).read(["@nation:7", "@nation:3", "@nation:-1"])
    return fields(read, n_nationkey=("n_nationkey", "int"), n_name=("n_name", "string"), i=("_id", "string")).select("n_nationkey", "n_name", F.col("i").isNotNull().alias("has_id"))


@query("document_many_collections", "SELECT 0 AS place, n_name AS name FROM nation WHERE n_nationkey = 2 UNION ALL SELECT 1, r_name FROM region WHERE r_regionkey = 1 UNION ALL SELECT 2, n_name FROM nation WHERE n_nationkey = 0")
def document_many_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers into several collections, in the order of the request."""
    read = stored(spark, sf_dir).read(["@nation:2", "@region:1", "@nation:0"])
    names = [(i, r.n or r.r) for i, r in enumerate(fields(read, n=("n_name", "string"), r=("r_name", "string")).collect())]
    return spark.createDataFrame(names, "place int, name string")


@query("document_order_of_application", "SELECT c_custkey, false AS has_name FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 20 OFFSET 5")
def document_order_of_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, order, offset, limit, references, projection."""
    read = stored(spark, sf_dir).read(["customer", {"c_acctbal": {"$gt": 0}}], order_by="c_acctbal", offset=5, limit=20, projection=["c_custkey"])
    return fields(read, c_custkey=("c_custkey", "long"), n=("c_name", "string")).select("c_custkey", F.col("n").isNotNull().alias("has_name"))


@query("document_sort_by_reference", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name DESC, CAST(s_suppkey AS VARCHAR) DESC LIMIT 15")
def document_sort_by_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole collection is resolved before it is ordered, so a reference's field can order it."""
    read = stored(spark, sf_dir).read("supplier", order_by="nation.n_name", order_direction="desc", limit=15)
    return fields(read, **SUPPLIER_PATHS, n_name=("nation.n_name", "string"))


@query("document_stored_order", "SELECT s_suppkey FROM supplier ORDER BY CAST(s_suppkey AS VARCHAR) LIMIT 5 OFFSET 3")
def document_stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an order, offset and limit take records in stored order."""
    return fields(stored(spark, sf_dir).read("supplier", hydrate=False, offset=3, limit=5), **SUPPLIER_PATHS)


@query("document_page", "SELECT c_custkey FROM customer ORDER BY c_mktsegment, CAST(c_custkey AS VARCHAR) LIMIT 30 OFFSET 30")
def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = stored(spark, sf_dir)
    first = scope.read([Filter.drawer("customer"), Filter.query({})], order_by="c_mktsegment", page_size=30, hydrate=False)
    second = scope.read([Filter.drawer("customer"), Filter.query({})], order_by="c_mktsegment", page_size=30, cursor=first.next_cursor, hydrate=False)
    return fields(second.rows, c_custkey=("c_custkey", "long"))


@query("document_lookup", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A secondary key's lookup."""
    return fields(stored(spark, sf_dir).lookup("supplier", "nation", "@nation:3"), **SUPPLIER_PATHS)


@query("document_percentiles", "SELECT c_mktsegment AS segment, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY 1")
def document_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents feed aggregates like any frame."""
    rows = fields(stored(spark, sf_dir).documents("customer"), segment=("c_mktsegment", "string"), bal=("c_acctbal", "double")).withColumn("one", F.lit(1))
    top = measure.weighted_percentiles(rows, "segment", "bal", "one")
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.max("bal").alias("top")).join(top.select("segment"), "segment")


# Filters ------------------------------------------------------------------------


@query("filter_reference_object", "SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def filter_reference_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object with only an ``_id`` means the pointer; the field's name tells the collection."""
    return fields(stored(spark, sf_dir).read(["supplier", {"nation": {"_id": "3"}}], hydrate=False), **SUPPLIER_PATHS)


@query("filter_in_references", "SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2) OR c_nationkey = 4")
def filter_in_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``$in`` takes keys, pointers and reference objects alike."""
    return fields(stored(spark, sf_dir).read(["customer", {"nation": {"$in": ["1", "@nation:2", {"_id": "4"}]}}], hydrate=False), c_custkey=("c_custkey", "long"))


@query("filter_operator_object", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal < 5000 AND c_mktsegment <> 'BUILDING'")
def filter_operator_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operators of one object hold together."""
    return fields(stored(spark, sf_dir).read(["customer", {"c_acctbal": {"$gte": 0, "$lt": 5000}, "c_mktsegment": {"$ne": "BUILDING"}}], hydrate=False), c_custkey=("c_custkey", "long"))


@query("filter_number_kinds", "SELECT n_nationkey, n_nationkey % 2 = 0 AS whole FROM nation")
def filter_number_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7 and 7.0 stay apart, through an edit of another field and through a bulk upsert too."""
    scope = cloned(spark, sf_dir)
    text = F.expr("concat('{\"_id\":\"', n_nationkey, '\",\"n_nationkey\":', n_nationkey, ',\"v\":', if(n_nationkey % 2 = 0, '7', '7.0'), '}')")
    scope.upsert_frame(load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.parse_json(text).alias("doc")), "kinds")
    scope.upsert({"edited": True}, [Filter.drawer("kinds"), Filter.query({"n_nationkey": {"$gte": 0}})], multi=True)
    out = None
    for value, whole in ((7, True), (7.0, False)):
        part = fields(scope.read(["kinds", {"v": value}]), n_nationkey=("n_nationkey", "int")).withColumn("whole", F.lit(whole))
        out = part if out is None else out.unionByName(part)
    return out


@query("filter_scalar_array", "SELECT 'array' AS form, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'scalar', 0 UNION ALL SELECT 'longer', 0 UNION ALL SELECT 'field', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_scalar_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar never matches an array's element; arrays match whole."""
    scope = cloned(spark, sf_dir)
    rows = load(spark, sf_dir, "customer")
    scope.upsert_frame(as_documents(rows, F.col("c_custkey"), tags=F.array("c_mktsegment"), field=F.col("c_mktsegment")), "tagged")
    asked = {"array": {"tags": ["BUILDING"]}, "scalar": {"tags": "BUILDING"}, "longer": {"tags": ["BUILDING", "BUILDING"]}, "field": {"field": "BUILDING"}}
    return spark.createDataFrame([(n, scope.count(["tagged", q])) for n, q in asked.items()], "form string, n long")


_NATIONS = "(SELECT count(*) FROM nation)"


@query(
    "filter_target_forms",
    cases_sql({n: _NATIONS for n in ("name", "at", "object", "dict")} | {n: "(SELECT count(*) FROM nation WHERE n_nationkey = 1)" for n in ("pair", "pointer", "id", "many", "path")}),
)
def filter_target_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the forms in which a collection or a record can be named."""
    scope = stored(spark, sf_dir)
    forms = {
        "name": "nation", "at": "@nation", "object": {"drawer": "nation"}, "dict": Filter.of_dict({"drawer": "nation"}), "pair": ("nation", "1"), "pointer": "@nation:lnk_1",
        "id": {"_id": "@nation:1"}, "many": ["nation", ["@nation:1"]], "path": Filter.of_dict({"drawer": "nation", "query": {"n_nationkey": 1}}),
    }
    return cases(spark, [(n, scope.count(f)) for n, f in forms.items()])


_BAD = {
    "two queries": [Filter.query({"a": 1}), Filter.query({"b": 1}), "nation"],
    "two collections": ["nation", "region"],
    "pointer elsewhere": ["region", "@nation:1"],
    "operator": ["nation", {"n_name": {"$regex": "x"}}],
    "in": ["nation", {"n_name": {"$in": "x"}}],
    "nested operator": ["nation", {"a": {"b": {"$like": 1}}}],
    "not an object": [Filter.drawer("nation"), Filter.query(["x"])],
    "pointer": "@nation:a:b",
    "no collection": Filter.query({"a": 1}),
    "unknown collection": "moon",
}


@query("filter_validation", cases_sql({n: "'true'" for n in _BAD} | {"good": "'false'", "of_dict keeps queries": "'true'"}))
def filter_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = stored(spark, sf_dir)
    rows = [(n, refused(lambda f=f: scope.count(f))) for n, f in _BAD.items()]
    return cases(spark, [*rows, ("good", refused(lambda: scope.count(["nation", {"n_name": {"$in": ["x"]}}]))), ("of_dict keeps queries", Selection.of(Filter.of_dict({"_id": "x"})).query == {"_id": "x"})])


@query("inferred_collections", "SELECT DISTINCT lower(c_mktsegment) || s AS field, CASE WHEN s = 'ies' THEN lower(c_mktsegment) || 'y' WHEN s = 's' THEN lower(c_mktsegment) ELSE lower(c_mktsegment) || s END AS collection FROM customer, (VALUES ('s'), ('ies'), ('ss'), ('us'), ('x')) t(s)")
def inferred_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection that a field's name suggests."""
    names = [r[0].lower() for r in load(spark, sf_dir, "customer").select("c_mktsegment").distinct().collect()]
    return spark.createDataFrame([(n + s, P.inferred_collection(n + s)) for n in names for s in ("s", "ies", "ss", "us", "x")], "field string, collection string")


# Writing ------------------------------------------------------------------------


@query("upsert_plain_ids", "SELECT c_custkey, '@nation:' || c_nationkey AS nation, '@segment:' || c_mktsegment AS segment FROM customer")
def upsert_plain_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain ids of declared fields become pointers: one or several, whatever the size of the batch."""
    scope = cloned(spark, sf_dir)
    scope.set_schema("buyer", {"required": ["c_custkey"], "properties": {"c_custkey": {"type": "integer"}}})
    scope.alter("buyer", "add", "relationship", "nation", {"type": "M:1", "target_drawer": "nation"})
    scope.alter("buyer", "add", "relationship", "segments", {"type": "M:M", "target_drawers": ["segment", "tag"], "target_drawer": "segment"})
    rows = load(spark, sf_dir, "customer")
    scope.upsert_frame(as_documents(rows, F.col("c_custkey"), c_custkey=F.col("c_custkey"), nation=F.col("c_nationkey").cast("string"), segments=F.array("c_mktsegment")), "buyer")
    return fields(scope.documents("buyer"), c_custkey=("c_custkey", "long"), nation=("nation", "string"), segment=("segments[0]", "string"))


@query("upsert_nested", "SELECT 'supplier' AS collection, CAST(s_suppkey AS VARCHAR) AS id, '@land:' || s_nationkey AS value FROM supplier UNION ALL SELECT 'land', CAST(n_nationkey AS VARCHAR), n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def upsert_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records nested in those of a batch are stored in their own collections, once each."""
    scope = cloned(spark, sf_dir)
    rows = load(spark, sf_dir, "supplier").join(load(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    land = F.struct(P.pointer_to("land", F.col("n_nationkey").cast("string")).alias("_id"), "n_name")
    scope.upsert_frame(as_documents(rows, F.col("s_suppkey"), land=land), "vendor")
    vendors = fields(scope.documents("vendor"), id=("_id", "string"), value=("land", "string")).withColumn("collection", F.lit("supplier"))
    lands = fields(scope.documents("land"), id=("_id", "string"), value=("n_name", "string")).withColumn("collection", F.lit("land"))
    return vendors.unionByName(lands).select("collection", "id", "value")


@query("upsert_children", "SELECT r_regionkey, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")
def upsert_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children of a 1:M field are stored with the way back, and not with the parent."""
    scope = cloned(spark, sf_dir)
    scope.engine.create(scope.database, "main", "area")
    scope.alter("area", "add", "relationship", "lands", {"type": "1:M", "target_drawer": "land", "mapped_by": "area"})
    lands = load(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("_id"), "n_name")).alias("lands"))
    scope.upsert_frame(as_documents(lands, F.col("n_regionkey"), lands=F.col("lands")), "area")
    assert scope.documents("area").where("variant_get(doc, '$.lands', 'variant') IS NOT NULL").isEmpty()
    back = fields(scope.documents("land"), area=("area", "string"), n_name=("n_name", "string"))
    return back.select(P.pointer_key(F.col("area")).cast("int").alias("r_regionkey"), "n_name")


@query("upsert_targets", "SELECT 'nation' AS collection, CAST(n_nationkey AS VARCHAR) AS id, CASE WHEN n_nationkey = 1 THEN 'CHANGED' ELSE n_name END AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region UNION ALL VALUES ('region', '90', 'NEW'), ('nation', '91', 'NEWER')")
def upsert_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch for several collections: a record's own pointer says where it goes."""
    scope = cloned(spark, sf_dir)
    scope.upsert([{"_id": "@region:90", "r_name": "NEW"}, {"_id": "@nation:1", "n_name": "CHANGED"}, {"_id": "@nation:lnk_91", "n_name": "NEWER"}])
    nation = fields(scope.documents("nation"), id=("_id", "string"), name=("n_name", "string")).withColumn("collection", F.lit("nation"))
    region = fields(scope.documents("region"), id=("_id", "string"), name=("r_name", "string")).withColumn("collection", F.lit("region"))
    return nation.unionByName(region).select("collection", "id", "name")


@query("upsert_by_query", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'debtor' END AS state, s_name FROM supplier UNION ALL VALUES (NULL, 'made', NULL)")
def upsert_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's changes are set on all it matches; if it matches nothing the record is made, once."""
    scope = cloned(spark, sf_dir)
    if scope.count(["supplier", {"s_acctbal": {"$lt": 0}}]):
        scope.upsert({"state": "debtor", "_id": "ignored"}, ["supplier", {"s_acctbal": {"$lt": 0}}], multi=True)
    for _ in range(2):
        scope.upsert({"state": "made"}, ["supplier", {"state": "made"}])
    scope.upsert({"state": "never"}, ["supplier", {"state": "never"}], create_if_missing=False)
    return fields(scope.documents("supplier"), s_suppkey=("s_suppkey", "long"), state=("state", "string"), s_name=("s_name", "string"))


@query("bulk_atomic", cases_sql({"refused": "'true'", "not atomic refused": "'true'", "atomic count": _NATIONS, "not atomic count": "(SELECT count(*) + 1 FROM nation)"}))
def bulk_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refused batch writes nothing; without atomicity what came before stays."""
    scope = cloned(spark, sf_dir)
    scope.set_schema("nation", {"properties": {"n_name": {"type": "string"}}})
    batch = [{"_id": "90", "n_name": "A"}, {"_id": "91", "n_name": 5}, {"_id": "92", "n_name": "B"}]
    out = [("refused", refused(lambda: scope.upsert(batch, "nation"))), ("atomic count", scope.count("nation"))]
    return cases(spark, [*out, ("not atomic refused", refused(lambda: scope.upsert(batch, "nation", atomic=False))), ("not atomic count", scope.count("nation"))])


@query("generated_ids", "SELECT CAST(count(*) AS BIGINT) AS records, CAST(count(*) AS BIGINT) AS ids, 32 AS shortest FROM customer")
def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without an id get one of their own."""
    scope = cloned(spark, sf_dir)
    rows = load(spark, sf_dir, "customer").select(F.lit(None).cast("string").alias("_id"), F.parse_json(F.to_json(F.struct("c_name"))).alias("doc"))
    scope.upsert_frame(rows, "anonymous")
    return scope.documents("anonymous").agg(F.count("*").alias("records"), F.countDistinct("_id").alias("ids"), F.min(F.length("_id")).alias("shortest"))


@query("write_timestamps", "SELECT n_nationkey, n_nationkey % 2 = 0 AS touched, true AS stamped, true AS kept FROM nation")
def write_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first write sets both times; a later one only the second."""
    scope = cloned(spark, sf_dir)
    scope.set_schema("stamped", {})
    scope.alter("stamped", "add", "timestamp")
    rows = load(spark, sf_dir, "nation")
    scope.upsert_frame(as_documents(rows, F.col("n_nationkey"), n_nationkey=F.col("n_nationkey"), even=F.expr("n_nationkey % 2 = 0")), "stamped")
    first = fields(scope.documents("stamped"), k=("n_nationkey", "int"), c0=("created_at", "string"), u0=("updated_at", "string"))
    scope.upsert({"seen": 1}, ["stamped", {"even": True}], multi=True)
    now = fields(scope.documents("stamped"), n_nationkey=("n_nationkey", "int"), c1=("created_at", "string"), u1=("updated_at", "string"))
    met = now.join(first, F.col("n_nationkey") == F.col("k"))
    return met.select("n_nationkey", (F.col("u1") > F.col("u0")).alias("touched"), (F.col("c0") == F.col("u0")).alias("stamped"), (F.col("c1") == F.col("c0")).alias("kept"))


@query("noted_aliases", "SELECT 'supplier' AS collection, 'nation' AS field UNION ALL SELECT 'nation', 'region' UNION ALL SELECT 'customer', 'nation'")
def noted_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undeclared fields that hold pointers are remembered."""
    scope = stored(spark, sf_dir)
    return spark.createDataFrame([(n, f) for n in STORED for f in scope.inspect(n)["meta"]["aliases"]], "collection string, field string")


@query("schema_documents", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def schema_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a schema refuses."""
    schema = {
        "required": ["c_name"], "additionalProperties": False,
        "properties": {"c_custkey": {"type": "integer"}, "c_name": {"type": "string", "minLength": 3}, "c_acctbal": {"type": "number", "minimum": 0, "maximum": 9000}, "c_mktsegment": {"enum": ["BUILDING", "MACHINERY"]}, "nation": {}},
    }
    return fields(constraints.document_errors(stored(spark, sf_dir).documents("customer"), schema, {"nation": {"type": "M:1", "target_drawers": ["land", "nation"]}}), c_custkey=("c_custkey", "long"))


_LAWS = {"unique": "'true'", "unique swap": "'false'", "required": "'true'", "one to one": "'true'", "wrong target": "'true'", "allowed target": "'false'", "not an array": "'true'", "no pointer": "'true'", "count": _NATIONS}


@query("write_constraints", cases_sql(_LAWS))
def write_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique and required fields, 1:1, M:1 and M:M references: what is refused and what is not."""
    scope = cloned(spark, sf_dir)
    scope.alter("nation", "add", "constraint", "n_nationkey", {"constraint": "unique"})
    scope.alter("nation", "add", "constraint", "n_name", {"constraint": "required"})
    scope.alter("nation", "add", "relationship", "capital", {"type": "1:1", "target_drawer": "city"})
    scope.alter("nation", "add", "relationship", "ally", {"type": "M:1", "target_drawers": ["nation", "region"]})
    scope.alter("nation", "add", "relationship", "friends", {"type": "M:M", "target_drawer": "nation"})

    def put(*records: dict) -> bool:
        return refused(lambda: scope.upsert([{"n_name": "X", **r} for r in records], "nation"))

    rows = [
        ("unique", put({"_id": "90", "n_nationkey": 3})), ("unique swap", put({"_id": "1", "n_nationkey": 2}, {"_id": "2", "n_nationkey": 1})), ("required", put({"_id": "90", "n_name": None})),
        ("one to one", put({"_id": "3", "capital": "rome"}, {"_id": "4", "capital": "@city:rome"})), ("wrong target", put({"_id": "90", "ally": "@supplier:1"})),
        ("allowed target", put({"_id": "0", "ally": "@region:1"})), ("not an array", put({"_id": "90", "friends": "@nation:1"})), ("no pointer", put({"_id": "90", "capital": 5})),
    ]
    return cases(spark, [*rows, ("count", scope.count("nation"))])


# Deleting -----------------------------------------------------------------------


def _family(scope: Scope, action: str) -> None:
    """Regions have nations and nations suppliers, by 1:M fields with a delete rule."""
    for parent, child in (("region", "nation"), ("nation", "supplier")):
        scope.alter(parent, "add", "relationship", f"{child}s", {"type": "1:M", "target_drawer": child, "mapped_by": parent})
        scope.alter(parent, "add", "cascade-delete", f"{child}s", {"action": action})


def _left(scope: Scope, *names: str) -> DataFrame:
    out = None
    for name in names:
        part = scope.documents(name).select(F.lit(name).alias("collection"), F.col("_id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("documents_cascade", "SELECT 'region' AS collection, CAST(r_regionkey AS VARCHAR) AS id FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def documents_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = cloned(spark, sf_dir)
    _family(scope, "Cascade")
    scope.delete("@region:1")
    return _left(scope, "region", "nation", "supplier")


@query("documents_cascade_forward", "SELECT 'nation' AS collection, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey > 4 UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey <= 4)")
def documents_cascade_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule on a record's own reference deletes what it points at."""
    scope = cloned(spark, sf_dir)
    scope.alter("nation", "add", "cascade-delete", "region")
    scope.delete(["nation", {"n_nationkey": {"$lte": 4}}])
    return _left(scope, "nation", "region")


@query("documents_set_null", "SELECT s_suppkey, CASE WHEN n_regionkey <> 2 THEN '@nation:' || s_nationkey END AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def documents_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = cloned(spark, sf_dir)
    scope.alter("nation", "add", "relationship", "suppliers", {"type": "1:M", "target_drawer": "supplier", "mapped_by": "nation"})
    scope.alter("nation", "add", "cascade-delete", "suppliers", {"action": "SetNull"})
    scope.delete(["nation", {"region": "@region:2"}])
    return fields(scope.documents("supplier"), **SUPPLIER_PATHS, nation=("nation", "string"))


_HELD = "EXISTS (SELECT 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1)"


@query("documents_rule_order", cases_sql({"refused": f"{_HELD}", "regions": f"CASE WHEN {_HELD} THEN (SELECT count(*) FROM region) ELSE (SELECT count(*) - 1 FROM region) END", "nations": f"CASE WHEN {_HELD} THEN {_NATIONS} ELSE (SELECT count(*) FROM nation WHERE n_regionkey <> 1) END", "suppliers": "(SELECT count(*) FROM supplier)"}))
def documents_rule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restrict, two steps down a cascade, refuses the whole request before anything goes."""
    scope = cloned(spark, sf_dir)
    _family(scope, "Cascade")
    scope.alter("nation", "add", "cascade-delete", "suppliers", {"action": "Restrict"})
    rows = [("refused", refused(lambda: scope.delete("@region:1")))]
    return cases(spark, [*rows, ("regions", scope.count("region")), ("nations", scope.count("nation")), ("suppliers", scope.count("supplier"))])


# Catalog ------------------------------------------------------------------------

_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS drawer, count(*) AS record_count FROM {t}" for t in STORED)


@query("store_structure", _COUNTS_SQL)
def store_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema's collections, with their records."""
    return base(spark, sf_dir).structure("base", "main").select("drawer", "record_count")


@query("store_inventory", f"SELECT *, true AS has_bytes, true AS has_files FROM ({_COUNTS_SQL})")
def store_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).store.inventory().where("database = 'base'")
    return rows.select("drawer", "record_count", (F.col("bytes") > 0).alias("has_bytes"), (F.col("files") > 0).alias("has_files"))


@query("backup_restore", "SELECT n_nationkey, n_name FROM nation")
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was deleted after a backup is there again."""
    scope = cloned(spark, sf_dir)
    folder = f"{scope.store.root}/_archives/{uuid.uuid4().hex}"
    scope.engine.backup(folder, scope.database)
    scope.delete([Filter.drawer("nation"), Filter.query({})])
    scope.engine.drop(scope.database, "main", "region")
    scope.engine.restore(folder)
    return fields(scope.read("nation", hydrate=False), n_nationkey=("n_nationkey", "int"), n_name=("n_name", "string"))


@query("migrate_prefixes", "SELECT CAST(n_nationkey AS VARCHAR) AS id, '@region:' || n_regionkey AS region, 'lnk_' || n_name AS name FROM nation")
def migrate_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and pointers of old stores lose their prefix when a collection is compacted; other texts keep it."""
    scope = cloned(spark, sf_dir)
    rows = as_documents(load(spark, sf_dir, "nation"), F.expr("concat('lnk_', n_nationkey)"), region=F.expr("concat('@region:lnk_', n_regionkey)"), name=F.expr("concat('lnk_', n_name)"))
    m, drawers = scope._state()
    path = scope.store.write(m, rows.select("_id", F.lit(0).cast("long").alias("_seq"), "doc"))
    drawers["nation"] = {**drawers["nation"], "path": path, "changes": []}
    scope.store.commit(m)
    scope.compact("nation")
    return scope.documents("nation").select(F.col("_id").alias("id"), F.variant_get("doc", "$.region", "string").alias("region"), F.variant_get("doc", "$.name", "string").alias("name"))


@query("catalog_names", cases_sql({"created": "'[\"a\",\"a/b\"]'", "schemas": "'[\"x\"]'", "no parent": "'true'", "bad names": "'[true,true,true,true,true]'", "implicit": _NATIONS, "dropped": "'[true,false]'", "left": _NATIONS, "drawers": "'[\"a/b/x/nation\"]'", "garbage": "1"}))
def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases, schemas and collections: made, implied by a write, refused, dropped, and what is left of others."""
    e = new_engine(spark)
    rows = load(spark, sf_dir, "nation")
    out = [("no parent", refused(lambda: e.create("a", "x")))]
    for name in ("a", "a/b"):
        e.create(name)
        e.create(name, "x")
        e.scope(f"{name}/x").upsert_frame(as_documents(rows, F.col("n_nationkey"), n=F.col("n_name")), "nation")
    out += [("created", [r.name for r in e.structure().collect()]), ("schemas", [r.name for r in e.structure("a").collect()])]
    out += [("bad names", [refused(lambda n=n: e.create("a", "x", n)) for n in ("p/q", "..", "d_index", "d_meta", " ")]), ("implicit", e.scope("a/x").count("nation"))]
    out += [("dropped", [e.drop("a")["removed"], e.drop("a")["removed"]]), ("garbage", len(e.store.collect_garbage())), ("left", e.scope("a/b/x").count("nation")), ("drawers", e.status()["drawers"])]
    return cases(spark, out)


@query("tenants_and_namespaces", cases_sql({"tenant": _NATIONS, "unknown tenant": "'true'", "unknown database": "'true'", "namespace": "1", "stored as": "'[\"nation\",\"ns_nation\"]'", "outside": _NATIONS}))
def tenants_and_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = new_engine(spark)
    e.create("org/db")
    e.create("org/db", "x")
    e.scope("org/db/x").upsert_frame(as_documents(load(spark, sf_dir, "nation"), F.col("n_nationkey"), n=F.col("n_name")), "nation")
    e.store.create_tenant("t", "org")
    ns = e.scope("org/db/x", namespace="ns")
    ns.upsert({"_id": "1"}, "nation")
    rows = [("tenant", e.scope("db/x", tenant="t").count("nation")), ("unknown tenant", refused(lambda: e.scope("db/x", tenant="u"))), ("unknown database", refused(lambda: e.scope("no/x", tenant="t")))]
    rows += [("namespace", ns.count("nation")), ("stored as", sorted(r.drawer for r in e.structure("org/db", "x").collect())), ("outside", e.scope("org/db/x").count("nation"))]
    return cases(spark, rows)


@query("altered_definitions", cases_sql({"indexes": "'[\"n_name\"]'", "triggers": "'[]'", "unique": "'[\"n_nationkey\"]'", "required": "'[\"n_name\"]'", "timestamps": "'true'", "refused": "'[true,true,true,true]'", "records": _NATIONS}))
def altered_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = cloned(spark, sf_dir)
    scope.alter("nation", "add", "index", "n_name")
    scope.alter("nation", "add", "trigger", "on", {"event": "insert"})
    scope.alter("nation", "remove", "trigger", "on")
    scope.alter("nation", "add", "key", "n_nationkey", {"key_type": "secondary"})
    scope.alter("nation", "add", "constraint", "n_name", {"constraint": "not_null"})
    scope.alter("nation", "add", "timestamps")
    bad = [("nation", "add", "view", "x", None), ("nation", "twist", "index", "x", None), ("moon", "add", "index", "x", None), ("nation", "add", "key", "n_name", {"key_type": "primary"})]
    seen = scope.inspect("nation")
    meta = seen["meta"]
    rows = [("indexes", sorted(meta["extensions"]["index"])), ("triggers", sorted(meta["extensions"]["trigger"])), ("unique", meta["unique"]), ("required", meta["schema"]["required"]), ("timestamps", meta["timestamps"])]
    return cases(spark, [*rows, ("refused", [refused(lambda b=b: scope.alter(*b)) for b in bad]), ("records", seen["record_count"])])


@query("status_and_upkeep", cases_sql({"databases": "'[\"db\"]'", "bytes add up": "'true'", "kinds": "'[\"data\",\"manifest\",\"other\",\"work\"]'", "one snapshot": "1", "records": "(SELECT count(*) FROM supplier WHERE s_acctbal >= 0)", "files of one": "'true'"}))
def status_and_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, the breakdown of storage, and what compaction leaves."""
    e = new_engine(spark)
    e.create("db")
    e.create("db", "x")
    scope = e.scope("db/x")
    scope.upsert_frame(as_documents(load(spark, sf_dir, "supplier"), F.col("s_suppkey"), bal=F.col("s_acctbal")), "supplier")
    scope.delete(["supplier", {"bal": {"$lt": 0}}])
    status = e.status()
    rows = [("databases", status["databases"]), ("kinds", sorted(status["storage_by_kind"])), ("bytes add up", sum(status["storage_by_kind"].values()) == status["storage"]["bytes"])]
    scope.compact()
    return cases(spark, [*rows, ("one snapshot", len(e.store.files.names(f"{e.store.root}/data"))), ("records", scope.count("supplier")), ("files of one", scope.inspect("supplier")["files"] > 0)])


@query("users_and_grants", cases_sql({"granted": "'[\"base:ru\"]'", "revoked": "'[]'", "refused": "'[true,true,true]'", "dropped": "'[true,false]'", "reads": _NATIONS}))
def users_and_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rights are kept and not enforced."""
    e = base(spark, sf_dir)
    user = uuid.uuid4().hex

    def held() -> list[str]:
        return e.store.manifest()["users"][user]["permissions"]

    e.store.access("create_user", {"username": user})
    e.grant(user, "base:ru")
    e.grant(user, "base:ru")
    rows: list[tuple[str, object]] = [("granted", held()), ("refused", [refused(lambda s=s: e.grant(user, s)) for s in ("base:rr", "base:x", "base")])]
    e.revoke(user, "base:ru")
    rows += [("revoked", held()), ("dropped", [e.store.access("drop_user", {"user": user})["removed"] for _ in range(2)])]
    return cases(spark, [*rows, ("reads", e.scope("base/main").count("nation"))])


@query("status_parts", cases_sql({"databases": "'[\"db\",\"db/in\"]'", "schemas": "'[\"x\",\"y\"]'", "drawers": "'[\"nation\"]'", "names": "'[\"db/in/x/nation\",\"db/x/nation\"]'", "storage": "'[2,\"ok\",true]'", "log": "'true'", "paths": "'[\"database\",\"schema\",\"drawer\"]'", "there": "'true'", "refused": "'[true,true]'", "attached": "1", "orphans": "0"}))
def status_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by part, the check of paths, and folders that no manifest names."""
    e = new_engine(spark)
    rows = load(spark, sf_dir, "nation")
    for name, schema in (("db", "x"), ("db", "y"), ("db/in", "x")):
        e.create(name)
        e.create(name, schema)
    for path in ("db/x", "db/in/x"):
        e.scope(path).upsert_frame(as_documents(rows, F.col("n_nationkey"), n=F.col("n_name")), "nation")
    storage, checks = e.status("storage"), [e.status("path", p) for p in ("db/in", "db/x", "db/in/x/nation")]
    out = [("databases", e.status("databases")), ("schemas", e.status("schemas", "db")), ("drawers", e.status("drawers", "db", "x")), ("names", e.status("drawer_names")), ("log", e.status("log")["ok"])]
    out += [("storage", [storage["drawer_count"], storage["status"], storage["data_bytes"] > 0]), ("paths", [c["kind"] for c in checks]), ("there", all(x["exists"] and x["bytes"] > 0 for c in checks for x in c["entries"]))]
    out += [("refused", [refused(lambda: e.status("path", "db/x/nation/more/yet")), refused(lambda: e.status("weather"))]), ("attached", e.attach("nation", rows, "n_nationkey").status("attached"))]
    return cases(spark, [*out, ("orphans", e.store.discover().where("collection IS NULL").count())])


@query("compact_path", "SELECT 'db/x/nation' AS collection, count(*) AS n, 1 AS folders FROM nation WHERE n_nationkey > 3 UNION ALL SELECT 'db/x/region', count(*), 1 FROM region UNION ALL SELECT 'db/y/nation', count(*), 1 FROM nation")
def compact_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database's collections are compacted at once: changes become one snapshot each, what is left over goes."""
    e = Engine(spark, new_engine(spark).store.root, {"merge_share": 1e9, "most_changes": 50, "logging": {"level": "off"}})
    e.create("db")
    for schema, names in (("x", ("nation", "region")), ("y", ("nation",))):
        e.create("db", schema)
        for name in names:
            key = STORED[name][0]
            e.scope(f"db/{schema}").upsert_frame(as_documents(load(spark, sf_dir, name), F.col(key), k=F.col(key)), name)
    e.scope("db/x").delete(["nation", {"k": {"$lte": 3}}])
    e.compact("db")
    rows = [(f"db/{s}/{d}", e.scope(f"db/{s}").count(d), len(e.status("path", f"db/{s}/{d}")["entries"])) for s, d in (("x", "nation"), ("x", "region"), ("y", "nation"))]
    return spark.createDataFrame(rows, "collection string, n long, folders int")
