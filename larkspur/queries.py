"""Registered queries over the driver's tables, each with its SQL twin.

Every query goes through the engine's own operators; results are flat columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur import stored_queries
from larkspur.functions import pointers as P
from larkspur.operators import constraints, delete, measure, read, relate, write
from larkspur.plans.filters import Filter
from larkspur.plans.options import Options
from larkspur.plans.predicates import Compiler, where
from larkspur.session import Engine

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
TABLES = (*KEYS, "lineitem")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """The named tables as typed collections."""
    out = Engine(spark)
    for name in names:
        out.attach(name, load(spark, sf_dir, name), KEYS.get(name))
    return out


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def filtered(name: str, table: str, columns: list[str], conditions: dict, sql_where: str) -> None:
    """A query that filters a table and projects columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, table)
        return e.read([table, Filter.query(conditions)]).select(*columns)

    query(name, f"SELECT {', '.join(columns)} FROM {table} WHERE {sql_where}")(run)


LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
filtered("filter_eq", "orders", ["o_orderkey", "o_orderstatus"], {"o_orderstatus": "F"}, "o_orderstatus = 'F'")
filtered("filter_wildcard_prefix", "part", ["p_partkey", "p_name"], {"p_name": "small%"}, "p_name LIKE 'small%'")
filtered("filter_wildcard_suffix", "part", ["p_partkey", "p_name"], {"p_name": "%bolt"}, "p_name LIKE '%bolt'")
filtered("filter_wildcard_literal_underscore", "part", ["p_partkey", "p_name"], {"p_name": "small_%"}, "p_name LIKE 'small^_%' ESCAPE '^'")
filtered("filter_wildcard_inner", "part", ["p_partkey", "p_name"], {"p_name": "%a%t%"}, "p_name LIKE '%a%t%'")
filtered("filter_range", "lineitem", LINE, {"l_quantity": {"$gte": 10, "$lte": 20}}, "l_quantity BETWEEN 10 AND 20")
filtered("filter_open_range", "lineitem", LINE, {"l_quantity": {"$gt": 10, "$lt": 12}}, "l_quantity > 10 AND l_quantity < 12")
filtered("filter_ne", "customer", ["c_custkey", "c_mktsegment"], {"c_mktsegment": {"$ne": "BUILDING"}}, "c_mktsegment <> 'BUILDING'")
filtered("filter_in", "orders", ["o_orderkey", "o_orderpriority"], {"o_orderpriority": {"$in": ["1-URGENT", "5-LOW"]}}, "o_orderpriority IN ('1-URGENT', '5-LOW')")
filtered("filter_in_numbers", "nation", ["n_nationkey", "n_name"], {"n_regionkey": {"$in": [1, 3]}}, "n_regionkey IN (1, 3)")
filtered("filter_in_wildcard", "part", ["p_partkey", "p_name"], {"p_name": {"$in": ["cold%", "large%"]}}, "p_name LIKE 'cold%' OR p_name LIKE 'large%'")
filtered(
    "filter_and", "orders", ["o_orderkey", "o_orderstatus", "o_totalprice"],
    {"o_orderstatus": "O", "o_totalprice": {"$gte": 100000}, "o_orderpriority": {"$in": ["1-URGENT", "2-HIGH"]}},
    "o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
filtered("filter_kind_mismatch", "orders", ["o_orderkey"], {"o_orderstatus": {"$gt": 5}}, "false")
filtered("filter_kind_mismatch_ne", "orders", ["o_orderkey"], {"o_orderstatus": {"$ne": 5}}, "true")
filtered("filter_missing_path", "orders", ["o_orderkey"], {"no_such_field": {"$ne": 1}}, "false")
filtered("filter_empty", "region", ["r_regionkey", "r_name"], {}, "true")
filtered("filter_empty_range", "lineitem", LINE, {"l_quantity": {"$gt": 5, "$lt": 3}}, "false")
filtered("filter_eq_operator", "supplier", ["s_suppkey", "s_name"], {"s_nationkey": {"$eq": 3.0}}, "s_nationkey = 3")
filtered("pk_lookup", "customer", ["c_custkey", "c_name"], {"_id": "1"}, "c_custkey = 1")


@query("filter_json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def filter_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    return where(docs, {"k": {"$gte": 50}}, doc="doc").select("event_id", F.variant_get("doc", "$.k", "long").alias("k"))


_KINDS_SQL = "CASE c_custkey % 4 WHEN 0 THEN '{\"v\": 7}' WHEN 1 THEN '{\"v\": \"7\"}' WHEN 2 THEN '{\"v\": null}' ELSE '{}' END"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", F.parse_json(F.expr(_KINDS_SQL)).alias("doc"))


@query("filter_document_kinds", "SELECT c_custkey, 'number' AS matched FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'null' FROM customer WHERE c_custkey % 4 = 2 UNION ALL SELECT c_custkey, 'ne' FROM customer WHERE c_custkey % 4 IN (1, 2)")
def filter_document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, text, null and missing values stay apart in documents."""
    docs, out = _kinds(spark, sf_dir), None
    for name, q in (("number", {"v": 7}), ("null", {"v": None}), ("ne", {"v": {"$ne": 7}})):
        part = where(docs, q, doc="doc").select("c_custkey", F.lit(name).alias("matched"))
        out = part if out is None else out.unionByName(part)
    return out


@query("filter_document_nested", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def filter_document_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested objects match by subset, arrays element by element with wildcards."""
    docs = load(spark, sf_dir, "orders").select(
        "o_orderkey", F.parse_json(F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("s"), F.lit(1).alias("x")).alias("a"), F.array("o_orderpriority").alias("p")))).alias("doc")
    )
    return where(docs, {"a": {"s": "F"}, "p": ["1%"]}, doc="doc").select("o_orderkey")


@query("multi_pointer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (7, 3)")
def multi_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "customer").read(["@customer:7", "@customer:3", "@customer:-1"]).select("c_custkey", "c_name")


@query("secondary_lookup", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey = 3")
def secondary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.secondary_lookup(load(spark, sf_dir, "supplier"), "s_nationkey", "3").select("s_suppkey", "s_nationkey")


ORDERS_TOP = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC NULLS LAST, CAST(o_orderkey AS VARCHAR) DESC LIMIT 20"


@query("sort_limit", ORDERS_TOP)
def sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    q = ["orders", {"o_orderstatus": "F", "o_totalprice": {"$gte": 100000}}]
    return e.read(q, order_by="o_totalprice", order_direction="desc", limit=20).select("o_orderkey", "o_totalprice")


@query("sort_nulls_last", "SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS b FROM customer) ORDER BY b DESC NULLS LAST, CAST(c_custkey AS VARCHAR) DESC LIMIT 60 OFFSET (SELECT count(*) - 30 FROM customer WHERE c_custkey % 3 <> 0)")
def sort_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows around the place where, at any size, values end and missing ones begin."""
    rows = load(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS b"))
    e = Engine(spark).attach("customer", rows, "c_custkey")
    values = rows.where("b IS NOT NULL").count()
    return e.read("customer", order_by="b", order_direction="desc", offset=values - 30, limit=60).select("c_custkey")


@query("sort_document_kinds", "SELECT c_custkey FROM customer ORDER BY c_custkey % 4 <> 0, CAST(c_custkey AS VARCHAR) LIMIT 40 OFFSET (SELECT count(*) - 20 FROM customer WHERE c_custkey % 4 = 0)")
def sort_document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of the first value that can be ordered decides; the rest comes last: the rows around that place."""
    docs = _kinds(spark, sf_dir).withColumn("_id", F.col("c_custkey").cast("string")).withColumn("_seq", F.col("c_custkey") % 4 * 1_000_000 + F.col("c_custkey"))
    first = docs.where("c_custkey % 4 = 0").count()
    return read.modified(docs, Options.of(order_by="v", offset=first - 20, limit=40), "doc").select("c_custkey")


@query("offset_limit", "SELECT p_partkey FROM part ORDER BY p_retailprice, CAST(p_partkey AS VARCHAR) LIMIT 10 OFFSET 15")
def offset_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "part").read("part", order_by="p_retailprice", offset=15, limit=10).select("p_partkey")


@query("page", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 50")
def page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "orders").read("orders", order_by="o_totalprice", page=3, page_size=25).rows.select("o_orderkey")


@query("cursor", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, CAST(o_orderkey AS VARCHAR) LIMIT 25 OFFSET 25")
def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    first = e.read("orders", order_by="o_totalprice", page_size=25)
    return e.read("orders", order_by="o_totalprice", page_size=25, cursor=first.next_cursor).rows.select("o_orderkey")


@query("page_metadata", "SELECT 3 AS page, 25 AS page_size, count(*) > 75 AS has_more FROM orders")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = engine(spark, sf_dir, "orders").read("orders", order_by="o_totalprice", page=3, page_size=25)
    return spark.createDataFrame([(got.page, got.page_size, got.has_more)], "page int, page_size int, has_more boolean")


@query("project_include", "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_acctbal FROM customer")
def project_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "customer").read("customer", select=["c_name", "c_acctbal"])


@query("project_exclude", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def project_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "customer").read("customer", projection=["-_id", "!c_acctbal", "-c_mktsegment", "c_name"])


@query("project_nested", "SELECT CAST(s_suppkey AS VARCHAR) AS _id, s_name AS a_name FROM supplier")
def project_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal")).alias("a"))
    return read.projected(rows, ["a.name"]).select("_id", F.col("a.name").alias("a_name"))


@query("count_filter", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = engine(spark, sf_dir, "orders").count(["orders", {"o_orderstatus": "F"}])
    return spark.createDataFrame([(n,)], "n long")


@query("count_page", "SELECT count(*) AS n FROM (SELECT 1 FROM customer WHERE c_acctbal > 0 LIMIT 40 OFFSET 30)")
def count_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = engine(spark, sf_dir, "customer").count(["customer", {"c_acctbal": {"$gt": 0}}], offset=30, limit=40)
    return spark.createDataFrame([(n,)], "n long")


@query("count_pointers", "SELECT 2 * count(*) AS n FROM customer WHERE c_custkey IN (1, -5)")
def count_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = engine(spark, sf_dir, "customer").count(["@customer:1", "@customer:1", "@customer:-5"])
    return spark.createDataFrame([(n,)], "n long")


@query("exists", "SELECT EXISTS (SELECT 1 FROM part WHERE p_size > 49) AS big, EXISTS (SELECT 1 FROM part WHERE p_size > 9999) AS huge")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "part")
    found = tuple(e.read(["part", {"p_size": {"$gt": n}}], return_shape="exists") for n in (49, 9999))
    return spark.createDataFrame([found], "big boolean, huge boolean")


@query("pointers_shape", "SELECT '@nation:' || n_nationkey AS pointer FROM nation WHERE n_regionkey = 2")
def pointers_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "nation").read(["nation", {"n_regionkey": 2}], return_shape="pointers")


@query("record_shape", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 4")
def record_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "nation").read("@nation:4").select("n_nationkey", "n_name")


@query("hydrate_m1", "SELECT o_orderkey, c_name AS customer_c_name, c_mktsegment AS customer_c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def hydrate_m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relate.hydrate(load(spark, sf_dir, "orders"), "o_custkey", load(spark, sf_dir, "customer"), "customer_", "c_custkey")
    return out.select("o_orderkey", "customer_c_name", "customer_c_mktsegment")


@query("hydrate_chain", "SELECT l_orderkey, l_linenumber, l_partkey, c_name, n_name, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def hydrate_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "lineitem")
    for field, table in (("l_orderkey", "orders"), ("o_custkey", "customer"), ("c_nationkey", "nation"), ("n_regionkey", "region")):
        out = relate.hydrate(out, field, load(spark, sf_dir, table), "", KEYS[table])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "c_name", "n_name", "r_name")


@query("hydrate_missing", "SELECT o_orderkey, coalesce(c_name, '@customer:' || o_custkey) AS customer FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey")
def hydrate_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a record keep their pointer."""
    some = where(load(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING"}).withColumn("_id", F.col("c_custkey").cast("string"))
    rows = load(spark, sf_dir, "orders").withColumn("customer", P.pointer_to("customer", F.col("o_custkey").cast("string")))
    out = relate.hydrate(rows, "customer", some, "c_", pointer_of="customer")
    return out.select("o_orderkey", F.coalesce("c_c_name", "customer").alias("customer"))


@query("hydrate_m2m", "SELECT o.l_orderkey AS order_key, o.pos, o.pk AS part_key, p_name FROM (SELECT l_orderkey, l_partkey AS pk, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) - 1 AS pos FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) o LEFT JOIN part ON pk = p_partkey")
def hydrate_m2m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of pointers keep their order."""
    lists = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.sort_array(F.collect_set("l_partkey")).alias("k"))
    lists = lists.select("_id", F.transform("k", lambda k: P.pointer_to("part", k.cast("string"))).alias("parts"))
    part = load(spark, sf_dir, "part").withColumn("_id", F.col("p_partkey").cast("string"))
    out = relate.hydrate_array(lists, "parts", part, F.struct("p_name"))
    out = out.select(F.col("_id").alias("order_key"), F.explode("parts").alias("p"))
    return out.select("order_key", F.col("p.pos").cast("long").alias("pos"), P.pointer_key(F.col("p.pointer")).cast("long").alias("part_key"), F.col("p.record.p_name").alias("p_name"))


@query("hydrate_polymorphic", "SELECT x.ptr, coalesce(s_name, c_name) AS name FROM (SELECT '@supplier:' || s_suppkey AS ptr, s_suppkey AS sk, NULL AS ck FROM supplier UNION ALL SELECT '@customer:' || c_custkey, NULL, c_custkey FROM customer) x LEFT JOIN supplier ON sk = s_suppkey LEFT JOIN customer ON ck = c_custkey")
def hydrate_polymorphic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "supplier", "customer")
    ptrs = e.read("supplier", return_shape="pointers").unionByName(e.read("customer", return_shape="pointers")).withColumnRenamed("pointer", "ptr")
    targets = {n: e.frame(n) for n in ("supplier", "customer")}
    return relate.hydrate_polymorphic(ptrs, "ptr", targets, {"name": {"supplier": "s_name", "customer": "c_name"}})


@query("hydrate_self", "SELECT a.n_nationkey, b.n_name AS neighbour FROM nation a LEFT JOIN nation b ON a.n_nationkey + 1 = b.n_nationkey")
def hydrate_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").withColumn("next", F.col("n_nationkey") + 1)
    return relate.hydrate(nation, "next", load(spark, sf_dir, "nation"), "b_", "n_nationkey").select("n_nationkey", F.col("b_n_name").alias("neighbour"))


@query("virtual_1m", "SELECT c_custkey, count(o_orderkey) AS orders, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def virtual_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir, "customer").frame("customer").withColumn("_id", F.col("c_custkey"))
    out = relate.child_summary(rows, load(spark, sf_dir, "orders"), "o_custkey", F.count("*").alias("orders"), F.min("o_orderkey").alias("first_order"), F.max("o_orderkey").alias("last_order"))
    return out.select("c_custkey", F.coalesce("orders", F.lit(0).cast("long")).alias("orders"), "first_order", "last_order")


@query("virtual_children", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def virtual_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", "supplier")
    out = relate.virtual_children(e.frame("nation"), "nation", e.frame("supplier"), "s_nationkey", "suppliers", F.struct("s_suppkey"), pointers=False)
    return out.select("n_nationkey", F.explode_outer("suppliers").alias("s")).select("n_nationkey", F.col("s.s_suppkey").alias("s_suppkey"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library workload's books, one per order, over customers as its people."""
    n = "CAST(o_orderkey AS BIGINT)"
    return load(spark, sf_dir, "orders").select(
        F.expr(f"{n} AS book"), F.expr(f"{n} % 150 + 1 AS author_id"), F.expr(f"CASE WHEN {n} % 10 = 0 THEN {n} % 150 ELSE (37 * {n} + 17) % 150 END + 1 AS editor_id"),
        F.expr(f"{n} % 23 + 1 AS quantity"), F.expr(f"{n} % 10 AS purge_bucket"),
    )


_BOOKS_SQL = "(SELECT o_orderkey AS book, o_orderkey % 150 + 1 AS author_id, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey % 150 ELSE (37 * o_orderkey + 17) % 150 END + 1 AS editor_id, o_orderkey % 23 + 1 AS quantity, o_orderkey % 10 AS purge_bucket FROM orders)"


@query("traversal_two_key", f"SELECT book, a.c_name AS author, e.c_name AS editor FROM {_BOOKS_SQL} JOIN customer a ON author_id = a.c_custkey JOIN customer e ON editor_id = e.c_custkey WHERE author_id = editor_id")
def traversal_two_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traversals of the library workload at once: books whose author edits them, with both people."""
    people = load(spark, sf_dir, "customer").select("c_custkey", "c_name")
    same = _books(spark, sf_dir).where("author_id = editor_id")
    out = relate.hydrate(relate.hydrate(same, "author_id", people, "a_", "c_custkey"), "editor_id", people, "e_", "c_custkey")
    return out.where("a_c_custkey IS NOT NULL AND e_c_custkey IS NOT NULL").select("book", F.col("a_c_name").alias("author"), F.col("e_c_name").alias("editor"))


@query("reverse_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def reverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = where(load(spark, sf_dir, "customer"), {"c_acctbal": {"$gt": 9000}})
    return relate.referring(load(spark, sf_dir, "orders"), "o_custkey", rich, "c_custkey").select("o_orderkey", "o_custkey")


@query("reverse_edges", "SELECT '@nation:' || s_nationkey AS parent, 'supplier' AS child, CAST(s_suppkey AS VARCHAR) AS child_id, 's_nationkey' AS field FROM supplier")
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir, "supplier").frame("supplier").withColumn("s_nationkey", P.pointer_to("nation", F.col("s_nationkey").cast("string")))
    return relate.edges(rows, "supplier", "s_nationkey")


@query("pointer_normalize", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '@vip:' || c_custkey ELSE '@customer:' || c_custkey END AS pointer FROM customer")
def pointer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare keys, old prefixes and full pointers become one form."""
    forms = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('@vip:', c_custkey) WHEN 1 THEN concat('lnk_', c_custkey) WHEN 2 THEN concat('@customer:lnk_', c_custkey) ELSE string(c_custkey) END")
    return load(spark, sf_dir, "customer").select("c_custkey", P.normalized(forms, "customer").alias("pointer"))


@query("upsert_replace", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (1, 2) UNION ALL VALUES (1, 'NEW ONE', 0), (2, 'NEW TWO', 1), (99, 'ADDED', 2)")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = spark.createDataFrame([(1, "NEW ONE", 0), (2, "NEW TWO", 1), (99, "ADDED", 2)], "n_nationkey int, n_name string, n_regionkey int")
    return write.replaced(load(spark, sf_dir, "nation"), batch, "n_nationkey")


@query("upsert_merge", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'AMERICAN' ELSE n_name END AS n_name, n_regionkey FROM nation")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation")
    return write.merged(rows, Compiler(rows).compile({"n_regionkey": 1}), {"n_name": "AMERICAN", "_id": "never"})


@query("upsert_create_if_missing", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (77, 'ATLANTIS')")
def upsert_create_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "region")
    for key, name in ((77, "ATLANTIS"), (78, "ASIA")):
        record = spark.createDataFrame([(key, name)], "r_regionkey int, r_name string")
        rows = write.created_if_missing(rows, Compiler(rows).compile({"r_name": name}), record)
    return rows


@query("bulk_dedupe", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def bulk_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a batch's rows with one id the last wins."""
    return write.last_of_each(load(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("unique_violations", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.unique_violations(load(spark, sf_dir, "customer"), "c_nationkey", "c_custkey")


@query("required_violations", "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0")
def required_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "customer").withColumn("c_name", F.expr("CASE WHEN c_custkey % 5 <> 0 THEN c_name END"))
    return constraints.required_violations(rows, ["c_name"], "c_custkey")


@query("schema_violations", "SELECT p_partkey FROM part WHERE length(p_name) > 11 OR p_size < 5 OR p_size > 45 OR p_type NOT IN ('ECONOMY', 'PROMO', 'LARGE')")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {
        "required": ["p_name"],
        "properties": {"p_name": {"type": "string", "maxLength": 11}, "p_size": {"type": "integer", "minimum": 5, "maximum": 45}, "p_type": {"enum": ["ECONOMY", "PROMO", "LARGE"]}},
    }
    return constraints.schema_violations(load(spark, sf_dir, "part"), schema, "p_partkey")


@query("delete_filter", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P')")
def delete_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders")
    return write.without(rows, Compiler(rows).compile({"o_orderstatus": "P"})).select("o_orderkey")


@query("delete_pointers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 2, 3)")
def delete_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "customer")
    return write.without_keys(e.frame("customer"), e.read(["@customer:1", "@customer:2", "@customer:3"])).select("c_custkey")


_GONE = "(SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1))"


@query("delete_cascade", f"SELECT 'nation' AS collection, count(*) AS n FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN {_GONE} UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN {_GONE}")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's deletion goes on to its nations, their customers and their orders, by delete rules."""
    tables = {n: load(spark, sf_dir, n) for n in ("nation", "customer", "orders")}
    links = (("region", "nation", "n_regionkey"), ("nation", "customer", "c_nationkey"), ("customer", "orders", "o_custkey"))
    rules = {delete.Rule("Cascade", parent, child, field): tables[child] for parent, child, field in links}

    def edges(rule: delete.Rule) -> DataFrame:
        key = F.col(KEYS[rule.child]).cast("string")
        return rules[rule].select(F.lit(rule.parent).alias("parent_drawer"), F.col(rule.field).cast("string").alias("parent_id"), F.lit(rule.child).alias("child"), key.alias("child_id"))

    doomed, _ = delete.closure(spark, spark.createDataFrame([("region", "1")], delete.NODE), list(rules), edges, relate.checkpointed)
    out = None
    for name, rows in tables.items():
        gone = doomed.where(F.col("drawer") == name).select(F.col("_id").alias("_gone"))
        part = rows.join(gone, rows[KEYS[name]].cast("string") == F.col("_gone"), "left_anti").agg(F.lit(name).alias("collection"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("delete_restrict", "SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS restricted FROM nation")
def delete_restrict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations may not be deleted because a supplier refers to them."""
    return restricted_nations(load(spark, sf_dir, "nation"), load(spark, sf_dir, "supplier"))


def restricted_nations(nation: DataFrame, supplier: DataFrame) -> DataFrame:
    """(n_nationkey, restricted) by the rule that a nation with suppliers stays."""
    rule = delete.Rule("Restrict", "nation", "supplier", "s_nationkey")
    refs = supplier.select(
        F.lit(rule.parent).alias("parent_drawer"), F.col(rule.field).cast("string").alias("parent_id"), F.lit(rule.child).alias("child"), F.col(KEYS[rule.child]).cast("string").alias("child_id")
    )
    start = nation.select(F.lit(rule.parent).alias("parent_drawer"), F.col("n_nationkey").cast("string").alias("parent_id"))
    held = delete.held_back({rule: refs}, start).select(F.col("parent_id").alias("k")).distinct()
    return nation.join(held, nation["n_nationkey"].cast("string") == held["k"], "left").select("n_nationkey", F.col("k").isNotNull().alias("restricted"))


@query("delete_set_null", "SELECT s_suppkey, CASE WHEN s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) THEN s_nationkey END AS s_nationkey FROM supplier")
def delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = where(load(spark, sf_dir, "nation"), {"n_regionkey": 2})
    return write.set_null(load(spark, sf_dir, "supplier"), "s_nationkey", gone, "n_nationkey").select("s_suppkey", "s_nationkey")


@query("inventory", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS record_count FROM {t}" for t in TABLES))
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in TABLES:
        part = load(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("record_count"))
        out = part if out is None else out.unionByName(part)
    return out


_BOUNDS = [(i, i % 12 + 1, i % 12 + 1 + i % 11) for i in range(100)]


@query("range_lookup_batch", f"SELECT id, count(book) AS n FROM (VALUES {', '.join(map(str, _BOUNDS))}) b(id, lo, hi) LEFT JOIN {_BOOKS_SQL} ON quantity BETWEEN lo AND hi GROUP BY id")
def range_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred range counts at once: books are counted by quantity first, so ranges meet few rows."""
    by_quantity = _books(spark, sf_dir).groupBy("quantity").agg(F.count("*").alias("c"))
    bounds = spark.createDataFrame(_BOUNDS, "id int, lo int, hi int")
    steps = bounds.select("id", F.explode(F.expr("sequence(CAST(lo AS BIGINT), CAST(hi AS BIGINT))")).alias("quantity"))
    return steps.join(by_quantity, "quantity", "left").groupBy("id").agg(F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))


@query("point_lookup_batch", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT (i * 7919) % 15000 FROM range(1000) t(i))")
def point_lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand key lookups as one join."""
    keys = spark.range(1000).select(((F.col("id") * 7919) % 15000).alias("k")).distinct()
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(keys, orders["o_orderkey"] == keys["k"], "left_semi")


@query(
    "weighted_percentiles",
    "WITH s AS (SELECT l_returnflag, l_discount, sum(l_linenumber)::DOUBLE AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_discount ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM s) "
    "SELECT l_returnflag, min(CASE WHEN upto >= ceil(total * 0.95::DOUBLE) THEN l_discount END) AS p95, min(CASE WHEN upto >= ceil(total * 0.99::DOUBLE) THEN l_discount END) AS p99 FROM c GROUP BY 1",
)
def weighted_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.weighted_percentiles(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", "l_linenumber")


@query("purge", f"SELECT book, quantity FROM {_BOOKS_SQL} WHERE purge_bucket <> 0")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _books(spark, sf_dir)
    return write.without(rows, Compiler(rows).compile({"purge_bucket": 0})).select("book", "quantity")


@query("document_round_trip", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'AMERICAN' ELSE n_name END AS n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 3")
def document_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents: bulk upserts, a query upsert, a delete, and a read with references resolved."""
    e = stored_queries.new_engine(spark)
    e.create("tpch")
    e.create("tpch", "main")
    scope = e.scope("tpch/main")
    region = load(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("_id"), F.parse_json(F.to_json(F.struct(F.col("r_regionkey").cast("string").alias("_id"), "r_name"))).alias("doc"))
    body = F.struct(F.col("n_nationkey").cast("string").alias("_id"), "n_nationkey", "n_name", P.pointer_to("region", F.col("n_regionkey").cast("string")).alias("region"))
    nation = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("_id"), F.parse_json(F.to_json(body)).alias("doc"))
    scope.upsert_frame(region, "region")
    scope.upsert_frame(nation, "nation")
    scope.upsert({"n_name": "AMERICAN"}, ["nation", {"region": "@region:1"}], multi=True)
    scope.delete(["nation", {"region": "@region:3"}])
    out = scope.read("nation")
    return out.select(*[F.variant_get("doc", f"$.{p}", t).alias(p.rpartition(".")[2]) for p, t in (("n_nationkey", "int"), ("n_name", "string"), ("region.r_name", "string"))])


QUERIES.update(stored_queries.QUERIES)
ORACLES.update(stored_queries.ORACLES)
