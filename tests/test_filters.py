import json
import random

import oracle
import pytest
from pyspark.sql import functions as F

from larkspur.errors import InvalidInput
from larkspur.plans.filters import Filter, Selection, validate
from larkspur.plans.options import Options
from larkspur.plans.predicates import where

VALUES = [None, True, False, 0, 1, 1.0, 2.5, -3, 2**53 + 1, 2**63 + 5, "", "a", "abc", "a_c", "a%c", "a\nc", "é", "1", "@tag:7", "@tag:lnk_7", "7", "a/b/7", "x\\y", [], ["a", "abc"], ["a", 1], {}, {"k": 1}, {"k": "abc", "l": None}, [{"k": 1}]]
LITERALS = [*VALUES, "a%", "%c", "%", "%%", "a%b%c", "_", "a_%", {"k": "a%"}, {"_id": "7"}, {"_id": "@tag:7"}]


def queries(rng):
    for v in LITERALS:
        yield {"f": v}
        yield {"g.f": v}
    for op in ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte"):
        for v in rng.sample(VALUES, 12):
            yield {"f": {op: v}}
    for _ in range(25):
        yield {"f": {"$in": rng.sample(LITERALS, 3)}}
    for _ in range(10):
        yield {"f": {"$gte": rng.choice([0, "a"]), "$ne": rng.choice(VALUES)}, "tags": {"$in": ["7", 1]}}
    yield {"f": {"$gt": 1, "plain": 2}}
    yield {"missing": {"$ne": 1}}
    yield {"missing": None}
    yield {}


def test_documents_match_as_interpreted(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rng = random.Random(1)
    docs = [{"f": v} for v in VALUES] + [{"g": {"f": v}} for v in VALUES] + [{"tags": v, "f": rng.choice(VALUES)} for v in VALUES]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").select("i", F.parse_json("t").alias("doc")).cache()
    asked = list(queries(rng))
    for start in range(0, len(asked), 40):
        part = asked[start : start + 40]
        from larkspur.plans.predicates import Compiler

        compiler = Compiler(df, doc="doc")
        got = df.select("i", *[compiler.compile(q).alias(f"q{k}") for k, q in enumerate(part)]).collect()
        for k, q in enumerate(part):
            found = {r["i"] for r in got if r[f"q{k}"]}
            assert found == {i for i, d in enumerate(docs) if oracle.matches(d, q)}, q


def test_typed_columns_match_as_interpreted(spark):
    rows = [(str(i), n, t, b, {"k": t}, [t, "z"]) for i, (n, t, b) in enumerate([(1, "abc", True), (2, "a_c", False), (None, None, None), (10, "%", True), (5, "x\\y", None), (7, "A", False)])]
    df = spark.createDataFrame(rows, "_id string, n int, t string, b boolean, o struct<k:string>, l array<string>").cache()
    docs = [{k: v for k, v in {"_id": r[0], "n": r[1], "t": r[2], "b": r[3], "o": {"k": r[2]} if r[2] else {}, "l": [v for v in r[5]]}.items() if v is not None} for r in rows]
    asked = [
        {"n": 1}, {"n": {"$gte": 2, "$lt": 10}}, {"n": {"$in": [1, 5]}}, {"n": {"$ne": 1}}, {"n": {"$gt": "a"}}, {"n": {"$ne": "a"}}, {"n": "1"},
        {"t": "a%"}, {"t": "a_c"}, {"t": "%\\%"}, {"t": {"$in": ["a%", "A"]}}, {"t": {"$gt": "A"}}, {"b": True}, {"b": {"$gt": False}},
        {"o.k": "abc"}, {"o": {"k": "a%"}}, {"l": ["a%", "z"]}, {"l": "z"}, {"nope": {"$ne": 1}}, {"o.nope": 1}, {"t": {"$in": ["@x:abc"]}}, {},
    ]
    for q in asked:
        assert {r[0] for r in where(df, q).select("_id").collect()} == {d["_id"] for d in docs if oracle.matches(d, q)}, q


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "string(id) AS s", "id AS unused").write.parquet(str(tmp_path / "t"))
    df = where(spark.read.parquet(str(tmp_path / "t")), {"id": {"$gte": 5, "$lte": 9}, "s": {"$in": ["5", "6"]}}).select("s")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,5)" in plan and "In(s" in plan and "unused" not in plan
    assert "LocalTableScan <empty>" in where(spark.read.parquet(str(tmp_path / "t")), {"id": {"$gt": 9, "$lt": 2}})._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bad", [["a"], "x", {"f": {"$nope": 1}}, {"f": {"$in": 1}}, {"f": {"g": {"$bad": 1}}}])
def test_malformed_queries_are_refused(bad):
    with pytest.raises(InvalidInput):
        validate(bad)


def test_selection_merges_filters():
    s = Selection.of(["@book", {"title": "x"}, ("book", "lnk_1")])
    assert (s.drawer, s.query, s.pointers) == ("book", {"title": "x"}, ["@book:1"])
    assert Selection.of({"_id": "@book:2"}).pointers == ["@book:2"]
    assert Selection.of({"drawer": "book"}).drawer == "book"
    assert Selection.of({}) == Selection() == Selection.of(None)
    assert Filter.of_dict({"_id": "x"}).kind == "query"
    assert Selection.of(Filter.of_dict({"drawer": "d", "query": {"a": 1}})).drawer == "d"
    for bad in (["@a", "@b"], [{"a": 1}, {"b": 2}], "@a:b:c"):
        with pytest.raises(InvalidInput):
            Selection.of(bad)


def test_options_are_strict():
    o = Options.of({"select": ["a"], "excludeHydration": ["b"], "limit": 3})
    assert (o.projection, o.exclude_hydration, o.limit) == (["a"], ["b"], 3)
    for bad in ({"nope": 1}, {"limit": -1}, {"limit": True}, {"multi": 1}, {"fields": "a"}, {"return_shape": "x"}, {"order_direction": "up"}, [1]):
        with pytest.raises(InvalidInput):
            Options.of(bad)
    assert Options().shape(Selection.of("@a:1")) == "record"
    assert Options().shape(Selection.of(["@a:1", "@a:2"])) == "records"


def test_pointer_columns_follow_the_parser(spark):
    import random

    from pyspark.sql import functions as F

    from larkspur.functions import pointers as P

    rng = random.Random(6)
    texts = ["".join(rng.choice(["@", ":", "/", "a", "b", "lnk_", "é", "\\", ".", "..", "\n"]) for _ in range(rng.randint(0, 7))) for _ in range(4000)]
    texts += ["@a:b", "@a:lnk_", "@a:lnk_x", "@:b", "@a:", "a/b/c", "a/b/lnk_c", "a/b", "@a/b:c", "x:y"]
    rows = spark.createDataFrame([(t,) for t in set(texts)], "t string")
    for r in rows.select("t", P.pointer_key(F.col("t")).alias("k"), P.pointer_collection(F.col("t")).alias("c")).collect():
        found = P.parse_pointer(r.t)
        if not found and r.c is not None:
            assert any(s in (".", "..") for s in r.t.split("/"))  # segments that only the parser refuses
        else:
            assert (r.c, r.k) == ((found[0], found[1]) if found else (None, r.t)), r.t
