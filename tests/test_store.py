import json

import pytest
from pyspark.sql import functions as F

from larkspur.errors import ConstraintViolation, InvalidInput, NotFound, Restricted
from larkspur.operators.constraints import schema_error
from larkspur.plans.filters import Filter
from larkspur.session import Engine
from larkspur.sources.store import new_meta


def docs(df):
    return [json.loads(r[0]) for r in df.select(F.to_json("doc")).collect()]


def by_id(scope, drawer, **more):
    return {d["_id"]: d for d in docs(scope.read(drawer, **{"hydrate": False, **more}))}


def test_upserts_reads_and_deletes(scope):
    assert scope.upsert([{"_id": "b1", "t": "Dune", "n": 3}, {"_id": "b2", "t": "Dusk", "n": 5.5}], "book").pointers == ["@book:b1", "@book:b2"]
    scope.upsert({"_id": "@book:b1", "t": "Dune II"})
    assert by_id(scope, "book") == {"b1": {"_id": "b1", "t": "Dune II"}, "b2": {"_id": "b2", "t": "Dusk", "n": 5.5}}
    generated = scope.upsert({"t": "new"}, "book").pointers[0]
    assert len(generated) == len("@book:") + 32
    assert not scope.upsert({"t": "X"}, ["book", {"t": "zzz"}], create_if_missing=False).pointers
    with pytest.raises(InvalidInput):
        scope.upsert({"x": 1}, ["book", {"t": "D%"}])
    scope.upsert({"x": 1, "_id": "no"}, ["book", {"t": "D%"}], multi=True)
    assert by_id(scope, "book")["b2"] == {"_id": "b2", "t": "Dusk", "n": 5.5, "x": 1}
    assert scope.delete(["@book:b1", "@book:nope"]) == 1
    assert scope.delete(["gone", {"a": 1}]) == 0
    with pytest.raises(NotFound):
        scope.delete("@gone:1")
    with pytest.raises(InvalidInput):
        scope.delete("book")
    assert scope.delete([Filter.drawer("book"), Filter.query({})]) == 2 and scope.count("book") == 0


def test_references_cycles_and_virtual_fields(scope):
    scope.upsert([{"_id": "a", "next": "@node:b"}, {"_id": "b", "next": "@node:a"}], "node")
    assert docs(scope.read("@node:a")) == [{"next": {"next": "@node:a"}}]
    scope.engine.create("lib", "main", "hero")
    scope.alter("hero", "add", "relationship", "weapons", {"type": "1:M", "target_drawer": "weapon", "mapped_by": "hero"})
    scope.upsert({"_id": "h", "name": "A", "weapons": [{"_id": "w1", "n": "bow"}, {"n": "axe"}]}, "hero")
    scope.upsert({"_id": "w9", "n": "free"}, "weapon")
    hero = docs(scope.read("hero"))[0]
    assert [w["n"] for w in hero["weapons"]] == ["bow", "axe"] and all("hero" not in w for w in hero["weapons"])
    assert "weapons" not in docs(scope.read("hero", hydrate=False))[0]
    assert docs(scope.read("hero", exclude_hydration=["weapons"])) == [{"_id": "h", "name": "A"}]
    assert scope.count(["weapon", {"hero": "@hero:h"}]) == 2
    scope.upsert({"_id": "p", "by": "@hero:nope", "all": ["@weapon:w9", "@weapon:x"]}, "post")
    post = docs(scope.read("@post:p"))[0]
    assert post["by"] == "@hero:nope" and post["all"][1] == "@weapon:x" and post["all"][0]["n"] == "free"
    scope.upsert({"_id": "q", "author": {"_id": "@hero:z", "name": "Zed"}, "note": {"x": 1}}, "post")
    assert by_id(scope, "post")["q"] == {"_id": "q", "author": "@hero:z", "note": {"x": 1}} and scope.count("hero") == 2
    ordered = scope.read("post", order_by="author.name", order_direction="desc")
    assert [d["_id"] for d in docs(ordered)] == ["q", "p"]


def test_chains_of_references_are_resolved_whole(scope):
    scope.upsert([{"_id": str(i), "next": f"@link:{i + 1}"} for i in range(7)] + [{"_id": "7", "next": "@link:5"}], "link")

    def length(doc):
        return 1 + length(doc["next"]) if isinstance(doc["next"], dict) else 0

    whole = docs(scope.read("@link:0"))[0]
    assert length(whole) == 7
    assert [length(docs(scope.read("@link:0", depth=n))[0]) for n in (0, 1, 5)] == [0, 1, 5]
    with pytest.raises(InvalidInput):
        scope.read("@link:0", depth=-1)


SCHEMA = {"type": "object", "required": ["name"], "additionalProperties": False, "properties": {"name": {"type": "string", "minLength": 2, "maxLength": 4}, "age": {"type": "integer", "minimum": 0, "maximum": 120}, "element": {"enum": ["fire", "ice"]}}}


def test_schemas():
    assert schema_error({"_id": "1", "name": "Ann", "age": 3, "element": "ice"}, SCHEMA) is None
    for bad in ({}, {"name": None}, {"name": "A"}, {"name": "Anton"}, {"name": "Ann", "age": -1}, {"name": "Ann", "age": 1.5}, {"name": "Ann", "element": "x"}, {"name": "Ann", "more": 1}):
        assert schema_error(bad, SCHEMA)


def test_a_refused_batch_changes_nothing(scope):
    scope.upsert({"_id": "1", "name": "Ann", "n": 1}, "hero")
    scope.set_schema("hero", {"properties": {"name": {"type": "string"}}})
    scope.alter("hero", "add", "constraint", "n", {"constraint": "unique"})
    before, version = by_id(scope, "hero"), scope.store.manifest()["version"]
    for batch in ([{"name": "B"}, {"name": 5}], [{"name": "B", "n": 1}], [{"name": "C", "n": None}, {"name": "D", "n": None}]):
        with pytest.raises(ConstraintViolation):
            scope.upsert(batch, "hero")
    assert by_id(scope, "hero") == before and scope.store.manifest()["version"] == version
    with pytest.raises(ConstraintViolation):
        scope.upsert([{"_id": "2", "name": "B"}, {"name": 5}], "hero", atomic=False)
    assert by_id(scope, "hero").keys() == {"1", "2"}
    scope.upsert([{"_id": "3", "name": "x"}, {"_id": "3", "name": "y"}], "hero")
    assert by_id(scope, "hero")["3"]["name"] == "y"
    scope.alter("hero", "add", "relationship", "gem", {"type": "1:1", "target_drawer": "gem"})
    scope.upsert({"_id": "4", "gem": "@gem:1"}, "hero")
    for bad in ({"gem": "@gem:1"}, {"gem": "@rock:1"}, {"gem": 5}):
        with pytest.raises(InvalidInput):
            scope.upsert(bad, "hero")


def test_timestamps(scope):
    scope.upsert({"_id": "1"}, "item")
    scope.alter("item", "add", "timestamp")
    scope.upsert({"_id": "1", "x": 1}, "item")
    first = by_id(scope, "item")["1"]
    assert first["created_at"] <= first["updated_at"] and first["updated_at"].endswith("Z") and len(first["updated_at"]) == 24
    scope.upsert({"_id": "1", "x": 2}, "item")
    second = by_id(scope, "item")["1"]
    assert second["created_at"] == first["created_at"] and second["updated_at"] >= first["updated_at"]


def family(scope, action):
    scope.upsert([{"_id": "a"}, {"_id": "b"}], "parent")
    scope.alter("parent", "add", "relationship", "kids", {"type": "1:M", "target_drawer": "kid", "mapped_by": "parent"})
    scope.upsert([{"_id": "k", "parent": "@parent:a"}, {"_id": "l", "parent": ["@parent:a", "@parent:b"]}, {"_id": "m", "parent": "@parent:b"}], "kid")
    scope.alter("parent", "add", "cascade-delete", "kids", {"action": action})


def test_cascade(scope):
    family(scope, "Cascade")
    scope.upsert([{"_id": "t", "of": "@kid:k"}], "toy")
    scope.alter("kid", "add", "relationship", "toys", {"type": "1:M", "target_drawer": "toy", "mapped_by": "of"})
    scope.alter("kid", "add", "cascade-delete", "toys")
    scope.alter("toy", "add", "cascade-delete", "of")
    assert scope.delete("@parent:a") == 1
    assert (by_id(scope, "parent").keys(), by_id(scope, "kid").keys(), scope.count("toy")) == ({"b"}, {"m"}, 0)


def test_restricted_nations_by_all_suppliers(spark):
    from larkspur import queries

    nation = spark.createDataFrame([(k,) for k in range(6)], "n_nationkey int")
    supplier = spark.createDataFrame([(1, 0), (11, 2), (900, 5), (901, 5), (902, None), (903, 77)], "s_suppkey long, s_nationkey int")
    got = {r.n_nationkey: r.restricted for r in queries.restricted_nations(nation, supplier).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 5: True}


def test_restrict_leaves_all(scope):
    family(scope, "Restrict")
    with pytest.raises(Restricted):
        scope.delete("@parent:a")
    assert scope.count("parent") == 2 and scope.count("kid") == 3
    scope.delete([("kid", "k"), ("kid", "l")])
    assert scope.delete("@parent:a") == 1


def test_set_null(scope):
    family(scope, "SetNull")
    assert scope.delete("@parent:a") == 1
    shown = {r[0]: json.loads(r[1]) for r in scope.documents("kid").select("_id", F.to_json("doc")).collect()}
    assert shown == {"k": {"_id": "k"}, "l": {"_id": "l", "parent": ["@parent:b"]}, "m": {"_id": "m", "parent": "@parent:b"}}


def test_catalog_archives_and_access(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    with pytest.raises(NotFound):
        e.create("db", "x")
    e.create("org/db")
    e.create("org/db", "x")
    e.create("org/db", "x", "d")
    for bad in ("a\\b", "..", "d_index", "d_meta", ""):
        with pytest.raises(InvalidInput):
            e.create("org/db", "x", bad or " ")
    s = e.scope("org/db/x")
    s.upsert([{"_id": "1"}, {"_id": "2"}], "d")
    with pytest.raises(NotFound):
        s.read("unknown")
    assert [r.name for r in e.structure().collect()] == ["org/db"] and [r.name for r in e.structure("org/db").collect()] == ["x"]
    assert e.structure("org/db", "x").first().record_count == 2
    assert e.status()["drawers"] == ["org/db/x/d"] and s.inspect("d")["record_count"] == 2
    e.backup(str(tmp_path / "b"), "org/db")
    s.delete("@d:1")
    assert s.compact()["bytes_after"] > 0 and s.count("d") == 1
    assert e.restore(str(tmp_path / "b"))["scope"] == "database" and s.count("d") == 2
    e.store.create_tenant("t1", "org")
    assert e.scope("db/x", tenant="t1").count("d") == 2
    with pytest.raises(NotFound):
        e.scope("other/x", tenant="t1")
    n = e.scope("org/db/x", namespace="ns")
    n.upsert({"_id": "1"}, "d")
    assert n.count("d") == 1 and "ns_d" in e.store.manifest()["databases"]["org/db"]["x"]
    assert e.drop("org/db", "x", "ns_d")["removed"] and not e.drop("org/db", "x", "ns_d")["removed"]
    e.grant("ann", "org/db:ru")
    e.grant("ann", "org/db:ru")
    assert e.store.manifest()["users"]["ann"]["permissions"] == ["org/db:ru"]
    for bad in ("org/db:rr", "org/db:x", "org"):
        with pytest.raises(InvalidInput):
            e.grant("ann", bad)
    e.revoke("ann", "org/db:ru")
    assert e.store.manifest()["users"]["ann"]["permissions"] == []


def test_stream_of_upserts(spark, scope, tmp_path):
    from larkspur.streaming.changes import upsert_stream

    spark.createDataFrame([("1", '{"_id":"1","v":1}'), ("2", '{"_id":"2","v":2}')], "_id string, t string").write.json(str(tmp_path / "in"))
    rows = spark.readStream.schema("_id string, t string").json(str(tmp_path / "in")).select("_id", F.parse_json("t").alias("doc"))
    upsert_stream(rows, scope, "d", str(tmp_path / "ck")).awaitTermination(120)
    assert by_id(scope, "d")["2"] == {"_id": "2", "v": 2}


def test_edits_keep_the_kinds_of_numbers(spark, scope):
    scope.upsert({"_id": "a", "y": 1.0, "n": 1, "in": {"z": [1.0, 2, 2.50, 0.1234567890123456789]}}, "num")
    scope.upsert({"note": "x"}, ["num", {"n": 1}])
    rows = spark.createDataFrame([("b", '{"_id":"b","y":1.0,"n":1}')], "_id string, t string").select("_id", F.parse_json("t").alias("doc"))
    scope.upsert_frame(rows, "num")
    assert [scope.count(["num", q]) for q in ({"y": 1.0}, {"y": 1}, {"n": 1}, {"n": 1.0})] == [2, 0, 2, 0]
    assert scope.count(["num", {"in": {"z": [1.0, 2, 2.5, 0.1234567890123456789]}}]) == 1
    scope.upsert({"_id": "r", "of": "@num:a"}, "ref")
    inner = scope.read("@ref:r").select(F.schema_of_variant(F.variant_get("doc", "$.of.y", "variant")).alias("k")).first().k
    assert inner.startswith("DECIMAL")
    scope.alter("num", "add", "timestamp")
    scope.upsert({"more": 2}, ["num", {"note": "x"}])
    assert scope.count(["num", {"y": 1.0}]) == 2


def test_drop_leaves_other_databases(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    for db in ("a", "a/b"):
        e.create(db)
        e.create(db, "b")
        e.scope(f"{db}/b").upsert({"_id": "1", "in": db}, "d")
    e.drop("a")
    left = e.scope("a/b/b")
    assert docs(left.read("d")) == [{"_id": "1", "in": "a/b"}]
    gone = e.store.collect_garbage()
    assert len(gone) == 1 and docs(left.read("d")) == [{"_id": "1", "in": "a/b"}]


def test_garbage_leaves_what_may_yet_be_committed(scope):
    scope.upsert({"_id": "1"}, "d")
    m = scope.store.manifest()
    path = scope.store.write(m, scope.documents("d"))
    assert path not in scope.store.collect_garbage()
    scope.upsert({"_id": "2"}, "d")
    assert path in scope.store.collect_garbage() and scope.count("d") == 2
    scope.store.kept_manifests = 2
    scope.store.collect_garbage()
    assert len(scope.store.files.names(f"{scope.store.root}/_manifest")) == 2 and scope.store.verify()["ok"] and scope.count("d") == 2


def test_requests_have_work_folders_of_their_own(scope):
    with scope._work() as keep:
        mine = keep(scope.spark.range(3))
        scope.upsert({"_id": "1"}, "d")
        scope.delete("@d:1")
        assert mine.count() == 3
    assert scope.store.files.names(f"{scope.store.root}/_work") == []


def test_plain_ids_of_declared_fields_become_pointers(spark, scope):
    scope.engine.create("lib", "main", "book")
    scope.alter("book", "add", "relationship", "author", {"type": "M:1", "target_drawer": "person"})
    scope.alter("book", "add", "relationship", "tags", {"type": "M:M", "target_drawer": "tag"})
    scope.alter("book", "add", "relationship", "about", {"type": "polymorphic", "target_drawers": ["person", "tag"]})
    scope.upsert({"_id": "b", "author": "p1", "tags": ["x", "@tag:y"], "about": "@tag:x", "title": "p1"}, "book")
    assert by_id(scope, "book")["b"] == {"_id": "b", "author": "@person:p1", "tags": ["@tag:x", "@tag:y"], "about": "@tag:x", "title": "p1"}
    with pytest.raises(InvalidInput):
        scope.upsert({"about": "@book:b"}, "book")
    body = '{"author": {"_id": "@person:p2", "name": "Zed"}, "tags": ["lnk_z"], "n": 2.0}'
    rows = [("c", body, 2), ("c", '{"n": 5}', 1), ("@book:e", '{"author": "p1"}', 1), (None, '{"n": 6}', 1), (None, '{"n": 7}', 1)]
    frame = spark.createDataFrame(rows, "_id string, t string, at int").select("_id", "at", F.parse_json("t").alias("doc"))
    assert scope.upsert_frame(frame, "book", "at") == 5
    found = by_id(scope, "book")
    assert found["c"] == {"_id": "c", "author": "@person:p2", "tags": ["@tag:z"], "n": 2} and found["e"] == {"_id": "e", "author": "@person:p1"}
    assert len(found) == 5 and scope.count(["book", {"n": 2.0}]) == 1 and by_id(scope, "person") == {"p2": {"_id": "p2", "name": "Zed"}}


def test_many_aliases_are_all_noted(scope):
    scope.upsert({"_id": "1", **{f"f{i}": "@x:1" for i in range(1200)}}, "wide")
    assert len(scope.inspect("wide")["meta"]["aliases"]) == 1200


def test_old_prefixes_go_at_any_depth(spark, scope):
    rows = spark.createDataFrame([('{"_id":"lnk_1","of":["@d:lnk_2",{"x":"@d:lnk_3"}],"note":"lnk_stays","n":1.0}',)], "t string")
    m, drawers = scope._state()
    drawers["d"] = {"path": scope.store.write(m, rows.select(F.lit("lnk_1").alias("_id"), F.lit(0).cast("long").alias("_seq"), F.parse_json("t").alias("doc"))), "meta": new_meta()}
    scope.store.commit(m)
    scope.compact("d")
    assert by_id(scope, "d") == {"1": {"_id": "1", "of": ["@d:2", {"x": "@d:3"}], "note": "lnk_stays", "n": 1}} and scope.count(["d", {"n": 1.0}]) == 1


def test_lookups_and_unknown_collections(scope):
    scope.upsert([{"_id": "1", "code": 7}, {"_id": "2", "code": "7"}, {"_id": "3", "code": 7.0}, {"_id": "4", "in": {"code": "7"}}], "d")
    assert sorted(r._id for r in scope.lookup("d", "code", "7").collect()) == ["1", "2"]
    assert [r._id for r in scope.lookup("d", "in.code", "7").collect()] == ["4"]
    for call in (lambda: scope.count("nope"), lambda: scope.lookup("nope", "a", "1")):
        with pytest.raises(NotFound):
            call()


def test_unique_looks_at_the_batch_only(scope):
    scope.upsert([{"_id": "1", "n": 1}, {"_id": "2", "n": 2}], "d")
    scope.alter("d", "add", "constraint", "n", {"constraint": "unique"})
    scope.upsert([{"_id": "1", "n": 2}, {"_id": "2", "n": 1}], "d")
    for bad in ({"_id": "3", "n": 1}, [{"_id": "3", "n": 9}, {"_id": "4", "n": 9.0}]):
        with pytest.raises(ConstraintViolation):
            scope.upsert(bad, "d")
    scope.upsert([{"_id": "5"}, {"_id": "6"}], "d")
    assert scope.count("d") == 4


def test_key_lookups_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id AS c_custkey", "string(id) AS name").write.parquet(str(tmp_path / "c"))
    e = Engine(spark).attach("customer", spark.read.parquet(str(tmp_path / "c")), "c_custkey")
    for selection in ([Filter.drawer("customer"), Filter.query({"_id": "7"})], "@customer:7", [Filter.drawer("customer"), Filter.query({"_id": {"$eq": "7"}})]):
        df = e.read(selection)
        assert "EqualTo(c_custkey,7)" in df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert [r.c_custkey for r in df.collect()] == [7]
    assert e.count(["@customer:7", "@customer:07", "@customer:7", "@customer:x"]) == 2
    assert e.count([Filter.drawer("customer"), Filter.query({"_id": {"$in": ["1", "2", "-0"]}})]) == 2 and e.count([Filter.drawer("customer"), Filter.query({"_id": "07"})]) == 0


@pytest.mark.parametrize("share,most", [(1e9, 2), (1e9, 50), (0.0, 8)])
def test_changes_are_merged_on_read(scope, monkeypatch, share, most):
    """Commits that write only what they change give what rewriting everything gives."""
    import random

    monkeypatch.setattr(scope.store, "share", share)
    monkeypatch.setattr(scope.store, "most_changes", most)
    rng = random.Random(most)
    held = {str(i): {"_id": str(i), "v": i} for i in range(12)}
    scope.upsert(list(held.values()), "d")
    order = list(held)
    for step in range(7):
        keys = rng.sample([str(i) for i in range(16)], 3)
        if step % 3 == 2:
            scope.delete([f"@d:{k}" for k in keys])
            order = [k for k in order if k not in keys]
            held = {k: v for k, v in held.items() if k not in keys}
        else:
            new = [{"_id": k, "v": step * 100 + i} for i, k in enumerate(keys)]
            scope.upsert(new, "d")
            order += [k for k in keys if k not in held]
            held |= {r["_id"]: r for r in new}
    entry = scope._state()[1]["d"]
    assert len(entry["changes"]) == 0 if share == 0 else 0 < len(entry["changes"]) <= most
    assert by_id(scope, "d") == held and scope.count("d") == len(held)
    assert [r._id for r in scope.documents("d").orderBy("_seq").collect()] == order
    before = scope.documents("d").select("_id", "_seq").collect()
    scope.store.collect_garbage()
    scope.compact("d")
    assert sorted(map(tuple, before)) == sorted(map(tuple, scope.documents("d").select("_id", "_seq").collect())) and not scope._state()[1]["d"]["changes"]


def test_archives_take_changes_along(scope, tmp_path, monkeypatch):
    monkeypatch.setattr(scope.store, "share", 1e9)
    scope.upsert([{"_id": "1", "v": 1}, {"_id": "2", "v": 1}], "d")
    scope.upsert({"_id": "1", "v": 2}, "d")
    scope.engine.backup(str(tmp_path / "b"), "lib")
    scope.store.clone("lib", "twin")
    scope.delete("@d:1")
    other = Engine(scope.spark, str(tmp_path / "other"))
    other.restore(str(tmp_path / "b"))
    for s in (other.scope("lib/main"), scope.engine.scope("twin/main")):
        assert by_id(s, "d") == {"1": {"_id": "1", "v": 2}, "2": {"_id": "2", "v": 1}}
        s.upsert({"_id": "1", "v": 3}, "d")
        assert by_id(s, "d")["1"]["v"] == 3
    assert by_id(scope, "d").keys() == {"2"}


def test_settings_and_logging(spark, tmp_path):
    from larkspur.config import Config, Logging

    said = tmp_path / "events.log"
    (tmp_path / "c.json").write_text(json.dumps({"root": str(tmp_path / "s"), "most_changes": 3, "logging": {"level": "info", "format": "json", "destination": "file", "file": str(said)}}))
    e = Engine(spark, config=str(tmp_path / "c.json"))
    assert (e.store.root, e.store.most_changes, e.store.share) == (str(tmp_path / "s"), 3, 0.25)
    e.create("a")
    e.create("a")
    assert [(r["level"], r["message"], r["version"]) for r in map(json.loads, said.read_text().splitlines())] == [("info", "commit", 1), ("info", "commit", 2)]
    for bad in ({"speed": 1}, {"logging": {"level": "loud"}}, {"logging": {"destination": "file"}}, {"logging": {"colour": 1}}, {"most_changes": 0}, {"merge_share": -1}, {"logging": {"format": "xml"}}):
        with pytest.raises(InvalidInput):
            Config.of(bad)
    assert Config.of().logging == Logging() and Logging(level="warn").logger() is Logging(level="warn").logger()


def test_pointers_of_a_query_come_when_asked(scope):
    scope.upsert([{"_id": c, "v": 1} for c in "cab"], "d")
    done = scope.upsert({"w": 2}, ["d", {"v": 1}], multi=True)
    assert done.frame.count() == 3 and done.pointers == ["@d:c", "@d:a", "@d:b"] and not done.created
    assert scope.upsert({"w": 3}, ["d", {"v": 9}]).created
