import json

import pytest
from pyspark.sql import functions as F

from larkspur.errors import InvalidInput
from larkspur.functions import pointers as P
from larkspur.operators import read, relate
from larkspur.session import Engine


@pytest.fixture
def books(spark):
    rows = [("b", 10, None), ("a", 10, "x"), ("c", 20, "y"), ("d", None, "z")]
    return Engine(spark).attach("book", spark.createDataFrame(rows, "_id string, rank int, note string"))


def ids(df):
    return [r["_id"] for r in df.collect()]


def test_order_puts_missing_last_and_ties_by_id(books):
    assert ids(books.read("book", order_by="rank")) == ["a", "b", "c", "d"]
    assert ids(books.read("book", order_by="rank", order_direction="desc")) == ["c", "b", "a", "d"]
    assert ids(books.read("book", order_by="nope", order_direction="desc")) == ["d", "c", "b", "a"]
    assert ids(books.read("book", order_by="rank", offset=1, limit=2)) == ["b", "c"]
    assert ids(books.read("book", offset=9)) == []


def test_pages_and_cursors(books):
    first = books.read("book", order_by="rank", page_size=2)
    assert (ids(first.rows), first.has_more, first.page, first.page_size) == (["a", "b"], True, 1, 2)
    second = books.read("book", order_by="rank", page_size=2, cursor=first.next_cursor)
    assert (ids(second.rows), second.has_more, second.next_cursor, second.page) == (["c", "d"], False, None, None)
    down = books.read("book", order_by="rank", order_direction="desc", page_size=3)
    assert ids(books.read("book", order_by="rank", order_direction="desc", page_size=3, cursor=down.next_cursor).rows) == ["d"]
    for bad in ({"page": 1}, {"order_by": "rank", "page": 0}, {"order_by": "rank", "page_size": 0}, {"order_by": "rank", "page": 1, "limit": 1}, {"order_by": "rank", "page": 1, "cursor": first.next_cursor}, {"order_by": "rank", "cursor": "x"}, {"order_by": "note", "cursor": first.next_cursor}, {"order_by": "rank", "cursor": json.dumps({"order_by": "rank", "order_direction": "asc", "id": "gone"})}):
        with pytest.raises(InvalidInput):
            books.read("book", bad)


def test_counts_and_shapes(books):
    assert books.count("book", offset=1, limit=1) == 1
    assert books.count("book", order_by="rank", page=2, page_size=3) == 1
    assert books.count(["@book:a", "@book:a", "@book:nope"]) == 2
    assert books.read(["book", {"rank": 20}], return_shape="exists") is True
    assert [r[0] for r in books.read(["@book:c", "@book:a"], return_shape="pointers").collect()] == ["@book:c", "@book:a"]
    assert ids(books.read("@book:c")) == ["c"]


def test_projection_of_structs_arrays_and_documents(spark):
    df = spark.createDataFrame([("1", {"n": "x", "e": "y"}, [{"p": 1, "q": 2}])], "_id string, a struct<n:string,e:string>, l array<struct<p:int,q:int>>")
    assert read.projected(df, ["a.n", "l.q"]).first().asDict(True) == {"_id": "1", "a": {"n": "x"}, "l": [{"q": 2}]}
    assert read.projected(df, ["-a.n", "!_id"]).first().asDict(True) == {"a": {"e": "y"}, "l": [{"p": 1, "q": 2}]}
    assert read.projected(df, ["nope"]).columns == ["_id"]
    doc = {"_id": "1", "a": {"n": 1, "e": 2}, "l": [{"p": 1, "q": 2}, 3]}
    docs = spark.createDataFrame([("1", json.dumps(doc))], "_id string, t string").select("_id", F.parse_json("t").alias("doc"))
    get = lambda p: json.loads(read.projected(docs, p, "doc").select(F.to_json("doc")).first()[0])
    assert get(["a.n", "l.q"]) == {"_id": "1", "a": {"n": 1}, "l": [{"q": 2}, 3]}
    assert get(["-a", "-l.p"]) == {"_id": "1", "l": [{"q": 2}, 3]}


def test_mixed_kinds_order_by_the_first(spark):
    rows = [("a", 0, '{"d": 20}'), ("b", 1, '{"d": "unknown"}'), ("c", 2, "{}"), ("d", 3, '{"d": 30}')]
    docs = spark.createDataFrame(rows, "_id string, _seq long, t string").select("_id", "_seq", F.parse_json("t").alias("doc"))
    assert ids(read.ordered(docs, "d", "desc", "doc")) == ["d", "a", "c", "b"]


def test_pointers():
    assert P.parse_pointer("@gem:lnk_hero") == ("gem", "hero") == P.parse_pointer("@gem:hero")
    assert P.parse_pointer("a/b/c/id") == ("a/b/c", "id")
    assert P.parse_pointer("user/user-02") is None and P.parse_pointer("@a:b:c") is None and P.parse_pointer("a/../c/id") is None
    assert P.normalize("gem", "lnk_x") == "@gem:x" and P.normalize("gem", "@rock:1", "ns") == "@ns_rock:1"
    assert [P.inferred_collection(x) for x in ("cities", "books", "class", "status", "s")] == ["city", "book", "class", "status", "s"]


def test_joins_of_references(spark):
    people = spark.createDataFrame([("1", "Ann"), ("2", "Bo")], "_id string, name string")
    posts = spark.createDataFrame([("p", "@person:1", ["@person:2", "@person:9"]), ("q", "@person:9", []), ("r", None, None)], "_id string, who string, liked array<string>")
    got = {r._id: (r.who, r.who_name) for r in relate.hydrate(posts, "who", people, pointer_of="person").collect()}
    assert got == {"p": ("@person:1", "Ann"), "q": ("@person:9", None), "r": (None, None)}
    got = {r._id: r.liked for r in relate.hydrate_array(posts, "liked", people, F.struct("name")).collect()}
    assert [(x.pointer, x.record and x.record.name) for x in got["p"]] == [("@person:2", "Bo"), ("@person:9", None)] and got["q"] == [] and got["r"] is None
    kids = relate.virtual_children(people, "person", posts, "who", "posts", F.struct(F.col("_id").alias("k")))
    assert {r._id: [x.k for x in r.posts] for r in kids.collect()} == {"1": ["p"], "2": []}
    assert sorted(r.parent for r in relate.edges(posts, "post", "liked").collect()) == ["@person:2", "@person:9"]


def test_document_projection_in_both_ways(spark):
    """Fields at the top go without Python; paths inside go through it: both give the same."""
    import json

    from pyspark.sql import functions as F

    from larkspur.operators import read

    texts = ['{"_id":"1","a":1.0,"b":{"c":[1,2.50]},"d":null}', '{"a":"x"}', "{}", '{"_id":"4","d":[{"a":1}]}']
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.parse_json("t").alias("doc"))
    for projection in (["a"], ["d", "b", "zz"], ["-a"], ["!b", "-_id"], ["-zz"]):
        exclusive, paths = read._split(projection)
        want = [read.prune_value(json.loads(t), exclusive, paths) for t in texts]
        got = [json.loads(r[0]) for r in read.projected(rows, projection, "doc").select(F.to_json("doc")).collect()]
        assert got == want
    kinds = read.projected(rows, ["a"], "doc").select(F.schema_of_variant(F.variant_get("doc", "$.a", "variant"))).first()[0]
    assert kinds.startswith("DECIMAL")
