"""Operators of the document engine on tiny documents, typed and schemaless."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import treeloom as tl
from treeloom import Field, TempField, etl, from_objects, get, get_from_parent, get_from_root, index, key, node


def rows(frame, *columns):
    frame = frame.select(*columns) if columns else frame
    out = [tuple(json.loads(str(v)) if type(v).__name__ == "VariantVal" else v for v in r) for r in frame.collect()]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


USERS = {"users": [{"id": "u1", "name": "Ann", "posts": [{"id": "p1", "title": "x"}, {"id": "p2", "title": None}]}, {"id": "u2", "name": "Bob", "posts": []}]}
USERS_SCHEMA = "users array<struct<id:string,name:string,posts:array<struct<id:string,title:string>>>>"
FORMS = [None, "struct<" + USERS_SCHEMA.replace("users ", "users:") + ">"]


@pytest.mark.parametrize("schema", FORMS)
def test_two_levels_keep_ancestors_and_drop_empty_lists(spark, schema):
    root = from_objects([USERS], schema=schema)
    t = etl(root).goto("users").each().goto("posts").each().map_to("posts", [Field("id", get("id")), Field("user", get_from_parent("id")), Field("n", index()), Field("m", tl.parent_index())]).run().tables["posts"]
    assert rows(t) == [("p1", "u1", 0, 0), ("p2", "u1", 1, 0)]


def test_typed_scan_reads_only_what_is_used(spark, tmp_path):
    spark.createDataFrame([(1, [(1, 2, "x")])], "id int, lines array<struct<a:int,b:int,c:string>>").write.parquet(str(tmp_path / "d"))
    t = etl(spark.read.parquet(str(tmp_path / "d"))).goto("lines").each().map_to("l", [Field("a", get("a"))]).run().tables["l"]
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "lines:array<struct<a:int>>" in plan and "id:int" not in plan


def test_object_entries_scalars_and_nulls(spark):
    doc = {"m": {"b": [1, 2], "a": []}, "words": ["x", None], "one": 5, "none": None}
    m = etl(doc).goto("m").each().each().map_to("m", [Field("k", tl.parent_key()), Field("v", tl.apply(int, node()))]).run().tables["m"]
    assert rows(m) == [("b", 1), ("b", 2)]
    words = etl(doc).goto("words").each().map_to("w", [Field("v", tl.apply(str, node())), Field("i", index())]).run().tables["w"]
    assert rows(words) == [("None", 1), ("x", 0)]
    one = etl(doc).goto("one").each().map_to("o", [Field("v", tl.apply(int, node())), Field("k", key())]).run().tables["o"]
    assert rows(one) == [(5, None)]
    for path in ("none", "missing"):
        assert etl(doc).goto(path).each().map_to("n", [Field("v", node())]).run().tables["n"].count() == 0


def test_row_without_each_and_trailing_goto(spark):
    doc = {"items": [{"id": 1, "child": {"x": 5}}, {"id": 2}]}
    t = etl(doc).goto("items").each().goto("child").map_to("t", [Field("id", tl.apply(int, get_from_parent("id"))), Field("x", tl.apply(int, get("x"))), Field("i", tl.parent_index()), Field("own", index())]).run().tables["t"]
    assert rows(t) == [(1, 5, 0, None), (2, None, 1, None)]
    gone = etl(doc).goto("nowhere").map_to("g", [Field("x", get("x")), Field("same", get_from_parent("x"))]).run().tables["g"]
    assert gone.count() == 1
    here = etl({"a": {"x": 1}}).goto("a").map_to("h", [Field("x", tl.apply(int, get("x"))), Field("up", tl.apply(int, get_from_parent("x")))]).run().tables["h"]
    assert rows(here) == [(1, 1)]


def test_three_levels_and_level_one_parent_is_the_container(spark):
    doc = {"levels": {"a": {"x": [1, 2]}, "b": {"y": [3]}}}
    t = etl(doc).goto("levels").each().each().each().map_to("t", [Field("a", tl.parent_key(2)), Field("x", tl.parent_key()), Field("v", tl.apply(int, node()))]).run().tables["t"]
    assert rows(t) == [("a", "x", 1), ("a", "x", 2), ("b", "y", 3)]
    sibling = etl({"m": {"a": 1, "b": 2}}).goto("m").each().map_to("s", [Field("b", tl.apply(int, get_from_parent("b")))]).run().tables["s"]
    assert rows(sibling) == [(2,), (2,)]


def test_paths_digits_and_bounds(spark):
    doc = {"a": [10, 20], "m": {"0": "zero"}}
    t = etl(doc).map_to("t", [Field("first", tl.apply(int, get("a.0"))), Field("over", get("a.9")), Field("minus", get(["a", -1])), Field("key", tl.apply(str.lower, get(["m", "0"]))), Field("no", get("m.0")), Field("root", tl.apply(int, get_from_root("a.1")))]).run().tables["t"]
    assert rows(t) == [(10, None, None, "zero", None, 20)]


@pytest.mark.parametrize("schema", [None, "struct<s:string,n:string,e:string,i:bigint,d:double,b:boolean,l:array<int>,m:map<string,int>>"])
def test_scalar_transforms(spark, schema):
    doc = {"s": "ab", "n": None, "e": "", "i": 5, "d": 2.5, "b": True, "l": [1, 2], "m": {"k": 1}}
    fields = [
        Field("concat", tl.concat(get("s"), get("n"), get("i"), get("d"), get("b"))),
        Field("fid", tl.format_id(get("s"), get("n"), get("e"), get("i"), sep="-")),
        Field("none", tl.format_id(get("n"), get("e"))),
        Field("co", tl.apply(str, tl.coalesce(get("n"), get("e"), get("s")))),
        Field("ls", tl.len_of(get("s"))),
        Field("ll", tl.len_of(get("l"))),
        Field("lm", tl.len_of(get("m"))),
        Field("li", tl.len_of(get("i"))),
        Field("le", tl.len_of(get("e"))),
    ]
    t = etl(from_objects([doc], schema=schema)).map_to("t", fields).run().tables["t"]
    assert rows(t) == [("ab52.5True", "ab-5", "", "", 2, 2, 1, None, 0)]


def test_apply_python_gets_none_and_errors_end_the_query(spark):
    docs = from_objects([{"x": "3"}, {"x": None}, {"x": "bad"}], schema="struct<x:string>")
    t = etl(docs).map_to("t", [Field("v", tl.apply(lambda v: "none" if v is None else v + "!", get("x")))]).run().tables["t"]
    assert rows(t) == [("3!",), ("bad!",), ("none",)]
    with pytest.raises(Exception, match="bad|CAST"):
        etl(docs).map_to("t", [Field("v", tl.apply(int, get("x")))]).run().tables["t"].collect()
    soft = etl(docs).map_to("t", [Field("v", tl.apply(int, get("x"), on_error="null"))]).run().tables["t"]
    assert rows(soft) == [(3,), (None,), (None,)]


def test_transform_decorator_and_selectors(spark):
    @tl.transform
    def part(ctx, path, n):
        return F.split_part(ctx.get(path).col, F.lit("_"), F.lit(n))

    t = etl(from_objects([{"c": "a_b"}], schema="struct<c:string>")).map_to("t", [Field("v", part("c", 2))]).run().tables["t"]
    assert rows(t) == [("b",)]
    with pytest.raises(ValueError, match="ctx"):
        tl.transform(lambda x: x)

    class M:
        email: str

    assert tl.field_of(M, lambda m: m.email) == "email"
    for bad in (lambda m: m.a.b, lambda m: m, lambda m: 1, lambda m: m.a(), lambda m: m["a"]):
        with pytest.raises(ValueError):
            tl.field_of(M, bad)


def test_keyed_merge_ragged_last_write_and_id(spark):
    doc = {"users": [{"id": 1, "name": "A"}, {"id": 1, "name": None}, {"id": None, "name": "lost"}], "emails": [{"user_id": 1, "email": "e"}, {"user_id": 2, "email": "f"}]}
    p = etl(doc).goto("users").each().map_to("u", [TempField("k", tl.apply(int, get("id"))), Field("name", tl.apply(str.upper, get("name")))], join_on=["k"])
    p = p.goto_root().goto("emails").each().map_to("u", [TempField("k", tl.apply(int, get("user_id"))), Field("email", tl.apply(str.upper, get("email")))], join_on=["k"])
    assert rows(p.run().tables["u"], "id", "name", "email") == [(1, None, "E"), (2, None, "F")]


def test_empty_text_keys_drop_and_false_and_zero_stay(spark):
    docs = from_objects([{"k": "", "z": 0}, {"k": "a", "z": 0}], schema="struct<k:string,z:int>")
    assert etl(docs).map_to("t", [Field("k", get("k"))], join_on=["k"]).run().tables["t"].count() == 1
    assert etl(docs).map_to("t", [Field("z", get("z"))], join_on=["z"]).run().tables["t"].count() == 1


def test_policies_in_arrival_order_over_documents(spark):
    events = [{"u": "a", "v": 2, "tags": ["x"], "f": None}, {"u": "a", "v": None, "tags": None, "f": False}, {"u": "a", "v": 5, "tags": ["y", "z"], "f": True}, {"u": "b", "v": None, "tags": None, "f": None}]
    docs = from_objects(events, schema="struct<u:string,v:bigint,tags:array<string>,f:boolean>")
    f = [
        Field("u", get("u")),
        Field("add", get("v"), tl.AddPolicy()),
        Field("app", get("v"), tl.AppendPolicy()),
        Field("ext", get("tags"), tl.ExtendPolicy()),
        Field("lo", get("v"), tl.MinPolicy()),
        Field("hi", get("v"), tl.MaxPolicy()),
        Field("first", get("f"), tl.FirstNonNullPolicy()),
        Field("last", get("v")),
    ]
    assert rows(etl(docs).map_to("t", f, join_on=["u"]).run().tables["t"].drop("id")) == [("a", 7, [2, 5], ["x", "y", "z"], 2, 5, False, 5), ("b", 0, [], [], None, None, None, None)]
    with pytest.raises(TypeError):
        etl(docs).map_to("t", [Field("u", get("u")), Field("x", get("u"), tl.AddPolicy())], join_on=["u"]).run()
    with pytest.raises(ValueError, match="two merge policies"):
        etl(docs).map_to("t", [Field("u", get("u")), Field("v", get("v"), tl.AddPolicy())], join_on=["u"]).map_to("t", [Field("u", get("u")), Field("v", get("v"), tl.MaxPolicy())], join_on=["u"]).run()


def test_text_and_number_keys_never_match(spark):
    a, b = from_objects([{"k": 1}], schema="struct<k:int>"), from_objects([{"k": "1"}], schema="struct<k:string>")
    p = etl(a, b).map_to("t", [Field("k", get("k"))], join_on=["k"]).goto_root(1).map_to("t", [Field("k", get("k"))], join_on=["k"])
    with pytest.raises(TypeError, match="never equals"):
        p.run()
    with pytest.raises(TypeError, match="cannot be a key"):
        etl(from_objects([{"k": [1]}], schema="struct<k:array<int>>")).map_to("t", [Field("k", get("k"))], join_on=["k"]).run()
    with pytest.raises(ValueError, match="join_on"):
        etl({"k": 1}).map_to("t", [Field("k", get("k"))], join_on=["nope"]).run()


def test_lookups(spark):
    doc = {"q": [{"id": "q1", "c": ["c1", "c2"]}, {"id": "q2", "c": ["c2"]}], "c": [{"id": "c1"}, {"id": "c2"}, {"id": "c3"}]}
    schema = "struct<q:array<struct<id:string,c:array<string>>>,c:array<struct<id:string>>>"
    p = etl(from_objects([doc], schema=schema), indices={"d": {"c1": "one", "c2": None}})
    p = p.goto("c").each().map_to("c", [Field("id", get("id")), Field("q", tl.lookup("of", get("id"))), Field("d", tl.lookup("d", get("id"), default="none"))])
    p = p.goto_root().goto("q").each().goto("c").each().build_index("of", key=node(), value=get_from_parent("id"))
    assert rows(p.run().tables["c"]) == [("c1", "q1", "one"), ("c2", "q2", None), ("c3", None, "none")]
    with pytest.raises(ValueError, match="available"):
        etl(doc).map_to("t", [Field("x", tl.lookup("gone", get("q")))]).run()
    with pytest.raises(ValueError):
        etl(doc).build_index("x")


def linked(docs, **options):
    p = etl(docs).goto("users").each().map_to("users", [Field("id", get("id")), Field("name", get("name"))])
    return p.goto_root().goto("posts").each().map_to("posts", [Field("title", get("title")), TempField("user_id", get("user_id"))]).link_to("users", by={"user_id": "id"}, **options)


@pytest.mark.parametrize("schema", [None, "struct<users:array<struct<id:int,name:string>>,posts:array<struct<title:string,user_id:int>>>"])
def test_link_to(spark, schema):
    doc = {"users": [{"id": 1, "name": "A"}, {"id": 1, "name": "last"}], "posts": [{"title": "x", "user_id": 1}, {"title": "y", "user_id": 9}, {"title": "z", "user_id": None}]}
    t = linked(from_objects([doc], schema=schema)).run().tables["posts"]
    assert [(str(r[0]).strip('"'), r[1]["name"] if r[1] is None or schema else str(r[1]["name"]).strip('"') if r[1] else None) if r[1] else (str(r[0]).strip('"'), None) for r in t.orderBy(F.col("title").cast("string")).collect()] == [("x", "last"), ("y", None), ("z", None)]
    errors = linked(from_objects([doc], schema=schema), required=True).run().errors
    assert errors.count() == 1


def test_backlink_keeps_order_repeats_and_skips_unknown(spark):
    doc = {"q": [{"id": "q1", "ids": ["c2", "c1", "gone", "c2"]}, {"id": "q2", "ids": None}], "c": [{"id": "c1", "t": "one"}, {"id": "c2", "t": "two"}]}
    docs = from_objects([doc], schema="struct<q:array<struct<id:string,ids:array<string>>>,c:array<struct<id:string,t:string>>>")
    p = etl(docs).goto("q").each().map_to("q", [Field("id", get("id")), TempField("ids", get("ids"))], join_on=["id"])
    p = p.goto_root().goto("c").each().map_to("c", [Field("id", get("id")), Field("t", get("t"))], join_on=["id"]).backlink("q", "c", "choices", by={"ids": "id"})
    assert [(r.id, [c.t for c in r.choices]) for r in p.run().tables["q"].orderBy("id").collect()] == [("q1", ["two", "one", "two"]), ("q2", [])]


def _moved(df) -> int:
    """Bytes that a frame's exchanges wrote, before compression."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    total, todo = 0, [execution.executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("dataSize").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_backlink_moves_no_list_with_each_of_its_ids(spark):
    n, of = 400, 8
    parents = spark.range(of).select("id", F.expr(f"transform(sequence(0, {n - 1}), x -> x * {of} + id)").alias("ids"))
    p = etl(parents, spark.range(n * of).withColumn("t", F.lit("text"))).map_to("q", [Field("id", get("id")), TempField("ids", get("ids"))], join_on=["id"])
    p = p.goto_root(1).map_to("c", [Field("id", get("id")), Field("t", get("t"))], join_on=["id"]).backlink("q", "c", "found", by={"ids": "id"})
    found = p.run().tables["q"]
    assert {r.id: [c.id for c in r.found] for r in found.collect()} == {i: [x * of + i for x in range(n)] for i in range(of)}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _moved(p.run().tables["q"]) < 400 * n * of  # a list has 3,200 bytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_backlink_tells_alike_lists_apart(spark):
    lists = [["a,b"], ["a", "b"], ["a", "b,"], ["b", "a"], ["a", "b"], [""], [], ["", ""], [None, "a"], ["a"], None, ["ab"], ["a", None, "", None, "b"]]
    docs = from_objects([{"q": [{"id": i, "ids": x} for i, x in enumerate(lists)], "c": [{"id": x} for x in ("a", "b", "a,b", "b,", "", "ab")]}], schema="struct<q:array<struct<id:int,ids:array<string>>>,c:array<struct<id:string>>>")
    p = etl(docs).goto("q").each().map_to("q", [Field("id", get("id")), TempField("ids", get("ids"))], join_on=["id"]).goto_root().goto("c").each().map_to("c", [Field("id", get("id"))])
    found = p.backlink("q", "c", "found", by={"ids": "id"}).run().tables["q"]
    assert {r.id: [c.id for c in r.found] for r in found.collect()} == {i: [v for v in x or [] if v is not None] for i, x in enumerate(lists)}
    # an hour that comes twice in New York: one text, two instants
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        at = spark.sql("SELECT id, timestamp_seconds(1730611800 + 3600 * id) AS at FROM range(2)")
        p = etl(at.select("id", F.array("at").alias("ats")), at).map_to("q", [Field("id", get("id")), TempField("ats", get("ats"))], join_on=["id"])
        p = p.goto_root(1).map_to("c", [Field("id", get("id")), Field("at", get("at"))], join_on=["id"]).backlink("q", "c", "found", by={"ats": "at"})
        assert {r.id: [c.id for c in r.found] for r in p.run().tables["q"].collect()} == {0: [0], 1: [1]}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_typed_targets_errors_and_modes(spark):
    import dataclasses

    @dataclasses.dataclass
    class Item:
        id: int
        count: int
        note: str | None = None

    docs = from_objects([{"id": 1, "count": "3"}, {"id": 2, "count": "x"}, {"id": 3, "count": None}], schema="struct<id:int,count:string>")
    fields = [Field("id", get("id")), Field("count", get("count"))]
    r = etl(docs).map_to(Item, fields, join_on=["id"]).run()
    assert rows(r.tables[Item], "id", "count") == [(1, 3)]
    assert sorted(m for e in r.errors.collect() for m in e.messages) == ["table=item key=2 count: not a valid bigint", "table=item key=3 count: required"]
    assert r.stats["item"].mapped == 1 and r.stats["item"].errors == 2
    with pytest.raises(RuntimeError, match="count"):
        etl(docs, errors="fail_fast").map_to(Item, fields, join_on=["id"]).run()
    with pytest.raises(ValueError, match="did you mean count"):
        etl(docs).map_to(Item, [Field("id", get("id")), Field("cuont", get("count"))]).run()
    checked = tl.Target("t", {"id": T.LongType()}, checks={"id": lambda c: c > 1})
    spec = tl.MappingSpec([tl.TraversalSpec([], [tl.InstanceEmit("t", [Field("id", get("id"))], builder=checked)], mode="single")])
    assert rows(tl.run_mapping(docs, spec)["t"].rows) == [(2,), (3,)]


def test_graph():
    assert tl.topological_sort({"b": {"a"}, "c": {"b", "c"}, "0": set()}) == ["0", "a", "b", "c"]
    with pytest.raises(ValueError, match="Circular"):
        tl.topological_sort({"a": {"b"}, "b": {"a"}})
    assert tl.weakly_connected_components({"b": {"a"}}, ["a", "b", "c"]) == [{"a", "b"}, {"c"}]
    assert tl.partition_components({"b": {"a"}, "c": {"e"}}, ["a", "b", "c", "d", "e"], ["e"]) == [{"a", "b"}, {"c", "d"}]


def test_builder_rejects_misuse(spark):
    with pytest.raises(IndexError):
        etl({}).goto_root(1)
    with pytest.raises(ValueError):
        etl({}).link_to("x", by={"a": "b"})
    with pytest.raises(ValueError):
        etl({}, errors="maybe")
    with pytest.raises(ValueError, match="stream needs load"):
        tl.stream([{}]).map_to("t", [Field("a", get("a"))]).run()


def test_empty_table_has_its_columns(spark):
    t = etl(from_objects([{"u": []}], schema="struct<u:array<struct<id:int>>>")).goto("u").each().map_to("u", [Field("id", get("id"))], join_on=["id"]).run().tables["u"]
    assert t.columns == ["id"] and t.count() == 0


def test_stream_chunks_keep_rows_apart_and_strategies_merge(spark):
    records = [{"users": [{"id": "1", "email": "e", "name": "n"}]}, {"users": [{"id": "1", "phone": "p", "name": None}]}]

    def load(strategy, **options):
        sink = tl.MemorySink()
        p = tl.stream(tl.OneRecordPerChunkSource(records), flush_strategy=strategy).goto("users").each()
        p.map_to("u", [Field(c, tl.apply(str.lower, get(c))) for c in ("id", "email", "phone", "name")], join_on=["id"]).load(sink, **options).run()
        return rows(sink.tables["u"])

    assert load(tl.KeyCompleteFlushStrategy()) == [("1", "e", None, "n"), ("1", None, "p", None)]
    assert load(tl.UpsertFlushStrategy("update")) == [("1", None, "p", None)]
    assert load(tl.UpsertFlushStrategy("skip")) == [("1", "e", None, "n")]
    assert load(tl.BufferedKeyFlushStrategy()) == [("1", "e", "p", "n")]


def test_stream_completeness_and_group_chunks(spark):
    def run(chunks):
        sink = tl.MemorySink()
        p = tl.stream(chunks).goto("users").each().map_to("users", [Field("id", get("id"))], join_on=["id"])
        p = p.goto_root().goto("posts").each().map_to("posts", [Field("t", get("t")), TempField("u", get("u"))]).link_to("users", by={"u": "id"})
        p.load(sink).run()
        return sink

    good = {"users": [{"id": 1}], "posts": [{"t": "x", "u": 1}]}
    assert run([good]).tables["posts"].count() == 1
    with pytest.raises(tl.RelationshipIncompleteError):
        run([good, {"users": [{"id": 2}], "posts": [{"t": "y", "u": 1}]}])
    grouped = list(tl.GroupByChunkSource([{"o": 1}, {"o": 1}, {"o": 2}, {"o": 1}], "o").chunks())
    assert [len(c.roots) for c in grouped] == [2, 1, 1]
    external = list(tl.ExternalPartitionChunkSource([{"o": 1}, {"o": 2}, {"o": 1}], "o").chunks())
    assert [len(c.roots) for c in external] == [2, 1]


def test_runs_along_an_order(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("aabbbaacc")], "n int, k string").repartition(3)
    got = sorted((r.n, r["__chunk"]) for r in tl.consecutive_groups(df, "k", "n").collect())
    ids = [c for _, c in got]
    assert [ids[i] != ids[i - 1] for i in range(1, 9)] == [False, True, False, False, True, False, True, False] and len(set(ids)) == 4


def test_database_sink(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, name TEXT)")

    def connect():
        import sqlite3

        return sqlite3.connect(path)

    for name in ("A", "B"):
        etl(from_objects([{"id": 1, "name": name}], schema="struct<id:int,name:string>")).map_to("u", [Field("id", get("id")), Field("name", get("name"))], join_on=["id"]).load(tl.DbApiSink(connect), upsert=True).run()
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT * FROM u").fetchall() == [(1, "B")]


def test_client_sink(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import json
        import types
        import uuid

        class Call:
            def __init__(self, name):
                self.name, self.call = name, None

            def insert(self, rows):
                self.call = ["insert", rows, None]
                return self

            def upsert(self, rows, on_conflict=None):
                self.call = ["upsert", rows, on_conflict]
                return self

            def execute(self):
                with open(f"{folder}/{self.name}-{uuid.uuid4().hex}", "w") as f:
                    json.dump(self.call, f)
                return types.SimpleNamespace(data=self.call[1])

        return types.SimpleNamespace(table=Call)

    docs = from_objects([{"id": i, "name": str(i)} for i in range(10)], schema="struct<id:int,name:string>")
    for name, upsert in (("a", False), ("b", True)):
        sink = tl.ClientSink(connect, batch_size=3, partitions=1)
        p = etl(docs).map_to(name, [Field("id", get("id")), Field("name", get("name"))], join_on=["id"]).load(sink, upsert=upsert)
        assert p.run().stats[name].inserted == 10
        sent = [json.loads(f.read_text()) for f in tmp_path.glob(f"{name}-*")]
        assert {(s[0], s[2]) for s in sent} == {("upsert", "id") if upsert else ("insert", None)} and max(len(s[1]) for s in sent) == 3
        assert sorted(r["id"] for s in sent for r in s[1]) == list(range(10))


def test_telemetry_survives_a_failing_callback(spark):
    seen = []

    def callback(event):
        seen.append(type(event).__name__)
        raise RuntimeError("ignored")

    etl({"a": 1}).map_to("t", [Field("a", tl.apply(int, get("a")))]).load(tl.MemorySink()).run(on_event=callback)
    assert seen == ["MapStarted", "MapCompleted", "FlushStarted", "FlushCompleted"]


def test_selectors_read_one_attribute_and_do_nothing_else():
    import math

    assert tl.field_of(object, lambda u: u.email) == "email"
    refused = [bool, int, float, str, len, iter, list, hash, abs, math.floor, lambda a: not a, lambda a: a and a, lambda a: a == 1, lambda a: a < 1, lambda a: a + 1, lambda a: -a, lambda a: 1 in a, lambda a: a[0], lambda a: a(), lambda a: f"{a}", lambda a: setattr(a, "x", 1), lambda a: a.b]
    for use in refused:
        with pytest.raises(ValueError):
            tl.field_of(object, lambda u: use(u.email))  # noqa: B023
    with pytest.raises(ValueError):
        tl.field_of(object, lambda u: u.a and u.b)


def model_class():
    """A class that looks like a model with validators of its own, made here so that it goes to the workers by value."""

    class Info:
        def __init__(self, needed):
            self.needed = needed

        def is_required(self):
            return self.needed

    class Wrong(ValueError):
        def errors(self):
            return [{"loc": ("age",), "msg": "must not be negative"}]

    class Model:
        id: int
        name: str
        age: int | None
        model_fields = {"id": Info(True), "name": Info(True), "age": Info(False)}

        class __pydantic_decorators__:
            field_validators = {"age": 1}

        def __init__(self, **values):
            self.__dict__.update(values)

        @classmethod
        def model_validate(cls, values):
            if values["age"] is not None and values["age"] < 0:
                raise Wrong
            if values["name"] == "boom":
                raise KeyError("name")
            return cls(id=values["id"], name=values["name"].strip(), age=values["age"])

    return Model


def test_models_build_their_rows(spark):
    Model = model_class()
    docs = [{"id": 1, "name": " Ann ", "age": 3}, {"id": 2, "name": "Bob", "age": -1}, {"id": 3, "name": "boom"}, {"id": 4, "name": None, "age": 1}, {"id": "x", "name": "Cy", "age": 2}]
    result = etl(docs).each().map_to(Model, [Field(c, get(c)) for c in ("id", "name", "age")], join_on=["id"]).run()
    assert [tuple(r) for r in result.tables[Model].select("id", "name", "age").collect()] == [(1, "Ann", 3)]
    found = sorted(m for r in result.errors.collect() for m in r.messages)
    assert sorted(m.split(" ", 2)[2] for m in found) == ["KeyError: 'name'", "age: must not be negative", "id: not a valid bigint", "name: required"]


def test_numbered_rows_are_exact(spark):
    docs = from_rows_of(spark, 1000)
    got = etl(docs).map_to("t", [Field("n", get("n"))]).run(in_order=True).numbered("t").collect()
    assert sorted((r.row_number, r.n) for r in got) == [(i, i) for i in range(1000)]
    with pytest.raises(ValueError):
        etl(docs).map_to("t", [Field("n", get("n"))]).run().numbered("t")


def from_rows_of(spark, n):
    return tl.from_rows(spark.range(n).selectExpr("id AS n").repartition(7), order_by="n")


def test_parquet_sink_versions(spark, tmp_path):
    sink = tl.ParquetSink(str(tmp_path / "out"), partitions=4)
    frame = lambda *r: spark.createDataFrame(r, "id int, v string")
    assert sink.write("t", frame((1, "a"), (2, "b"), (3, "c"), (None, "n")), "update", ["id"]) == 4
    before = sink.read(spark, "t")
    assert sink.write("t", frame((2, "B"), (9, "z")), "update", ["id"]) == 2
    want = [(1, "a"), (2, "B"), (3, "c"), (9, "z"), (None, "n")]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, sink.read(spark, "t").collect()), key=key) == want
    assert before.count() == 4  # an old reader still sees what it began with
    sink.write("t", frame((2, "x"), (10, "new")), "skip", ["id"])
    sink.write("t", spark.createDataFrame([(1, None, 5)], "id int, v string, w int"), "merge", ["id"])
    got = {r.id: (r.v, r.w) for r in sink.read(spark, "t").collect()}
    assert got == {1: ("a", 5), 2: ("B", None), 3: ("c", None), 9: ("z", None), 10: ("new", None), None: ("n", None)}
    assert sink.write("t", frame((7, "r")), "append", [], batch=("s", 3)) == 1
    assert sink.write("t", frame((7, "r")), "append", [], batch=("s", 3)) == 0 and sink.write("t", frame((7, "r")), "append", [], batch=("s", 2)) == 0
    assert sink.read(spark, "t").where("id = 7").count() == 1
    sink.write("t", frame((7, "once")), "update", ["id"])
    assert [r.v for r in sink.read(spark, "t").where("id = 7").collect()] == ["once"]
    count = sink.read(spark, "t").count()
    sink.vacuum(spark, "t")
    assert sink.read(spark, "t").count() == count and len(list((tmp_path / "out" / "t" / "versions").glob("[0-9]*"))) == 1
    sink.write("t", frame((1, "by v")), "update", ["v"])
    assert sink.read(spark, "t").count() == count + 1
    with pytest.raises(ValueError):
        sink.read(spark, "none")


def test_records_are_spilled_by_key(spark):
    sink = tl.MemorySink()
    records = ({"k": i % 5, "n": i} for i in range(1000))
    source = tl.ExternalPartitionChunkSource(records, "k", slice_rows=64)
    tl.stream(source).map_to("t", [Field("k", tl.apply(int, get("k"))), Field("n", tl.apply(int, get("n")), tl.AddPolicy())], join_on=["k"]).load(sink).run()
    assert sorted((r.k, r.n) for r in sink.tables["t"].collect()) == [(k, sum(range(k, 1000, 5))) for k in range(5)]
    empty = tl.MemorySink()
    tl.stream(tl.ExternalPartitionChunkSource(iter(()), "k")).map_to("t", [Field("k", tl.apply(int, get("k")))]).load(empty).run()
    assert empty.tables["t"].count() == 0


def test_documents_of_large_chunks_keep_their_order(spark):
    from treeloom.sources.chunks import batches

    roots = [r for group in batches(tl.PreSegmentedChunkSource([[{"a": i} for i in range(50)], [{"a": 50}]]), 10) for r in group]
    ats = [r["__at"] for root in roots for r in root.docs.collect()]
    assert sorted(ats) == list(range(51))
