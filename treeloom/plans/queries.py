"""Registered queries of the document operators, each with the SQL that gives the same rows from the flat tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.functions.policies import AddPolicy, AppendPolicy, ExtendPolicy, FirstNonNullPolicy, MaxPolicy, MergePolicy, MinPolicy
from treeloom.functions.selectors import field_of
from treeloom.functions.transforms import apply, coalesce, concat, format_id, get, get_from_parent, get_from_root, index, key, len_of, literal, lookup, node, parent_index, parent_key, transform
from treeloom.plans.lowlevel import InstanceEmit, IterationLevel, ManyToOneSpec, MappingSpec, TableEmit, TraversalSpec, bind_many_to_one, run_mapping
from treeloom.plans.pipeline import etl, stream
from treeloom.plans.schema import Target
from treeloom.plans.tables import Field, TempField
from treeloom.runtime import scratch_path, table
from treeloom.sources.chunks import CallableChunkSource, Chunk, ExternalPartitionChunkSource, GroupByChunkSource, OneRecordPerChunkSource, PreSegmentedChunkSource
from treeloom.sources.documents import from_json, from_rows
from treeloom.sources.sinks import MemorySink, ParquetSink
from treeloom.streaming.flush import BufferedKeyFlushStrategy, UpsertFlushStrategy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# documents made of the flat tables -----------------------------------------------------------------------------------


def order_docs(spark: SparkSession, d: str) -> DataFrame:
    """One document an order, with its lines as a list; an order without lines has an empty one."""
    lines = table(spark, d, "lineitem")
    joined = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    line = F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    return joined.groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority").agg(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), line)).alias("lines"))


def region_docs(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").groupBy("c_nationkey").agg(F.collect_list(F.struct("c_custkey", "c_name", "c_acctbal")).alias("customers"))
    nations = table(spark, d, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    by_region = nations.groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name", "customers")).alias("nations"))
    return table(spark, d, "region").join(by_region, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_regionkey", "r_name", "nations")


def supplier_docs(spark: SparkSession, d: str) -> DataFrame:
    """One document a supplier, with the ids of the parts it delivers in order."""
    parts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("part_ids"))
    return table(spark, d, "supplier").join(parts, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("s_suppkey", "s_name", "s_nationkey", "part_ids")


# navigation -----------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def unnest_lines(spark: SparkSession, d: str) -> DataFrame:
    fields = [Field("o_orderkey", get_from_parent("o_orderkey", depth=1)), Field("o_custkey", get_from_root("o_custkey")), Field("l_partkey", get("l_partkey")), Field("l_quantity", get("l_quantity"))]
    docs = order_docs(spark, d).select(F.struct("o_orderkey", "o_custkey", "lines").alias("order"))
    docs = docs.select(F.array("order").alias("orders"), F.col("order.o_custkey").alias("o_custkey"))
    return etl(docs).goto("orders").each().goto("lines").each().map_to("lines", fields).run().tables["lines"]


@query(
    "SELECT r_name, n_name, c_custkey, c_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey"
)
def unnest_three_levels(spark: SparkSession, d: str) -> DataFrame:
    docs = region_docs(spark, d).agg(F.collect_list(F.struct("*")).alias("regions"))
    fields = [Field("r_name", get_from_parent("r_name", depth=2)), Field("n_name", get_from_parent("n_name")), Field("c_custkey", get("c_custkey")), Field("c_name", get("c_name"))]
    return etl(docs).goto("regions").each().goto("nations").each().goto("customers").each().map_to("customers", fields).run().tables["customers"]


@query("SELECT o_custkey, o_orderpriority AS priority, o_orderkey FROM orders")
def map_items_key(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.collect_list("o_orderkey").alias("keys"))
    docs = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "keys"))).alias("by_priority"))
    fields = [Field("o_custkey", get_from_root("o_custkey")), Field("priority", parent_key()), Field("o_orderkey", node())]
    return etl(docs).goto("by_priority").each().each().map_to("orders", fields).run().tables["orders"]


@query("SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS position, unnest(embedding)::DOUBLE AS value FROM embeddings")
def array_index(spark: SparkSession, d: str) -> DataFrame:
    fields = [Field("vec_id", get_from_root("vec_id")), Field("label", get_from_root("label")), Field("position", index()), Field("value", apply(float, node()))]
    return etl(table(spark, d, "embeddings")).goto("embedding").each().map_to("cells", fields).run().tables["cells"]


@query(
    """SELECT o_orderkey, l.i - 1 AS line, generate_subscripts(l.pair, 1) - 1 AS part, unnest(l.pair) AS value
    FROM (SELECT o_orderkey, unnest(p) AS l FROM (SELECT o_orderkey, list_transform(range(1, len(v) + 1), lambda i: {'i': i, 'pair': v[i]}) AS p
      FROM (SELECT l_orderkey AS o_orderkey, list([l_partkey, l_suppkey] ORDER BY l_partkey, l_suppkey, l_linenumber) AS v FROM lineitem GROUP BY l_orderkey)))"""
)
def parent_positions(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber"))).alias("v"))
    docs = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("v", lambda x: F.array(x["l_partkey"], x["l_suppkey"])).alias("pairs"))
    fields = [Field("o_orderkey", get_from_root("o_orderkey")), Field("line", parent_index()), Field("part", index()), Field("value", node())]
    return etl(docs).goto("pairs").each().each().map_to("cells", fields).run().tables["cells"]


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.parse_json("props").alias("props"))
    return etl(events).map_to("props", [Field("event_id", get("event_id")), Field("k", apply(int, get("props.k")))]).run().tables["props"]


@query("SELECT event_id, 'k' AS name, json_extract_string(props, '$.k') AS value FROM events")
def json_items(spark: SparkSession, d: str) -> DataFrame:
    """Object entries of schemaless documents."""
    events = table(spark, d, "events").select("event_id", F.parse_json("props").alias("props"))
    fields = [Field("event_id", get_from_root("event_id")), Field("name", key()), Field("value", apply(str, node()))]
    return etl(events).goto("props").each().map_to("items", fields).run().tables["items"]


@query("SELECT count(*) AS orders, 'all' AS scope, max(o_orderkey) AS last FROM orders")
def singleton_row(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "orders").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")).alias("sums"))
    fields = [Field("orders", get_from_root("sums.n")), Field("scope", literal("all")), Field("last", get_from_parent("last"))]
    return etl(docs).goto("sums").map_to("summary", fields).run().tables["summary"]


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS gone FROM nation")
def missing_path_row(spark: SparkSession, d: str) -> DataFrame:
    """A trailing goto keeps the row even where the path leads nowhere."""
    docs = table(spark, d, "nation").agg(F.collect_list(F.struct("*")).alias("nations"))
    fields = [Field("n_nationkey", get_from_parent("n_nationkey")), Field("n_name", get_from_parent("n_name")), Field("gone", get("x"))]
    return etl(docs).goto("nations").each().goto("child").map_to("nations", fields).run().tables["nations"]


# transforms -----------------------------------------------------------------------------------------------------------


@query(
    """SELECT c_custkey, c_name || '/' || coalesce(c_mktsegment, '') AS label, c_custkey::VARCHAR || '_' || c_nationkey::VARCHAR AS cid, length(c_name) AS name_len,
    coalesce(c_mktsegment, c_name) AS first_value, 7 AS seven FROM customer"""
)
def scalar_transforms(spark: SparkSession, d: str) -> DataFrame:
    fields = [
        Field("c_custkey", get("c_custkey")),
        Field("label", concat(get("c_name"), "/", get("c_mktsegment"))),
        Field("cid", format_id(get("c_custkey"), literal(""), get("nothing"), get("c_nationkey"))),
        Field("name_len", len_of(get("c_name"))),
        Field("first_value", coalesce(get("nothing"), get("c_mktsegment"), get("c_name"))),
        Field("seven", literal(7)),
    ]
    return etl(table(spark, d, "customer")).map_to("customers", fields).run().tables["customers"]


@query(
    "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim(p_type) AS stripped, p_retailprice::BIGINT - (CASE WHEN p_retailprice::BIGINT > p_retailprice THEN 1 ELSE 0 END) AS whole, p_size::DOUBLE AS size, p_partkey::VARCHAR AS txt FROM part"
)
def apply_casts(spark: SparkSession, d: str) -> DataFrame:
    fields = [
        Field("p_partkey", get("p_partkey")),
        Field("up", apply(str.upper, get("p_name"))),
        Field("low", apply(str.lower, get("p_brand"))),
        Field("stripped", apply(str.strip, get("p_type"))),
        Field("whole", apply(int, get("p_retailprice"))),
        Field("size", apply(float, get("p_size"))),
        Field("txt", apply(str, get("p_partkey"))),
    ]
    return etl(table(spark, d, "part")).map_to("parts", fields).run().tables["parts"]


@query("SELECT p_partkey, reverse(p_name) AS backwards FROM part")
def apply_python(spark: SparkSession, d: str) -> DataFrame:
    """A Python function, in Arrow batches."""
    return etl(table(spark, d, "part")).map_to("parts", [Field("p_partkey", get("p_partkey")), Field("backwards", apply(lambda s: s[::-1], get("p_name")))]).run().tables["parts"]


@transform
def _word(ctx, path: str, n: int):
    return F.split_part(ctx.get(path).col, F.lit("#"), F.lit(n))


@query("SELECT c_custkey, split_part(c_name, '#', 2) AS number FROM customer")
def custom_transform(spark: SparkSession, d: str) -> DataFrame:
    return etl(table(spark, d, "customer")).map_to("customers", [Field("c_custkey", get("c_custkey")), Field("number", _word("c_name", 2))]).run().tables["customers"]


# keyed merges ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey AS id, c_name AS name, n AS orders FROM customer FULL OUTER JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def merge_two_paths(spark: SparkSession, d: str) -> DataFrame:
    """Two emissions into one table, from roots of different shape."""
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    p = etl(table(spark, d, "customer"), counts)
    p = p.map_to("customers", [Field("id", get("c_custkey")), Field("name", get("c_name"))], join_on=["id"])
    p = p.goto_root(1).map_to("customers", [TempField("key", get("o_custkey")), Field("orders", get("n"))], join_on=["key"])
    return p.run().tables["customers"]


def _events(spark: SparkSession, d: str):
    return etl(from_rows(table(spark, d, "events"), order_by="event_id"))


@query("SELECT user_id AS id, round(sum(value), 4) AS total, count(*) AS n, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY user_id")
def policy_add_min_max(spark: SparkSession, d: str) -> DataFrame:
    fields = [TempField("u", get("user_id")), Field("total", get("value"), AddPolicy()), Field("n", literal(1), AddPolicy()), Field("least", get("value"), MinPolicy()), Field("most", get("value"), MaxPolicy())]
    t = _events(spark, d).map_to("users", fields, join_on=["u"]).run().tables["users"]
    return t.select("id", F.round("total", 4).alias("total"), "n", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"))


@query("SELECT user_id AS id, string_agg(event_type, ',' ORDER BY event_id) AS types, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def policy_append_first_last(spark: SparkSession, d: str) -> DataFrame:
    fields = [TempField("u", get("user_id")), Field("types", get("event_type"), AppendPolicy()), Field("first_type", get("event_type"), FirstNonNullPolicy()), Field("last_type", get("event_type"))]
    t = _events(spark, d).map_to("users", fields, join_on=["u"]).run().tables["users"]
    return t.select("id", F.array_join("types", ",").alias("types"), "first_type", "last_type")


@query("SELECT s_nationkey AS id, string_agg(p, ',' ORDER BY s_suppkey, pos) AS parts FROM (SELECT s_nationkey, s_suppkey, unnest(ps)::VARCHAR AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT s_nationkey, s_suppkey, list_sort(list(DISTINCT l_partkey)) AS ps FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)) GROUP BY 1")
def policy_extend(spark: SparkSession, d: str) -> DataFrame:
    docs = from_rows(supplier_docs(spark, d), order_by="s_suppkey")
    t = etl(docs).map_to("nations", [TempField("n", get("s_nationkey")), Field("parts", get("part_ids"), ExtendPolicy())], join_on=["n"]).run().tables["nations"]
    return t.where(F.size("parts") > 0).select("id", F.array_join(F.col("parts").cast("array<string>"), ",").alias("parts"))


class Longest(MergePolicy):
    """The longest text, the earliest of equals: a policy in Python."""

    def merge(self, old, new):
        return new if new is not None and (old is None or len(new) > len(old)) else old


@query("SELECT c_nationkey AS id, arg_max(c_mktsegment, (length(c_mktsegment), -c_custkey)) AS segment FROM customer GROUP BY c_nationkey")
def policy_custom(spark: SparkSession, d: str) -> DataFrame:
    docs = from_rows(table(spark, d, "customer"), order_by="c_custkey")
    return etl(docs).map_to("nations", [TempField("n", get("c_nationkey")), Field("segment", get("c_mktsegment"), Longest())], join_on=["n"]).run().tables["nations"]


@query("SELECT l_orderkey, l_suppkey, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1, 2")
def composite_key(spark: SparkSession, d: str) -> DataFrame:
    fields = [Field("l_orderkey", get_from_root("o_orderkey")), Field("l_suppkey", get("l_suppkey")), Field("quantity", apply(int, get("l_quantity")), AddPolicy())]
    return etl(order_docs(spark, d)).goto("lines").each().map_to("pairs", fields, join_on=["l_orderkey", "l_suppkey"]).run().tables["pairs"]


# lookups --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'b' WHEN 'MACHINERY' THEN 'm' ELSE 'other' END AS code FROM customer")
def lookup_dict(spark: SparkSession, d: str) -> DataFrame:
    p = etl(table(spark, d, "customer"), indices={"codes": {"BUILDING": "b", "MACHINERY": "m"}})
    return p.map_to("customers", [Field("c_custkey", get("c_custkey")), Field("code", lookup("codes", get("c_mktsegment"), default="other"))]).run().tables["customers"]


@query("SELECT o_orderkey, l_partkey, p_brand AS brand FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey")
def lookup_built(spark: SparkSession, d: str) -> DataFrame:
    p = etl(order_docs(spark, d), table(spark, d, "part")).goto_root(1).build_index("brands", key=get("p_partkey"), value=get("p_brand"))
    fields = [Field("o_orderkey", get_from_root("o_orderkey")), Field("l_partkey", get("l_partkey")), Field("brand", lookup("brands", get("l_partkey")))]
    return p.goto_root(0).goto("lines").each().map_to("lines", fields).run().tables["lines"]


# relationships --------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def link_nation(spark: SparkSession, d: str) -> DataFrame:
    p = etl(table(spark, d, "nation"), table(spark, d, "customer"))
    p = p.map_to("nations", [Field("id", get("n_nationkey")), Field("name", get("n_name"))], join_on=["id"])
    p = p.goto_root(1).map_to("customers", [Field("c_custkey", get("c_custkey")), Field("c_name", get("c_name")), TempField("nation", get("c_nationkey"))]).link_to("nations", by={"nation": "id"})
    return p.run().tables["customers"].select("c_custkey", "c_name", F.col("nation.name").alias("n_name"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, n AS deliveries FROM lineitem LEFT JOIN (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2) ON p = l_partkey AND s = l_suppkey")
def link_composite(spark: SparkSession, d: str) -> DataFrame:
    docs = order_docs(spark, d)
    p = etl(docs).goto("lines").each().map_to("deliveries", [Field("part", get("l_partkey")), Field("supplier", get("l_suppkey")), Field("n", literal(1), AddPolicy())], join_on=["part", "supplier"])
    fields = [Field("l_orderkey", get_from_root("o_orderkey")), Field("l_partkey", get("l_partkey")), Field("l_suppkey", get("l_suppkey"))]
    p = p.map_to("lines", fields).link_to("deliveries", by={"l_partkey": "part", "l_suppkey": "supplier"}, attr="pair")
    return p.run().tables["lines"].select("l_orderkey", "l_partkey", "l_suppkey", F.col("pair.n").alias("deliveries"))


@query(
    """SELECT s_suppkey, coalesce(string_agg(p_name, '|' ORDER BY p_partkey), '') AS names FROM supplier
    LEFT JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON l_suppkey = s_suppkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY s_suppkey"""
)
def backlink_parts(spark: SparkSession, d: str) -> DataFrame:
    p = etl(supplier_docs(spark, d), table(spark, d, "part"))
    p = p.map_to("suppliers", [Field("s_suppkey", get("s_suppkey")), TempField("part_ids", get("part_ids"))], join_on=["s_suppkey"])
    p = p.goto_root(1).map_to("parts", [Field("p_partkey", get("p_partkey")), Field("p_name", get("p_name"))], join_on=["p_partkey"])
    t = p.backlink("suppliers", "parts", "parts", by={"part_ids": "p_partkey"}).run().tables["suppliers"]
    return t.select("s_suppkey", F.array_join(F.transform("parts", lambda x: x["p_name"]), "|").alias("names"))


@query("SELECT DISTINCT l_suppkey AS supplier_id, l_partkey AS part_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def junction_rows(spark: SparkSession, d: str) -> DataFrame:
    """A junction table of a parent's list of ids."""
    fields = [Field("supplier_id", get_from_root("s_suppkey")), Field("part_id", node())]
    return etl(supplier_docs(spark, d)).goto("part_ids").each().map_to("supplier_parts", fields, join_on=["supplier_id", "part_id"]).run().tables["supplier_parts"].select("supplier_id", "part_id")


@query("SELECT 'line_items' AS \"table\", order_id::VARCHAR AS missing, count(*) AS n FROM line_items_77 WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT id FROM orders_77) GROUP BY 2")
def missing_parent_errors(spark: SparkSession, d: str) -> DataFrame:
    p = etl(table(spark, d, "orders_77"), table(spark, d, "line_items_77"))
    p = p.map_to("orders", [Field("id", get("id")), Field("customer", get("customer"))], join_on=["id"])
    p = p.goto_root(1).map_to("line_items", [Field("sku", get("sku")), TempField("order_id", get("order_id"))]).link_to("orders", by={"order_id": "id"}, required=True)
    errors = p.run().errors
    return errors.groupBy("table", F.col("key")[0].alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey, n_name AS nation_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def foreign_keys(spark: SparkSession, d: str) -> DataFrame:
    """Foreign keys filled from the parent."""
    p = etl(table(spark, d, "nation"), table(spark, d, "supplier"))
    p = p.map_to("nations", [Field("nation_id", get("n_nationkey")), Field("name", get("n_name"))], join_on=["nation_id"])
    p = p.goto_root(1).map_to("suppliers", [Field("s_suppkey", get("s_suppkey")), TempField("nation", get("s_nationkey"))]).link_to("nations", by={"nation": "nation_id"}, fk={"nation_name": "name"})
    return p.run().tables["suppliers"].select("s_suppkey", "nation_name")



@query("SELECT raw.o AS l_orderkey, raw.p AS l_partkey, n_name AS nation FROM (SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem) raw JOIN supplier ON s_suppkey = raw.s JOIN nation ON n_nationkey = s_nationkey")
def linked_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A lookup whose key is the result of another one."""
    p = etl(order_docs(spark, d), table(spark, d, "supplier"), table(spark, d, "nation"))
    p = p.goto_root(1).build_index("nation_of", key=get("s_suppkey"), value=get("s_nationkey")).goto_root(2).build_index("name_of", key=get("n_nationkey"), value=get("n_name"))
    fields = [Field("l_orderkey", get_from_root("o_orderkey")), Field("l_partkey", get("l_partkey")), Field("nation", lookup("name_of", lookup("nation_of", get("l_suppkey"))))]
    return p.goto_root(0).goto("lines").each().map_to("lines", fields).run().tables["lines"]


# typed targets and low-level specifications --------------------------------------------------------------------------


@query("SELECT count(*) FILTER (WHERE author_id IS NOT NULL AND votes IS NOT NULL) AS good, count(*) FILTER (WHERE author_id IS NULL OR votes IS NULL) AS bad FROM documents")
def typed_errors(spark: SparkSession, d: str) -> DataFrame:
    target = Target("docs", {"author": T.LongType(), "votes": T.LongType()}, frozenset({"author", "votes"}))
    spec = MappingSpec([TraversalSpec([], [_instance("docs", target)], mode="single")])
    result = run_mapping(table(spark, d, "documents"), spec)["docs"]
    return result.rows.agg(F.count(F.lit(1)).alias("good")).crossJoin(result.errors.agg(F.count(F.lit(1)).alias("bad")))


def _instance(name: str, target: Target) -> InstanceEmit:
    return InstanceEmit(name, [Field("author", get("author_id")), Field("votes", get("votes"))], builder=target)


@query("SELECT r_regionkey, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def low_level_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Tables and a many-to-one link from specifications."""
    docs = region_docs(spark, d).agg(F.collect_list(F.struct("*")).alias("regions"))
    regions = TraversalSpec(["regions"], [TableEmit("regions", [Field("name", get("r_name"))], [get("r_regionkey")])])
    nations = TraversalSpec([], [TableEmit("nations", [Field("n_nationkey", get("n_nationkey")), Field("n_name", get("n_name")), Field("r_regionkey", get_from_parent("r_regionkey"))])], levels=[IterationLevel(["regions"]), IterationLevel(["nations"])])
    link = ManyToOneSpec("nations", "regions", "region", [get_from_parent("r_regionkey")])
    bound = bind_many_to_one(run_mapping(docs, MappingSpec([regions, nations]), links=[link]), [link])
    return bound["nations"].rows.select("r_regionkey", "n_nationkey", "n_name", F.col("region.name").alias("r_name"))


# streams and loads ----------------------------------------------------------------------------------------------------


@query("SELECT table_name, n FROM (SELECT 'nations' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'customers', count(*) FROM customer)")
def load_stats(spark: SparkSession, d: str) -> DataFrame:
    p = etl(table(spark, d, "nation"), table(spark, d, "customer"))
    p = p.map_to("nations", [Field("id", get("n_nationkey"))], join_on=["id"]).goto_root(1).map_to("customers", [Field("id", get("c_custkey"))])
    stats = p.load(ParquetSink(scratch_path(spark, "load"))).run().stats
    return spark.createDataFrame([(n, s.inserted) for n, s in stats.items()], "table_name string, n bigint")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_parity(spark: SparkSession, d: str) -> DataFrame:
    """A file stream through the same plan, batch by batch."""
    schema = table(spark, d, "events").schema
    folder = scratch_path(spark, "stream-in")
    table(spark, d, "events").repartition(3).write.parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    sink = ParquetSink(scratch_path(spark, "stream-out"))
    fields = [Field("event_id", get("event_id")), Field("user_id", get("user_id")), Field("event_type", get("event_type"))]
    stream(source).map_to("events", fields).load(sink).run(checkpoint=scratch_path(spark, "stream-state"))
    return sink.read(spark, "events")


def _upsert(spark: SparkSession, d: str, strategy) -> DataFrame:
    events = table(spark, d, "events")
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    sink = MemorySink()
    for part in (events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)):
        p = stream(from_rows(part, order_by="event_id").docs.select("__doc.*", "__at"), flush_strategy=strategy)
        p.map_to("users", [Field("user_id", get("user_id")), Field("event_type", get("event_type"))], join_on=["user_id"]).load(sink).run()
    return sink.tables["users"].select("user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_update(spark: SparkSession, d: str) -> DataFrame:
    return _upsert(spark, d, UpsertFlushStrategy("update"))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM (SELECT *, min(late) OVER (PARTITION BY user_id) AS first_half FROM (SELECT *, event_id > (SELECT quantile_disc(event_id, 0.5) FROM events) AS late FROM events)) WHERE late = first_half GROUP BY user_id")
def upsert_skip(spark: SparkSession, d: str) -> DataFrame:
    return _upsert(spark, d, UpsertFlushStrategy("skip"))


@query("SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_id % 3 <> 0) AS event_type, arg_max(value, event_id) FILTER (WHERE event_id % 3 <> 1) AS value FROM events GROUP BY user_id")
def upsert_buffered(spark: SparkSession, d: str) -> DataFrame:
    """Rows with gaps, in three batches: later ones fill in and replace, nulls replace nothing."""
    gaps = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 != 1, F.col("value")).alias("value"))
    low, high = gaps.agg(F.min("event_id"), F.max("event_id")).first()
    third = (high - low) // 3 + 1
    sink = ParquetSink(scratch_path(spark, "buffered"))
    for i in range(3):
        part = gaps.where(F.col("event_id").between(low + i * third, low + (i + 1) * third - 1)).withColumn("__chunk", F.col("event_id"))
        p = stream(part, flush_strategy=BufferedKeyFlushStrategy())
        p.map_to("users", [Field(c, get(c)) for c in ("user_id", "event_type", "value")], join_on=["user_id"]).load(sink).run()
    return sink.read(spark, "users").select("user_id", "event_type", "value")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_parquet(spark: SparkSession, d: str) -> DataFrame:
    """Two batches into folders of which each write renews only the hash partitions it touches; the second comes twice."""
    events = table(spark, d, "events")
    middle = events.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)")).first()[0]
    sink = ParquetSink(scratch_path(spark, "upserted"))
    parts = [events.where(F.col("event_id") <= middle), events.where(F.col("event_id") > middle)]
    for part in (*parts, parts[1]):
        p = stream(from_rows(part, order_by="event_id").docs.select("__doc.*", "__at"), flush_strategy=UpsertFlushStrategy("update"))
        p.map_to("users", [Field("user_id", get("user_id")), Field("event_type", get("event_type"))], join_on=["user_id"]).load(sink).run()
    return sink.read(spark, "users").select("user_id", "event_type")


@query("SELECT event_id, event_type FROM events")
def replayed_batch(spark: SparkSession, d: str) -> DataFrame:
    """A stream that is run again from its beginning: what has been written is not appended once more."""
    sink, name = ParquetSink(scratch_path(spark, "replayed")), scratch_path(spark, "feed")
    for _ in range(2):
        stream(table(spark, d, "events")).map_to("events", [Field("event_id", get("event_id")), Field("event_type", get("event_type"))]).load(sink).run(checkpoint=name)
    return sink.read(spark, "events")


@query(
    """SELECT sum(new)::BIGINT AS n, count(DISTINCT user_id) AS users FROM
  (SELECT user_id, CASE WHEN user_id IS NOT DISTINCT FROM lag(user_id) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events)"""
)
def grouped_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive equal keys as chunks; a key that comes back makes another row."""
    sink = MemorySink()
    source = GroupByChunkSource(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")
    stream(source).map_to("runs", [Field("user_id", get("user_id")), Field("n", literal(1), AddPolicy())], join_on=["user_id"]).load(sink).run()
    return sink.tables["runs"].agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))



@query("SELECT c_custkey, n_name AS nation_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def eager_dimension(spark: SparkSession, d: str) -> DataFrame:
    """A small dimension mapped once and linked to every batch."""
    sink = MemorySink()
    nations = table(spark, d, "nation")
    p = stream(table(spark, d, "customer").select("c_custkey", "c_nationkey"), eager_roots=[nations])
    p = p.map_to("nations", [Field("id", get("n_nationkey")), Field("name", get("n_name"))], join_on=["id"]).load_eager("nations")
    p = p.goto_root(0).map_to("customers", [Field("c_custkey", get("c_custkey")), TempField("nation", get("c_nationkey"))]).link_to("nations", by={"nation": "id"}, fk={"nation_name": "name"})
    p.load(sink).run()
    return sink.tables["customers"].select("c_custkey", "nation_name")



@query("SELECT doc_id, source FROM documents")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """Typed documents from JSON text."""
    text = table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "source")).alias("body"))
    root = from_json(text, "body", schema="doc_id bigint, source string")
    return etl(root).map_to("docs", [Field("doc_id", get("doc_id")), Field("source", get("source"))]).run().tables["docs"]


# chunk sources, order, targets -----------------------------------------------------------------------------------------


def _nations(spark: SparkSession, d: str) -> list[dict]:
    """The nations, 25 at any scale, as Python records."""
    return [r.asDict() for r in table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


def _nation_rows(source) -> DataFrame:
    sink = MemorySink()
    stream(source).map_to("nations", [Field("n_nationkey", apply(int, get("n_nationkey"))), Field("n_name", apply(str, get("n_name")))]).load(sink).run(chunks_per_batch=7)
    return sink.tables["nations"]


@query("SELECT n_nationkey, n_name FROM nation")
def one_record_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _nation_rows(OneRecordPerChunkSource(_nations(spark, d)))


@query("SELECT n_nationkey, n_name FROM nation")
def callable_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = _nations(spark, d)
    return _nation_rows(CallableChunkSource(lambda: (Chunk((r,)) for r in rows)))


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def segmented_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Records cut into segments by the caller: each holds all rows of its keys."""
    rows, sink = _nations(spark, d), MemorySink()
    segments = [[r for r in rows if r["n_regionkey"] == k] for k in sorted({r["n_regionkey"] for r in rows})]
    p = stream(PreSegmentedChunkSource(segments)).map_to("regions", [Field("region", apply(int, get("n_regionkey"))), Field("n", literal(1), AddPolicy())], join_on=["region"])
    p.load(sink).run()
    return sink.tables["regions"].select("region", "n")


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def external_records(spark: SparkSession, d: str) -> DataFrame:
    """Python records brought together by key, wherever they stand, through shared storage."""
    sink = MemorySink()
    source = ExternalPartitionChunkSource(iter(_nations(spark, d)), "n_regionkey", slice_rows=10)
    stream(source).map_to("regions", [Field("region", apply(int, get("n_regionkey"))), Field("n", literal(1), AddPolicy())], join_on=["region"]).load(sink).run()
    return sink.tables["regions"].select("region", "n")


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def external_chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk a key, wherever its records stand in a frame."""
    sink = MemorySink()
    source = ExternalPartitionChunkSource(table(spark, d, "events").select("event_id", "user_id"), "user_id")
    stream(source).map_to("users", [Field("user_id", get("user_id")), Field("n", literal(1), AddPolicy())], join_on=["user_id"]).load(sink).run()
    return sink.tables["users"].select("user_id", "n")


@query("SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS row_number FROM events")
def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a table without keys, numbered in the order of arrival."""
    return _events(spark, d).map_to("events", [Field("event_id", get("event_id")), Field("event_type", get("event_type"))]).run(in_order=True).numbered("events")


@query("SELECT s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey FROM customer")
def union_of_emissions(spark: SparkSession, d: str) -> DataFrame:
    """Two emissions without keys into one table, from roots of different shape."""
    p = etl(table(spark, d, "supplier"), table(spark, d, "customer"))
    p = p.map_to("parties", [Field("name", get("s_name")), Field("nation", get("s_nationkey"))])
    return p.goto_root(1).map_to("parties", [Field("name", get("c_name")), Field("nation", get("c_nationkey"))]).run().tables["parties"]


@dataclass
class Nation:
    n_nationkey: int
    n_name: str
    region: int | None = None


@query("SELECT n_nationkey, n_name, n_regionkey AS region FROM nation")
def class_routing(spark: SparkSession, d: str) -> DataFrame:
    """A table named and typed by a class."""
    fields = [Field("n_nationkey", get("n_nationkey")), Field(field_of(Nation, lambda n: n.n_name), get("n_name")), Field("region", get("n_regionkey"))]
    return etl(table(spark, d, "nation")).map_to(Nation, fields, join_on=["n_nationkey"]).run().tables[Nation]


class Answer:
    """Targets with conditions: as columns, and in Python."""

    __checks__ = {"votes": lambda c: c >= 0}
    __validators__ = {"kind": lambda v: v == "answer"}

    def __init__(self, doc_id: int, votes: int, kind: str):
        self.doc_id, self.votes, self.kind = doc_id, votes, kind


@query(
    """SELECT doc_id::VARCHAR AS doc, 'table=answer key=' || doc_id || ' ' || CASE WHEN votes IS NULL THEN 'votes: required' WHEN votes < 0 THEN 'votes: check failed' ELSE 'kind: check failed' END AS message
    FROM documents WHERE votes IS NULL OR votes < 0 OR doc_kind <> 'answer'"""
)
def target_messages(spark: SparkSession, d: str) -> DataFrame:
    """Rows that do not fit a class, each with what is wrong with it."""
    fields = [Field("doc_id", get("doc_id")), Field("votes", get("votes")), Field("kind", get("doc_kind"))]
    errors = etl(table(spark, d, "documents")).map_to(Answer, fields, join_on=["doc_id"]).run().errors
    return errors.select(F.col("key")[0].alias("doc"), F.explode("messages").alias("message"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' END AS code FROM nation")
def index_of_dict(spark: SparkSession, d: str) -> DataFrame:
    p = etl(table(spark, d, "nation")).build_index("codes", from_dict={0: "zero", 1: "one"})
    return p.map_to("nations", [Field("n_nationkey", get("n_nationkey")), Field("code", lookup("codes", get("n_regionkey")))]).run().tables["nations"]


@query("SELECT n_nationkey, field, value FROM (SELECT n_nationkey, 'name' AS field, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation)")
def level_of_items(spark: SparkSession, d: str) -> DataFrame:
    """Entries of an object, by a low-level specification."""
    docs = table(spark, d, "nation").select("n_nationkey", F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("fields"))
    emit = TableEmit("cells", [Field("n_nationkey", get_from_root("n_nationkey")), Field("field", key()), Field("value", node())])
    return run_mapping(docs, MappingSpec([TraversalSpec(["fields"], [emit], mode="items")]))["cells"].rows.select("n_nationkey", "field", "value")
