"""Registered queries of the general data-quality operators (problems 2 to 4)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.keyload import dominant_keys, per_key_counts
from treeloom.operators.orphans import orphan_references, orphan_report
from treeloom.operators.shred import post_links, users_and_posts
from treeloom.runtime import materialize, table

#: child table, reference, parent table
REFERENCES = [("line_items_77", "order_id", "orders_77"), ("posts_a", "user_id", "users_a"), ("items", "tag_id", "tags")]
#: Least share of a table's distinct rows that makes a key dominant.
DOMINANT = 0.02


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        orphan_references(table(spark, sf_dir, child), table(spark, sf_dir, parent), reference=ref).select(
            F.lit(child).alias("table_name"), F.col("month").alias("created_month"), "child_id", "kind"
        )
        for child, ref, parent in REFERENCES
    ]
    return reduce(DataFrame.unionByName, found)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p2_found(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_links(table(spark, sf_dir, "raw_docs"))


def p3_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, _ = users_and_posts(table(spark, sf_dir, "raw_docs"))
    return users.where("user_id IS NOT NULL").groupBy(F.col("src").alias("raw_no"), "user_id").agg(F.max("name").alias("name"))


def _key_counts(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    # range partitioning reads its input twice, once for the sample
    posts = materialize(p3_found(spark, sf_dir).select("user_id", "post_id"), "posts")
    return [
        ("line_items_85", per_key_counts(table(spark, sf_dir, "line_items_85").where("id IS NOT NULL"), "order_id", "id")),
        ("posts", per_key_counts(posts, "user_id", "post_id")),
    ]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [dominant_keys(counts, DOMINANT).select(F.lit(name).alias("table_name"), F.col("key").alias("key_text")) for name, counts in _key_counts(spark, sf_dir)]
    return reduce(DataFrame.unionByName, found)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows of every key."""
    found = [counts.select(F.lit(name).alias("table_name"), F.col("key").alias("key_text"), F.col("items").alias("distinct_rows")) for name, counts in _key_counts(spark, sf_dir)]
    return reduce(DataFrame.unionByName, found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p3_found": p3_found,
    "p3_users": p3_users,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
}

_ORPHANS = " UNION ALL ".join(
    f"""SELECT DISTINCT '{child}' AS table_name, strftime(c.created_at, '%Y-%m') AS created_month, c.id AS child_id,
      CASE WHEN p.born IS NULL THEN 'missing' WHEN p.born > c.created_at THEN 'late' ELSE 'deleted' END AS kind
    FROM {child} c LEFT JOIN (SELECT id, min(created_at) AS born FROM {parent} GROUP BY id) p ON p.id = c.{ref}
    WHERE c.{ref} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} a WHERE a.id = c.{ref}
      AND a.created_at <= c.created_at AND (a.deleted_at IS NULL OR c.created_at < a.deleted_at))"""
    for child, ref, parent in REFERENCES
)

#: What rows of bodies are: opened if they are JSON text, their type, their own id, and whether their keys are ids.
_READ = """(SELECT *, json_type(o) AS typ, coalesce(CASE WHEN trim(o->>'$.id') <> '' THEN o->>'$.id' END, map_key) AS own_id,
    coalesce(held AND entity IS NOT NULL AND json_type(o) = 'OBJECT' AND len(json_keys(o)) > 0 AND NOT list_has_any(json_keys(o), ['id', 'user_id', 'name', 'title', 'users', 'posts', 'replies'])
      AND (SELECT bool_and(coalesce(json_type(x.value), 'NULL') IN ('OBJECT', 'NULL')
        OR CASE WHEN json_type(x.value) = 'VARCHAR' AND json_valid(x.value->>'$') THEN json_type(x.value->>'$') = 'OBJECT' ELSE false END) FROM json_each(o) x), false) AS is_map
  FROM (SELECT *, CASE WHEN json_type(v) = 'VARCHAR' AND left(ltrim(v->>'$'), 1) IN ('{', '[') AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END AS o FROM nodes))"""

#: What the engine of the SQL reads as JSON and is none: commas before an end, numbers that are none.
_STRICT = r"""NOT regexp_matches(regexp_replace(body, '"(\\.|[^"\\])*"', '""', 'g'), ',\s*[}\]]|NaN|Infinity')"""

_SHRED = f"""nodes(raw_no, v, entity, held, map_key, owner) AS (
    SELECT raw_no, body::JSON, NULL::VARCHAR, false, NULL::VARCHAR, NULL::VARCHAR FROM raw_docs WHERE json_valid(body) AND {_STRICT}
    UNION ALL
    SELECT raw_no, e.value,
      CASE WHEN typ = 'ARRAY' OR is_map THEN entity WHEN e.key = 'users' THEN 'user' WHEN e.key IN ('posts', 'replies') THEN 'post' END,
      CASE WHEN typ = 'ARRAY' THEN entity IS NOT NULL AND json_type(e.value) = 'ARRAY' ELSE NOT is_map AND e.key IN ('users', 'posts', 'replies') END,
      CASE WHEN is_map THEN e.key END,
      CASE WHEN typ = 'OBJECT' AND NOT is_map AND entity = 'user' THEN own_id ELSE owner END
    FROM {_READ} p, json_each(p.o) e WHERE typ IN ('OBJECT', 'ARRAY')),
  objects AS (SELECT *, o->>'$.name' AS name, CASE WHEN trim(o->>'$.user_id') <> '' THEN o->>'$.user_id' ELSE owner END AS post_owner FROM {_READ} WHERE typ = 'OBJECT' AND NOT is_map),
  links AS (SELECT DISTINCT raw_no, post_owner AS user_id, own_id AS post_id FROM objects WHERE entity = 'post' AND own_id IS NOT NULL AND post_owner IS NOT NULL),
  counts AS (SELECT 'line_items_85' AS table_name, order_id::VARCHAR AS key_text, count(DISTINCT id) AS distinct_rows FROM line_items_85 WHERE order_id IS NOT NULL AND id IS NOT NULL GROUP BY order_id
    UNION ALL SELECT 'posts', user_id, count(DISTINCT post_id) FROM links GROUP BY user_id)"""

SQL: dict[str, str] = {
    "p3_found": f"WITH RECURSIVE {_SHRED} SELECT * FROM links",
    "p3_users": f"WITH RECURSIVE {_SHRED} SELECT raw_no, own_id AS user_id, max(name) AS name FROM objects WHERE entity = 'user' AND own_id IS NOT NULL GROUP BY ALL",
    "p4_found": f"""WITH RECURSIVE {_SHRED}
      SELECT table_name, key_text FROM (SELECT *, sum(distinct_rows) OVER (PARTITION BY table_name) AS total FROM counts) WHERE distinct_rows >= {DOMINANT} * total""",
    "p4_counts": f"WITH RECURSIVE {_SHRED} SELECT * FROM counts",
    "p2_found": _ORPHANS,
    "p2_report": f"SELECT table_name, created_month, kind, count(*) AS cases FROM ({_ORPHANS}) GROUP BY 1, 2, 3",
}
