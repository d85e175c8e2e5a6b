"""Orphan references, shredding and per-key counts against brute force on small and awkward tables."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.operators.keyload import dominant_keys, per_key_counts
from treeloom.operators.orphans import _ranges, orphan_references, orphan_report
from treeloom.operators.shred import _parse_deep, parse, post_links, shred, users_and_posts

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def brute_orphans(children, parents):
    out = set()
    for cid, ref, at in children:
        if ref is None:
            continue
        lives = [(b, d) for k, b, d in parents if k == ref]
        if not lives:
            kind = "missing"
        elif at is None or any((b is None or b <= at) and (d is None or at < d) for b, d in lives):
            continue
        else:
            kind = "late" if all(b is not None and b > at for b, _ in lives) else "deleted"
        out.add((cid, at.strftime("%Y-%m") if at else None, kind))
    return out


@pytest.mark.parametrize("ranges,sparse", [(1, 1), (5, 1), (60, 1), (7, 1 << 56)])
def test_orphans_match_brute_force(spark, ranges, sparse):
    rng = random.Random(ranges)
    parents = [(rng.randint(-5, 30) if rng.random() > 0.05 else None, START + DAY * rng.randint(0, 90) if rng.random() > 0.1 else None, None) for _ in range(60)]
    parents = [(k, b, (b or START) + DAY * rng.randint(0, 40) if rng.random() > 0.4 else None) for k, b, _ in parents]
    parents = [(k and k * sparse, b, d) for k, b, d in parents + parents[:10]]
    children = [(i, rng.choice([None, 3 * sparse, 3 * sparse, 3 * sparse, *(k * sparse for k in range(-6, 34))]), START + DAY * rng.randint(0, 120) if rng.random() > 0.05 else None) for i in range(300)]
    children += children[:40]
    c = spark.createDataFrame(children, "id bigint, ref bigint, created_at timestamp").withColumns({"key": F.lit("clash"), "range": F.lit(1), "kind": F.lit("x"), "block": F.lit(None).cast("string")})
    p = spark.createDataFrame(parents, "id bigint, created_at timestamp, deleted_at timestamp").withColumn("range", F.lit("clash"))
    got = orphan_references(c, p, reference="ref", ranges=ranges, range_rows=1)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute_orphans(children, parents)))


def test_references_are_spread_however_sparse_or_skewed(spark):
    keys = [k * (1 << 50) for k in range(400)] + [(1 << 58) + 1] * 600
    bounds = _ranges(spark.createDataFrame([(k,) for k in keys], "key bigint"), 10, 1)
    assert len(bounds) == 9 and sorted(bounds) == list(bounds)
    low, high = (np.searchsorted(bounds, np.array(keys, float), side) for side in ("left", "right"))
    share = np.zeros(10)
    for a, b in zip(low, high):
        share[a : b + 1] += 1 / (b - a + 1)
    assert share.max() < 200


def test_orphans_boundaries_and_empty_tables(spark):
    c = spark.createDataFrame([(1, 1, START), (2, 1, START + DAY), (3, 1, START - DAY)], "id bigint, ref bigint, created_at timestamp")
    p = spark.createDataFrame([(1, START, START + DAY)], "id bigint, created_at timestamp, deleted_at timestamp")
    kinds = {r.child_id: r.kind for r in orphan_references(c, p, reference="ref").collect()}
    assert kinds == {2: "deleted", 3: "late"}
    assert {r.kind for r in orphan_references(c, p.limit(0), reference="ref").collect()} == {"missing"}
    assert orphan_references(c.limit(0), p, reference="ref").count() == 0
    report = orphan_report(orphan_references(c, p, reference="ref").select(F.lit("c").alias("table_name"), F.col("month").alias("created_month"), "child_id", "kind"))
    assert {(r.kind, r.cases) for r in report.collect()} == {("deleted", 1), ("late", 1)}


BODIES = [
    ({"users": [{"id": 7, "posts": [{"id": "a"}, {"id": "b", "user_id": 9}, {"id": None}, None, {"id": "c", "user_id": "", "replies": [{"id": "r", "user_id": "u2"}, {"id": "s"}]}]}]}, {("7", "a"), ("9", "b"), ("7", "c"), ("u2", "r"), ("7", "s")}),
    ({"data": {"users": {"u1": {"name": "x", "posts": {"p1": {"title": "t"}, "p2": {"id": "own"}}}, "u2": {"posts": {"id": "single"}}}}}, {("u1", "p1"), ("u1", "own"), ("u2", "single")}),
    ({"users": json.dumps([{"id": "u", "posts": json.dumps([{"id": 1.50}])}])}, {("u", "1.5")}),
    ({"posts": [{"id": "a", "user_id": "u"}, {"id": "b"}], "users": [{"id": "u"}]}, {("u", "a")}),
    ({"users": [{"name": "no id", "posts": [{"id": "a"}]}, {"id": "v", "sections": [{"posts": [{"id": "b"}, {"id": "b"}]}, {"posts": None}, {"posts": 5}], "profile": {"badges": [{"id": "z"}]}}]}, {("v", "b")}),
    ({"users": [], "posts": {}}, set()),
]


def test_links_of_users_and_posts(spark):
    rows = [(i, json.dumps(b)) for i, (b, _) in enumerate(BODIES)]
    extra = [(100, None), (101, ""), (102, '{"users": [1,]}'), (103, '{"users":[{"id":"u","posts":[{"id":NaN}]}]}'), (None, rows[0][1]), (104, "5"), (0, rows[0][1]), (105, '{"users":[{"id":9007199254747518,"posts":[{"id":"q"}]}]}')]
    docs = spark.createDataFrame(rows + extra, "raw_no bigint, body string").withColumn("src", F.lit("clash"))
    got = {}
    for r in post_links(docs).collect():
        got.setdefault(r.raw_no, set()).add((r.user_id, r.post_id))
    for i, (_, want) in enumerate(BODIES):
        assert got.get(i, set()) == want, i
    assert got[None] == BODIES[0][1] and got[105] == {("9007199254747518", "q")}
    assert not {100, 101, 102, 103, 104} & set(got)
    assert post_links(docs.limit(0)).count() == 0


def test_very_deep_and_long_bodies(spark):
    deep = '{"users":[{"id":"u","x":' * 150 + '{"posts":[{"id":"p"}]}' + "}]}" * 150
    long = json.dumps({"users": [{"id": "u", "name": "n" * 300_000, "posts": [{"id": i} for i in range(20_000)]}]})
    too_deep = "[" * 200_000
    half = '{"users":[{"id":"u\\ud800","posts":[{"id":"\\ud83d\\ude00"}]}]}'
    docs = spark.createDataFrame([(1, deep), (2, long), (3, too_deep), (4, half)], "raw_no bigint, body string")
    counts = {r.raw_no: r["count"] for r in post_links(docs).groupBy("raw_no").count().collect()}
    assert counts == {1: 1, 2: 20_000, 4: 1}


def test_adjacency_round_trip(spark):
    body = {"a": [1, {"b": None}, "x"], "c": {"d": True, "e": []}}
    nodes = shred(spark.createDataFrame([(1, json.dumps(body))], "raw_no bigint, body string"), doc_id="raw_no", body="body", containers={"posts": "post"}).collect()
    below = {}
    for n in sorted(nodes, key=lambda n: n.node):
        below.setdefault(n.parent, []).append(n)

    def build(n):
        kids = sorted(below.get(n.node, []), key=lambda k: k.ordinal)
        if n.kind == "object":
            return {k.label: build(k) for k in kids}
        if n.kind == "array":
            return [build(k) for k in kids]
        return {"null": None, "boolean": n.scalar == "true"}[n.kind] if n.kind in ("null", "boolean") else json.loads(n.scalar) if n.kind == "number" else n.scalar

    assert build(below[-1][0]) == body
    users, posts = users_and_posts(spark.createDataFrame([(1, json.dumps(BODIES[0][0]))], "raw_no bigint, body string"))
    assert users.count() == 1 and posts.where("parent IS NOT NULL").count() == 6
    assert parse("1.0") == "1.0"


@pytest.mark.parametrize("chunk,parts", [(1, 3), (7, 4), (1000, 2)])
def test_counts_match_grouping(spark, chunk, parts):
    rng = random.Random(chunk)
    rows = [(rng.choice([None, "hot", "hot", "hot", *"abcdef"]), rng.choice([None, *range(60)])) for _ in range(2000)] + [("one", 5)] * 400
    df = spark.createDataFrame(rows, "k string, i bigint").repartition(5).withColumns({"key": F.lit(1), "pid": F.lit("x"), "from": F.lit(0)})
    got = {r.key: (r["rows"], r["items"]) for r in per_key_counts(df, "k", "i", chunk_rows=chunk, partitions=parts).collect()}
    want = {r.k: (r.n, r.d) for r in df.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d")).collect()}
    assert got == want
    assert per_key_counts(df.limit(0), "k", "i").count() == 0


def test_dominant_keys_at_the_threshold(spark):
    counts = spark.createDataFrame([("a", 49), ("b", 2), ("c", 49)], "key string, items bigint")
    assert {r.key for r in dominant_keys(counts, 0.02).collect()} == {"a", "b", "c"}
    assert {r.key for r in dominant_keys(counts, 0.0201).collect()} == {"a", "c"}
    assert dominant_keys(counts.limit(0), 0.02).count() == 0


def test_bodies_nested_deeper_than_the_parser_recurses(spark):
    deep = 20_000
    body = '{"users": [{"id": "u", "posts": [{"id": "p"}], "meta": ' + '{"a": [' * deep + "1.50" + "]}" * deep + "}]}"
    docs = spark.createDataFrame([(1, body), (2, body[:-1]), (3, '{"users": [{"id": 7, "posts": [{"id": 1}]}]}')], "raw_no bigint, body string")
    assert sorted(map(tuple, post_links(docs).collect())) == [(1, "u", "p"), (3, "7", "1")]
    rng, good = random.Random(1), '{"a": [1, -2.5e3, null, true, {"b": "x\\u00e9\\"", "b": {}}, []], "c": false, "": "\\ud800"}'
    texts = ["", " ", "[1,]", '{"a":1,}', "[NaN]", "-Infinity", "[01]", "[1] 2", '"\t"', "﻿[]", " [ ] ", "1", good]
    for _ in range(3000):
        i = rng.randrange(len(good))
        texts.append(good[:i] + rng.choice(["", '"', "]", "}", ",", ":", "1", " ", "{"]) + good[i + rng.randrange(2) :])
    for text in texts:
        try:
            want = repr(parse(text))
        except ValueError:
            want = "invalid"
        try:
            got = repr(_parse_deep(text))
        except ValueError:
            got = "invalid"
        assert got == want, text
