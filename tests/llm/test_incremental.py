import random
import string

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treeloom.llm.components import connected_components
from treeloom.llm.incremental import History, deduplicate
from treeloom.llm.slips import band_keys, deletions, minwise, one_slip


def slip(a, b):
    """Equal or one slip apart, by trying every slip."""
    if a == b:
        return True
    swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
    gone = lambda t: {t[:i] + t[i + 1 :] for i in range(len(t))}
    other = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    return b in swaps or b in gone(a) or a in gone(b) or other


def test_one_slip_and_deletions(spark):
    rng = random.Random(3)
    pairs = [("", ""), ("a", ""), ("ab", "ba"), ("ab", "b"), ("abc", "cab")]
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            if b:
                i = rng.randrange(len(b))
                b[i : i + 1] = rng.choice([[], [rng.choice("abc")], [b[i], rng.choice("abc")], [b[i]]])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").where("a <> '' AND b <> ''")
    for r in df.select("a", "b", one_slip(F.col("a"), F.col("b")).alias("near"), F.arrays_overlap(deletions(F.col("a")), deletions(F.col("b"))).alias("met")).collect():
        assert r.near == slip(r.a, r.b), (r.a, r.b)
        assert r.met or not r.near


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_minwise_depends_on_the_text_only(texts):
    together, signatures = minwise(texts, 4)
    for i, t in enumerate(texts):
        for same in (t, "".join(sorted(t))):
            alone, signature = minwise([same], 4)
            assert (alone[0] == together[i]).all() and signature[0] == signatures[i]
    assert band_keys(together, np.arange(len(texts))).shape == (len(texts), 4)


def test_bands_meet_as_often_as_promised():
    rng = random.Random(5)
    base = ["".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(14)) for _ in range(4000)]
    other = [t[:6] + "_" + t[7:] for t in base]
    (x, sx), (y, sy) = minwise(base, 5), minwise(other, 5)
    assert (x == y).any(axis=1).mean() > 0.999
    assert max(int(d).bit_count() for d in (sx ^ sy).view(np.uint64)) <= 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (101, 100), (7, 7), (None, 3)] + [(200, 200 + i) for i in range(1, 60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)} | {i: 200 for i in range(200, 260)}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute(rows):
    group = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    known = [(b, k, t, a) for b, k, t, a in rows if t]
    for _, _, t, a in known:
        for _, _, u, c in known:
            if t == u or slip(t, u) and {x for x in a if x} & {x for x in c if x}:
                group[find(t)] = find(u)
    out = set()
    for b, k, t, _ in known:
        first = min((b2, k2) for b2, k2, t2, _ in known if find(t2) == find(t))
        if b >= 1 and first < (b, k):
            out.add((min(k, first[1]), max(k, first[1])))
    return out


def _later(pair, rows):
    place = {k: (b, k) for b, k, *_ in rows}
    return max(pair, key=place.get)


@pytest.mark.parametrize("hot,small", [(40, 1_000_000), (2, 1_000_000), (2, 0)])
def test_batches_match_brute_force(spark, hot, small):
    rng = random.Random(hot)
    base = ["".join(rng.choice("abcdefgh") for _ in range(12)) for _ in range(30)]
    rows = []
    for k in range(240):
        t = list(rng.choice(base))
        if rng.random() < 0.4:
            i = rng.randrange(len(t) - 1)
            t[i : i + 2] = rng.choice([[t[i + 1], t[i]], [t[i]], ["x", t[i + 1]], [t[i], "y", t[i + 1]]])
        rows.append((rng.choice([0, 0, 0, 1, 2, 3]), k, "".join(t) if rng.random() > 0.05 else None, [rng.choice(["p", "q", None]), rng.choice(["r", None])]))
    df = spark.createDataFrame(rows, "batch int, key bigint, text string, agree array<string>")
    history = History(spark, bands=6, hot=hot, broadcast_rows=small, hash_bytes=small)
    prepared = df.select("key", F.array("text").alias("texts"), F.transform("agree", lambda a: F.when(a.isNotNull(), F.xxhash64(a))).alias("agree"), "batch")
    for n in range(4):
        history.accept(prepared.where(F.col("batch") == n).drop("batch"), n)
        history.accept(prepared, n)  # a batch that comes again changes nothing
        asof = brute([r for r in rows if r[0] <= n])
        of_batch = {k for b, k, *_ in rows if b == n}
        assert n == 0 or {tuple(r) for r in history.repeats(n).collect()} == {p for p in asof if of_batch & set(p) and _later(p, rows) in of_batch}
    got = {tuple(r) for r in history.repeats().collect()}
    assert got == brute(rows)
    again = History(spark, history.path, buckets=99)
    assert again.buckets == history.buckets and again.repeats().count() == len(got)


def test_only_the_new_batch_is_read_as_new(spark):
    history = History(spark, bands=4)
    frame = lambda rows: spark.createDataFrame(rows, "key bigint, texts array<string>, agree array<bigint>")
    history.accept(frame([(1, ["abcdefgh"], [7]), (2, ["unrelated"], [8])]), 0)
    history.accept(frame([(3, ["abcdefhg"], [7]), (4, ["unrelatde"], [9]), (5, [None], [7]), (6, None, None)]), 1)
    assert [tuple(r) for r in history.repeats().collect()] == [(1, 3)]
    history.accept(frame([]), 2)
    assert history.repeats().count() == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "b int, k bigint, t string")
    assert deduplicate(df, batch="b", key="k", texts=F.array("t"), agree=F.array("t")).repeats().count() == 0
