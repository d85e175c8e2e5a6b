import datetime as dt
import random

from pyspark.sql import functions as F

from treeloom.llm.survivors import survivors

START = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, rec bigint, email string, name string, feed string, at timestamp"


NEWEST = {"half_life_days": 1 / 64 / 86_400e6, "tie_bits": 64, "source": "feed", "trust": {"bad": 0.1, "good": 0.9}}


def usable(c):
    return F.when(F.col(c) != "", F.lower(c))


def choose(df, **options):
    return survivors(df, group="id", record_id="rec", time="at", fields={c: usable(c) for c in ("email", "name")}, **options)


def test_newest_wins_and_ties_go_to_the_smallest_record(spark):
    rng = random.Random(1)
    rows = []
    for rec in range(400):
        at = START + dt.timedelta(days=rng.randint(0, 6)) if rng.random() > 0.2 else None
        rows.append((rng.choice([None, *range(20)]), rec, rng.choice(["", None, "A", "a", "b"]), rng.choice([None, "N", "n", "m"]), rng.choice([None, "bad", "good"]), at))
    rows.append((50, 1000, None, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"grp": F.lit("clash"), "field": F.lit(1), "value": F.lit(None).cast("string"), "votes": F.lit(0)})
    got = {r.id: (r.n_rows, r.email_record, r.name_record) for r in choose(df, **NEWEST).collect()}
    want = {}
    for i in {r[0] for r in rows if r[0] is not None}:
        group = [r for r in rows if r[0] == i]

        def best(k):
            use = [r for r in group if r[k]]
            return min(use, key=lambda r: (r[5] is None, -(r[5] or START).timestamp(), r[1]))[1] if use else None

        want[i] = (len(group), best(2), best(3))
    assert got == want


def test_votes_add_up_by_trust_and_age(spark):
    day = lambda n: START + dt.timedelta(days=n)
    rows = [(1, 1, "old", None, "good", day(0)), (1, 2, "OLD", None, "good", day(1)), (1, 3, "new", None, "good", day(2)), (2, 4, "x", None, "bad", day(2)), (2, 5, "y", None, "good", day(0)), (3, 6, "u", None, "good", None), (3, 7, "v", None, "bad", day(-9000))]
    df = spark.createDataFrame(rows, SCHEMA)
    slow = {r.id: r.email_record for r in choose(df, half_life_days=1000.0, source="feed", trust={"bad": 0.1}).collect()}
    assert slow == {1: 2, 2: 5, 3: 7}
    assert {r.id: r.email_record for r in choose(df, half_life_days=7.0).collect()}[3] == 7  # any time counts more than none
    fast = {r.id: r.email_record for r in choose(df, half_life_days=0.1).collect()}
    assert fast[1] == 3 and fast[2] == 4


def test_sums_reach_over_epochs(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(60):
        half_life = 0.25
        votes = {}
        for k in range(rng.randint(1, 12)):
            days = rng.choice([rng.uniform(-128.5, 0.5), rng.uniform(-1, 1), rng.uniform(126, 130)])
            value = rng.choice("abc")
            votes[value] = votes.get(value, 0) + 2 ** (days / half_life)
            rows.append((i, 100 * i + k, value, None, None, dt.datetime(1970, 1, 1) + dt.timedelta(days=days)))
        want[i] = max(votes, key=votes.get)
    got = choose(spark.createDataFrame(rows, SCHEMA), half_life_days=0.25).collect()
    assert {r.id: r.email for r in got} == want


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert choose(df).count() == 0
    twice = spark.createDataFrame([(1, 5, "a", "n" * 100_000, None, START)] * 3, SCHEMA)
    r = choose(twice, **NEWEST).first()
    assert (r.n_rows, r.email_record, len(r.name)) == (3, 5, 100_000)
