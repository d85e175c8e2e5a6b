"""Best representative of each group of duplicate records, field by field.

Each field of each record becomes one long row with its normalised value. Votes
are summed per (group, field, value): a row votes with its source's trust times a
decay by age. ``max_by`` picks each field's winner, and a grouping by field turns
the winners back into one row per group. All groupings combine map-side, so a
group that holds a third of all rows costs no more than any other.

A vote is trust * 2 ** (time / half-life), which no float can hold when the
half-life is short. So votes are summed within epochs of ``EPOCH`` half-lives, as
multiples of the epoch's first vote; only a value's last epoch and the one before
can matter, and of two neighbouring epochs one is even and one odd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half-lives in an epoch.
EPOCH = 512


def ballots(records: DataFrame, *, group: str, record_id: str, time: str, fields: dict[str, Column], source: str | None, trust: dict[str, float] | None) -> DataFrame:
    """Long rows (grp, field, value, raw, rec, ts, trust); value is null where a field is not usable."""
    weight = F.lit(1.0)
    if source is not None and trust:
        for name, w in trust.items():
            weight = F.when(F.col(source) == name, F.lit(float(w))).otherwise(weight)
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), expr.alias("value"), F.col(f).cast("string").alias("raw")) for f, expr in fields.items())))
    return (
        records.where(F.col(group).isNotNull())
        .select(F.col(group).alias("grp"), F.col(record_id).alias("rec"), F.col(time).alias("ts"), weight.alias("trust"), long.alias("v"))
        .select("grp", "rec", "ts", "trust", "v.*")
    )


def survivors(
    records: DataFrame,
    *,
    group: str,
    record_id: str,
    time: str,
    fields: dict[str, Column],
    source: str | None = None,
    trust: dict[str, float] | None = None,
    half_life_days: float = 180.0,
    tie_bits: float = 2.0**-20,
) -> DataFrame:
    """(group, n_rows, then <field>, <field>_record and <field>_votes of each field).

    A value's votes are the sum of trust * 2 ** (days / half_life_days) over its
    rows, days since 1970; ``<field>_votes`` is their binary logarithm, null if no
    row has a time. Rows without time count less than all others: their votes are
    added up by themselves, for values without any time. Values whose logarithms
    are in one step of ``tie_bits`` tie, which go to the newest row, then to the
    smallest record id; the row a value is taken from is its newest. A half-life
    far below the smallest step of time, with as many tie bits, so gives the
    newest value.

    Rows with a null group belong to none. A field without any usable value is
    null. Exact repeats vote again but cannot win by their id. An empty table
    gives no row. Columns of other names are ignored. Trust must be positive.
    """
    if half_life_days <= 0 or tie_bits <= 0 or any(w <= 0 for w in (trust or {}).values()):
        raise ValueError("half-life, tie bits and trust must be positive")
    rows = ballots(records, group=group, record_id=record_id, time=time, fields=fields, source=source, trust=trust)
    # a value that is not usable is counted only, in one place
    lives = F.when(F.col("value").isNotNull(), F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(86_400e6 * half_life_days))
    rows = rows.withColumn("lives", lives).withColumn("epoch", F.floor(F.col("lives") / EPOCH))
    vote = F.col("trust") * F.coalesce(F.pow(F.lit(2.0), F.col("lives") - F.col("epoch") * EPOCH), F.lit(1.0))
    # Newest first; a null time is smallest; ~id turns the smallest id into the largest.
    newest = F.struct(F.col("ts").alias("ts"), F.bitwise_not("rec").alias("inv"))
    sums = rows.groupBy("grp", "field", "value", "epoch").agg(F.sum(vote).alias("votes"), F.max(newest).alias("newest"), F.max_by("raw", newest).alias("raw"), F.count(F.lit(1)).alias("n"))
    last = lambda odd: F.max(F.when(F.pmod("epoch", F.lit(2)) == odd, F.struct("epoch", "votes")))
    tally = sums.groupBy("grp", "field", "value").agg(
        last(0).alias("even"), last(1).alias("odd"), F.sum(F.when(F.col("epoch").isNull(), F.col("votes"))).alias("undated"), F.max("newest").alias("newest"), F.max_by("raw", "newest").alias("raw"), F.sum("n").alias("n")
    )
    tally = tally.withColumn("epoch", F.greatest("even.epoch", "odd.epoch"))
    part = lambda side: F.when(F.col(f"{side}.epoch") >= F.col("epoch") - 1, F.col(f"{side}.votes") * F.pow(F.lit(2.0), (F.col(f"{side}.epoch") - F.col("epoch")) * EPOCH)).otherwise(F.lit(0.0))
    tally = tally.withColumn("log", F.log2(part("even") + part("odd"))).withColumn("votes", F.col("epoch") * EPOCH + F.col("log"))
    names = list(fields)
    aggs = [F.sum(F.when(F.col("field") == names[0], F.col("n"))).alias("n_rows")]
    rank = F.struct(_step(F.col("epoch"), F.col("log"), tie_bits).alias("step"), F.when(F.col("epoch").isNull(), _step(F.lit(0), F.log2("undated"), tie_bits)).alias("undated"), "newest")
    for f in names:
        valid = (F.col("field") == f) & F.col("value").isNotNull()
        won = F.max_by(F.struct("raw", F.bitwise_not("newest.inv").alias("rec"), "votes"), F.when(valid, rank))
        aggs.append(won.alias(f"won_{f}"))
    wide = tally.groupBy("grp").agg(*aggs)
    return wide.select(
        F.col("grp").alias(group),
        "n_rows",
        *(F.col(f"won_{f}.{part}").alias(name) for f in names for part, name in (("raw", f), ("rec", f"{f}_record"), ("votes", f"{f}_votes"))),
    )


def _step(epoch: Column, log: Column, bits: float) -> Column:
    """In which step of ``bits`` a vote's logarithm lies; steps of whole bits begin a quarter step early, for trust below 1, and are exact."""
    if bits >= 1:
        whole = epoch * EPOCH + F.floor(log) + int(bits) // 4
        return whole - F.pmod(whole, F.lit(int(bits)))
    over = F.floor(log / EPOCH)
    return F.struct((epoch + over).alias("epoch"), F.floor((log - over * EPOCH) / F.lit(bits)).alias("place"))
