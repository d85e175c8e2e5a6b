"""Mixing sources to target shares of all tokens, with capped repeats.

Tokens are summed per cell of (source, language, topic). Iterative proportional
fitting rakes the cells' weights to the source targets and to the corpus's own
language and topic shares, no cell above its source's repeat cap. A cell's weight
over its tokens is how often each of its documents is expected: the whole part is
taken for all, the fraction by a hash of the document against a threshold that is
calibrated on the cell's token histogram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import materialize

BUCKETS = 256


@dataclass(frozen=True)
class Cell:
    source: str
    lang: str
    topic: int
    tokens: float


def source_name(column: Column) -> Column:
    return F.lower(F.trim(column))


def source_totals(available: dict[str, float], share: dict[str, float], cap: dict[str, float], budget: float) -> dict[str, float]:
    """Tokens of each source: its share of the budget, or all its repeats if these are fewer.

    What a capped source lacks is not made up by others, since that would move
    every source further from its share.
    """
    return {s: min(share[s] * budget, cap[s] * available.get(s, 0.0)) for s in share}


def exact_budget(available: dict[str, float], share: dict[str, float], cap: dict[str, float]) -> float:
    """The largest mixture in which every source that has tokens reaches its share."""
    return min((cap[s] * available[s] / share[s] for s in share if share[s] > 0 and available.get(s, 0) > 0), default=0.0)


def rake(cells: list[Cell], sources: dict[str, float], cap: dict[str, float], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Token weight of each cell: source sums as given, language and topic sums as near to the corpus's shares as the caps allow."""
    have = np.array([c.tokens for c in cells])
    most = np.array([c.tokens * cap[c.source] for c in cells])
    weight = have.copy()
    total = sum(sources.values())
    of = {axis: np.unique([str(getattr(c, axis)) for c in cells], return_inverse=True) for axis in ("lang", "topic", "source")}
    for _ in range(rounds):
        before = weight.copy()
        for axis in ("lang", "topic", "source"):
            names, index = of[axis]
            sums = np.bincount(index, weight, len(names))
            if axis == "source":
                goal = np.array([sources[n] for n in names])
            else:
                goal = np.bincount(index, have, len(names)) / have.sum() * total
            weight = np.minimum(weight * np.where(sums > 0, goal / np.where(sums > 0, sums, 1), 0)[index], most)
        if np.abs(weight - before).max() <= tolerance * max(total, 1):
            break
    # cells at their cap leave a source short: the others of the source take up the rest
    names, index = of["source"]
    for _ in range(len(cells)):
        lack = np.array([sources[n] for n in names]) - np.bincount(index, weight, len(names))
        room = most - weight
        spare = np.bincount(index, np.where(weight > 0, room, 0), len(names))
        if not ((lack > tolerance * max(total, 1)) & (spare > 0)).any():
            break
        step = np.where(spare > 0, np.clip(lack, 0, None) / np.where(spare > 0, spare, 1), 0)
        weight = np.minimum(weight + np.where(weight > 0, room, 0) * np.minimum(step, 1)[index], most)
    return weight


def thresholds(histogram: pd.DataFrame) -> pd.DataFrame:
    """(source, lang, topic, whole, limit_bucket): repeats of all documents of a cell, and the hash bucket below which one more is taken.

    histogram(source, lang, topic, bucket, tokens, weight, cap) of one source. What
    a cell's limit misses is carried to the next cell that is not at its cap.
    """
    out, carry = [], 0.0
    for (source, lang, topic), cell in histogram.groupby(["source", "lang", "topic"], sort=True):
        sums = np.zeros(BUCKETS + 1)
        np.add.at(sums, cell["bucket"].to_numpy() + 1, cell["tokens"].to_numpy(float))
        sums = np.cumsum(sums)
        have, weight = sums[-1], float(cell["weight"].iloc[0])
        whole = int(np.floor(weight / have + 1e-12))
        want = weight - whole * have + carry
        limit = int(np.abs(sums - want).argmin()) if whole < cell["cap"].iloc[0] and want > 0 else 0
        carry = want - sums[limit]
        out.append((source, lang, topic, whole, limit))
    return pd.DataFrame(out, columns=["source", "lang", "topic", "whole", "limit_bucket"])


def mix(features: DataFrame, targets: DataFrame, *, budget: float | str | None = "exact", max_sources: int = 1000, max_languages: int = 16) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen(doc_id, source, tokens, copies) has the documents taken at least once;
    shares(source, target_share, repeat_cap, available_tokens, tokens, actual_share)
    has every target. features(doc_id, source, lang, topic, tokens).

    budget: "exact" for the largest mixture that meets all shares, a number of
    tokens, or None for as many as the targets' sources have; with either of these
    a source whose repeats do not suffice is taken as often as allowed. Sources are
    compared without case and outer blanks. Documents without source, of other
    sources or without tokens are not used. A target without documents reaches 0;
    no targets or no documents give no chosen rows. Repeated documents count each.
    The languages with most tokens are told apart, at most ``max_languages``; all
    others and null are one more.
    """
    spark = features.sparkSession
    listed = targets.where("source IS NOT NULL AND target_share > 0").select(source_name(F.col("source")), F.col("target_share").cast("double"), F.greatest(F.coalesce("repeat_cap", F.lit(1)), F.lit(0)).cast("double")).limit(max_sources + 1).collect()
    if len(listed) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    share = {r[0]: r[1] for r in listed}
    cap = {r[0]: r[2] for r in listed}
    whole = sum(share.values()) or 1.0
    share = {s: v / whole for s, v in share.items()}
    rows = features.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce(F.lower(F.trim("lang")), F.lit("")).alias("lang"), "topic", "tokens").where(F.col("source").isin(*share) & (F.col("tokens") > 0))
    rows = materialize(rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(BUCKETS)).cast("int")), "mix")
    common = [r[0] for r in rows.where("lang <> ''").groupBy("lang").agg(F.sum("tokens").alias("tokens")).orderBy(F.desc("tokens"), "lang").limit(max_languages).collect()]
    rows = rows.withColumn("lang", F.when(F.col("lang").isin(*common), F.col("lang")).otherwise(F.lit("other")) if common else F.lit("other"))
    by = ["source", "lang", "topic"]
    histogram = materialize(rows.groupBy(*by, "bucket").agg(F.sum("tokens").alias("tokens")), "histogram")
    # at most sources x languages x topics rows, whatever the size of the corpus
    cells = [Cell(r[0], r[1], r[2], float(r[3])) for r in histogram.groupBy(*by).agg(F.sum("tokens")).orderBy(*by).collect()]
    available: dict[str, float] = {}
    for c in cells:
        available[c.source] = available.get(c.source, 0.0) + c.tokens
    size = exact_budget(available, share, cap) if budget == "exact" else float(budget) if budget is not None else sum(available.values())
    weights = rake(cells, source_totals(available, share, cap, size), cap) if cells else []
    plan = spark.createDataFrame([(c.source, c.lang, c.topic, float(w), cap[c.source]) for c, w in zip(cells, weights)], "source string, lang string, topic int, weight double, cap double")
    # plan and limits have one row a cell; a source's group has at most one row a cell and bucket
    limits = histogram.join(F.broadcast(plan), by).groupBy("source").applyInPandas(thresholds, "source string, lang string, topic int, whole int, limit_bucket int")
    limits = materialize(limits, "limits")
    copies = (F.col("whole") + (F.col("bucket") < F.col("limit_bucket")).cast("int")).alias("copies")
    chosen = rows.join(F.broadcast(limits), by).select("doc_id", "source", "tokens", copies).where("copies > 0")
    goal = spark.createDataFrame([(s, share[s], int(cap[s]), int(available.get(s, 0))) for s in sorted(share)], "source string, target_share double, repeat_cap int, available_tokens bigint")
    reached = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    shares = goal.join(reached, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = reached.agg(F.sum("tokens").alias("all_tokens"))
    shares = shares.crossJoin(F.broadcast(total)).select("source", "target_share", "repeat_cap", "available_tokens", "tokens", F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("actual_share"))
    return chosen, shares
