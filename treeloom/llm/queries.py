"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import contact
from treeloom.llm.extid import content, ext_id_steps
from treeloom.llm.features import document_features
from treeloom.llm.incremental import deduplicate
from treeloom.llm.mixing import mix
from treeloom.llm.packing import fill, pack
from treeloom.llm.sql import SQL
from treeloom.llm.survivors import survivors
from treeloom.llm.truncation import rates, truncated
from treeloom.runtime import materialize, table

__all__ = ["QUERIES", "SQL"]

#: How far the feeds of users_77 are trusted in p1_survivors; others count as 1.
FEED_TRUST = {"crm_push": 1.0, "web_form": 0.9, "till_sync": 0.8, "partner_csv": 0.7, "legacy_dump": 0.5}


def _users(spark: SparkSession, sf_dir: str, *, drop_tag: bool) -> DataFrame:
    """users_77 with the usable value of each descriptive field in one writing, else null."""
    users = table(spark, sf_dir, "users_77")
    users = contact.with_reading(users, "inbox", F.col("email"), contact.email_steps(drop_tag))
    users = contact.with_reading(users, "person", F.col("name"), contact.name_steps())
    return contact.with_reading(users, "number", F.col("phone"), contact.phone_steps())


def _user_fields() -> dict:
    return {"email": F.col("inbox"), "name": F.col("person"), "phone": F.col("number")}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest usable value of each field: votes halve 64 times a microsecond, so that no number of older ones outweighs a newer one."""
    best = survivors(
        _users(spark, sf_dir, drop_tag=False), group="id", record_id="rec_id", time="changed_at", fields=_user_fields(), source="feed", trust=FEED_TRUST, half_life_days=1 / 64 / 86_400e6, tie_bits=64
    )
    long = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f"{f}_record").alias("rec_id")) for f in ("email", "name", "phone"))))
    return best.where("n_rows >= 2").select(F.col("id").alias("user_id"), long.alias("v")).select("user_id", "v.*").where("rec_id IS NOT NULL")


def p1_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user by summed votes: trust of the feed, half-life 180 days."""
    best = survivors(_users(spark, sf_dir, drop_tag=False), group="id", record_id="rec_id", time="changed_at", fields=_user_fields(), source="feed", trust=FEED_TRUST)
    return best.select(F.col("id").alias("user_id"), "n_rows", "email", "email_record", "name", "name_record", "phone", "phone_record")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = deduplicate(
        _users(spark, sf_dir, drop_tag=True),
        batch="batch_no",
        key="rec_id",
        texts=F.array("inbox"),
        agree=F.array(F.concat(F.lit("phone "), "number"), F.concat(F.lit("name "), "person")),
        bands=4,
    )
    identified = contact.with_reading(table(spark, sf_dir, "events_77"), "writings", F.col("ext_id"), ext_id_steps())
    events = deduplicate(
        identified, batch="batch_no", key="id", texts=F.coalesce("writings", F.array(F.lit(None).cast("string"))), agree=F.array(content(F.col("payload"))), bands=5
    )
    return users.repeats().select(F.lit("users_77").alias("table_name"), "key_a", "key_b").unionByName(events.repeats().select(F.lit("events_77").alias("table_name"), "key_a", "key_b"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(document_features(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_specs"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(p6_packed(spark, sf_dir), table(spark, sf_dir, "pack_specs"))


def p6_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each spec: the documents packed; those not packed as a whole, once; containers too full; documents split without need; and whether 98 % of the space is used, or all but one container."""
    features = materialize(document_features(table(spark, sf_dir, "documents")).where("tokens > 0").select("doc_id", "tokens", "curve"), "features")
    specs = table(spark, sf_dir, "pack_specs")
    packed = materialize(pack(features, specs), "packed")
    whole = packed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("packed"), F.max("piece_no").alias("last"), F.count(F.lit(1)).alias("pieces"))
    whole = features.select("doc_id", F.col("tokens").alias("size")).crossJoin(F.broadcast(specs)).join(whole, ["spec_name", "doc_id"], "left")
    lost = (F.coalesce("packed", F.lit(0)) != F.col("size")) | (F.col("pieces") != F.col("last") + 1)
    split = (F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))
    docs = whole.groupBy("spec_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if(lost).alias("lost"), F.count_if(split).alias("split"))
    loads = packed.groupBy("spec_name", "container_id").agg(F.sum("tokens").alias("load")).join(F.broadcast(specs), "spec_name")
    loads = loads.groupBy("spec_name").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull"), (F.sum("load") >= F.least(0.98 * F.sum("capacity_tokens"), F.sum("capacity_tokens") - F.max("capacity_tokens"))).alias("well_filled"))
    return docs.join(loads, "spec_name").select("spec_name", "documents", "lost", "overfull", "split", "well_filled")


def _mixed(spark: SparkSession, sf_dir: str, budget: float | str | None = "exact") -> tuple[DataFrame, DataFrame]:
    features = document_features(table(spark, sf_dir, "documents"), source="source", lang="lang")
    return mix(features, table(spark, sf_dir, "mix_targets"), budget=budget)


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the largest mixture in which no cap binds."""
    return _mixed(spark, sf_dir)[1]


def p7_shares_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of a mixture as large as the sources, of which small ones are taken as often as allowed."""
    return _mixed(spark, sf_dir, None)[1]


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source that has documents: whether its share is within 0.005 or the largest document taken from it of its target, and no document repeated more often than allowed."""
    chosen, shares = _mixed(spark, sf_dir)
    most = chosen.groupBy("source").agg(F.max("copies").alias("copies"), F.max("tokens").alias("largest"))
    whole = chosen.agg(F.sum(F.col("tokens") * F.col("copies")).alias("whole"))
    reachable = shares.where("available_tokens > 0").agg(F.sum("target_share").alias("reachable"))
    off = F.abs(F.col("tokens") - F.col("target_share") / F.col("reachable") * F.col("whole"))
    near = (F.col("available_tokens") == 0) | (off <= F.greatest(0.005 * F.col("whole"), "largest"))
    ones = [F.broadcast(d) for d in (whole, reachable)]
    return reduce(DataFrame.crossJoin, ones, shares.join(most, "source", "left")).select("source", near.alias("near_target"), (F.coalesce("copies", F.lit(0)) <= F.col("repeat_cap")).alias("within_cap"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents")).where("is_cut").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rates(docs, truncated(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_survivors": p1_survivors,
    "p5_found": p5_found,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p6_checked": p6_checked,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p7_checked": p7_checked,
    "p7_shares_full": p7_shares_full,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}