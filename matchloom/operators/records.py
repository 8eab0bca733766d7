"""Record maintenance as change logs: latest change wins, tombstones, partial updates.

All of these are aggregations (arg-max per id), not windows, so they combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def latest(changes: DataFrame, key: str, order: Column, cols: list[str]) -> DataFrame:
    return changes.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("_c")).select(key, *[F.col(f"_c.{c}").alias(c) for c in cols])


def apply_edits(base: DataFrame, changes: DataFrame, key: str, order: Column, fields: list[str], deleted: str = "deleted") -> DataFrame:
    """Base rows with the latest change applied; null fields keep the old value, deleted rows vanish."""
    new = latest(changes, key, order, [*fields, deleted])
    for f in fields:
        new = new.withColumnRenamed(f, f"_new_{f}")
    d = base.join(new, key, "left").filter(~F.coalesce(F.col(deleted), F.lit(False)))
    keep = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    return d.select(*keep)


def partial_update(changes: DataFrame, key: str, order: Column, fields: list[str]) -> DataFrame:
    """Last non-blank value of each field; blank updates leave the old value."""
    aggs = []
    for f in fields:
        v = F.nullif(F.col(f), F.lit(""))
        aggs.append(F.max_by(v, F.when(v.isNotNull(), order)).alias(f))
    return changes.groupBy(key).agg(*aggs)


def insert_ignore(existing: DataFrame, new: DataFrame, on: str) -> DataFrame:
    fresh = new.dropDuplicates([on]).join(existing.select(on), on, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def merge_params(defaults: DataFrame, overrides: DataFrame, key: str = "key") -> DataFrame:
    """Overrides on defaults, key path by key path; keys of either side are kept."""
    o = overrides.select(key, F.col("value").alias("_o"))
    return defaults.join(o, key, "full").select(key, F.coalesce("_o", "value").alias("value"))


def override_team(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """A locked manual team beats the classifier's."""
    o = overrides.select("track_id", F.col("team").alias("_t"), "locked")
    return rows.join(o, "track_id", "left").withColumn(
        "team", F.when(F.col("locked") & F.col("_t").isNotNull(), F.col("_t")).otherwise(F.col("team"))
    ).drop("_t", "locked")


def jersey_votes(reads: DataFrame, lock: float = 2.5, margin: float = 1.5) -> DataFrame:
    """Number of a track by summed confidence: enough votes and margin over the second, then
    one owner per number and match (more votes win, lower track id on ties)."""
    from pyspark.sql import Window as W

    votes = reads.groupBy("match_id", "track_id", "number").agg(F.sum("conf").alias("votes"))
    ranked = votes.groupBy("match_id", "track_id").agg(
        F.max(F.struct("votes", (-F.col("number")).alias("neg"))).alias("top"), F.sum("votes").alias("total"),
        F.slice(F.sort_array(F.collect_list("votes"), asc=False), 1, 2).alias("two"),
    )  # a track has at most 99 numbers
    t = ranked.select(
        "match_id", "track_id", (-F.col("top.neg")).alias("number"), F.col("top.votes").alias("votes"),
        F.coalesce(F.get("two", F.lit(1)), F.lit(0.0)).alias("second"))
    t = t.filter((F.col("votes") >= lock) & (F.col("votes") - F.col("second") >= margin))
    w = W.partitionBy("match_id", "number").orderBy(F.desc("votes"), "track_id")
    return t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "second")
