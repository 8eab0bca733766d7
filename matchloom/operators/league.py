"""League store: match statistics, careers, roll-ups, roster look-ups.

Player, club and competition dimensions join on their key without a forced
broadcast: the size-based broadcast threshold and the adaptive skew join decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.functions.common import count_if, pct
from matchloom.plans.ordered import scan


def player_match_stats(shots: DataFrame) -> DataFrame:
    return shots.groupBy("player_id", "match_id").agg(
        F.count(F.lit(1)).alias("shots"),
        count_if(F.col("outcome") == "GOAL").alias("goals"),
        count_if(F.col("outcome") == "SAVE").alias("saved"),
    )


def career(stats: DataFrame, players: DataFrame) -> DataFrame:
    tot = stats.groupBy("player_id").agg(
        F.sum("shots").alias("shots"), F.sum("goals").alias("goals"), F.count(F.lit(1)).alias("matches")
    )
    zero = F.lit(0).cast("bigint")
    return players.select("player_id", "player_name").join(tot, "player_id", "left").select(
        "player_id", "player_name", *[F.coalesce(c, zero).alias(c) for c in ("shots", "goals", "matches")]
    )


def rollup(stats: DataFrame, players: DataFrame, clubs: DataFrame, competitions: DataFrame) -> DataFrame:
    """Aggregate per player first, so the dimension joins see one row per player."""
    per = stats.groupBy("player_id").agg(F.sum("shots").alias("shots"), F.sum("goals").alias("goals"))
    dim = (
        players.select("player_id", "club_id")
        .join(clubs, "club_id")
        .join(competitions, "competition_id")
        .select("player_id", "club_name", "competition_name")
    )
    return (
        per.join(dim, "player_id")
        .rollup("competition_name", "club_name")
        .agg(F.sum("shots").alias("shots"), F.sum("goals").alias("goals"))
    )


def running_save_rate(shots: DataFrame) -> DataFrame:
    """Cumulative save rate per keeper, one row per match (shots pre-aggregated per match)."""
    per = shots.groupBy("gk_id", "match_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("outcome") == "SAVE").alias("s")
    )
    run = scan(per, ["gk_id"], "match_id", sums={"shots_so_far": F.col("n"), "saves_so_far": F.col("s")})
    return run.select("gk_id", "match_id", "shots_so_far", "saves_so_far").withColumn(
        "save_rate", pct(F.col("saves_so_far"), F.col("shots_so_far"))
    )


def label_from_roster(shots: DataFrame, players: DataFrame, clubs: DataFrame) -> DataFrame:
    roster = players.join(clubs, "club_id").select(
        "player_id", "number", "player_name", "club_name", F.col("number").alias("roster_number")
    )
    return shots.join(roster, ["player_id", "number"], "left").select(
        "match_id", "frame_n", "player_id", "club_name", F.col("roster_number").alias("number"),
        F.coalesce("player_name", F.concat(F.lit("#"), F.col("number").cast("string"))).alias("label"),
    )


def find_by_number(players: DataFrame) -> DataFrame:
    return players.groupBy("number", "club_id").agg(
        F.min("player_id").alias("player_id"), F.count(F.lit(1)).alias("candidates")
    )


def get_or_create(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Existing player by case-insensitive name and club, else a new row to create."""
    a = asked.select(F.upper("name").alias("asked_name"), "club_id").distinct()
    k = known.groupBy(F.upper("name").alias("asked_name"), "club_id").agg(F.min("player_id").alias("player_id"))
    return a.join(k, ["asked_name", "club_id"], "left").withColumn("created", F.col("player_id").isNull())


def compare_players(stats: DataFrame, ids: DataFrame) -> DataFrame:
    per = stats.groupBy("player_id").agg(F.sum("shots").alias("shots"), F.sum("goals").alias("goals"))
    return (
        per.join(ids, "player_id", "left_semi")
        .withColumn("performance", pct(F.col("goals"), F.col("shots")))
        .orderBy(F.desc("performance"), "player_id")
    )
