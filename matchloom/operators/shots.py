"""Shot records: clean-up, per shooter and per keeper reports.

All aggregations go through one (actor, zone, cell, outcome) pre-aggregation,
so a hot shooter or keeper shrinks to a few hundred rows map-side before any
shuffle; dense grids are rebuilt from that bounded set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom import params as P
from matchloom.functions.common import count_if, pct, str_array


def one_of(c: Column, allowed, default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def clean_shots(raw: DataFrame) -> DataFrame:
    """Unknown zone, cell and outcome take their defaults; outcome is upper-cased."""
    out = F.upper("outcome_raw")
    return raw.select(
        "match_id", "frame_n", "player_id", "gk_id", "team", "number",
        one_of(F.col("zone_raw"), P.SHOT_ZONES, "Center Back").alias("zone"),
        one_of(F.col("cell_raw"), P.GOAL_CELLS + P.OFF_TARGET, "CH").alias("cell"),
        F.when(out.isin(*P.OUTCOMES), out).otherwise(F.lit("GOAL")).alias("outcome"),
        "reaction_ms", "x_cm", "y_cm",
    )


def zone_distance(zone: Column) -> Column:
    m = F.create_map(*[F.lit(v) for kv in P.ZONE_DISTANCE.items() for v in kv])
    return F.coalesce(m[zone], F.lit("9m"))


def cell_counts(shots: DataFrame, actor: list[str], hit: str) -> DataFrame:
    """Bounded summary: at most zones x cells rows per actor."""
    return shots.groupBy(*actor, "zone", "cell").agg(
        count_if(F.col("outcome") == hit).alias("hits"), F.count(F.lit(1)).alias("total")
    )


def dense_grid(shots: DataFrame, actor: list[str], hit: str) -> DataFrame:
    """12 zones x 9 cells, the 9-cell summary and the off-target counts, zeros kept."""
    per_cell = cell_counts(shots, actor, hit)
    key = F.concat_ws("|", "zone", "cell")
    packed = per_cell.groupBy(*actor).agg(
        F.map_from_entries(
            F.collect_list(F.struct(key.alias("k"), F.struct("hits", "total").alias("v")))
        ).alias("m")
    )
    zones = str_array(P.SHOT_ZONES + ["*"])
    grid = packed.select(*actor, "m", F.explode(zones).alias("zone")).select(
        *actor, "m", "zone", F.explode(str_array(P.GOAL_CELLS + P.OFF_TARGET)).alias("cell")
    )
    grid = grid.filter(~F.col("cell").isin(*P.OFF_TARGET) | (F.col("zone") == "*"))
    zero = F.struct(F.lit(0).cast("bigint").alias("hits"), F.lit(0).cast("bigint").alias("total"))
    picked = F.when(
        F.col("zone") == "*",
        F.aggregate(
            F.filter(F.map_entries("m"), lambda e: F.element_at(F.split(e["key"], r"\|"), -1) == F.col("cell")),
            zero,
            lambda a, e: F.struct(
                (a["hits"] + e["value"]["hits"]).alias("hits"), (a["total"] + e["value"]["total"]).alias("total")
            ),
        ),
    ).otherwise(F.coalesce(F.col("m")[key], zero))
    return grid.select(*actor, "zone", "cell", picked.alias("p")).select(
        *actor, "zone", "cell", F.col("p.hits").alias("hits"), F.col("p.total").alias("total")
    )


def shooters(shots: DataFrame) -> DataFrame:
    return shots.groupBy("player_id", "team").agg(
        F.count(F.lit(1)).alias("shots"),
        count_if(F.col("outcome") == "GOAL").alias("goals"),
        F.min(F.struct("match_id", "frame_n", "number"))["number"].alias("number"),
    )


def keepers(shots: DataFrame) -> DataFrame:
    return (
        shots.groupBy("gk_id")
        .agg(F.count(F.lit(1)).alias("faced"), count_if(F.col("outcome") == "SAVE").alias("saves"))
        .orderBy(F.desc("faced"), "gk_id")
    )


def shot_report(shots: DataFrame) -> DataFrame:
    d = zone_distance(F.col("zone"))
    aggs = [F.count(F.lit(1)).alias("shots"), count_if(F.col("outcome") == "GOAL").alias("goals")]
    for km in ("6m", "7m", "9m"):
        aggs.append(count_if(d == km).alias(f"shots_{km}"))
        aggs.append(count_if((d == km) & (F.col("outcome") == "GOAL")).alias(f"goals_{km}"))
    aggs += [count_if(F.col("outcome") == o).alias(f"n_{o.lower()}") for o in P.OUTCOMES]
    return shots.groupBy("player_id", "team").agg(*aggs).withColumn("efficiency", pct(F.col("goals"), F.col("shots")))


def save_report(shots: DataFrame) -> DataFrame:
    """Per keeper and goal-mouth cell: saves, shots, save share, next to the keeper totals."""
    g = dense_grid(shots, ["gk_id"], "SAVE").filter(F.col("zone") == "*").filter(F.col("cell").isin(*P.GOAL_CELLS))
    tot = shots.groupBy("gk_id").agg(
        F.count(F.lit(1)).alias("faced"), count_if(F.col("outcome") == "SAVE").alias("saves")
    )
    return g.join(tot, "gk_id").select(
        "gk_id", "cell", F.col("hits").alias("cell_saves"), F.col("total").alias("cell_shots"),
        pct(F.col("hits"), F.col("total")).alias("cell_pct"), "faced", "saves",
        pct(F.col("saves"), F.col("faced")).alias("save_pct"),
    )


def team_summary(shots: DataFrame) -> DataFrame:
    """Outcome totals and per-zone goals of a team in one grouping-sets pass."""
    return (
        shots.groupBy("team", "zone", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupingSets(
            [["team", "outcome"], ["team", "zone"]], "team", "zone", "outcome"
        )
        .agg(
            F.grouping("zone").cast("bigint").alias("gz"),
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("outcome") == "GOAL", F.col("n")).otherwise(F.lit(0))).alias("goals"),
        )
    )


def keeper_log(shots: DataFrame) -> DataFrame:
    """Keeper totals; ``conceded_all`` counts every shot not saved, ``conceded`` only goals."""
    aggs = [
        F.count(F.lit(1)).alias("shots"),
        count_if(F.col("outcome") == "SAVE").alias("saves"),
        count_if(F.col("outcome") == "GOAL").alias("conceded"),
        F.sum("reaction_ms").alias("rs"), F.count("reaction_ms").alias("rn"),
    ] + [count_if(F.col("cell") == c).alias(f"cell_{c.lower()}") for c in P.GOAL_CELLS]
    return shots.groupBy("gk_id").agg(*aggs).select(
        "gk_id", "shots", "saves", "conceded", (F.col("shots") - F.col("saves")).alias("conceded_all"),
        pct(F.col("saves"), F.col("shots")).alias("save_rate"),
        F.when(F.col("rn") > 0, F.floor(F.col("rs") * 10.0 / F.col("rn") + 0.5) / 10.0).alias("mean_reaction_ms"),
        *[f"cell_{c.lower()}" for c in P.GOAL_CELLS],
    )
