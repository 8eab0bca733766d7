"""Rule alerts: one boolean predicate per rule over positions, then a debounce."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom import params as P
from matchloom.functions import zones as Z
from matchloom.functions.common import count_if, sq_dist
from matchloom.plans.folds import debounce


def fatigue(motion: DataFrame, sprints=(80, 120), speeds=(1.5, 1.2), distance: float = 4500.0) -> DataFrame:
    """Tired from two points, substitute from four (sprint frames, slow average, long distance)."""
    s, v = F.col("sprint_frames"), F.col("avg_speed")
    score = (
        F.when(s > sprints[1], 3).when(s > sprints[0], 1).otherwise(0)
        + F.when(v < speeds[1], 3).when(v < speeds[0], 1).otherwise(0)
        + F.when(F.col("distance_m") > distance, 2).otherwise(0)
    )
    d = motion.select("match_id", "player_id", score.alias("score")).filter(F.col("score") >= 2)
    return d.withColumn("advice", F.when(F.col("score") >= 4, "substitute").otherwise("tired"))


# ---- positional rules -------------------------------------------------------
FRAME = ["match_id", "frame_n"]


def raised(hits: DataFrame, keys: list[str], cooldown: int) -> DataFrame:
    """Alert rows: a rule's hits, at most one per key within ``cooldown`` frames."""
    return debounce(hits, keys, "frame_n", cooldown)


def role_drift(tracks: DataFrame, roles: DataFrame) -> DataFrame:
    """Wings that drift to the middle of the court."""
    d = tracks.join(roles, ["match_id", "player_id"])
    out = ((F.col("role") == "RW") & (F.col("y_cm") > 900)) | ((F.col("role") == "LW") & (F.col("y_cm") < 1100))
    return raised(d.filter(out), ["match_id", "player_id", "role"], 375)


def too_many(tracks: DataFrame, limit: int = 7) -> DataFrame:
    n = tracks.groupBy(*FRAME, "team").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return raised(n, ["match_id", "team"], 100)


def area_violation(tracks: DataFrame) -> DataFrame:
    """Attackers inside the goal area they attack."""
    goal = F.when(F.col("team") == "team_a", F.lit(P.COURT_W * 100)).otherwise(F.lit(0.0))
    d = tracks.filter(Z.in_goal_area(F.col("x_cm"), F.col("y_cm"), goal, unit=100.0))
    return raised(d, ["match_id", "player_id"], 50)


def break_chance(lines: DataFrame) -> DataFrame:
    return raised(lines.filter(F.col("ahead") > F.col("between") + 1), ["match_id", "team"], 75)


def numbers(tracks: DataFrame) -> DataFrame:
    """Two players more or fewer than the opponent in the half a team attacks."""
    right = F.col("x_cm") > 2000
    n = tracks.groupBy(*FRAME).agg(*[count_if((F.col("team") == t) & c).alias(f"{t[-1]}_{s}") for t in ("team_a", "team_b") for s, c in (("r", right), ("l", F.col("x_cm") < 2000))])
    rows = n.select(*FRAME, F.explode(F.array(
        F.struct(F.lit("team_a").alias("team"), (F.col("a_r") - F.col("b_r")).alias("diff")),
        F.struct(F.lit("team_b").alias("team"), (F.col("b_l") - F.col("a_l")).alias("diff")),
    )).alias("z")).select(*FRAME, "z.team", "z.diff").filter(F.abs("diff") >= 2)
    kind = F.when(F.col("diff") > 0, "superiority").otherwise("inferiority")
    return raised(rows.withColumn("kind", kind), ["match_id", "team", "kind"], 100)


def goal_open(lines: DataFrame) -> DataFrame:
    gap = F.when(F.col("team") == "team_a", 4000 - F.col("bx_cm")).otherwise(F.col("bx_cm"))
    return raised(lines.filter((F.abs(gap) < 900) & (F.col("lane") == 0)), ["match_id", "team"], 50)


def holes(hole_rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Holes of the team without the ball, one per whole metre of position."""
    att = lines.select(*FRAME, F.col("team").alias("att"))
    d = hole_rows.join(att, FRAME).filter(F.col("team") != F.col("att"))
    return raised(d.withColumn("at_m", F.floor(F.col("mid_cm") / 100.0)), ["match_id", "team", "at_m"], 125)


def wing_open(tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """A wing without a defender within 3 m but an attacker within 4 m (the intended distances)."""
    att = lines.select(*FRAME, F.col("team").alias("att"))
    d = tracks.select(*FRAME, "team", "y_cm").join(att, FRAME)
    mine = F.col("team") == F.col("att")
    g = d.groupBy(*FRAME, "att").agg(*[c for wing, y in (("right", 200), ("left", 1800)) for c in (
        count_if(~mine & (F.abs(F.col("y_cm") - y) < 300)).alias(f"d_{wing}"), count_if(mine & (F.abs(F.col("y_cm") - y) < 400)).alias(f"a_{wing}"))])
    wings = F.array(*[F.when((F.col(f"d_{w}") == 0) & (F.col(f"a_{w}") > 0), F.lit(w)) for w in ("right", "left")])
    rows = g.select(*FRAME, F.explode(F.array_compact(wings)).alias("wing"))
    return raised(rows, ["match_id", "wing"], 100)


def pivot_free(tracks: DataFrame, lines: DataFrame) -> DataFrame:
    """An attacker in the goal area without a defender within 1.5 m."""
    att = lines.select(*FRAME, F.col("team").alias("att"))
    d = tracks.select(*FRAME, "team", "player_id", "x_cm", "y_cm").join(att, FRAME)
    goal = F.when(F.col("att") == "team_a", F.lit(P.COURT_W * 100)).otherwise(F.lit(0.0))
    inside = Z.in_goal_area(F.col("x_cm"), F.col("y_cm"), goal, unit=100.0)
    a = d.filter((F.col("team") == F.col("att")) & inside).alias("a")
    b = d.filter(F.col("team") != F.col("att")).alias("b")
    near = sq_dist(F.col("a.x_cm"), F.col("a.y_cm"), F.col("b.x_cm"), F.col("b.y_cm")) < 150 * 150
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in FRAME] + [near]
    return raised(a.join(b, on, "left_anti").select(*FRAME, "team"), ["match_id", "team"], 75)
