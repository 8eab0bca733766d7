"""Ball holder, possession, passes, chains and ball quality runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom import params as P
from matchloom.functions.common import count_if, pct, sq_dist
from matchloom.plans.ordered import halo, islands, number_rows, scan
from matchloom.session import cut_lineage

FRAME = ["match_id", "frame_n"]


def nearest_player(tracks: DataFrame, ball: DataFrame, radius: float | None, where: Column | None = None) -> DataFrame:
    """Nearest player to the ball per frame; lowest player id on ties.

    One equi-join on the frame; the arg-min aggregates map-side, so no pair list is kept.
    """
    b = ball.filter(F.col("bpx").isNotNull()).select(*FRAME, "bpx", "bpy")
    d = tracks.select(*FRAME, "player_id", "team", "px", "py").join(b, FRAME)
    d = d.withColumn("d2", sq_dist(F.col("px"), F.col("py"), F.col("bpx"), F.col("bpy")))
    if radius is not None:
        d = d.filter(F.col("d2") < radius * radius)
    if where is not None:
        d = d.filter(where)
    best = F.min(F.struct("d2", "player_id", "team"))
    return d.groupBy(*FRAME).agg(best.alias("m"), F.first("bpx").alias("bpx"), F.first("bpy").alias("bpy")).select(
        *FRAME, "m.player_id", "m.team", "m.d2", "bpx", "bpy"
    )


def valid_ball(ball: DataFrame, max_side: float = 150.0, aspect=(0.4, 2.5)) -> DataFrame:
    ratio = F.col("bw_px") / F.col("bh_px")
    return ball.filter(
        F.col("bpx").isNotNull() & (F.col("bw_px") <= max_side) & (F.col("bh_px") <= max_side) & ratio.between(*aspect)
    )


def ball_steps(ball: DataFrame, max_jump: float = 300.0) -> DataFrame:
    """Valid ball rows with the step from the previous one; a jump restarts the history."""
    b = valid_ball(ball).select(*FRAME, "bpx", "bpy")
    d = scan(b, ["match_id"], "frame_n", lag={"lx": F.col("bpx"), "ly": F.col("bpy"), "lf": F.col("frame_n")})
    step = F.sqrt(sq_dist(F.col("bpx"), F.col("bpy"), F.col("lx"), F.col("ly")))
    return d.withColumn("step", F.when(step <= max_jump, step)).withColumn("jump", F.coalesce(step > max_jump, F.lit(False)))


def holders(tracks: DataFrame, ball: DataFrame, radius: float = P.POSSESSION_RADIUS_PX) -> DataFrame:
    """One row per frame with a player within reach of the ball, with the ball's last step.

    This table is a fourteenth of the tracks and feeds several passes, so its lineage is cut.
    """
    near = nearest_player(tracks, valid_ball(ball), radius)
    step = ball_steps(ball).select(*FRAME, "step")
    return cut_lineage(near.join(step, FRAME).select(*FRAME, "player_id", "team", "bpx", "bpy", "step"))


def touches(hold: DataFrame, debounce: int = P.POSSESSION_DEBOUNCE) -> DataFrame:
    """Holder rows with their run of one team, position in it (capped at ``debounce``) and
    the team in possession before the run."""
    d = islands(hold, ["match_id"], "frame_n", F.col("team"), "run", row_number="rn")

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("rn")
        pos = F.lit(debounce)
        for k in range(debounce - 1, 0, -1):
            same = F.coalesce(F.lag("run", k).over(w) == F.col("run"), F.lit(False))
            pos = F.when(~same, F.lit(k)).otherwise(pos)
        nth = F.coalesce(F.lag("run", debounce).over(w) == F.col("run"), F.lit(False))
        return x.withColumn("pos", pos).withColumn("commits", (F.col("pos") == debounce) & ~nth)

    d = cut_lineage(halo(d, ["match_id"], "rn", debounce + 1, build))
    runs = d.groupBy("match_id", "run").agg(F.first("team").alias("t"), F.max("commits").alias("c"))
    runs = scan(runs, ["match_id"], "run", prior={"held": F.when(F.col("c"), F.col("t"))})
    return d.join(runs.select("match_id", "run", "held"), ["match_id", "run"])


def possession_changes(touch: DataFrame) -> DataFrame:
    d = touch.filter(F.col("commits") & ~F.col("team").eqNullSafe(F.col("held")))
    return d.select("match_id", "frame_n", "team", "player_id", F.coalesce("held", F.lit("none")).alias("from_team"))


def active(touch: DataFrame, debounce: int = P.POSSESSION_DEBOUNCE) -> DataFrame:
    """Rows that may move the ball to another player of the team in possession."""
    back = (F.col("pos") == 1) & F.col("team").eqNullSafe(F.col("held"))
    return touch.filter(back | (F.col("pos") >= debounce))


def passes(touch: DataFrame, min_step: float = P.PASS_SPEED_PXF) -> DataFrame:
    d = scan(active(touch), ["match_id"], "frame_n", lag={"from_id": F.col("player_id")})
    hit = F.col("from_id").isNotNull() & (F.col("from_id") != F.col("player_id")) & (F.col("step") > min_step)
    return d.filter(hit).select("match_id", "frame_n", "team", "from_id", F.col("player_id").alias("to_id"), "step")


def chains(touch: DataFrame, keep: int = 12) -> DataFrame:
    """Last ``keep`` touches (repeats merged) of every possession, oldest first."""
    d = islands(active(touch), ["match_id"], "frame_n", F.col("team"), "chain")
    d = islands(d, ["match_id", "chain"], "frame_n", F.col("player_id"), "nth")
    t = d.groupBy("match_id", "chain", "nth").agg(F.first("team").alias("team"), F.first("player_id").alias("player_id"))
    n = t.groupBy("match_id", "chain").agg(F.max("nth").alias("n"))
    kept = t.join(n, ["match_id", "chain"]).filter(F.col("nth") > F.col("n") - keep)
    return kept.groupBy("match_id", "chain").agg(
        F.first("team").alias("team"),
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "player_id"))), lambda s: s["player_id"]).alias("players"),
    )


def chain_assist(players: Column, shooter: Column) -> Column:
    """The touch before the shooter's first one, or the second last when the shooter has none."""
    i = F.array_position(players, shooter)
    return F.when(i > 1, F.get(players, (i - 2).cast("int"))).when(
        (i == 0) & (F.size(players) >= 2), F.element_at(players, -2)
    )


def pass_network(pass_rows: DataFrame) -> DataFrame:
    return pass_rows.groupBy("match_id", "team", "from_id", "to_id").agg(F.count(F.lit(1)).alias("passes"))


def ball_speed(ball: DataFrame, back: int = 2) -> DataFrame:
    """Displacement per frame over ``back`` rows of the history since the last jump."""
    d = ball_steps(ball)
    d = scan(d, ["match_id"], "frame_n", sums={"part": F.col("jump").cast("bigint"), "rn": F.lit(1).cast("bigint")})

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("rn")
        ok = F.lag("part", back).over(w) == F.col("part")
        px, py, pf = (F.lag(c, back).over(w) for c in ("bpx", "bpy", "frame_n"))
        v = F.sqrt(sq_dist(F.col("bpx"), F.col("bpy"), px, py)) / F.greatest(F.col("frame_n") - pf, F.lit(1))
        return x.withColumn("speed", F.when(ok, v))

    return halo(d, ["match_id"], "rn", back + 1, build)


def ball_fill(ball: DataFrame, friction: float = 0.85, stop: float = 0.5) -> DataFrame:
    """Positions for frames without a ball: the last step slowed by ``friction`` per frame.

    A step never exceeds the 300 px jump limit, so it falls below ``stop`` within 40 frames.
    """
    d = ball_steps(ball)
    d = d.withColumn("vx", F.when(F.col("step").isNotNull(), (F.col("bpx") - F.col("lx")) / (F.col("frame_n") - F.col("lf"))))
    d = d.withColumn("vy", F.when(F.col("step").isNotNull(), (F.col("bpy") - F.col("ly")) / (F.col("frame_n") - F.col("lf"))))
    gone = ball.filter(F.col("bpx").isNull()).select("match_id", "frame_n")
    every = d.select(*FRAME, "bpx", "bpy", "vx", "vy").unionByName(gone, allowMissingColumns=True)
    seen = F.when(F.col("bpx").isNotNull(), F.struct("frame_n", "bpx", "bpy", "vx", "vy"))
    e = scan(every, ["match_id"], "frame_n", last={"s": seen}).filter(F.col("bpx").isNull() & F.col("s").isNotNull())
    k = F.col("frame_n") - F.col("s.frame_n")
    geo = friction * (1.0 - F.pow(F.lit(friction), k)) / (1.0 - friction)
    speed = F.greatest(F.abs(F.col("s.vx")), F.abs(F.col("s.vy"))) * F.pow(F.lit(friction), k)
    e = e.filter(speed >= stop)
    return e.select(*FRAME, (F.col("s.bpx") + F.col("s.vx") * geo).alias("bpx"), (F.col("s.bpy") + F.col("s.vy") * geo).alias("bpy"))


def still_rows(ball: DataFrame, still_px: float = 2.0, limit: int = 50) -> DataFrame:
    """Valid ball rows flagged once the ball has not moved for more than ``limit`` rows."""
    d = ball_steps(ball)
    moved = (F.coalesce(F.sqrt(sq_dist(F.col("bpx"), F.col("bpy"), F.col("lx"), F.col("ly"))), F.lit(1e9)) >= still_px)
    d = d.withColumn("_m", moved)
    d = number_rows(d, ["match_id"], "frame_n")
    d = scan(d, ["match_id"], "rn", last={"_lm": F.when(F.col("_m"), F.col("rn"))})
    return d.withColumn("still_for", F.col("rn") - F.col("_lm")).withColumn("rejected", F.col("still_for") > limit)


def streaks(ball: DataFrame, state: str) -> DataFrame:
    """Runs of consecutive frames in one state."""
    d = islands(ball.select(*FRAME, "state"), ["match_id"], "frame_n", F.col("state") == state, "run")
    return d.filter(F.col("state") == state).groupBy("match_id", "run").agg(
        F.min("frame_n").alias("start_frame"), F.count(F.lit(1)).alias("frames")
    )


def trusted(ball: DataFrame, limit: int = 2) -> DataFrame:
    """Frames whose current run of phantom balls is not longer than ``limit``."""
    d = number_rows(ball.select(*FRAME, "state"), ["match_id"], "frame_n")
    d = scan(d, ["match_id"], "rn", last={"_ok": F.when(F.col("state") != "phantom", F.col("rn"))})
    return d.withColumn("streak", F.col("rn") - F.coalesce("_ok", F.lit(0))).filter(F.col("streak") <= limit)


def state_shares(ball: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per match: share of frames by ball state and of frames without any candidate."""
    n = candidates.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("c"))
    d = ball.select(*FRAME, "state").join(n, FRAME, "left").withColumn("c", F.least(F.coalesce("c", F.lit(0)), F.lit(5)))
    tot = F.count(F.lit(1))
    return d.groupBy("match_id").agg(
        tot.alias("frames"), *[pct(count_if(F.col("state") == s), tot).alias(f"{s}_pct") for s in ("real", "phantom", "lost")],
        *[count_if(F.col("c") == k).alias(f"with_{k}") for k in range(6)],
        pct(count_if(F.col("c") == 0), tot).alias("none_pct"),
    )


def dribbles(hold: DataFrame, min_rows: int = 8, flips: int = 2, amplitude: float = 9.0, moved: float = 40.0) -> DataFrame:
    """Runs of one holder whose ball bounces: vertical direction flips, height, distance covered."""
    d = islands(hold, ["match_id"], "frame_n", F.col("player_id"), "run", row_number="rn")

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("rn")
        a = F.signum(F.when(F.lag("run").over(w) == F.col("run"), F.col("bpy") - F.lag("bpy").over(w)))
        x = x.withColumn("_s", F.nullif(a, F.lit(0.0)))
        return x.withColumn("flip", F.coalesce((F.lag("_s").over(w) == -F.col("_s")) & (F.lag("run").over(w) == F.col("run")), F.lit(False)))

    d = halo(d, ["match_id"], "rn", 3, build)
    g = d.groupBy("match_id", "run").agg(
        F.first("player_id").alias("player_id"), F.min("frame_n").alias("start_frame"), F.max("frame_n").alias("end_frame"),
        F.count(F.lit(1)).alias("n"), count_if(F.col("flip")).alias("flips"), (F.max("bpy") - F.min("bpy")).alias("amp"),
        F.min_by(F.struct("bpx", "bpy"), "frame_n").alias("a"), F.max_by(F.struct("bpx", "bpy"), "frame_n").alias("b"),
    )
    far = sq_dist(F.col("a.bpx"), F.col("a.bpy"), F.col("b.bpx"), F.col("b.bpy")) >= moved * moved
    return g.filter((F.col("n") >= min_rows) & (F.col("flips") >= flips) & (F.col("amp") >= amplitude) & far).select(
        "match_id", "player_id", "start_frame", "end_frame", "n", "flips", "amp"
    )
