"""Event machines: shots, goals, fast breaks, flights, keeper saves, techniques.

Predicates that depend on inputs only are blocked windows; a cooldown is a debounce over the
few hits left.  Shots are chains of possible starts, each followed through its own next seconds;
flights fall into pieces between holders.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from matchloom.functions.common import dist, sq_dist

from matchloom.functions.pose import L_ANK, L_HIP, L_KNEE, L_SH, L_WR, NOSE, R_ANK, R_HIP, R_KNEE, R_SH, R_WR, Body, seen_points
from matchloom.operators.possession import ball_speed, nearest_player, valid_ball
from matchloom.plans.chains import chain, debounce
from matchloom.plans.ordered import halo, number_rows, scan
from matchloom.plans.ranges import interval_join

FRAME = ["match_id", "frame_n"]


def ball_frames(tracks: DataFrame, ball: DataFrame, touch: DataFrame, boxes: DataFrame, pad: int = 12) -> DataFrame:
    """One row per valid ball frame: two-row speed, direction, nearest player, team in possession, goal-box side.

    ``at_edge`` is the side whose picture edge the ball is at, where the match has no goal box on that side.
    """
    sp = ball_speed(ball).select(*FRAME, "bpx", "bpy", "speed", (F.col("bpx") - F.col("lx")).alias("dx"))
    near = nearest_player(tracks, valid_ball(ball), 150.0).select(*FRAME, F.col("player_id").alias("near_id"), F.col("team").alias("near_team"), "d2")
    d = sp.join(near, FRAME, "left")
    d = d.join(tracks.select(*FRAME, F.col("player_id").alias("near_id"), F.col("px").alias("near_px")), [*FRAME, "near_id"], "left")
    commit = touch.filter("commits").select(*FRAME, F.col("team").alias("commit"))
    d = scan(d.join(commit, FRAME, "left"), ["match_id"], "frame_n", last={"held": F.col("commit")})
    b = boxes.groupBy("match_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s[0]}_{c}") for s in ("left", "right") for c in ("gx1", "gx2", "gy1", "gy2")])
    d = d.join(b, "match_id", "left")

    def inside(s):
        return F.col("bpx").between(F.col(f"{s}_gx1") - pad, F.col(f"{s}_gx2") + pad) & F.col("bpy").between(F.col(f"{s}_gy1") - pad, F.col(f"{s}_gy2") + pad)

    side = F.when(inside("l"), "left").when(inside("r"), "right")
    edge = F.when(F.col("l_gx1").isNull() & (F.col("bpx") <= EDGE_STRIP), "left").when(F.col("r_gx1").isNull() & (F.col("bpx") >= 1280 - EDGE_STRIP), "right")
    return d.select(*FRAME, "bpx", "bpy", "speed", "dx", "near_id", "near_team", "near_px", "held", side.alias("in_box"), edge.alias("at_edge"))


# --- fixed values: shot machine ---
SHOT_COOLDOWN, SHOT_EXPIRES, GOAL_CHECKS, SAVE_ZONE = 37.5, 75, 2, 320.0
EDGE_STRIP, MID_HEIGHT = 30, (252, 468)


def launches(frames: DataFrame, slow: float = 18.0, fast: float = 90.0) -> DataFrame:
    """Ball frames at which a shot may start: possession, speed in range, moving towards the attacked goal."""
    toward = F.when(F.col("held") == "team_a", F.col("dx") > 0).otherwise(F.col("dx") < 0)
    ok = F.col("held").isNotNull() & (F.col("speed") > slow) & (F.col("speed") <= fast) & ~F.isnan("speed") & toward
    shooter = F.when(F.col("near_team") == F.col("held"), F.col("near_id")).cast("long")
    return frames.filter(ok).select(*FRAME, F.col("held").alias("team"), "speed", shooter.alias("shooter_id"), F.col("bpx").alias("x"), F.col("bpy").alias("y"))


def shots(frames: DataFrame, slow: float = 18.0, fast: float = 90.0, edges: bool = False) -> DataFrame:
    """Shots and how they end: goal (in the attacked box on two checks), save (nearest is an opponent
    close to the goal), or missed when three seconds have passed, seen or not.

    With ``edges``, a match without a box on the attacked side is judged by the strip along that edge of the picture: two checks in it
    are a goal at mid height and a miss elsewhere. Rows without a speed, or faster than ``fast``, then are no checks.

    What ends a shot depends on its own next three seconds only, so every possible start looks ahead inside frame blocks; which of
    them are shots is a chain, as none starts while another is open or cools down. A shot still open at the last frame is left out.
    """
    def ends(d, keys):
        w = W.partitionBy(*keys).orderBy("frame_n")
        for t, goal_x, box in (("a", 1280.0, "right"), ("b", 0.0, "left")):
            team = f"team_{t}"
            save = F.col("near_team").isNotNull() & (F.col("near_team") != team) & (F.abs(F.col("near_px") - goal_x) < SAVE_ZONE)
            ahead = w.rangeBetween(1, SHOT_EXPIRES)
            d = d.withColumn(f"save_{t}", F.min(F.when(save, F.struct("frame_n", F.col("near_id").cast("long").alias("keeper_id")))).over(ahead))
            d = d.withColumn("_in", F.coalesce(F.coalesce("in_box", "at_edge") == box, F.lit(False)))
            scored = F.coalesce(F.col("in_box") == box, F.lit(False)) | F.col("bpy").between(*MID_HEIGHT)
            both = F.col("_in") & F.coalesce(F.lag("_in", GOAL_CHECKS - 1).over(w), F.lit(False))
            # a check counts only if its first frame comes after the start, so the start's own next row cannot complete one
            d = d.withColumn("_goal", F.when(both, F.struct("frame_n", scored.alias("scored"), F.lag("frame_n", GOAL_CHECKS - 1).over(w).alias("since"))))
            d = d.withColumn("_goals", F.collect_list("_goal").over(ahead))
            d = d.withColumn(f"goal_{t}", F.array_min(F.transform(F.filter("_goals", lambda g: g.since > F.col("frame_n")), lambda g: F.struct(g.frame_n, g.scored))))
        return d.drop("_in", "_goal", "_goals")

    cols = [*FRAME, "bpy", "near_team", "near_px", "near_id", "in_box", F.col("at_edge") if edges else F.lit(None).cast("string").alias("at_edge")]
    checks = frames.filter(F.col("speed") <= fast) if edges else frames
    seen = halo(checks.select(*cols), ["match_id"], "frame_n", 0, ends, ahead=SHOT_EXPIRES + 1)
    home = F.col("team") == "team_a"
    d = launches(frames, slow, fast).join(seen.select(*FRAME, "save_a", "save_b", "goal_a", "goal_b"), FRAME)
    d = d.withColumn("save", F.when(home, F.col("save_a")).otherwise(F.col("save_b"))).withColumn("goal", F.when(home, F.col("goal_a")).otherwise(F.col("goal_b")))
    saved = F.col("save").isNotNull() & (F.col("goal").isNull() | (F.col("save.frame_n") <= F.col("goal.frame_n")))
    outcome = F.when(saved, "save").when(F.col("goal.scored"), "goal").otherwise("missed")
    end = F.coalesce(F.least("save.frame_n", "goal.frame_n"), F.col("frame_n") + SHOT_EXPIRES + 1)
    d = d.select(*FRAME, "team", "speed", "shooter_id", "x", "y", end.alias("end_frame"), outcome.alias("outcome"), F.when(saved, F.col("save.keeper_id")).alias("keeper_id"))
    d = d.withColumn("_next", F.greatest(F.col("end_frame") + 1, F.col("frame_n") + math.ceil(SHOT_COOLDOWN)))
    kept = chain(d, ["match_id"], "frame_n", "_next").drop("_next")
    last = frames.groupBy("match_id").agg(F.max("frame_n").alias("_last"))
    return kept.join(last, "match_id").filter(F.col("end_frame") <= F.col("_last")).drop("_last")


def direct_goals(ball: DataFrame, boxes: DataFrame, frames: int = 4, pad: int = 10, min_conf: int = 25, cooldown: int | None = 75) -> DataFrame:
    """A real, confident ball in a goal box for consecutive frames; ``cooldown`` None gives the raw hits."""
    d = ball.join(boxes, "match_id")
    ok = (F.col("state") == "real") & (F.col("bconf_pct") >= min_conf) & F.col("bpx").between(F.col("gx1") - pad, F.col("gx2") + pad) & F.col("bpy").between(F.col("gy1") - pad, F.col("gy2") + pad)
    d = d.filter(ok).select("match_id", "side", "frame_n")

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("frame_n").rangeBetween(-(frames - 1), 0)
        return x.withColumn("n", F.count(F.lit(1)).over(w))

    hits = halo(d, ["match_id", "side"], "frame_n", frames - 1, build).filter(F.col("n") == frames).select("match_id", "frame_n").distinct()
    return hits if cooldown is None else debounce(hits, ["match_id"], "frame_n", cooldown)


def smart_goals(tracks: DataFrame, ball: DataFrame, shot_rows: DataFrame, strip: float = 0.12, clear: float = 62.0, window: int = 62, slow: float = 0.6, cooldown: int | None = 75) -> DataFrame:
    """Ball enters a side strip away from every player soon after a shot, then slows or vanishes."""
    d = ball_speed(ball).select(*FRAME, "bpx", "bpy", "speed")
    lo, hi = 1280 * strip, 1280 * (1 - strip)
    d = d.withColumn("inside", (F.col("bpx") < lo) | (F.col("bpx") > hi))
    gone = ball.filter(F.col("bpx").isNull()).select("match_id", (F.col("frame_n") - 1).alias("frame_n")).withColumn("gone", F.lit(True))
    d = scan(d, ["match_id"], "frame_n", lag={"was": F.col("inside"), "v0": F.col("speed")}).join(gone, FRAME, "left")
    calm = F.coalesce(F.col("speed") < F.col("v0") * slow, F.lit(False)) | F.coalesce("gone", F.lit(False))
    d = d.filter(F.col("inside") & ~F.coalesce("was", F.lit(True)) & calm)
    close = nearest_player(tracks, ball, clear).select(*FRAME)
    d = d.join(close, FRAME, "left_anti")
    s = shot_rows.select("match_id", F.col("frame_n").alias("lo"), (F.col("frame_n") + window).alias("hi"))
    d = interval_join(d, s, ["match_id"], "frame_n", "lo", "hi", bucket=128, how="left_semi").select(*FRAME)
    return d if cooldown is None else debounce(d, ["match_id"], "frame_n", cooldown)


def goals_of_all_paths(*paths: DataFrame, cooldown: int = 75) -> DataFrame:
    """Hits of several goal detectors under one shared cooldown."""
    out = paths[0].select(*FRAME)
    for p in paths[1:]:
        out = out.unionByName(p.select(*FRAME))
    return debounce(out, ["match_id"], "frame_n", cooldown)


def fast_breaks(changes: DataFrame, ball: DataFrame, lines: DataFrame, after=(10, 75), speed=(14.0, 80.0), defenders=(1, 2), cooldown: int = 100) -> DataFrame:
    """Quick ball and few defenders ahead shortly after winning possession."""
    c = changes.select("match_id", "team", (F.col("frame_n") + after[0]).alias("lo"), (F.col("frame_n") + after[1]).alias("hi"))
    d = ball_speed(ball).filter(F.col("speed").between(*speed)).select(*FRAME).join(lines.select(*FRAME, "team", "between"), FRAME)
    d = d.filter(F.col("between").between(*defenders))
    d = interval_join(d, c, ["match_id", "team"], "frame_n", "lo", "hi", bucket=128, how="left_semi")
    return debounce(d, ["match_id", "team"], "frame_n", cooldown)


def flights(frames: DataFrame, shot_speed: float = 18.0, pass_speed: float = 6.0, cone: float = 22.0, longest: int = 30, bend: float = 35.0) -> DataFrame:
    """Ball flights: launched when the ball leaves its holder, closed at another player or after ``longest`` frames.

    ``frames`` has one row per ball frame with holder_id / holder_team (null when nobody is near). A frame with a holder
    settles the state whatever came before, so a match falls into pieces between holders: at most one flight each, launched at the
    first frame fast enough. Pieces are grouped aggregations; nothing walks a match.
    """
    here, held = F.struct("bpx", "bpy"), F.col("holder_id").isNotNull() & ~F.isnan(F.col("holder_id").cast("double"))
    owner = F.when(held, F.struct(F.col("holder_id").cast("long").alias("id"), F.col("holder_team").alias("team")))
    d = scan(frames.select(*FRAME, "bpx", "bpy", "holder_id", "holder_team"), ["match_id"], "frame_n", lag={"q": here}, prior={"by": owner}, sums={"piece": held.cast("long")})
    d = d.withColumn("own", owner).withColumn("piece", F.col("piece") - held.cast("long")).filter("by IS NOT NULL")
    dx, dy = F.col("bpx") - F.col("q.bpx"), F.col("bpy") - F.col("q.bpy")
    d = d.withColumn("v", F.sqrt(dx * dx + dy * dy)).withColumn("h", F.when(F.col("v") > 0, F.degrees(F.atan2(dy, dx))))
    piece = ["match_id", "piece"]
    start = F.struct(F.col("frame_n").alias("f"), "v", "h", "by", F.col("bpx").alias("x"), F.col("bpy").alias("y"))
    began = d.filter(F.col("own").isNull() & (F.col("v") >= pass_speed)).groupBy(*piece).agg(F.min_by(start, "frame_n").alias("s"))
    d = d.join(began, piece).filter(F.col("frame_n") >= F.col("s.f"))
    over = (F.col("frame_n") > F.col("s.f")) & (F.col("own").isNotNull() | (F.col("frame_n") - F.col("s.f") > longest))
    ended = d.filter(over).groupBy(*piece).agg(F.min_by(F.struct("frame_n", "own"), "frame_n").alias("e"))
    d = d.join(ended, piece).filter(F.col("frame_n") <= F.col("e.frame_n"))

    def turn(a, b):
        return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)

    w = W.partitionBy(*piece).orderBy("frame_n").rowsBetween(W.unboundedPreceding, -1)  # at most longest + 2 frames
    steady = F.coalesce(turn(F.col("h"), F.last("h", ignorenulls=True).over(w)) < bend, F.lit(True))
    d = d.withColumn("steady", steady).groupBy(*piece).agg(F.first("s").alias("s"), F.first("e").alias("e"), F.min("steady").alias("ballistic"))
    aim = F.least(*[turn(F.col("s.h"), F.degrees(F.atan2(360.0 - F.col("s.y"), gx - F.col("s.x")))) for gx in (F.lit(0.0), F.lit(1280.0))])
    kind = F.when((F.col("s.v") >= shot_speed) & (aim < cone), "shot").otherwise("pass")
    other = F.col("e.own").isNotNull() & (F.col("e.own.id") != F.col("s.by.id"))
    result = F.when(other & (F.col("e.own.team") == F.col("s.by.team")), "completed").when(other, "intercepted").otherwise("open")
    out = d.select("match_id", F.col("s.f").alias("start_frame"), F.col("e.frame_n").alias("end_frame"), kind.alias("kind"), F.col("s.by.id").alias("from_id"),
                   F.when(other, F.col("e.own.id")).alias("to_id"), result.alias("result"), "ballistic")
    return out.filter("result <> 'open' OR kind = 'shot'")


def keeper_shots(frames: DataFrame, speed: float = 18.0, near_px: float = 288.0, drop: float = 0.45, longest: int = 60) -> DataFrame:
    """Shots at a keeper: start fast towards a goal within 9 m, end in the goal, at contact (slow-down or turn), or after ``longest`` frames.

    Each possible start is followed through its own next ``longest`` frames, where the peak speed runs along; which starts are shots is
    a chain, as none begins while another is open. A shot still open at the last frame is left out.
    """
    left, right = (F.col("dx") < 0) & (F.col("bpx") < near_px), (F.col("dx") > 0) & (F.col("bpx") > 1280 - near_px)
    v = F.when(~F.isnan("speed"), F.col("speed"))
    starts = frames.filter((v >= speed) & (left | right)).select("match_id", F.col("frame_n").alias("lo"), (F.col("frame_n") + longest).alias("hi"), F.col("dx").alias("dx0"), F.when(left, "left").otherwise("right").alias("side"))
    seen = frames.select(*FRAME, v.alias("v"), "dx", F.col("near_id").isNotNull().alias("near"), "in_box")
    d = interval_join(seen, starts, ["match_id"], "frame_n", "lo", "hi", bucket=64)
    start = ["match_id", "lo"]
    d = d.withColumn("peak", F.coalesce(F.max("v").over(W.partitionBy(*start).orderBy("frame_n")), F.lit(0.0)))  # longest + 1 rows at most
    goal = F.coalesce(F.col("in_box") == F.col("side"), F.lit(False))
    contact = F.coalesce(F.col("v") < drop * F.col("peak"), F.lit(False)) | F.coalesce(F.col("dx") * F.col("dx0") < 0, F.lit(False))
    outcome = F.when(goal, "goal").when(contact, F.when(F.col("near"), "save").otherwise("missed"))
    ends = F.min(F.when((F.col("frame_n") > F.col("lo")) & (goal | contact), F.struct("frame_n", outcome.alias("outcome"), "peak")))
    d = d.groupBy(*start).agg(F.first("side").alias("side"), F.first("hi").alias("hi"), ends.alias("e"), F.max("peak").alias("all_peak"))
    d = d.select("match_id", F.col("lo").alias("start_frame"), F.coalesce("e.frame_n", "hi").alias("end_frame"), "side", F.coalesce("e.peak", "all_peak").alias("peak"), F.coalesce("e.outcome", F.lit("unknown")).alias("outcome"))
    kept = chain(d.withColumn("_next", F.col("end_frame") + 1), ["match_id"], "start_frame", "_next").drop("_next")
    last = frames.groupBy("match_id").agg(F.max("frame_n").alias("_last"))
    return kept.join(last, "match_id").filter(F.col("end_frame") <= F.col("_last")).drop("_last")


def reactions(starts: DataFrame, tracks: DataFrame, fps: float = 25.0, moved: float = 12.0, longest: int = 60) -> DataFrame:
    """Milliseconds from a shot's start to the keeper's centre moving by ``moved`` pixels."""
    s = starts.select("match_id", F.col("start_frame").alias("lo"), F.when(F.col("side") == "left", 0).otherwise(7).alias("slot")).withColumn("hi", F.col("lo") + longest)
    d = interval_join(tracks.select(*FRAME, "slot", "px", "py"), s, ["match_id", "slot"], "frame_n", "lo", "hi", bucket=64)
    by = ["match_id", "slot", "lo"]
    first = d.groupBy(*by).agg(F.min_by(F.struct("px", "py"), "frame_n").alias("p0"))
    d = d.join(first, by)
    go = sq_dist(F.col("px"), F.col("py"), F.col("p0.px"), F.col("p0.py")) >= moved * moved
    return d.groupBy(*by).agg(((F.min(F.when(go, F.col("frame_n"))) - F.first("lo")) * 1000.0 / fps).alias("reaction_ms")).select(
        "match_id", F.col("lo").alias("start_frame"), "slot", "reaction_ms")


# ---- techniques -----------------------------------------------------------------
def ball_metres(ball: DataFrame) -> DataFrame:
    b = valid_ball(ball).select(*FRAME, (F.col("bx_cm") / 100.0).alias("bx"), (F.col("by_cm") / 100.0).alias("by"), "bpx", "bpy")
    return number_rows(b, ["match_id"], "frame_n")


def _back(d: DataFrame, keys: list[str], n: int, cols: list[str], order: str = "rn") -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    for c in cols:
        d = d.withColumn(f"o_{c}", F.lag(c, n).over(w))
    return d


def technique_shots(ball: DataFrame, tracks: DataFrame, fps: float = 25.0, speed: float = 12.0) -> DataFrame:
    """Ball over five samples faster than ``speed`` into a goal end; nearest player shoots, jumping if its
    image height arcs by more than 8 px within 18 rows."""
    b = halo(ball_metres(ball), ["match_id"], "rn", 5, lambda d, k: _back(d, k, 4, ["bx", "by", "frame_n"]))
    df = F.greatest(F.col("frame_n") - F.col("o_frame_n"), F.lit(1))
    vx = (F.col("bx") - F.col("o_bx")) / df * fps
    v = dist(F.col("bx"), F.col("by"), F.col("o_bx"), F.col("o_by")) / df * fps
    b = b.withColumn("v", v).filter((F.col("v") >= speed) & (((F.col("bx") < 5) & (vx < -3)) | ((F.col("bx") > 35) & (vx > 3))))
    near = nearest_player(tracks, ball, None).select(*FRAME, "player_id")
    n = number_rows(tracks.select(*FRAME, "player_id", "py"), ["match_id", "player_id"], "frame_n")

    def arc(d, keys):
        w = W.partitionBy(*keys).orderBy("rn").rowsBetween(-17, 0)
        at = F.min(F.struct("py", "rn")).over(w)
        d = d.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_lo", at).withColumn("_first", F.first(F.struct("py", "rn")).over(w))
        i = F.col("_lo.rn") - F.col("_first.rn")
        return d.withColumn("jump", (F.col("_n") == 18) & i.between(3, 15) & (F.col("_first.py") - F.col("_lo.py") > 8)).drop("_n", "_lo", "_first")

    j = halo(n, ["match_id", "player_id"], "rn", 18, arc).select(*FRAME, "player_id", "jump")
    return b.join(near, FRAME).join(j, [*FRAME, "player_id"], "left").select(
        *FRAME, "player_id", F.when(F.col("jump"), "jump_shot").otherwise("standing_shot").alias("technique"), "v")


def technique_breaks(tracks: DataFrame, free: DataFrame, fps: float = 25.0, speed: float = 5.5) -> DataFrame:
    """Players faster than a sprint over 15 samples in open space."""
    d = number_rows(tracks.select(*FRAME, "player_id", "x_cm", "y_cm"), ["match_id", "player_id"], "frame_n")
    d = halo(d, ["match_id", "player_id"], "rn", 15, lambda x, k: _back(x, k, 14, ["x_cm", "y_cm", "frame_n"]))
    v = dist(F.col("x_cm"), F.col("y_cm"), F.col("o_x_cm"), F.col("o_y_cm")) / 100.0 / (F.col("frame_n") - F.col("o_frame_n")) * fps
    return d.withColumn("v", v).filter(F.col("v") > speed).join(free.select(*FRAME, "player_id"), [*FRAME, "player_id"], "left_semi").select(*FRAME, "player_id", "v")


def near_ball(tracks: DataFrame, ball: DataFrame, reach_cm: float = 180.0) -> DataFrame:
    b = ball.filter("bx_cm is not null").select(*FRAME, "bx_cm", "by_cm")
    d = tracks.select(*FRAME, "player_id", "x_cm", "y_cm").join(b, FRAME)
    return d.withColumn("near", sq_dist(F.col("x_cm"), F.col("y_cm"), F.col("bx_cm"), F.col("by_cm")) < reach_cm * reach_cm)


def technique_dribbles(tracks: DataFrame, ball: DataFrame, rows: int = 25, share: float = 0.65, moved_cm: float = 300.0) -> DataFrame:
    """Ball near the player in most of the last rows while the player moved on."""
    d = number_rows(near_ball(tracks, ball), ["match_id", "player_id"], "frame_n")

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("rn").rowsBetween(-(rows - 1), 0)
        x = x.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_near", F.sum(F.col("near").cast("int")).over(w))
        return x.withColumn("_p", F.first(F.struct("x_cm", "y_cm")).over(w))

    d = halo(d, ["match_id", "player_id"], "rn", rows, build)
    far = sq_dist(F.col("x_cm"), F.col("y_cm"), F.col("_p.x_cm"), F.col("_p.y_cm")) > moved_cm * moved_cm
    return d.filter((F.col("_n") == rows) & (F.col("_near") > rows * share) & far).select(*FRAME, "player_id", F.col("_near").alias("near_rows"))


def turns(ball: DataFrame, back: int, cos: float = 0.3) -> DataFrame:
    """Ball frames whose direction differs sharply from ``back`` rows earlier (both moving)."""
    def build(d, keys):
        w = W.partitionBy(*keys).orderBy("rn")
        for c in ("bpx", "bpy"):
            d = d.withColumn(f"n{c}", (F.col(c) - F.lag(c).over(w)) / F.greatest(F.col("frame_n") - F.lag("frame_n").over(w), F.lit(1)))
            d = d.withColumn(f"p{c}", (F.lag(c, back - 1).over(w) - F.lag(c, back).over(w)) / F.greatest(F.lag("frame_n", back - 1).over(w) - F.lag("frame_n", back).over(w), F.lit(1)))
        return d

    d = halo(ball_metres(ball), ["match_id"], "rn", back + 1, build)
    m1, m2 = F.sqrt(F.col("pbpx") * F.col("pbpx") + F.col("pbpy") * F.col("pbpy")), F.sqrt(F.col("nbpx") * F.col("nbpx") + F.col("nbpy") * F.col("nbpy"))
    dot = F.col("nbpx") * F.col("pbpx") + F.col("nbpy") * F.col("pbpy")
    return d.filter((m1 >= 0.5) & (m2 >= 0.5) & (dot / F.nullif(m1 * m2, F.lit(0.0)) < cos)).select(*FRAME)


def technique_saves(tracks: DataFrame, ball: DataFrame, moved_cm: float = 120.0) -> DataFrame:
    """Players near a goal line displaced within six samples while the ball turns."""
    d = number_rows(tracks.select(*FRAME, "player_id", "x_cm", "y_cm"), ["match_id", "player_id"], "frame_n")
    d = halo(d, ["match_id", "player_id"], "rn", 6, lambda x, k: _back(x, k, 5, ["x_cm", "y_cm"]))
    far = sq_dist(F.col("x_cm"), F.col("y_cm"), F.col("o_x_cm"), F.col("o_y_cm")) > moved_cm * moved_cm
    d = d.filter(((F.col("x_cm") < 500) | (F.col("x_cm") > 3500)) & far)
    return d.join(turns(ball, 6), FRAME, "left_semi").select(*FRAME, "player_id")


def technique_blocks(tracks: DataFrame, ball: DataFrame, touch: DataFrame) -> DataFrame:
    """Ball turns at a player who is not the last one in possession."""
    near = nearest_player(tracks, ball, None).select(*FRAME, "player_id")
    d = turns(ball, 5).join(near, FRAME)
    owner = touch.filter("commits").select(*FRAME, F.col("player_id").alias("o"))
    d = scan(d.join(owner, FRAME, "full"), ["match_id"], "frame_n", last={"owner": F.col("o")})
    return d.filter(F.col("player_id").isNotNull() & ~F.col("player_id").eqNullSafe(F.col("owner"))).select(*FRAME, "player_id")


def technique_pivots(tracks: DataFrame, ball: DataFrame, back: int = 8, reach_m: float = 6.5) -> DataFrame:
    """Player inside the goal circle with the ball now but not ``back`` frames ago."""
    d = near_ball(tracks, ball)
    x, y = F.col("x_cm") / 100.0, F.col("y_cm") / 100.0
    from matchloom.functions.zones import near_goal_6m

    now = d.filter(F.col("near") & near_goal_6m(x, y, reach_m)).select(*FRAME, "player_id")
    before = d.filter("near").select("match_id", (F.col("frame_n") + back).alias("frame_n"), "player_id")
    return now.join(before, [*FRAME, "player_id"], "left_anti")


def technique_passes(pass_rows: DataFrame, ball: DataFrame, fps: float = 25.0, speed: float = 7.0, arc_px: float = 15.0) -> DataFrame:
    """Passes whose ball moved fast over eight samples; overhead when it arced upwards between."""
    def build(d, keys):
        w = W.partitionBy(*keys).orderBy("rn")
        return _back(d, keys, 7, ["bx", "by", "frame_n", "bpy"]).withColumn("mid", F.lag("bpy", 4).over(w))

    b = halo(ball_metres(ball), ["match_id"], "rn", 8, build)
    v = dist(F.col("bx"), F.col("by"), F.col("o_bx"), F.col("o_by")) / F.greatest(F.col("frame_n") - F.col("o_frame_n"), F.lit(1)) * fps
    over = (F.col("mid") < F.col("o_bpy") - arc_px) & (F.col("mid") < F.col("bpy") - arc_px)
    b = b.select(*FRAME, v.alias("v"), F.coalesce(over, F.lit(False)).alias("over")).filter(F.col("v") > speed)
    return pass_rows.join(b, FRAME).select(*FRAME, "from_id", "to_id", F.when(F.col("over"), "overhead_pass").otherwise("pass").alias("technique"), "v")


# ---- body -----------------------------------------------------------------------
STATURE_CM = 188.0


def jumps(poses: DataFrame, stature: float = STATURE_CM, airborne_cm: float = 8.0, rows: int = 60) -> DataFrame:
    """Jump height above the deepest foot position of the last rows, airborne flag, running peak."""
    k = Body()
    feet = F.greatest(k.y(L_ANK), k.y(R_ANK))
    d = poses.filter(F.col("h_px") >= 20).withColumn("foot", feet).filter("foot is not null").select(*FRAME, "player_id", "h_px", "foot")
    keys = ["match_id", "player_id"]
    d = number_rows(d, keys, "frame_n")

    def build(x, p):
        w = W.partitionBy(*p).orderBy("rn").rowsBetween(-(rows - 1), 0)
        return x.withColumn("jump_cm", (F.max("foot").over(w) - F.col("foot")) * F.lit(stature) / F.col("h_px"))

    d = halo(d, keys, "rn", rows - 1, build).withColumn("airborne", F.col("jump_cm") >= airborne_cm)
    return scan(d, keys, "frame_n", maxes={"peak_cm": F.col("jump_cm")})


def arms(poses: DataFrame, stature: float = STATURE_CM) -> DataFrame:
    """Elbow angle of the higher arm and the wrist's height over the hips in centimetres."""
    k = Body()
    hip, seen = k.mean("y", (L_HIP, R_HIP))
    d = poses.withColumn("arm", k.throwing_arm()).filter("arm is not null")
    release = F.greatest(F.lit(0.0), hip - F.col("arm.wrist_y")) * F.lit(stature) / F.col("h_px")
    return d.select(*FRAME, "player_id", F.col("arm.angle").alias("angle"), F.when(seen > 0, release).alias("release_cm"))


def pose_actions(poses: DataFrame) -> DataFrame:
    """jump_shot, passing, running or standing from key points and the previous row's wrists.

    All but the wrists' speed is told by the row itself, before rows are ordered: these carry four places and three flags.
    """
    wrists = [f"{axis}{i}" for i in (L_WR, R_WR) for axis in "xy"]
    d = seen_points(poses, [*FRAME, "player_id", "h_px"], (L_SH, R_SH, L_WR, R_WR), (NOSE, L_WR, R_WR, L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANK, R_ANK))
    y, h, zero = (lambda i: F.col(f"y{i}")), F.greatest(F.col("h_px"), F.lit(1)), F.lit(0.0)
    votes = zero
    for wrist in (L_WR, R_WR):
        votes = votes + F.when(y(wrist) < y(NOSE), F.lit(0.4)).otherwise(zero)
    ratio = ((y(L_HIP) + y(R_HIP)) / 2.0 - (y(L_ANK) + y(R_ANK)) / 2.0) / h
    votes = votes + F.when(ratio > 0.05, F.least(ratio * 4.0, F.lit(0.6))).otherwise(zero)
    running = F.coalesce(F.abs(y(L_KNEE) - y(R_KNEE)) / h > 0.08, F.lit(False))
    far = [(F.abs(F.col(f"x{wr}") - F.col(f"x{sh}")) / h >= 0.3).alias(f"far{wr}") for wr, sh in ((R_WR, R_SH), (L_WR, L_SH))]
    own = F.when(votes >= 0.5, "jump_shot").when(running, "running").otherwise("standing")
    d = d.select(*FRAME, "player_id", "h_px", *wrists, own.alias("own"), *far)
    d = scan(d, ["match_id", "player_id"], "frame_n", lag={"q": F.struct(*wrists)})
    passing = F.lit(False)
    for wr in (R_WR, L_WR):
        quick = dist(F.col(f"x{wr}"), F.col(f"y{wr}"), F.col(f"q.x{wr}"), F.col(f"q.y{wr}")) / h > 0.08
        passing = passing | F.coalesce(F.col(f"far{wr}") & quick, F.lit(False))
    return d.select(*FRAME, "player_id", F.when((F.col("own") != "jump_shot") & passing, "passing").otherwise(F.col("own")).alias("action"))
