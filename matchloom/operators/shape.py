"""Team shape, defensive block, open space, transitions, shot options.

Everything is keyed by (match, frame[, team]); pair searches inside a frame are sort
windows or conditional aggregates, never pair lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom import params as P
from matchloom.functions.common import count_if, dist, r1, sq_dist
from matchloom.functions.geometry import point_segment
from matchloom.functions.pose import L_WR, R_WR, seen_points
from matchloom.operators.calibrate import opponent
from matchloom.plans.ranges import interval_join
from matchloom.plans.ordered import scan

FRAME = ["match_id", "frame_n"]
FT = [*FRAME, "team"]


def team_shape(tracks: DataFrame, w: float = P.FRAME_W, h: float = P.FRAME_H) -> DataFrame:
    """Centroid, mean radius, width and depth in percent of the frame, compactness; null under two players."""
    g = W.partitionBy(*FT)
    d = tracks.select(*FT, "px", "py", F.avg("px").over(g).alias("mx"), F.avg("py").over(g).alias("my"))
    d = d.groupBy(*FT).agg(
        F.count(F.lit(1)).alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.avg(dist(F.col("px"), F.col("py"), F.col("mx"), F.col("my"))).alias("radius"),
        (F.max("px") - F.min("px")).alias("width"), (F.max("py") - F.min("py")).alias("depth"),
    )
    ok = F.col("n") >= 2

    def when(c):
        return F.when(ok, c)

    return d.select(
        *FT, "n", when(r1(F.col("mx"))).alias("cx"), when(r1(F.col("my"))).alias("cy"), when(r1(F.col("radius"))).alias("spread"),
        when(r1(F.col("width") * 100.0 / w)).alias("width_pct"), when(r1(F.col("depth") * 100.0 / h)).alias("depth_pct"),
        when(F.floor(100.0 * (1.0 - F.least(F.lit(1.0), F.col("radius") / (0.25 * w))) + 0.5)).alias("compactness"),
    )


def own_x(team: Column) -> Column:
    return F.when(team == "team_a", F.lit(0.0)).otherwise(F.lit(P.COURT_W))


def formation(tracks: DataFrame, holder: DataFrame) -> DataFrame:
    """Formation code per frame and team of at least four; ``holder`` gives the team in possession."""
    far = F.abs(F.col("x_cm") / 100.0 - own_x(F.col("team"))) < 15
    d = tracks.groupBy(*FT).agg(F.count(F.lit(1)).alias("n"), count_if(far).alias("own")).filter("n >= 4")
    d = d.join(holder.select(*FRAME, F.col("team").alias("ball_team")), FRAME, "left")
    attack = F.col("team").eqNullSafe(F.col("ball_team"))
    code = F.when(attack, F.when(F.col("n") - F.col("own") >= 5, "3-2-1").otherwise("balanced")).otherwise(
        F.when(F.col("own") >= 5, "6-0").when(F.col("own") == 4, "5-1").otherwise("4-2"))
    return d.select(*FT, F.when(attack, "attack").otherwise("defence").alias("mode"), code.alias("formation"))


# ---- defensive block --------------------------------------------------------
def block_order(tracks: DataFrame, min_players: int = 3) -> DataFrame:
    """Players of a team ordered along the principal axis of their positions, with the gap to the previous one."""
    g = W.partitionBy(*FT)
    x, y = F.col("px"), F.col("py")
    d = tracks.select(*FT, "player_id", "px", "py", F.count(F.lit(1)).over(g).alias("n"), F.avg(x).over(g).alias("mx"), F.avg(y).over(g).alias("my"))
    d = d.filter(F.col("n") >= min_players).withColumn("dx", x - F.col("mx")).withColumn("dy", y - F.col("my"))
    sxx, syy, sxy = (F.sum(e).over(g) for e in (F.col("dx") * F.col("dx"), F.col("dy") * F.col("dy"), F.col("dx") * F.col("dy")))
    d = d.withColumn("angle", F.atan2(sxy * 2.0, sxx - syy) / 2.0)
    d = d.withColumn("along", F.floor((F.col("dx") * F.cos("angle") + F.col("dy") * F.sin("angle")) * 1e6 + 0.5))
    w = g.orderBy("along", "player_id")
    step = dist(x, y, F.lag("px").over(w), F.lag("py").over(w))
    return d.withColumn("rank", F.row_number().over(w)).withColumn("prev_id", F.lag("player_id").over(w)).withColumn("gap_px", step).select(
        *FT, "player_id", "px", "py", "rank", "prev_id", "gap_px")


def largest_gap(tracks: DataFrame, flag_px: float = 140.0) -> DataFrame:
    d = block_order(tracks).filter("prev_id is not null")
    top = F.max_by(F.struct("prev_id", "player_id", "gap_px"), F.struct("gap_px", -F.col("rank")))
    d = d.groupBy(*FT).agg(top.alias("g"))
    gap = F.col("g.gap_px")
    return d.select(
        *FT, gap.alias("gap_px"), F.col("g.prev_id").alias("left_id"), F.col("g.player_id").alias("right_id"),
        F.greatest(F.lit(30.0), gap / 2.0).alias("axis_a"), F.greatest(F.lit(24.0), gap / 3.2).alias("axis_b"), (gap >= flag_px).alias("flagged"))


def lateral_defender(tracks: DataFrame) -> DataFrame:
    """For every player the opponent with the least lateral distance (lowest id on ties).

    The nearest value below and above comes from ordered windows over the frame.
    """
    base = W.partitionBy(*FRAME).orderBy("py")
    below, above = base.rangeBetween(W.unboundedPreceding, 0), base.rangeBetween(0, W.unboundedFollowing)
    d = tracks.select(*FT, "player_id", "px", "py")
    for t in ("team_a", "team_b"):
        mine = F.col("team") == t
        lo = F.max(F.when(mine, F.struct("py", (-F.col("player_id")).alias("neg"), "px"))).over(below)
        hi = F.min(F.when(mine, F.struct("py", "player_id", "px"))).over(above)
        d = d.withColumn(f"lo_{t}", lo).withColumn(f"hi_{t}", hi)
    best = []
    for t in ("team_a", "team_b"):
        lo, hi = F.col(f"lo_{t}"), F.col(f"hi_{t}")
        a = F.when(lo.isNotNull(), F.struct((F.col("py") - lo["py"]).alias("side_px"), (-lo["neg"]).alias("id"), lo["px"].alias("x")))
        b = F.when(hi.isNotNull(), F.struct((hi["py"] - F.col("py")).alias("side_px"), hi["player_id"].alias("id"), hi["px"].alias("x")))
        best.append(F.least(a, b))
    d = d.withColumn("d", F.when(F.col("team") == "team_a", best[1]).otherwise(best[0])).filter("d is not null")
    return d.select(*FT, "player_id", "px", F.col("d.id").alias("defender_id"), F.col("d.side_px").alias("side_px"), F.col("d.x").alias("defender_x"))


def beaten(tracks: DataFrame, margin: float = 60.0, lane: float = 130.0) -> DataFrame:
    """Defenders passed by an attacker in their lane and not already flagged for a gap."""
    sign = F.when(F.col("team") == "team_a", F.lit(1)).otherwise(F.lit(-1))
    d = lateral_defender(tracks).filter(
        (F.col("px") * sign > F.col("defender_x") * sign + margin) & (F.col("side_px") <= lane)
    ).select(*FRAME, opponent(F.col("team")).alias("team"), F.col("defender_id").alias("player_id")).distinct()
    enough = tracks.groupBy(*FT).agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    d = d.join(enough.select(*FT), FT, "left_semi")
    return d.join(gap_ends(tracks), [*FT, "player_id"], "left_anti")


def gap_ends(tracks: DataFrame) -> DataFrame:
    g = largest_gap(tracks).filter("flagged")
    return g.select(*FT, F.explode(F.array("left_id", "right_id")).alias("player_id"))


def flag_tally(tracks: DataFrame) -> DataFrame:
    """How often each defender was flagged, and the worst of each team."""
    f = gap_ends(tracks).unionByName(beaten(tracks)).groupBy("match_id", "team", "player_id").agg(F.count(F.lit(1)).alias("flags"))
    worst = f.groupBy("match_id", "team").agg(F.max_by("player_id", F.struct("flags", (-F.col("player_id")).alias("i"))).alias("worst_id"))
    return f.join(worst, ["match_id", "team"]).withColumn("worst", F.col("player_id") == F.col("worst_id")).drop("worst_id")


def lateral_holes(tracks: DataFrame, gap_cm: int = 450) -> DataFrame:
    """Gaps across the court between neighbours of a team of at least three."""
    g = W.partitionBy(*FT)
    w = g.orderBy("y_cm", "player_id")
    d = tracks.select(*FT, "player_id", "y_cm", F.count(F.lit(1)).over(g).alias("n"), F.lag("y_cm").over(w).alias("prev"))
    d = d.filter((F.col("n") >= 3) & (F.col("y_cm") - F.col("prev") > gap_cm))
    return d.select(*FT, (F.col("y_cm") - F.col("prev")).alias("gap_cm"), ((F.col("y_cm") + F.col("prev")) / 2.0).alias("mid_cm"))


# ---- space ------------------------------------------------------------------
def open_players(tracks: DataFrame, radius_cm: float = 300.0) -> DataFrame:
    """Players without an opponent within the radius: an anti-join that stops at the first hit."""
    a = tracks.select(*FT, "player_id", "x_cm", "y_cm").alias("a")
    b = tracks.select(*FT, "x_cm", "y_cm").withColumn("foe", opponent(F.col("team"))).alias("b")
    near = sq_dist(F.col("a.x_cm"), F.col("a.y_cm"), F.col("b.x_cm"), F.col("b.y_cm")) < radius_cm * radius_cm
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in FRAME] + [F.col("a.team") == F.col("b.foe"), near]
    return a.join(b, on, "left_anti")


def ball_lines(tracks: DataFrame, holder: DataFrame, slack_cm: int = 300, lane_cm: int = 400) -> DataFrame:
    """Per frame: attackers ahead of the ball, defenders between ball and goal, those near the central lane."""
    h = holder.select(*FRAME, F.col("team").alias("att"), "bx_cm")
    d = tracks.select(*FT, "x_cm", "y_cm").join(h, FRAME)
    right = F.col("att") == "team_a"
    x, bx = F.col("x_cm"), F.col("bx_cm")
    between = (F.col("team") != F.col("att")) & F.when(right, (x > bx) & (x < 4000)).otherwise((x > 0) & (x < bx))
    ahead = (F.col("team") == F.col("att")) & F.when(right, x > bx - slack_cm).otherwise(x < bx + slack_cm)
    return d.groupBy(*FRAME, F.col("att").alias("team"), "bx_cm").agg(
        count_if(ahead).alias("ahead"), count_if(between).alias("between"),
        count_if(between & (F.abs(F.col("y_cm") - 1000) < lane_cm)).alias("lane"))


HALF = 20  # cells of 1 m along both sides of a half
PACKED = 3  # columns of HALF bits in one long


def open_cells(players: DataFrame, by: list[str], radius: float = 3.5) -> DataFrame:
    """open_m2: 1 m cells of the team's own half (400) out of reach of the group's players in that half.

    A disc is rasterised column by column: its cells in one column are a run of bits. Three columns of 20 bits are one
    long, so the players of a group reduce map-side to seven longs joined by ``bit_or``.
    """
    reach = radius * 100
    x = F.col("x_cm") - F.when(F.col("team") == "team_a", F.lit(0)).otherwise(F.lit(HALF * 100))
    lo = F.greatest(F.ceil((x - 50 - reach) / 100), F.lit(0)).cast("int")
    hi = F.least(F.floor((x - 50 + reach) / 100), F.lit(HALF - 1)).cast("int")
    columns = F.when(in_own_half() & (lo <= hi), F.sequence(lo, hi)).otherwise(F.array(F.lit(-1)))  # -1: marks nothing
    d = players.select(*by, "y_cm", x.alias("x"), F.explode(columns).alias("k"))
    left = F.lit(reach * reach) - (F.col("x") - (F.col("k") * 100 + 50)) * (F.col("x") - (F.col("k") * 100 + 50))
    d = d.select(*by, "k", "y_cm", F.sqrt(F.greatest(left, F.lit(0.0))).alias("half"))
    d = d.select(
        *by, "k", F.greatest(F.ceil((F.col("y_cm") - 50 - F.col("half")) / 100), F.lit(0)).cast("int").alias("lo"),
        F.least(F.floor((F.col("y_cm") - 50 + F.col("half")) / 100), F.lit(HALF - 1)).cast("int").alias("hi"))
    one = F.lit(1).cast("bigint")
    run = F.call_function("shiftleft", one, F.col("hi") + 1) - F.call_function("shiftleft", one, F.col("lo"))
    run = F.when((F.col("k") >= 0) & (F.col("hi") >= F.col("lo")), run).otherwise(F.lit(0).cast("bigint"))
    d = d.select(*by, F.floor(F.col("k") / PACKED).alias("word"), F.call_function("shiftleft", run, F.pmod("k", F.lit(PACKED)) * HALF).alias("bits"))
    none = F.lit(0).cast("bigint")
    words = [F.bit_or(F.when(F.col("word") == k, F.col("bits")).otherwise(none)).alias(f"w{k}") for k in range(-(-HALF // PACKED))]
    covered = sum((F.bit_count(f"w{k}") for k in range(1, len(words))), F.bit_count("w0"))
    return d.groupBy(*by).agg(*words).select(*by, (F.lit(HALF * HALF) - covered).alias("open_m2"))


def in_own_half() -> Column:
    return F.when(F.col("team") == "team_a", F.col("x_cm") < 2000).otherwise(F.col("x_cm") > 2000)


def coverage(tracks: DataFrame) -> DataFrame:
    """Uncovered square metres of the own half per frame and team (400 when nobody is back)."""
    return open_cells(tracks, FT)


def transitions(tracks: DataFrame, changes: DataFrame, max_frames: int = 200, min_defenders: int = 3) -> tuple[DataFrame, DataFrame]:
    """(episodes, frames): after a possession change, until every defender is back, the limit, or the next change."""
    nxt = changes.select("match_id", "frame_n", opponent(F.col("team")).alias("team"))
    rev = nxt.withColumn("neg", -F.col("frame_n"))
    rev = scan(rev, ["match_id"], "neg", lag={"next_frame": F.col("frame_n")})
    ep = rev.select(
        "match_id", "team", F.col("frame_n").alias("start_frame"),
        F.least(F.col("frame_n") + max_frames, F.coalesce(F.col("next_frame") - 1, F.col("frame_n") + max_frames)).alias("limit"))
    ep = ep.withColumn("lo", F.col("start_frame") + 1)
    d = interval_join(tracks.select(*FT, "player_id", "x_cm", "y_cm"), ep, ["match_id", "team"], "frame_n", "lo", "limit", bucket=256)
    by = ["match_id", "start_frame", "limit", "team"]
    out = ~in_own_half()
    depth = F.when(F.col("team") == "team_a", F.col("x_cm")).otherwise(-F.col("x_cm"))
    fr = d.groupBy(*by, "frame_n").agg(
        F.count(F.lit(1)).alias("n"), count_if(out).alias("away"),
        F.max(F.when(out, F.struct(depth.alias("depth"), (-F.col("player_id")).alias("neg")))).alias("lag")).filter(F.col("n") >= min_defenders)
    end = fr.groupBy(*by).agg(F.min(F.when(F.col("away") == 0, F.col("frame_n"))).alias("done"))
    fr = fr.join(end, by).filter(F.col("done").isNull() | (F.col("frame_n") < F.col("done")))
    last = fr.groupBy(*by).agg(F.max_by(F.struct("frame_n", "lag"), "frame_n").alias("z"))
    back = d.join(end, by).filter(in_own_half() & (F.col("done").isNull() | (F.col("frame_n") <= F.col("done"))))
    back = back.join(fr.select(*by, "frame_n").unionByName(end.filter("done is not null").select(*by, F.col("done").alias("frame_n"))).distinct(), [*by, "frame_n"], "left_semi")
    rec = back.groupBy(*by, "player_id").agg(F.min("frame_n").alias("f")).groupBy(*by).agg(F.count(F.lit(1)).alias("recovered"), F.max("f").alias("last_recovery"))
    eps = end.join(last, by, "left").join(rec, by, "left").select(
        "match_id", "start_frame", "team", F.coalesce("done", "limit").alias("end_frame"), (-F.col("z.lag.neg")).alias("laggard_id"),
        (F.col("z.frame_n") - F.col("start_frame")).alias("laggard_frames"), F.coalesce("recovered", F.lit(0)).alias("recovered"), "last_recovery")
    live = d.join(fr.select(*by, "frame_n"), [*by, "frame_n"])
    return eps, live


def worst_open_space(live: DataFrame) -> DataFrame:
    """Largest uncovered area over the frames of each episode."""
    by = ["match_id", "start_frame", "team"]
    return open_cells(live, [*by, "frame_n"]).groupBy(*by).agg(F.max("open_m2").alias("max_open_m2"))


# ---- shot options -------------------------------------------------------------
def shot_options(
    shots: DataFrame, tracks: DataFrame, n_options: int = 3, spacing: float = 35.0, edge: float = 10.0,
    block_px: float = 38.0, penalty: float = 500.0,
) -> DataFrame:
    """Best target points on the goal line per shot (match_id, frame_n, team, sx, sy, goal_x, top, bottom).

    25 points are scored by the keeper's distance, blocked lines and a corner bonus; the picks are
    made in score order keeping ``spacing`` apart.
    """
    lo, hi = F.col("top") + edge, F.col("bottom") - edge
    s = shots.filter(hi > lo).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24))))
    s = s.withColumn("ty", lo + (hi - lo) * F.col("i") / 24.0)
    foes = tracks.select(*FRAME, opponent(F.col("team")).alias("team"), "slot", "px", "py")
    d = s.join(foes, FT, "left")
    keeper = F.col("slot").isin(0, 7)
    hit = point_segment(F.col("px"), F.col("py"), F.col("sx"), F.col("sy"), F.col("goal_x"), F.col("ty")) < block_px
    by = [*FT, "goal_x", "top", "bottom", "i", "ty"]
    d = d.groupBy(*by).agg(
        F.max(F.when(keeper, dist(F.col("goal_x"), F.col("ty"), F.col("px"), F.col("py")))).alias("keep"),
        count_if(~keeper & hit).alias("blocks"))
    bonus = F.least(F.abs(F.col("ty") - lo), F.abs(F.col("ty") - hi)) * -0.15 + (hi - lo) * 0.15
    score = F.floor((F.coalesce("keep", F.lit(0.0)) - F.col("blocks") * penalty + bonus) * 1e6 + 0.5)
    d = d.withColumn("score", score)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), (-F.col("i")).alias("j"), "ty")))  # always 25
    empty = F.array().cast("array<double>")
    pick = F.aggregate(
        "c", empty,
        lambda got, p: F.when(
            (F.size(got) < n_options) & F.forall(got, lambda y: F.abs(y - p["ty"]) > spacing), F.array_append(got, p["ty"])
        ).otherwise(got))
    d = d.groupBy(*FT, "goal_x").agg(ordered.alias("c")).withColumn("ys", pick)
    return d.select(*FT, "goal_x", F.posexplode("ys").alias("rank", "y"))


def moves(tracks: DataFrame, holder: DataFrame, window: int = 25, far: float = 40.0) -> DataFrame:
    """Every ``window`` frames: players without the ball displaced by at least ``far`` pixels within it."""
    from matchloom.plans.ordered import halo

    def build(d, keys):
        w = W.partitionBy(*keys).orderBy("frame_n").rangeBetween(-window, 0)
        return d.withColumn("p0", F.first(F.struct("frame_n", "px", "py")).over(w))

    d = halo(tracks.select(*FRAME, "player_id", "px", "py"), ["match_id", "player_id"], "frame_n", window, build)
    d = d.filter((F.col("frame_n") % window == 0) & (sq_dist(F.col("px"), F.col("py"), F.col("p0.px"), F.col("p0.py")) >= far * far))
    d = d.join(holder.select(*FRAME, "player_id"), [*FRAME, "player_id"], "left_anti")
    return d.select(*FRAME, "player_id", F.col("p0.frame_n").alias("from_frame"), "px", "py")


def cluster_flagged(points: DataFrame, radius: float = 220.0) -> DataFrame:
    """Greedy grouping per frame: each point joins the earliest seed within the radius, else becomes one."""
    pts = F.array_sort(F.collect_list(F.struct("player_id", "px", "py")))  # flagged players of one frame
    empty = F.array().cast("array<struct<player_id:bigint,px:bigint,py:bigint>>")

    def near(s, p):
        return sq_dist(s["px"], s["py"], p["px"], p["py"]) <= radius * radius

    seeds = F.aggregate("pts", empty, lambda acc, p: F.when(F.exists(acc, lambda s: near(s, p)), acc).otherwise(F.array_append(acc, p)))
    d = points.groupBy(*FRAME).agg(pts.alias("pts")).withColumn("seeds", seeds)
    d = d.select(*FRAME, "seeds", F.explode("pts").alias("p"))
    mine = F.get(F.filter("seeds", lambda s: near(s, F.col("p"))), F.lit(0))
    return d.select(*FRAME, F.col("p.player_id").alias("player_id"), mine["player_id"].alias("seed_id"))


def keeper_guess(tracks: DataFrame) -> DataFrame:
    """Keeper-labelled player nearest the own goal, else the nearest team mate to it."""
    d = tracks.withColumn("d", F.abs(F.col("x_cm") / 100.0 - own_x(F.col("team"))))
    best = F.min(F.struct(F.when(F.col("slot").isin(0, 7), 0).otherwise(1).alias("k"), "d", "player_id"))
    return d.groupBy(*FT).agg(best.alias("m")).select(*FT, F.col("m.player_id").alias("keeper_id"), (F.col("m.k") == 0).alias("labelled"))


def shooter_guess(poses: DataFrame, ball: DataFrame, reach: float = 250.0, wrist_conf: int = 30) -> DataFrame:
    """Nearest player by box centre or confident wrist, within reach of the ball."""
    p = seen_points(poses, [*FRAME, "player_id", "px", "py", "h_px"], (L_WR, R_WR), (L_WR, R_WR), wrist_conf)
    d = p.join(ball.filter("bpx is not null").select(*FRAME, "bpx", "bpy"), FRAME)
    cands = [sq_dist(F.col("px") * 1.0, F.col("py") - F.col("h_px") / 2.0, F.col("bpx"), F.col("bpy"))]
    cands += [sq_dist(F.col(f"x{i}"), F.col(f"y{i}"), F.col("bpx"), F.col("bpy")).cast("double") for i in (L_WR, R_WR)]
    d = d.withColumn("d2", F.least(*cands)).filter(F.col("d2") < reach * reach)
    return d.groupBy(*FRAME).agg(F.min(F.struct("d2", "player_id")).alias("m")).select(*FRAME, F.col("m.player_id").alias("shooter_id"), F.col("m.d2").alias("d2"))


def occluded(tracks: DataFrame, share: float = 0.30) -> DataFrame:
    """Players whose box is covered by another box by more than ``share`` of itself."""
    def box(p):
        half = F.col(f"{p}.h_px") * 0.25
        return [F.col(f"{p}.px") - half, F.col(f"{p}.py") - F.col(f"{p}.h_px"), F.col(f"{p}.px") + half, F.col(f"{p}.py") * 1.0]

    from matchloom.functions.geometry import box_overlap

    a, b = tracks.alias("a"), tracks.alias("b")
    ba, bb = box("a"), box("b")
    area = (ba[2] - ba[0]) * (ba[3] - ba[1])
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in FRAME] + [F.col("a.player_id") != F.col("b.player_id"), box_overlap(ba, bb) > area * share]
    return a.join(b, on, "left_semi").select("match_id", "frame_n", "player_id")
