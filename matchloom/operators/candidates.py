"""Ball candidates: votes, static markers, scoring, and trajectory clean-up."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from matchloom.functions.common import dist, sq_dist
from matchloom.functions.geometry import iou
from matchloom.functions.pose import L_SH, L_WR, R_SH, R_WR, seen_points
from matchloom.plans.ordered import halo, scan, segments
from matchloom.plans.ranges import interval_join
from matchloom.plans.stateful import fold_rows

FRAME = ["match_id", "frame_n"]
CAND = [*FRAME, "cand"]


def temporal_votes(cands: DataFrame, frames: int = 3, reach: float = 120.0, bonus: float = 0.18, cap: float = 0.50) -> DataFrame:
    """Bonus per earlier frame holding a neighbour; earlier candidates are carried forward to the
    frame they support, so this is an equi-join with a boolean aggregate per candidate."""
    past = cands.select("match_id", "frame_n", F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    past = past.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(frames)))).withColumn("frame_n", F.col("frame_n") + F.col("k"))
    near = sq_dist(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy")) < reach * reach
    d = cands.select(*CAND, "cx", "cy").join(past, FRAME, "left")
    seen = [F.bool_or(F.coalesce(near & (F.col("k") == k), F.lit(False))).cast("int") for k in range(1, frames + 1)]
    d = d.groupBy(*CAND).agg(sum(seen, F.lit(0)).alias("votes"))
    return d.withColumn("bonus", F.least(F.col("votes") * bonus, F.lit(cap)))


def near_player(cands: DataFrame, tracks: DataFrame, reach: float) -> DataFrame:
    """Candidates flagged when a player stands within reach."""
    d = cands.join(tracks.select(*FRAME, "px", F.col("py").alias("foot"), "h_px"), FRAME, "left")
    hit = sq_dist(F.col("cx"), F.col("cy"), F.col("px"), F.col("foot") - F.col("h_px") / 2.0) < reach * reach
    return d.groupBy(*CAND, "cx", "cy").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("near"))


def static_cells(cands: DataFrame, tracks: DataFrame, cell: int = 10, window: int = 75, share: float = 0.70, player: float = 0.45, frozen: float = 0.90, reach: float = 55.0) -> DataFrame:
    """(match, cell, frame) on which a cell counts as a painted marker: hit often enough over the
    window and either without players or practically always."""
    d = near_player(cands, tracks, reach)
    d = d.select("match_id", F.floor(F.col("cx") / cell).cast("bigint").alias("gx"), F.floor(F.col("cy") / cell).cast("bigint").alias("gy"), "frame_n", "near")

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("frame_n").rangeBetween(-window, 0)
        return x.withColumn("hits", F.count(F.lit(1)).over(w)).withColumn("with_player", F.sum(F.col("near").cast("int")).over(w))

    d = halo(d, ["match_id", "gx", "gy"], "frame_n", window, build)
    least = max(3, int(share * window))
    always = F.col("hits") >= max(least + 1, int(frozen * window))
    mark = (F.col("hits") >= least) & (always | (F.col("with_player") / F.col("hits") < player))
    return d.filter(mark).groupBy("match_id", "gx", "gy", "frame_n").agg(F.max("hits").alias("hits"))


def marker_spans(marks: DataFrame, ttl: int = 1500) -> DataFrame:
    """Frames during which a marker cell is blocked: merged runs of marks plus the time to live."""
    keys = ["match_id", "gx", "gy"]
    d = segments(marks, keys, "frame_n", ["frame_n"], lambda p, c: c("frame_n") - p("frame_n") > ttl, "span")
    return d.groupBy(*keys, "span").agg(F.min("frame_n").alias("lo"), (F.max("frame_n") + ttl).alias("hi"))


def unblocked(cands: DataFrame, spans: DataFrame, cell: int = 10) -> DataFrame:
    """Candidates outside blocked cells and their eight neighbours."""
    ring = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
    wide = spans.withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring)).select(
        "match_id", (F.col("gx") + F.col("dx")).alias("gx"), (F.col("gy") + F.col("dy")).alias("gy"), "lo", "hi").distinct()
    d = cands.withColumn("gx", F.floor(F.col("cx") / cell).cast("bigint")).withColumn("gy", F.floor(F.col("cy") / cell).cast("bigint"))
    return interval_join(d, wide, ["match_id", "gx", "gy"], "frame_n", "lo", "hi", bucket=1024, how="left_anti").drop("gx", "gy")


def off_faces(cands: DataFrame, poses: DataFrame, reach: float = 30.0, min_conf: int = 30) -> DataFrame:
    """Candidates that do not sit on a visible nose or eye."""
    p = poses.alias("p")
    c = cands.alias("c")
    hit = F.lit(False)
    for i in (0, 1, 2):
        d2 = sq_dist(F.col("c.cx"), F.col("c.cy"), F.get("p.kx", F.lit(i)), F.get("p.ky", F.lit(i)))
        hit = hit | ((F.get("p.kc", F.lit(i)) >= min_conf) & (d2 < reach * reach))
    on = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in FRAME] + [hit]
    return c.join(p, on, "left_anti")


def hand_flags(cands: DataFrame, poses: DataFrame, reach: float = 140.0, min_conf: int = 30, carry=()) -> DataFrame:
    """Per candidate: near a wrist, in a shoe band, above the nearest player's shoulders; ``carry`` names columns to keep."""
    body = seen_points(poses, [*FRAME, "player_id", "px", "py", "h_px"], (L_WR, R_WR), (L_SH, R_SH, L_WR, R_WR), min_conf)
    d = cands.select(*CAND, *dict.fromkeys(["cx", "cy", *carry])).join(body, FRAME, "left")
    half = F.col("h_px") * 0.25
    x, y = F.col("cx"), F.col("cy")
    shoe = (x > F.col("px") - half) & (x < F.col("px") + half) & (y > F.col("py") - F.col("h_px") * 0.15)
    hand = F.lit(False)
    for i in (L_WR, R_WR):
        hand = hand | (sq_dist(x, y, F.col(f"x{i}"), F.col(f"y{i}")) < reach * reach)
    tops = [F.col(f"y{i}") for i in (L_SH, R_SH)]
    away = sq_dist(x * 1.0, y, F.col("px"), F.col("py") - F.col("h_px") / 2.0)
    above = F.coalesce(y < F.least(*tops), F.lit(False))
    # (distance in millionths, player, above) as one number: a minimum of structs would sort every pair of candidate and player
    micro = F.floor(F.least(away, F.lit(9e8)) * 1e6 + 0.5).cast("decimal(16,0)")
    key = micro * F.lit(Decimal(10**20)) + (F.col("player_id") * 10 + above.cast("int")).cast("decimal(20,0)")
    none = F.lit(False)
    return d.groupBy(*CAND, *carry).agg(
        F.bool_or(F.coalesce(hand, none)).alias("in_hand"), F.bool_or(F.coalesce(shoe, none)).alias("in_shoe"), F.min(key).alias("m"),
    ).select(*CAND, "in_hand", "in_shoe", F.coalesce(F.pmod("m", F.lit(10).cast("decimal(38,0)")) == 1, none).alias("above"), *carry)


# --- fixed values: candidate score terms ---
SHOE, HAND, ABOVE, SKIN_PENALTY, COLOUR_W = -1.5, 0.90, 0.50, -0.70, 0.55
SKIN_SOFT, SKIN_HARD = 0.32, 0.58
FAR_JUMP, JUMP_SCALE = 250.0, 500.0


def pick_ball(cands: DataFrame, poses: DataFrame, last: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Best candidate per frame above the threshold.

    ``cands`` carries conf, skin and colour shares as columns; ``last`` the ball position known
    before the frame. The candidates move once: what follows the flags is grouped and joined by the frame.
    """
    d = hand_flags(cands, poses, carry=("cx", "cy", "conf", "skin", "colour")).join(last.select(*FRAME, "lx", "ly"), FRAME, "left")
    far = dist(F.col("cx"), F.col("cy"), F.col("lx"), F.col("ly"))
    zero = F.lit(0.0)
    score = (
        F.col("conf") + F.when(F.coalesce(far > FAR_JUMP, F.lit(False)), -far / JUMP_SCALE).otherwise(zero)
        + F.when(F.col("in_shoe"), F.lit(SHOE)).otherwise(zero) + F.when(F.col("in_hand"), F.lit(HAND)).otherwise(zero)
        + F.when(F.col("above"), F.lit(ABOVE)).otherwise(zero)
        + F.when((F.col("skin") >= SKIN_SOFT) & ~F.col("in_hand"), F.lit(SKIN_PENALTY)).otherwise(zero) + (F.col("colour") - 0.5) * COLOUR_W
    )
    d = d.filter(F.col("in_hand") | (F.col("skin") < SKIN_HARD)).withColumn("score", F.floor(score * 1e6 + 0.5) / 1e6).filter(F.col("score") > threshold)
    best = F.max(F.struct("score", (-F.col("cand")).alias("neg"), "cx", "cy"))
    return d.groupBy(*FRAME).agg(best.alias("m")).select(*FRAME, (-F.col("m.neg")).alias("cand"), "m.cx", "m.cy", "m.score")


def attach_keypoints(tracks: DataFrame, detections: DataFrame, cell: float = 128.0) -> DataFrame:
    """Detection with the best overlap for each track.

    Boxes are spread over the coarse screen cells they touch, so only boxes sharing a cell meet.
    """
    def cells(d, p):
        def rng(lo, hi):
            return F.sequence(F.floor(F.col(f"{p}{lo}") / cell), F.floor(F.col(f"{p}{hi}") / cell))

        return d.withColumn("_cx", F.explode(rng("x1", "x2"))).withColumn("_cy", F.explode(rng("y1", "y2")))

    d = cells(tracks, "t_").join(cells(detections, "d_"), [*FRAME, "_cx", "_cy"])
    score = iou([F.col(f"t_{c}") for c in ("x1", "y1", "x2", "y2")], [F.col(f"d_{c}") for c in ("x1", "y1", "x2", "y2")])
    d = d.withColumn("iou", F.floor(score * 1e9 + 0.5) / 1e9).filter(F.col("iou") > 0)
    return d.groupBy(*FRAME, "track_id").agg(F.max(F.struct("iou", (-F.col("det_id")).alias("neg"))).alias("m")).select(
        *FRAME, "track_id", (-F.col("m.neg")).alias("det_id"), F.col("m.iou").alias("iou"))


def still_points(ball: DataFrame, rows: int = 4, tol: float = 4.0) -> DataFrame:
    """Ball rows that close a run of ``rows`` near-still steps, counting restarting after each hit."""
    from matchloom.plans.ordered import islands

    d = scan(ball, ["match_id"], "frame_n", lag={"lx": F.col("bpx"), "ly": F.col("bpy")})
    still = F.coalesce(sq_dist(F.col("bpx"), F.col("bpy"), F.col("lx"), F.col("ly")) <= tol * tol, F.lit(False))
    d = islands(d.withColumn("still", still), ["match_id"], "frame_n", F.col("still"), "run", row_number="rn")
    first = d.groupBy("match_id", "run").agg(F.min("rn").alias("r0"))
    d = d.join(first, ["match_id", "run"])
    return d.filter(F.col("still") & (F.pmod(F.col("rn") - F.col("r0") + 1, F.lit(rows)) == 0)).select(*FRAME, "bpx", "bpy")


def kill_still(cands: DataFrame, points: DataFrame, ttl: int = 1500, reach: int = 22) -> DataFrame:
    """Candidates not within reach of a point blocked earlier; points are spread over their grid
    cells so the anti-join is an equi-join on cell and time bucket."""
    ring = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint"))
    p = points.select("match_id", F.col("bpx").alias("kx"), F.col("bpy").alias("ky"), (F.col("frame_n") + 1).alias("lo"), (F.col("frame_n") + ttl).alias("hi"))
    p = p.withColumn("dx", F.explode(ring)).withColumn("dy", F.explode(ring))
    p = p.withColumn("gx", F.floor(F.col("kx") / reach) + F.col("dx")).withColumn("gy", F.floor(F.col("ky") / reach) + F.col("dy"))
    p = p.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / 1024), F.floor(F.col("hi") / 1024)))).alias("p")
    c = cands.withColumn("gx", F.floor(F.col("cx") / reach)).withColumn("gy", F.floor(F.col("cy") / reach)).withColumn("_b", F.floor(F.col("frame_n") / 1024)).alias("c")
    on = [F.col(f"c.{k}") == F.col(f"p.{k}") for k in ("match_id", "gx", "gy", "_b")]
    on += [F.col("c.frame_n").between(F.col("p.lo"), F.col("p.hi")), sq_dist(F.col("c.cx"), F.col("c.cy"), F.col("p.kx"), F.col("p.ky")) < reach * reach]
    return c.join(p, on, "left_anti").drop("gx", "gy", "_b")


def teleport_filter(ball: DataFrame, jump: float = 230.0, confirm: float = 90.0) -> DataFrame:
    """A far jump is held back until the next sighting lands near it."""
    def start():
        return None, None  # last accepted, pending

    def step(st, row):
        if row is None:
            return st, []
        last, pending = st
        p = (row["bpx"], row["bpy"])
        ok = last is None or math.dist(p, last) <= jump or (pending is not None and math.dist(p, pending) < confirm)
        if ok:
            return (p, None), [{"frame_n": row["frame_n"], "bpx": p[0], "bpy": p[1]}]
        return (last, p), []

    return fold_rows(ball, ["match_id"], ["frame_n"], start, step, "match_id bigint, frame_n bigint, bpx bigint, bpy bigint")


# --- fixed values: constant-acceleration filter noise, gate and life times ---
PROCESS_NOISE = (1.0, 1.0, 4.0, 4.0, 16.0, 16.0)
START_VARIANCE = (10.0, 10.0, 100.0, 100.0, 200.0, 200.0)
NOISE_SURE, NOISE_UNSURE = 4.0, 60.0
GATE_SIGMA, LOCK_HITS, RESET_AFTER, COAST = 3.5, 2, 25, 10


def kalman_track(frames: DataFrame) -> DataFrame:
    """Constant-acceleration Kalman filter per match over one row per frame (cx, cy, conf or null).

    Emits real, coast (predicted, up to ten frames) or lost rows.  The recursion is sequential per
    match, so rows stream through a 6-number state in frame order.
    """
    f = np.eye(6)
    for i, (j, v) in enumerate(((2, 1.0), (3, 1.0), (4, 1.0), (5, 1.0))):
        f[i, j] = v
    f[0, 4] = f[1, 5] = 0.5
    q, eye2 = np.diag(PROCESS_NOISE), np.eye(2)

    def start():
        return {"x": None, "p": None, "hits": 0, "missed": 0}

    def step(s, row):
        if row is None:
            return s, []
        if s["x"] is not None:
            s = {**s, "x": f @ s["x"], "p": f @ s["p"] @ f.T + q, "missed": s["missed"] + 1}
            if s["missed"] > RESET_AFTER:
                s = start()
        seen = row["cx"] is not None and not math.isnan(row["cx"])
        out = {"frame_n": row["frame_n"], "state": "lost", "x": None, "y": None}
        if seen:
            z = np.array([row["cx"], row["cy"]])
            if s["x"] is None:
                x0 = np.concatenate([z, np.zeros(4)])
                s = {"x": x0, "p": np.diag(START_VARIANCE), "hits": 1, "missed": 0}
                return s, [{**out, "state": "real", "x": float(z[0]), "y": float(z[1])}]
            gap = z - s["x"][:2]
            cov = s["p"][:2, :2]
            if s["hits"] < LOCK_HITS or math.sqrt(max(0.0, gap @ np.linalg.solve(cov + eye2 * NOISE_SURE, gap))) <= GATE_SIGMA:
                sure = min(1.0, max(0.05, row["conf"]))
                noise = NOISE_SURE + (NOISE_UNSURE - NOISE_SURE) * (1.0 - sure)
                gain = s["p"][:, :2] @ np.linalg.inv(cov + eye2 * noise)
                s = {"x": s["x"] + gain @ gap, "p": s["p"] - gain @ s["p"][:2, :], "hits": s["hits"] + 1, "missed": 0}
                return s, [{**out, "state": "real", "x": float(s["x"][0]), "y": float(s["x"][1])}]
        if s["x"] is not None and s["missed"] <= COAST:
            return s, [{**out, "state": "coast", "x": float(s["x"][0]), "y": float(s["x"][1])}]
        return s, [out]

    return fold_rows(frames, ["match_id"], ["frame_n"], start, step, "match_id bigint, frame_n bigint, state string, x double, y double")


def smooth_boxes(rows: DataFrame, keys: list[str], cols: list[str], alpha: float = 0.35, max_gap: int = 75) -> DataFrame:
    """Exponential smoothing of boxes, restarted after ``max_gap`` frames without one.

    Old rows weigh less than double precision after ``n`` rows, so each row blends its last n.
    """
    n = int(math.ceil(math.log(1e-17) / math.log(1 - alpha)))
    d = segments(rows, keys, "frame_n", ["frame_n"], lambda p, c: c("frame_n") - p("frame_n") > max_gap, "part", row_number="rn")

    def build(x, k):
        w = W.partitionBy(*k, "part").orderBy("rn").rowsBetween(-(n - 1), 0)
        for c in cols:
            seq = F.collect_list(F.col(c).cast("double")).over(w)
            x = x.withColumn(f"s_{c}", F.aggregate(F.slice(seq, 2, n), F.get(seq, F.lit(0)), lambda a, v: a * (1 - alpha) + v * alpha))
        return x

    return halo(d, keys, "rn", n, build)


def filter_path(points: DataFrame, far: float = 120.0) -> DataFrame:
    """Drop unreal points that jump or turn back, then average three neighbours (ends kept).

    Keyed by event_id: an event's window holds a few seconds of frames.
    """
    def start():
        return []

    def step(kept, row):
        if row is None:
            return kept, []
        p, real = (float(row["bpx"]), float(row["bpy"])), row["state"] == "real"
        if kept and not real:
            if math.dist(p, kept[-1]) > far:
                return kept, []
            if len(kept) >= 2:
                (ax, ay), (bx, by) = kept
                if (bx - ax) * (p[0] - bx) + (by - ay) * (p[1] - by) < -2.0:
                    return kept, []
        return (kept + [p])[-2:], [{"frame_n": row["frame_n"], "bpx": p[0], "bpy": p[1]}]

    kept = fold_rows(points, ["event_id"], ["frame_n"], start, step, "event_id bigint, frame_n bigint, bpx double, bpy double")
    w = W.partitionBy("event_id").orderBy("frame_n")
    out = kept
    for c in ("bpx", "bpy"):
        mid = (F.lag(c).over(w) + F.col(c) + F.lead(c).over(w)) / 3.0
        out = out.withColumn(f"s{c}", F.coalesce(mid, F.col(c)))
    return out.select("event_id", "frame_n", F.col("sbpx").alias("bpx"), F.col("sbpy").alias("bpy"))


def shot_frames(windows: DataFrame) -> DataFrame:
    """Frame before the fastest ball step ahead of each goal (at least four frames needed)."""
    pre = windows.filter(F.col("frame_n") <= F.col("goal_frame"))
    w = W.partitionBy("event_id").orderBy("frame_n")
    speed = dist(F.col("bpx"), F.col("bpy"), F.lag("bpx").over(w), F.lag("bpy").over(w)) / (F.col("frame_n") - F.lag("frame_n").over(w))
    d = pre.withColumn("v", speed).withColumn("prev", F.lag("frame_n").over(w))
    best = F.max_by("prev", F.when(F.col("v").isNotNull(), F.struct("v", -F.col("frame_n"))))
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), best.alias("shot_frame")).filter((F.col("n") >= 4) & F.col("shot_frame").isNotNull()).drop("n")


def run_ups(goals: DataFrame, tracks: DataFrame, frames: int = 25) -> DataFrame:
    """The shooter's path over the last frames before each goal, oldest first."""
    g = goals.select("match_id", "event_id", F.col("shooter_id").alias("player_id"), F.col("frame_n").alias("hi"), (F.col("frame_n") - frames + 1).alias("lo"))
    d = interval_join(tracks.select(*FRAME, "player_id", "px", "py"), g, ["match_id", "player_id"], "frame_n", "lo", "hi", bucket=64)
    path = F.transform(F.array_sort(F.collect_list(F.struct("frame_n", "px", "py"))), lambda s: F.concat_ws(":", s["px"].cast("string"), s["py"].cast("string")))
    return d.groupBy("event_id").agg(path.alias("path"))

