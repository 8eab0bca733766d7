"""Player motion: steps and speeds, sprints, stamina, heat, roles, reports.

Look-backs bounded in time use block halos, unbounded ones use the two-level
scan, so neither a long match nor a hot player lands in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom import params as P
from matchloom.functions import zones as Z
from matchloom.functions.common import codes, count_if, dist, metres, pct, r4
from matchloom.functions.scoring import norm_compare
from matchloom.operators.calibrate import against_norms
from matchloom.plans import clamps
from matchloom.plans.folds import debounce
from matchloom.plans.ordered import BLOCK, halo, number_rows, scan
from matchloom.session import cut_lineage

KEYS = ["match_id", "player_id"]


def _step_cols(d: DataFrame, keys: list[str], max_gap: int, fps: float, max_speed: float) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("frame_n")
    gap = F.col("frame_n") - F.lag("frame_n").over(w)
    step = dist(metres(F.col("x_cm")), metres(F.col("y_cm")), metres(F.lag("x_cm").over(w)), metres(F.lag("y_cm").over(w)))
    d = d.withColumn("_gap", gap).withColumn("_step", step)
    speed = F.col("_step") * fps / F.col("_gap")
    ok = (F.col("_gap") > 0) & (F.col("_gap") <= max_gap) & (speed <= max_speed)
    return d.withColumn("speed", F.when(ok, speed).otherwise(F.lit(0.0))).withColumn(
        "step_m", F.when(ok, F.col("_step")).otherwise(F.lit(0.0))
    ).drop("_gap", "_step")


def steps(tracks: DataFrame, max_gap: int = 12, fps: float = P.FPS, max_speed: float = P.MAX_SPEED_MS, block: int = BLOCK) -> DataFrame:
    """Add speed (m/s) and step_m; 0 over gaps above ``max_gap`` frames and for impossible speeds."""
    return halo(tracks, KEYS, "frame_n", max_gap + 1, lambda d, k: _step_cols(d, k, max_gap, fps, max_speed), block=block)


def avg_speed(tracks: DataFrame, rows: int = 90) -> DataFrame:
    """Mean of the positive speeds among the last ``rows`` samples."""
    numbered = number_rows(tracks.select(*KEYS, "frame_n", "x_cm", "y_cm"), KEYS, "frame_n")

    def build(d, keys):
        d = _step_cols(d, keys, 12, P.FPS, P.MAX_SPEED_MS)
        w = W.partitionBy(*keys).orderBy("rn").rowsBetween(-(rows - 1), 0)
        return d.withColumn("avg_speed", F.avg(F.when(F.col("speed") > 0, F.col("speed"))).over(w))

    return halo(numbered, KEYS, "rn", rows, build)


def sprints(tracks: DataFrame, min_speed: float = P.SPRINT_MS, min_s: float = P.SPRINT_MIN_S, fps: float = P.FPS) -> DataFrame:
    """Closed runs of fast rows: start, duration to the first slow row, distance after the first row, peak."""
    gap = 24

    def build(d, keys):
        d = _step_cols(d, keys, gap, fps, P.MAX_SPEED_MS).withColumn("fast", F.col("speed") >= min_speed)
        w = W.partitionBy(*keys).orderBy("frame_n")
        before = F.coalesce(F.lag("fast").over(w), F.lit(False))
        return d.withColumn("_start", (F.col("fast") & ~before).cast("bigint"))

    d = halo(tracks.select(*KEYS, "frame_n", "x_cm", "y_cm"), KEYS, "frame_n", 2 * gap + 1, build)
    d = scan(d, KEYS, "frame_n", sums={"run": F.col("_start")})
    g = d.filter(F.col("run") > 0).groupBy(*KEYS, "run").agg(
        F.min(F.when(F.col("fast"), F.col("frame_n"))).alias("start_frame"),
        F.min(F.when(~F.col("fast"), F.col("frame_n"))).alias("end_frame"),
        F.sum(F.when(F.col("fast") & (F.col("_start") == 0), F.col("step_m")).otherwise(F.lit(0.0))).alias("distance_m"),
        F.max(F.when(F.col("fast"), F.col("speed"))).alias("peak"),
    )
    dur = (F.col("end_frame") - F.col("start_frame")) / F.lit(fps)
    return g.withColumn("duration_s", dur).filter(F.col("duration_s") >= min_s).select(
        *KEYS, "start_frame", "duration_s", "distance_m", "peak"
    )


def speed_decline(sprint_rows: DataFrame, factor: float = 0.80) -> DataFrame:
    """Peak of the last five sprints against the first three, flagged below ``factor`` of it."""
    n = number_rows(sprint_rows, KEYS, "start_frame")
    tot = n.groupBy(*KEYS).agg(F.max("rn").alias("n"))
    d = n.join(tot, KEYS)
    g = d.groupBy(*KEYS).agg(
        F.max("n").alias("n"),
        F.max(F.when(F.col("rn") > F.col("n") - 5, F.col("peak"))).alias("late"),
        F.max(F.when(F.col("rn") <= 3, F.col("peak"))).alias("early"),
    )
    return g.filter(F.col("n") >= 3).withColumn("declined", F.col("late") < F.col("early") * factor)


# ---- stamina: a clamped running sum ---------------------------------------
SCALE = 10_000  # integer ten-thousandths keep the fold exact


def stamina_delta(speed: Column, fps: float) -> Column:
    """Energy change of one row, in 1/10000 points."""
    def unit(v):
        return F.lit(int(round(v * SCALE / fps))).cast("bigint")

    return (
        F.when(speed >= P.SPRINT_MS, unit(-0.80)).when(speed >= P.RUN_MS, unit(-0.10))
        .when(speed >= P.WALK_MS, unit(-0.01)).otherwise(unit(0.25))
    )


def stamina(tracks: DataFrame, fps: float = P.FPS, lo: int = 10 * SCALE, hi: int = 100 * SCALE, block: int = clamps.BLOCK) -> DataFrame:
    """Stamina after every row, a running sum held in [lo, hi]; speeds and block maps come from one shuffle."""
    back = 25
    block = block if block > back else 2 * back

    def build(d, keys):
        d = _step_cols(d, keys, back - 1, fps, P.MAX_SPEED_MS).filter(~F.col("_halo"))
        return clamps.block_maps(d, keys, "frame_n", stamina_delta(F.col("speed"), fps), lo, hi, block)

    maps = halo(tracks.select(*KEYS, "frame_n", "x_cm", "y_cm"), KEYS, "frame_n", back, build, block=block)
    maps = cut_lineage(maps.select(*KEYS, "frame_n", *clamps.MAP, "_end"))  # read twice below
    return clamps.replay(maps, KEYS, "frame_n", lo, hi, hi, "stamina", block)


def rest_windows(tracks: DataFrame, rest_s: float = 30.0, fps: float = P.FPS) -> DataFrame:
    """Rest windows per player: within a stretch without running, standing rows more than
    ``rest_s`` after its start (or the last counted row) count once."""
    d = steps(tracks, max_gap=24, fps=fps).select(
        *KEYS, "frame_n", (F.col("speed") >= P.RUN_MS).cast("bigint").alias("run"), (F.col("speed") < P.WALK_MS).alias("still")
    )
    d = scan(d, KEYS, "frame_n", sums={"seg": F.col("run")}).filter(F.col("run") == 0)
    first = d.groupBy(*KEYS, "seg").agg(F.min("frame_n").alias("frame_n"))
    marks = d.filter("still").select(*KEYS, "seg", "frame_n").unionByName(first)
    kept = debounce(marks, [*KEYS, "seg"], "frame_n", int(rest_s * fps) + 1)
    per = kept.groupBy(*KEYS, "seg").agg((F.count(F.lit(1)) - 1).alias("n"))
    return per.groupBy(*KEYS).agg(F.sum("n").alias("rest_windows"))


def sample_every(rows: DataFrame, seconds: float, fps: float = P.FPS) -> DataFrame:
    """Rows at least ``seconds`` after the previous sampled one (the clock starts at frame 0)."""
    gap = int(seconds * fps)
    start = rows.select(*KEYS).distinct().withColumn("frame_n", F.lit(0).cast("bigint"))
    kept = debounce(rows.select(*KEYS, "frame_n").unionByName(start), KEYS, "frame_n", gap).filter(F.col("frame_n") > 0)
    return rows.join(kept, [*KEYS, "frame_n"], "left_semi")


# ---- aggregates -----------------------------------------------------------
def motion_summary(tracks: DataFrame, *extra: str) -> DataFrame:
    return steps(tracks).groupBy(*KEYS, *extra).agg(
        F.sum("step_m").alias("distance_m"), F.max("speed").alias("top_speed"),
        count_if(F.col("speed") > P.SPRINT_MS).alias("sprint_frames"), F.count(F.lit(1)).alias("frames"),
        F.avg(F.when(F.col("speed") > 0, F.col("speed"))).alias("avg_speed"),
    )


def band_hits(tracks: DataFrame) -> DataFrame:
    flags = Z.band_flags(metres(F.col("x_cm")), metres(F.col("y_cm")))
    return tracks.groupBy(*KEYS).agg(*[count_if(f).alias(n) for n, f in flags.items()])


def zone_share(tracks: DataFrame) -> DataFrame:
    """One row per player and band with its share of all band hits."""
    h = band_hits(tracks)
    names = list(P.COURT_BANDS)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    pairs = F.array(*[F.struct(F.lit(n).alias("zone"), F.col(n).alias("hits")) for n in names])
    return h.select(*KEYS, total.alias("total"), F.explode(pairs).alias("z")).select(
        *KEYS, "z.zone", "z.hits", pct(F.col("z.hits"), F.col("total")).alias("share_pct")
    )


def dominant_zone(tracks: DataFrame) -> DataFrame:
    best = F.max_by("zone", F.struct("hits", F.col("zone")))
    return zone_share(tracks).groupBy(*KEYS).agg(best.alias("zone"), F.max("share_pct").alias("share_pct"))


def roles(tracks: DataFrame, min_hits: int = 50) -> DataFrame:
    """Role from zone shares at the last row of a player; null until enough hits."""
    h = band_hits(tracks)
    last = tracks.groupBy(*KEYS).agg(F.max_by(metres(F.col("y_cm")), "frame_n").alias("y"))
    m = motion_summary(tracks).select(*KEYS, "distance_m")
    names = list(P.COURT_BANDS)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    d = h.join(last, KEYS).join(m, KEYS).withColumn("total", total)
    sh = {n: F.col(n) / F.col("total") for n in names}
    y = F.col("y")

    def side(lo, hi, low, high, mid):
        return F.when(y < lo, low).when(y > hi, high).otherwise(mid)

    role = (
        F.when((sh["own_goal_area"] > 0.40) | ((sh["own_half"] > 0.85) & (F.col("distance_m") < 1500)), F.lit("GK"))
        .when(sh["opp_6m"] > 0.25, side(5.0, 15.0, "RW", "LW", "PV"))
        .when((sh["opp_9m"] > 0.20) | (sh["centre"] > 0.30), side(7.5, 12.5, "RB", "LB", "CB"))
        .otherwise(F.lit("CB"))
    )
    return d.select(*KEYS, F.when(F.col("total") >= min_hits, role).alias("role"))


def heat_cells(tracks: DataFrame, *by: str) -> DataFrame:
    """80 x 40 occupancy counts (half-metre cells)."""
    def cell(c, n):
        return F.least(F.greatest(F.floor(F.col(c) / 50), F.lit(0)), F.lit(n - 1)).cast("bigint")

    return tracks.groupBy(*by, cell("x_cm", 80).alias("cell_x"), cell("y_cm", 40).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n")
    )


def heat_thirds(cells: DataFrame, *by: str, width: int = 80) -> DataFrame:
    a, b = width // 3, 2 * width // 3
    x, n = F.col("cell_x"), F.col("n")
    tot = F.sum("n")

    def share(cond):
        return F.floor(F.sum(F.when(cond, n).otherwise(F.lit(0))) * 1000.0 / tot + 0.5) / 1000.0

    return cells.groupBy(*by).agg(share(x < a).alias("left"), share((x >= a) & (x < b)).alias("center"), share(x >= b).alias("right"))


def heat_normalised(cells: DataFrame, *by: str) -> DataFrame:
    """Counts scaled by the key's maximum to 0..255."""
    top = cells.groupBy(*by).agg(F.max("n").alias("top"))
    return cells.join(top, list(by)).withColumn("level", F.floor(F.col("n") * 255.0 / F.col("top")).cast("bigint")).drop("top")


def heat_decay(tracks: DataFrame, decay: float = 0.995, cell_px: int = 16) -> DataFrame:
    """Pixel cells whose hits fade by ``decay`` per frame up to the last frame of the match.

    Hits are counted per cell and frame before they are weighted.
    """
    end = tracks.groupBy("match_id").agg(F.max("frame_n").alias("_end"))
    hits = tracks.groupBy(
        "match_id", "frame_n", F.floor(F.col("px") / cell_px).cast("bigint").alias("cell_x"),
        F.floor(F.col("py") / cell_px).cast("bigint").alias("cell_y"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    w = F.col("_n") * F.pow(F.lit(decay), F.col("_end") - F.col("frame_n"))
    return hits.join(end, "match_id").groupBy("match_id", "cell_x", "cell_y").agg(F.sum(w).alias("heat"))


def team_rollup(players: DataFrame) -> DataFrame:
    """Team totals over per-player rows (distance, speed, fatigue, injury frame, skills map)."""
    fat = F.col("fatigue")
    base = players.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("players_seen"), F.sum("distance_m").alias("distance_m"), F.max("top_speed").alias("top_speed"),
        F.avg(F.when(fat > 0, fat)).alias("fatigue_avg"), count_if(fat > 0.5).alias("fatigue_high"),
        count_if(F.col("injury_frame") >= 0).alias("injury_alerts"),
    )
    return base.withColumn("fatigue_avg", F.coalesce("fatigue_avg", F.lit(0.0)))


# ---- velocities -----------------------------------------------------------
def mean_velocity(tracks: DataFrame, rows: int = 5) -> DataFrame:
    """Mean step over the last ``rows`` positions (pixels per row)."""
    d = number_rows(tracks, KEYS, "frame_n")

    def build(x, keys):
        w = W.partitionBy(*keys).orderBy("rn").rowsBetween(-(rows - 1), 0)
        n = F.count(F.lit(1)).over(w) - 1
        for c in ("px", "py"):
            x = x.withColumn(f"v{c}", F.when(n > 0, (F.col(c) - F.first(c).over(w)) / n).otherwise(F.lit(0.0)))
        return x

    return halo(d, KEYS, "rn", rows - 1, build)


def weighted_velocity(tracks: DataFrame, history: int = 12, keep: float = 0.60) -> DataFrame:
    """Weighted least-squares velocity over the last ``history`` points (weights e^-2 .. 1),
    smoothed exponentially.  The smoothing forgets below double precision after ``back`` rows, so a
    bounded look-back gives the same numbers as the endless recursion.  Lags and plain sums only: lists
    and lambdas per row are interpreted."""
    back = int(math.ceil(math.log(1e-17) / math.log(keep)))
    d = number_rows(tracks.select(*KEYS, "frame_n", "px", "py"), KEYS, "frame_n")

    def build(x, keys):
        w, base = W.partitionBy(*keys).orderBy("rn"), x.columns
        older = list(range(history - 1, -1, -1))
        x = x.withColumn("_n", F.least(F.row_number().over(w), F.lit(history)))
        x = x.select("*", *[F.lag(F.struct("frame_n", "px", "py"), j).over(w).alias(f"_p{j}") for j in older if j], F.struct("frame_n", "px", "py").alias("_p0"))
        weight = [F.exp(F.lit(-2.0) + (F.col("_n") - 1 - j) * 2.0 / F.greatest(F.col("_n") - 1, F.lit(1))) for j in range(history)]
        x = x.select("*", *[F.when(F.col("_n") > j, weight[j]).otherwise(F.lit(0.0)).alias(f"_w{j}") for j in older])

        def wsum(fn):
            total = F.lit(0.0)
            for j in older:
                total = total + F.coalesce(F.col(f"_w{j}") * fn(f"_p{j}"), F.lit(0.0))
            return total

        def centred(p, c, mean):
            return F.col(f"{p}.{c}") - F.col(mean)

        x = x.withColumn("_sw", wsum(lambda p: F.lit(1.0)))
        x = x.select("*", *[(wsum(lambda p, c=c: F.col(f"{p}.{c}")) / F.col("_sw")).alias(m) for c, m in (("frame_n", "_tb"), ("px", "_mpx"), ("py", "_mpy"))])
        x = x.withColumn("_den", F.nullif(wsum(lambda p: centred(p, "frame_n", "_tb") * centred(p, "frame_n", "_tb")), F.lit(0.0)))
        nums = {c: wsum(lambda p, c=c: centred(p, "frame_n", "_tb") * centred(p, c, f"_m{c}")) for c in ("px", "py")}
        x = x.select(*base, *[F.when(F.col("_n") >= 2, n / F.col("_den")).alias(f"raw_v{c}") for c, n in nums.items()])
        # sums over 1, 2, 4, ... rows: twice the rows are a sum and the one before it, faded
        x = x.select("*", *[(F.coalesce(f"raw_v{c}", F.lit(0.0)) * (1.0 - keep)).alias(f"v{c}") for c in ("px", "py")])
        rows = 1
        while rows < back:
            x = x.select(*base, "raw_vpx", "raw_vpy", *[(F.col(f"v{c}") + F.coalesce(F.lag(f"v{c}", rows).over(w), F.lit(0.0)) * keep**rows).alias(f"v{c}") for c in ("px", "py")])
            rows *= 2
        return x

    return halo(d, KEYS, "rn", back + history, build)


def predict(x: Column, v: Column, gap: Column, linear: int = 6, decay: float = 0.92) -> Column:
    """Position ``gap`` frames ahead: constant velocity, then a geometric slow-down."""
    n = F.greatest(gap - linear, F.lit(0))
    slide = decay * (1.0 - F.pow(F.lit(decay), n)) / (1.0 - decay)
    return x + v * F.least(gap, F.lit(linear)) + v * slide


def fill_gaps(tracks: DataFrame, max_gap: int = 12, cap: float = 35.0) -> DataFrame:
    """Rows for skipped frames, moved on along the last step; steps above ``cap`` px per frame freeze."""
    back = max_gap + 1

    def build(d, keys):
        w = W.partitionBy(*keys).orderBy("frame_n")
        return (
            d.withColumn("_nf", F.lead("frame_n").over(w)).withColumn("_pf", F.lag("frame_n").over(w))
            .withColumn("_vx", (F.col("px") - F.lag("px").over(w)) / (F.col("frame_n") - F.col("_pf")))
            .withColumn("_vy", (F.col("py") - F.lag("py").over(w)) / (F.col("frame_n") - F.col("_pf")))
        )

    d = halo(tracks.select(*KEYS, "frame_n", "px", "py"), KEYS, "frame_n", 25, build, ahead=back)
    calm = F.col("_pf").isNotNull() & (F.col("frame_n") - F.col("_pf") <= 25) & (F.abs("_vx") <= cap) & (F.abs("_vy") <= cap)
    skipped = F.col("_nf").isNotNull() & (F.col("_nf") - F.col("frame_n")).between(2, max_gap)
    k = F.col("k")
    g = d.filter(skipped).withColumn("ok", calm).withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_nf") - F.col("frame_n") - 1)))
    return g.select(
        *KEYS, (F.col("frame_n") + k).alias("frame_n"),
        F.when(F.col("ok"), F.col("px") + F.col("_vx") * k).otherwise(F.col("px").cast("double")).alias("px"),
        F.when(F.col("ok"), F.col("py") + F.col("_vy") * k).otherwise(F.col("py").cast("double")).alias("py"),
    )


# ---- rule report ----------------------------------------------------------
def player_report(rows: DataFrame, min_frames: int = 75) -> DataFrame:
    """Strength, improvement, alert and note codes of a player.

    Needs role, dist_km, sprints, top_ms, shots, goals, saves, assists, breaks, stamina,
    frames, declined; distance and sprints are scaled to an hour after five minutes.
    """
    minutes = F.col("frames") / F.lit(P.FPS * 60.0)
    scale = F.when(minutes > 5, 60.0 / F.greatest(minutes, F.lit(1.0))).otherwise(F.lit(1.0))
    d = rows.filter(F.col("frames") >= min_frames).withColumn("_d60", F.col("dist_km") * scale).withColumn("_s60", F.col("sprints") * scale)
    d = against_norms(d.withColumnRenamed("sprints", "n_sprints"), "_d60", "_s60")

    def edge(i):
        m = F.create_map(*[F.lit(v) for r, n in P.ROLE_NORMS.items() for v in (r, float(n[2][i]))])
        return F.coalesce(m[F.col("role")], F.lit(float(P.DEFAULT_NORM[2][i])))

    speed = norm_compare(F.col("top_ms"), edge(0), edge(1))
    rate = F.when(F.col("shots") > 0, F.col("goals") / F.col("shots")).otherwise(F.lit(0.0))
    gk, runner = F.col("role") == "GK", ~F.col("role").isin("GK", "PV")
    st, shots = F.col("stamina"), F.col("shots")
    low_d, low_s = F.col("distance") == "below", F.col("sprints") == "below"
    return d.select(
        *KEYS,
        codes(
            ("work_rate", F.col("distance") == "above"), ("speed", speed == "above"), ("sprint_volume", F.col("sprints") == "above"),
            ("conversion", (rate >= 0.35) & (shots >= 3)), ("keeping", F.col("saves") >= 5), ("playmaking", F.col("assists") >= 2),
            ("counter_attack", F.col("breaks") >= 3), ("stamina", st >= 75),
        ).alias("strengths"),
        codes(
            ("movement", low_d & ~gk), ("acceleration", speed == "below"), ("finishing", (shots > 2) & (rate < 0.20)),
            ("sprint_frequency", low_s & runner),
        ).alias("improvements"),
        codes(
            ("stamina_critical", st < 25), ("stamina_warning", (st >= 25) & (st < 45)), ("speed_decline", F.col("declined")),
            ("low_top_speed", (F.col("dist_km") > 0) & (F.col("top_ms") < 4.0) & ~gk),
        ).alias("alerts"),
        codes(
            ("increase_movement", low_d & ~gk), ("explosive_runs", low_s & runner), ("shot_selection", (shots > 3) & (rate < 0.20) & ~gk),
            ("rest", st < 40), ("sprint_training", (F.col("top_ms") < edge(0)) & runner),
            ("keeper_untested", gk & (F.col("saves") == 0) & (shots == 0)),
        ).alias("notes"),
    )


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, r4(F.col(c)))
    return df
