"""Calibrated positions, custom zones and period-aware dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom import params as P
from matchloom.functions import geometry as G, zones as Z
from matchloom.functions.common import r4, switch

H = ["h11", "h12", "h13", "h21", "h22", "h23", "h31", "h32", "h33"]


def to_metres(tracks: DataFrame, calibration: DataFrame, fallback: bool, x: str = "px", y: str = "py") -> DataFrame:
    """Add x_m, y_m.  The calibration joins on match_id; with ``fallback`` frame scaling fills the rest."""
    d = tracks.join(calibration, "match_id", "left" if fallback else "inner")
    xm, ym = G.project(F.col(x), F.col(y), [F.col(h) for h in H])
    if fallback:
        sx, sy = G.scaled(F.col(x), F.col(y))
        xm, ym = F.coalesce(xm, sx), F.coalesce(ym, sy)
    return d.withColumn("x_m", xm).withColumn("y_m", ym).drop(*H)


def to_pixels(rows: DataFrame, calibration: DataFrame) -> DataFrame:
    """Inverse projection of x_m, y_m, truncated towards zero."""
    d = rows.join(calibration, "match_id")
    x, y = G.project(F.col("x_m"), F.col("y_m"), G.invert([F.col(h) for h in H]))
    nudge = F.lit(1e-7)
    return d.withColumn("px", (x + nudge).cast("bigint")).withColumn("py", (y + nudge).cast("bigint")).drop(*H)


def court_position(rows: DataFrame, board_w: int = 800, board_h: int = 400) -> DataFrame:
    """Zone of the exact position, metres rounded to two digits, clipped board cell."""
    x, y = F.col("x_m"), F.col("y_m")

    def cell(v: Column, size: int, court: float) -> Column:
        return F.least(F.greatest(v * F.lit(size / court), F.lit(0.0)), F.lit(size - 1.0)).cast("bigint")

    return rows.select(
        *[c for c in rows.columns if c not in ("x_m", "y_m")],
        Z.zone10(x, y).alias("zone"), cell(x, board_w, P.COURT_W).alias("board_x"), cell(y, board_h, P.COURT_H).alias("board_y"),
        (F.floor(x * 100.0 + 0.5) / 100.0).alias("x_m"), (F.floor(y * 100.0 + 0.5) / 100.0).alias("y_m"),
    )


def in_rectangles(points: DataFrame, rects: DataFrame, x: str, y: str, cell: int = 500) -> DataFrame:
    """Range join through grid cells: rectangles are spread over the cells they touch,
    points have exactly one cell, so the join is an equi-join however many rectangles exist."""
    def cells(lo, hi):
        return F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))

    spread = rects.withColumn("_cx", F.explode(cells("x1", "x2"))).withColumn("_cy", F.explode(cells("y1", "y2")))
    keyed = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    inside = F.col(x).between(F.col("x1"), F.col("x2")) & F.col(y).between(F.col("y1"), F.col("y2"))
    return keyed.join(spread, ["_cx", "_cy"]).filter(inside).drop("_cx", "_cy", "x1", "x2", "y1", "y2")


def unit_frame(x: Column, y: Column, w: float = P.FRAME_W, h: float = P.FRAME_H) -> tuple[Column, Column]:
    def clamp(v):
        return r4(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))

    return clamp(x / w), clamp(y / h)


def with_period(events: DataFrame) -> DataFrame:
    """Period 1 up to and including the first period end of the match, 2 after it."""
    end = events.filter(F.col("event_type") == "period_end").groupBy("match_id").agg(F.min("seq").alias("_end"))
    d = events.join(end, "match_id", "left")
    return d.withColumn("period", F.when(F.col("seq") > F.col("_end"), F.lit(2)).otherwise(F.lit(1))).drop("_end")


def opponent(team: Column) -> Column:
    return F.when(team == "team_a", F.lit("team_b")).otherwise(F.lit("team_a"))


def torso_box(box: list[Column], min_conf: int = 40) -> list[Column]:
    """Torso rectangle from shoulder and hip points (3 of 4 needed), else box fractions."""
    def visible(axis):
        return F.array_compact(
            F.array(*[F.when(F.get("kc", F.lit(i)) > min_conf, F.get(axis, F.lit(i))) for i in (5, 6, 11, 12)])
        )

    xs, ys = visible("kx"), visible("ky")
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    ok = F.size(xs) >= 3
    mx, my = ((x2 - x1) * 0.1).cast("bigint"), ((y2 - y1) * 0.1).cast("bigint")
    bw, bh = box[2] - box[0], box[3] - box[1]
    return [
        F.when(ok, x1 + mx).otherwise((box[0] + bw * 0.3).cast("bigint")).alias("tx1"),
        F.when(ok, x2 - mx).otherwise((box[2] - bw * 0.3).cast("bigint")).alias("tx2"),
        F.when(ok, F.greatest(F.lit(0).cast("bigint"), y1 - my)).otherwise((box[1] + bh * 0.18).cast("bigint")).alias("ty1"),
        F.when(ok, y2).otherwise((box[1] + bh * 0.5).cast("bigint")).alias("ty2"),
    ]


def against_norms(rows: DataFrame, km: str, sprints: str) -> DataFrame:
    """Compare distance and sprint count with the norms of the row's role."""
    from matchloom.functions.scoring import norm_compare

    def bound(part, side):
        return switch(
            [(F.col("role") == r, F.lit(float(n[part][side]))) for r, n in P.ROLE_NORMS.items()],
            F.lit(float(P.DEFAULT_NORM[part][side])),
        )

    return rows.withColumn("distance", norm_compare(F.col(km), bound(0, 0), bound(0, 1))).withColumn(
        "sprints", norm_compare(F.col(sprints), bound(1, 0), bound(1, 1))
    )
