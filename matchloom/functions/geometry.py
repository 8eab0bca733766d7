"""Plane geometry as column expressions (boxes, homography, angles, segments)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchloom import params as P
from matchloom.functions.common import dist

EPS = 1e-9


def box_centre(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2.0, (y1 + y2) / 2.0


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two (x1, y1, x2, y2) boxes; 0 when the union is empty."""
    inter = box_overlap(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def box_overlap(a: list[Column], b: list[Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def project(x: Column, y: Column, h: list[Column]) -> tuple[Column, Column]:
    """Apply a row-major 3x3 homography; null where the scale vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) > EPS
    return (
        F.when(ok, (h[0] * x + h[1] * y + h[2]) / w),
        F.when(ok, (h[3] * x + h[4] * y + h[5]) / w),
    )


def invert(h: list[Column]) -> list[Column]:
    """Adjugate of a 3x3 matrix: the inverse up to scale, enough for a homography."""
    a, b, c, d, e, f, g, k, i = h
    return [
        e * i - f * k, c * k - b * i, b * f - c * e,
        f * g - d * i, a * i - c * g, c * d - a * f,
        d * k - e * g, b * g - a * k, a * e - b * d,
    ]


def scaled(x: Column, y: Column, w: float = P.FRAME_W, h: float = P.FRAME_H) -> tuple[Column, Column]:
    """Pixels to metres by frame size alone, for footage without a calibration."""
    return x * P.COURT_W / w, y * P.COURT_H / h


def angle_at(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Degrees at b of a-b-c; null when an arm has no length or a point is missing."""
    n = dist(ax, ay, bx, by) * dist(cx, cy, bx, by)
    cos = ((ax - bx) * (cx - bx) + (ay - by) * (cy - by)) / n
    return F.when(n > EPS, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def line_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.degrees(F.atan2((by - ay).cast("double"), (bx - ax).cast("double")))


def line_separation(first: Column, second: Column) -> Column:
    """Angle between two undirected lines, 0..90 degrees."""
    d = F.pmod(F.abs(first - second), F.lit(180.0))
    return F.least(d, F.lit(180.0) - d)


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment; to its start when the segment is a point."""
    vx, vy = bx - ax, by - ay
    l2 = vx * vx + vy * vy
    t = F.when(l2 < EPS, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * vx + (py - ay) * vy) / l2))
    )
    return dist(px, py, ax + t * vx, ay + t * vy)


def lane_polygon(ax: Column, ay: Column, bx: Column, by: Column, start: float = 26.0, end: float = 52.0) -> list[Column]:
    """Corner coordinates of a passing corridor widening from ``start`` to ``end``; zero-length lanes collapse."""
    n = dist(ax, ay, bx, by)
    ux = F.when(n > EPS, (bx - ax) / n).otherwise(F.lit(0.0))
    uy = F.when(n > EPS, (by - ay) / n).otherwise(F.lit(0.0))
    return [
        ax - uy * start, ay + ux * start, bx - uy * end, by + ux * end,
        bx + uy * end, by - ux * end, ax + uy * start, ay - ux * start,
    ]


def shot_angle(fx: Column, fy: Column, tx: Column, ty: Column, gx: Column, gy: Column) -> Column:
    """Degrees between the shot and the direct line to the goal centre, 0 for zero lengths."""
    return F.coalesce(angle_at(tx, ty, fx, fy, gx, gy), F.lit(0.0))
