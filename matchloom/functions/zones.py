"""Court zones as ``when`` chains over metres (or pixels where stated)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchloom import params as P
from matchloom.functions.common import dist, switch

# --- fixed values: goal mouth and lines in metres ---
GOAL_Y1, GOAL_Y2 = 8.5, 11.5
GOAL_CENTRE_Y = 10.0
AREA_R = 6.0


def zone10(x: Column, y: Column) -> Column:
    """Ten named regions tried in order, else ``centre``."""
    mid, lane = (y > 5.5) & (y < 14.5), (y > 2.0) & (y < 18.0)
    wing = (y < 5.0) | (y > 15.0)
    return switch(
        [
            (x < 0.0, "goal_left"), (x > P.COURT_W, "goal_right"),
            ((x <= 6.0) & mid, "area_6m_left"), ((x >= 34.0) & mid, "area_6m_right"),
            ((x > 6.0) & (x <= 9.0) & lane, "free_throw_left"), ((x >= 31.0) & (x < 34.0) & lane, "free_throw_right"),
            ((x <= 20.0) & wing, "wing_left"), ((x > 20.0) & wing, "wing_right"),
            ((x > 9.0) & (x <= 20.0), "back_left"), ((x > 20.0) & (x < 31.0), "back_right"),
        ],
        "centre",
    )


def band_flags(x: Column, y: Column) -> dict[str, Column]:
    """Membership in each of the seven overlapping rectangles (edges inclusive)."""
    inside = (y >= 0) & (y <= P.COURT_H)
    return {n: (x >= a) & (x <= b) & inside for n, (a, b) in P.COURT_BANDS.items()}


# --- fixed values: band edges, metres and 1280-pixel fallback ---
BAND_NAMES = ("6m_left", "9m_left", "back_left", "centre", "back_right", "9m_right", "6m_right")
BAND_EDGES_M = (6, 9, 18, 22, 31, 34)
BAND_EDGES_PX = (150, 280, 500, 780, 1000, 1130)


def zone_band(x: Column, edges=BAND_EDGES_M) -> Column:
    return switch([(x < e, n) for e, n in zip(edges, BAND_NAMES)], BAND_NAMES[-1])


def zone_shot5(x: Column, y: Column, team: Column) -> Column:
    """Shot zone; team_b is mirrored so both attack towards x = court length."""
    nx = F.when(team == "team_a", x).otherwise(P.COURT_W - x)
    return switch(
        [
            ((nx > 32) & (y < 4.5), "wing_right"), ((nx > 32) & (y > 15.5), "wing_left"),
            (nx.between(32.5, 33.5) & y.between(9.0, 11.0), "penalty_7m"),
            ((nx >= 31) & y.between(5.0, 15.0), "center_6m"),
        ],
        "center_9m",
    )


def zone_screen(px: Column, foot_y: Column, team: Column, w: float = P.FRAME_W, h: float = P.FRAME_H) -> Column:
    """Rough zone from the screen position of the shooter; unknown without one."""
    sx, sy = px / w, foot_y / h
    depth = F.when(team == "team_a", 1.0 - sx).otherwise(sx)
    return switch(
        [
            (px.isNull() | foot_y.isNull(), "Unknown"),
            ((depth < 0.18) & (F.abs(sy - 0.65) > 0.20), "Wing"), (depth < 0.18, "6m Centre"),
            (depth < 0.32, "9m Centre"), (depth < 0.50, "Long Distance"),
        ],
        "Backcourt",
    )


def is_goal_line(x: Column, y: Column, tolerance: float = 0.0) -> Column:
    return y.between(GOAL_Y1, GOAL_Y2) & ((x <= tolerance) | (x >= P.COURT_W - tolerance))


def in_goal_area(x: Column, y: Column, goal_x: Column, r: float = AREA_R, unit: float = 1.0) -> Column:
    """Inside the 6 m area: the straight part or the quarter circle round a post; positions in ``unit`` ths of a metre.

    Whole centimetres (``unit`` 100) decide rows on the line itself exactly, metres may round either way.
    """
    low, high = GOAL_Y1 * unit, GOAL_Y2 * unit
    nearest_post = F.when(y < low, F.lit(low)).when(y > high, F.lit(high)).otherwise(y)
    return dist(x, y, goal_x, nearest_post) <= r * unit


def near_goal_6m(x: Column, y: Column, r: float = 6.5) -> Column:
    c = F.lit(GOAL_CENTRE_Y)
    return (dist(x, y, F.lit(0.0), c) < r) | (dist(x, y, F.lit(P.COURT_W), c) < r)


def near_goal(x: Column, margin: float = 5.0) -> Column:
    return (x < margin) | (x > P.COURT_W - margin)


def goal_mouth_cell(y_m: Column, ball_y: Column, top: Column, bottom: Column) -> Column:
    """Row T/M/B from the height in the goal box, column L/C/R from metres along the line."""
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ball_y - top) / (bottom - top)))
    row = switch([(bottom <= top, "M"), (rel < 0.33, "T"), (rel < 0.67, "M")], "B")
    col = switch([((y_m >= GOAL_Y1) & (y_m < 9.5), "L"), ((y_m >= 10.5) & (y_m < GOAL_Y2), "R")], "C")
    return F.concat(row, col)


def attack_sign(team: Column, flipped: Column) -> Column:
    """+1 when the team attacks towards x = court length."""
    right = (team == "team_a") != flipped
    return F.when(right, F.lit(1)).otherwise(F.lit(-1))


def attacked_goal_x(sign: Column) -> Column:
    return F.when(sign > 0, F.lit(P.COURT_W)).otherwise(F.lit(0.0))


def own_goal_x(sign: Column) -> Column:
    return F.when(sign > 0, F.lit(0.0)).otherwise(F.lit(P.COURT_W))
