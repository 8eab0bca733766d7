"""Body key points: visibility, centre of mass, torso box, arms.

Key points are three aligned arrays (x, y, confidence percent) of 17 entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.functions.geometry import angle_at

NOSE, L_SH, R_SH, L_EL, R_EL, L_WR, R_WR = 0, 5, 6, 7, 8, 9, 10
L_HIP, R_HIP, L_KNEE, R_KNEE, L_ANK, R_ANK = 11, 12, 13, 14, 15, 16

# --- fixed values: body segment weights by key point ---
SEGMENT_WEIGHTS = {
    NOSE: 0.07, L_SH: 0.06, R_SH: 0.06, L_WR: 0.025, R_WR: 0.025, L_HIP: 0.12, R_HIP: 0.12,
    L_KNEE: 0.065, R_KNEE: 0.065, L_ANK: 0.035, R_ANK: 0.035,
}


def seen_points(poses: DataFrame, cols: list[str], xs=(), ys=(), min_conf: int = 30) -> DataFrame:
    """``cols`` and the named points where they are seen, as plain columns x<i> and y<i> (null otherwise).

    A row that is joined or ordered then carries the few numbers that are asked for, not three arrays of 17.
    """
    def at(axis, i):
        return F.when(F.get("kc", F.lit(i)) >= min_conf, F.get(f"k{axis}", F.lit(i))).alias(f"{axis}{i}")

    return poses.select(*cols, *[at("x", i) for i in xs], *[at("y", i) for i in ys])


class Body:
    """Column view of one row's key points with a visibility threshold."""

    def __init__(self, min_conf: int = 30, x: str = "kx", y: str = "ky", c: str = "kc"):
        self.min_conf, self._x, self._y, self._c = min_conf, F.col(x), F.col(y), F.col(c)

    def seen(self, i: int) -> Column:
        return F.get(self._c, F.lit(i)) >= self.min_conf

    def x(self, i: int) -> Column:
        return F.when(self.seen(i), F.get(self._x, F.lit(i)))

    def y(self, i: int) -> Column:
        return F.when(self.seen(i), F.get(self._y, F.lit(i)))

    def mean(self, axis: str, points, weights=None) -> tuple[Column, Column]:
        """(weighted mean over visible points, total weight)."""
        get = self.x if axis == "x" else self.y
        num = den = F.lit(0.0)
        for i in points:
            w = float(weights[i]) if weights else 1.0
            num = num + F.coalesce(get(i) * w, F.lit(0.0))
            den = den + F.when(self.seen(i), F.lit(w)).otherwise(F.lit(0.0))
        return F.when(den > 0, num / den), den

    def centre_of_mass(self) -> tuple[Column, Column]:
        out = []
        for axis in ("x", "y"):
            m, w = self.mean(axis, SEGMENT_WEIGHTS, SEGMENT_WEIGHTS)
            plain, n = self.mean(axis, range(17))
            out.append(F.when(w > 0.1, m).when(n > 0, plain).otherwise(F.lit(0.0)))
        return out[0], out[1]

    def keeper_centre(self) -> tuple[Column, Column]:
        pts = (L_HIP, R_HIP, L_ANK, R_ANK, NOSE)
        return self.mean("x", pts)[0], self.mean("y", pts)[0]

    def throwing_arm(self) -> Column:
        """struct<wrist_y, angle> of the fully visible arm with the higher wrist, null without one."""
        # plain conditions: array functions over the two arms are not compiled
        shown, arms = [], []
        for sh, el, wr in ((L_SH, L_EL, L_WR), (R_SH, R_EL, R_WR)):
            a = angle_at(self.x(sh), self.y(sh), self.x(el), self.y(el), self.x(wr), self.y(wr))
            shown.append(F.coalesce(self.seen(sh) & self.seen(el) & self.seen(wr), F.lit(False)))
            arms.append(F.struct(self.y(wr).alias("wrist_y"), F.lit(len(arms)).alias("side"), a.alias("angle")))
        left, right = self.y(L_WR), self.y(R_WR)
        higher = left.isNull() | F.coalesce(left <= right, F.lit(False))
        return F.when(shown[0] & (~shown[1] | higher), arms[0]).when(shown[1], arms[1])
