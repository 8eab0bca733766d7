"""Default parameters.  Every operator takes these as arguments; pass your own to change them."""

FPS = 25.0
COURT_W, COURT_H = 40.0, 20.0
FRAME_W, FRAME_H = 1280.0, 720.0

# --- fixed values: shot vocabulary -----------------------------------------
SHOT_ZONES = [
    "Left Wing", "Right Wing", "Left Back", "Right Back", "Center Back", "Left 6m",
    "Center 6m", "Right 6m", "Fast Break", "Break Through", "7m Penalty", "Long Distance",
]
GOAL_CELLS = ["LU", "CU", "RU", "LH", "CH", "RH", "LD", "CD", "RD"]
OFF_TARGET = ["MISS", "POST", "BLOCK"]
OUTCOMES = ["GOAL", "SAVE", "MISS", "POST", "BLOCK"]
ZONE_DISTANCE = {
    "Left Wing": "6m", "Right Wing": "6m", "Left Back": "9m", "Right Back": "9m", "Center Back": "9m",
    "Left 6m": "6m", "Center 6m": "6m", "Right 6m": "6m", "Fast Break": "6m", "Break Through": "6m",
    "7m Penalty": "7m", "Long Distance": "9m",
}

# --- fixed values: overlapping court rectangles in metres (x1, x2; full width) ---
COURT_BANDS = {
    "own_goal_area": (0, 6), "own_9m": (0, 9), "own_half": (0, 20), "centre": (16, 24),
    "opp_half": (20, 40), "opp_9m": (31, 40), "opp_6m": (34, 40),
}

# --- fixed values: role norms (low, high) for km, sprints, top speed in m/s ---
ROLE_NORMS = {
    "GK": ((1.2, 2.5), (2, 8), (5.5, 7.0)),
    "CB": ((5.4, 7.2), (15, 25), (7.0, 9.0)),
    "LB": ((5.2, 6.8), (12, 22), (7.0, 9.0)),
    "RB": ((5.2, 6.8), (12, 22), (7.0, 9.0)),
    "LW": ((4.2, 5.8), (10, 20), (7.5, 9.5)),
    "RW": ((4.2, 5.8), (10, 20), (7.5, 9.5)),
    "PV": ((3.8, 5.2), (8, 15), (6.5, 8.5)),
}
DEFAULT_NORM = ((4.8, 6.5), (12, 22), (6.8, 8.8))

# --- motion -----------------------------------------------------------------
SPRINT_MS, RUN_MS, WALK_MS = 5.5, 2.5, 0.3
SPRINT_MIN_S = 1.0
MAX_STEP_S, MAX_SPEED_MS = 0.5, 30.0
# --- possession and shots (pixels, pixels per frame, frames) ------------------
POSSESSION_RADIUS_PX = 150.0
POSSESSION_DEBOUNCE = 6
PASS_SPEED_PXF = 8.0
SHOT_MIN_PXF, SHOT_MAX_PXF = 18.0, 90.0
