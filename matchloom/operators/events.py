"""Statistics, look-backs and feeds over match events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom.functions.common import codes, count_if, pct
from matchloom.operators.calibrate import opponent, with_period
from matchloom.plans.ordered import number_rows, scan
from matchloom.plans.ranges import interval_join

TEAMS = ("team_a", "team_b")


def kind(*names: str) -> Column:
    return F.col("event_type").isin(*names)


def team_stats(events: DataFrame) -> DataFrame:
    """A turnover counts for the team that gained the ball, when the loser is known."""
    return events.groupBy("match_id", "team").agg(
        count_if(kind("shot")).alias("shots"), count_if(kind("goal")).alias("goals"), count_if(kind("save")).alias("saves"),
        count_if(kind("fast_break")).alias("fast_breaks"),
        count_if(kind("possession_change") & (F.col("from_team") != "none")).alias("turnovers"),
        count_if(kind("foul")).alias("fouls"),
    ).withColumn("efficiency", pct(F.col("goals"), F.col("shots")))


def player_stats(events: DataFrame) -> DataFrame:
    zone = F.when(F.col("x_cm") < 900, "near").when(F.col("x_cm") > 3100, "far").otherwise("mid")
    return events.filter(kind("shot", "goal", "save")).groupBy("match_id", "player_id").agg(
        count_if(kind("shot")).alias("shots"), count_if(kind("goal")).alias("goals"), count_if(kind("save")).alias("saves"),
        *[count_if(kind("shot") & (zone == z)).alias(f"shots_{z}") for z in ("near", "mid", "far")],
    )


def action_counts(events: DataFrame) -> DataFrame:
    """Per player counters; a goal also counts as a shot."""
    return events.groupBy("player_id").agg(
        count_if(kind("goal")).alias("goals"), count_if(kind("shot", "goal")).alias("shots"), count_if(kind("pass")).alias("passes"),
        count_if(kind("save")).alias("saves"), count_if(kind("fast_break")).alias("fast_breaks"),
    )


def keeper_kpi(events: DataFrame) -> DataFrame:
    """Keeper numbers of the defending team: opponents' goals and misses turn into its own row."""
    keeper = F.when(kind("save"), F.col("team")).otherwise(opponent(F.col("team")))
    g = events.filter(kind("save", "goal", "missed_shot")).groupBy("match_id", keeper.alias("team")).agg(
        count_if(kind("save")).alias("saves"), count_if(kind("goal")).alias("conceded"), count_if(kind("missed_shot")).alias("off_target")
    )
    return g.withColumn("on_target", F.col("saves") + F.col("conceded")).withColumn(
        "save_pct", pct(F.col("saves"), F.col("saves") + F.col("conceded"))
    )


def period_stats(events: DataFrame) -> DataFrame:
    return with_period(events).groupBy("match_id", "period", "team").agg(
        count_if(kind("goal")).alias("goals"), count_if(kind("shot")).alias("shots"), count_if(kind("fast_break")).alias("fast_breaks")
    ).withColumn("conversion", pct(F.col("goals"), F.col("shots")))


def match_stats(events: DataFrame) -> DataFrame:
    per = [
        count_if(kind(k) & (F.col("team") == t)).alias(f"{n}_{t[-1]}")
        for t in TEAMS for k, n in (("goal", "score"), ("shot", "shots"), ("save", "saves"), ("fast_break", "breaks"))
    ]
    return events.groupBy("match_id").agg(*per, F.count(F.lit(1)).alias("events")).withColumn(
        "accuracy_a", pct(F.col("score_a"), F.col("shots_a"))
    ).withColumn("accuracy_b", pct(F.col("score_b"), F.col("shots_b")))


def strengths(events: DataFrame, gap_leader: DataFrame) -> DataFrame:
    """Team flag codes from accuracy, breaks, keeper rate, fouls, and the gap leader's presence."""
    t = team_stats(events).join(keeper_kpi(events).select("match_id", "team", "on_target", "save_pct"), ["match_id", "team"], "left")
    t = t.join(gap_leader, ["match_id", "team"], "left")
    keep = F.coalesce("save_pct", F.lit(0.0))
    n, on = F.col("shots"), F.coalesce("on_target", F.lit(0))
    return t.select(
        "match_id", "team",
        codes(
            ("accurate", (n >= 3) & (F.col("efficiency") >= 55)), ("counter_attack", F.col("fast_breaks") >= 2),
            ("keeper", (on >= 3) & (keep >= 35)),
        ).alias("strengths"),
        codes(
            ("inaccurate", (n >= 3) & (F.col("efficiency") < 35)), ("keeper", (on >= 3) & (keep < 20)), ("fouls", F.col("fouls") >= 3),
            ("gap_leader", F.col("leader").isNotNull()),
        ).alias("weaknesses"),
    )


def running_score(events: DataFrame) -> DataFrame:
    """Score before and after every event (manual goals included)."""
    d = scan(
        events.select("event_id", "match_id", "seq", "event_type", "team"), ["match_id"], "seq",
        sums={f"after_{t[-1]}": (kind("goal") & (F.col("team") == t)).cast("bigint") for t in TEAMS},
    )
    for t in TEAMS:
        d = d.withColumn(f"before_{t[-1]}", F.col(f"after_{t[-1]}") - (kind("goal") & (F.col("team") == t)).cast("bigint"))
    return d.drop("event_type", "team")


def score_timeline(status: DataFrame) -> DataFrame:
    """Rows of a status feed (match_id, seq, a, b) on which a score went up."""
    d = scan(status, ["match_id"], "seq", lag={"pa": F.col("a"), "pb": F.col("b")})
    up_a, up_b = F.col("a") > F.coalesce("pa", F.lit(0)), F.col("b") > F.coalesce("pb", F.lit(0))
    return d.filter(up_a | up_b).select("match_id", "seq", F.when(up_a, "team_a").otherwise("team_b").alias("team"), "a", "b")


def attempts(events: DataFrame) -> DataFrame:
    """Finishing attempts numbered per team."""
    f = events.filter(kind("goal", "save", "missed_shot")).select("event_id", "match_id", "team", "seq")
    return number_rows(f, ["match_id", "team"], "seq", "attempt")


def clip_plan(tags: DataFrame, fps: float, before_s: float = 5.0, length_s: float = 8.0) -> DataFrame:
    """Cut list: start, length and a running name per type and team."""
    d = number_rows(tags.select("event_id", "match_id", "event_type", "team", "seq", "frame_n"), ["match_id", "event_type", "team"], "seq", "n")
    return d.select(
        "event_id", F.greatest(F.lit(0.0), F.col("frame_n") / F.lit(fps) - before_s).alias("start_s"), F.lit(length_s).alias("length_s"),
        F.concat_ws("_", "event_type", "team", F.lpad(F.col("n").cast("string"), 3, "0")).alias("name"),
    )


def assists(events: DataFrame, max_frames: int = 100, max_events: int = 80) -> DataFrame:
    """Last pass of the scoring team to the scorer (or to nobody known) shortly before a goal.

    Two backward as-of scans - by receiver, and over passes without one - and the later wins.
    """
    e = events.filter(kind("pass", "goal")).select("event_id", "match_id", "team", "seq", "frame_n", "event_type", "player_id", "to_player_id")
    is_pass = kind("pass")
    mark = F.when(is_pass, F.struct("seq", "frame_n", "player_id"))
    known = e.withColumn("who", F.when(is_pass, F.col("to_player_id")).otherwise(F.col("player_id"))).filter("who is not null")
    a = scan(known, ["match_id", "team", "who"], "seq", prior={"p1": mark}).filter(kind("goal"))
    loose = e.filter(~is_pass | F.col("to_player_id").isNull())
    b = scan(loose, ["match_id", "team"], "seq", prior={"p2": mark}).filter(kind("goal")).select("event_id", "p2")
    d = a.join(b, "event_id").withColumn("p", F.greatest("p1", "p2"))
    near = (F.col("frame_n") - F.col("p.frame_n") <= max_frames) & (F.col("seq") - F.col("p.seq") <= max_events)
    return d.select(
        "event_id", "match_id", "frame_n", "player_id",
        F.when(near, F.col("p.player_id")).alias("assist_id"), F.when(near, F.col("p.frame_n")).alias("assist_frame"),
    )


def shot_outcomes(events: DataFrame) -> DataFrame:
    """Resolving events with the pending shot since the previous resolution."""
    e = events.filter(kind("shot", "goal", "save", "missed_shot"))
    d = scan(
        e, ["match_id"], "seq",
        prior={"shot": F.when(kind("shot"), F.struct("seq", "player_id")), "done": F.when(~kind("shot"), F.col("seq"))},
    ).filter(~kind("shot"))
    live = F.col("shot").isNotNull() & (F.col("done").isNull() | (F.col("shot.seq") > F.col("done")))
    return d.select(
        "event_id", "match_id", F.col("event_type").alias("outcome"),
        F.when(live, F.col("shot.seq")).alias("shot_seq"), F.when(live, F.col("shot.player_id")).alias("shooter_id"),
    )


def goal_windows(goals: DataFrame, frames: DataFrame, before: int = 100, after: int = 37) -> DataFrame:
    """Frames from 4 s before to 1.5 s after every goal; windows may overlap."""
    g = goals.select("match_id", "event_id", F.col("frame_n").alias("goal_frame")).withColumn("lo", F.col("goal_frame") - before).withColumn(
        "hi", F.col("goal_frame") + after)
    return interval_join(frames, g, ["match_id"], "frame_n", "lo", "hi", bucket=128).drop("lo", "hi")


def assist_windows(assist_rows: DataFrame, frames: DataFrame, lead: int = 10, plain: int = 50) -> DataFrame:
    """Frames from just before the assist (else 2 s before the finish) to the finish, every second one and the last."""
    lo = F.coalesce(F.col("assist_frame") - lead, F.col("finish") - plain)
    g = assist_rows.select("match_id", "event_id", F.col("frame_n").alias("finish"), "assist_frame").withColumn("lo", lo)
    d = interval_join(frames.select("match_id", "frame_n", "bpx", "bpy"), g, ["match_id"], "frame_n", "lo", "finish", bucket=128)
    w = W.partitionBy("event_id").orderBy("frame_n")  # a window holds at most a few seconds of frames
    d = d.withColumn("i", F.row_number().over(w) - 1).withColumn("last", F.lead("frame_n").over(w).isNull())
    return d.filter((F.pmod("i", F.lit(2)) == 0) | F.col("last")).select("event_id", "match_id", "frame_n", "bpx", "bpy")


def pass_endpoints(windows: DataFrame, tracks: DataFrame, receivers: DataFrame, reach: float = 90.0) -> DataFrame:
    """Ball at the window start and end, and the receiver's first frame within reach of the ball."""
    w = windows.join(receivers, "event_id")
    ends = w.filter("bpx is not null").groupBy("event_id").agg(
        F.min_by(F.struct("bpx", "bpy"), "frame_n").alias("a"), F.max_by(F.struct("bpx", "bpy"), "frame_n").alias("b"))
    near = w.join(tracks.select("match_id", "frame_n", "player_id", "px", "py"), ["match_id", "frame_n", "player_id"])
    d2 = (F.col("px") - F.col("bpx")) * (F.col("px") - F.col("bpx")) + (F.col("py") - F.col("bpy")) * (F.col("py") - F.col("bpy"))
    first = near.filter(d2 < reach * reach).groupBy("event_id").agg(F.min("frame_n").alias("receive_frame"))
    return ends.join(first, "event_id", "left").select(
        "event_id", F.col("a.bpx").alias("start_x"), F.col("a.bpy").alias("start_y"), "receive_frame",
        F.col("b.bpx").alias("end_x"), F.col("b.bpy").alias("end_y"))


def recent(events: DataFrame, window: int) -> DataFrame:
    """Events of the last ``window`` frames of their match."""
    end = events.groupBy("match_id").agg(F.max("frame_n").alias("_end"))
    return events.join(end, "match_id").filter(F.col("frame_n") >= F.col("_end") - window).drop("_end")


def newest(events: DataFrame, n: int) -> DataFrame:
    """Newest n events per match; the rank limit is applied map-side before the shuffle."""
    w = W.partitionBy("match_id").orderBy(F.desc("seq"))
    return events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def evenly_spaced(frames: DataFrame, k: int) -> DataFrame:
    """k evenly spaced rows per match, first and last included."""
    n = number_rows(frames, ["match_id"], "frame_n")
    tot = n.groupBy("match_id").agg(F.max("rn").alias("n"))
    picks = tot.select("match_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "n").select(
        "match_id", (F.floor(F.col("i") * (F.col("n") - 1) / (k - 1)) + 1).cast("bigint").alias("rn")).distinct()
    return n.join(picks, ["match_id", "rn"]).select("match_id", "frame_n", "rn")


def feeds(**parts: DataFrame) -> DataFrame:
    """One feed from several event sources, missing columns null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("feed", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def absences(rows: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """Unseen for at least ``gap`` frames between two rows, or until the end of the match."""
    d = scan(rows.select(*keys, "frame_n"), keys, "frame_n", lag={"prev": F.col("frame_n")})
    inside = d.filter(F.col("frame_n") - F.col("prev") >= gap).select(*keys, F.col("prev").alias("last_seen"), (F.col("prev") + gap).alias("alert_frame"))
    end = rows.groupBy("match_id").agg(F.max("frame_n").alias("_end"))
    tail = rows.groupBy(*keys).agg(F.max("frame_n").alias("last_seen")).join(end, "match_id")
    tail = tail.filter(F.col("_end") - F.col("last_seen") >= gap).select(*keys, "last_seen", (F.col("last_seen") + gap).alias("alert_frame"))
    return inside.unionByName(tail)
