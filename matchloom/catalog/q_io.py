"""Sources and sinks as write-read round trips, play report."""

import uuid

from pyspark.sql import functions as F

from matchloom.catalog.q_motion import STAMINA
from matchloom.catalog.q_shape import BLOCK
from matchloom.catalog.q_shots import CLEAN, PCT
from matchloom.catalog.registry import query, r4
from matchloom.functions.text import clock, event_text, ordinal
from matchloom.operators import events as E, motion as M, shape as S, shots as SH
from matchloom.operators.calibrate import opponent
from matchloom.operators.motion import rounded
from matchloom.session import checkpoint_dir
from matchloom.sources import readers as R, writers as W


def folder(t):
    return f"{checkpoint_dir(t.spark)}/exports/{uuid.uuid4().hex}"


@query("src_tracks", "SELECT match_id, frame_n, player_id, team, px, py FROM tracks")
def _(t):
    p = folder(t)
    W.write_tracks(t.tracks.select("match_id", "frame_n", "player_id", "team", "px", "py"), p)
    return R.read_tracks(t.spark, p).select("match_id", "frame_n", "player_id", "team", "px", "py")


@query("src_detections_jsonl", f"SELECT match_id, frame_n, 32 AS class_id, cx * 1e0 AS x, cy * 1e0 AS y, {r4('conf_pct / 100e0')} AS conf FROM candidates")
def _(t):
    p = folder(t)
    W.write_detections(t.candidates.select("match_id", "frame_n", F.lit(32).alias("class_id"), F.col("cx").cast("double").alias("x"), F.col("cy").cast("double").alias("y"), (F.col("conf_pct") / 100.0).alias("conf")), p)
    return rounded(R.read_detections(t.spark, p), "conf")


LOG = "SELECT frame_n / 25e0 AS ts, event_type AS type, source, team, 'p' || player_id AS player, x_cm * 1e0 AS x, y_cm * 1e0 AS y FROM match_events"


def _log(t):
    return t.match_events.select((F.col("frame_n") / 25.0).alias("ts"), F.col("event_type").alias("type"), "source", "team",
                                 F.concat(F.lit("p"), F.col("player_id").cast("string")).alias("player"), F.col("x_cm").cast("double").alias("x"), F.col("y_cm").cast("double").alias("y"))


@query("src_event_log", LOG)
def _(t):
    p = folder(t)
    W.write_json(_log(t), p)
    return R.read_event_log(t.spark, p)


@query("src_tags", "SELECT 'm' || match_id AS video, frame_n * 40 AS timestamp_ms, event_type, CASE team WHEN 'team_a' THEN 'red' ELSE 'blue' END AS team, CASE WHEN source = 'manual' THEN 'checked' END AS note FROM match_events")
def _(t):
    p = folder(t)
    W.write_tags(t.match_events.select(F.concat(F.lit("m"), F.col("match_id").cast("string")).alias("video"), (F.col("frame_n") * 40).alias("timestamp_ms"), "event_type",
                                       F.when(F.col("team") == "team_a", "red").otherwise("blue").alias("team"), F.when(F.col("source") == "manual", "checked").alias("note")), p)
    return R.read_tags(t.spark, p)


SHOT_COLS = ["match_id", "frame_n", "player_id", "gk_id", "team", "number", "zone", "cell", "outcome"]


@query("src_shots", f"WITH {CLEAN} SELECT {', '.join(SHOT_COLS)} FROM clean")
def _(t):
    p = folder(t)
    W.write_json(SH.clean_shots(t.shots).select(*SHOT_COLS), p)
    return R.read_shots(t.spark, p)


@query("snk_shots", f"WITH {CLEAN} SELECT match_id, count(*) AS shots, count(*) FILTER (outcome = 'GOAL') AS goals FROM clean GROUP BY 1")
def _(t):
    """Append-only store in two commits, read through the partitioned view."""
    p, s = folder(t), SH.clean_shots(t.shots).select(*SHOT_COLS)
    s.filter("team = 'team_a'").write.mode("append").parquet(p)
    s.filter("team <> 'team_a'").write.mode("append").parquet(p)
    return t.spark.read.schema(s.schema).parquet(p).groupBy("match_id").agg(F.count(F.lit(1)).alias("shots"), F.sum((F.col("outcome") == "GOAL").cast("bigint")).alias("goals"))


@query("snk_summary_csv", "SELECT team, event_type, count(*) AS n FROM match_events GROUP BY ALL")
def _(t):
    p = folder(t)
    W.write_summary_csv(t.match_events.groupBy("team", "event_type").agg(F.count(F.lit(1)).alias("n")), p)
    return t.spark.read.schema("team string, event_type string, n bigint").option("header", True).csv(p)


@query("snk_profiles", """SELECT match_id, player_id, count(*) AS cells, CAST(sum(n) AS BIGINT) AS frames FROM (SELECT match_id, player_id, x_cm // 50 AS a, y_cm // 50 AS b, count(*) AS n FROM (SELECT match_id, player_id, least(x_cm, 3999) AS x_cm, least(y_cm, 1999) AS y_cm FROM tracks) GROUP BY ALL) GROUP BY match_id, player_id""")
def _(t):
    p = folder(t)
    W.write_profiles(M.motion_summary(t.tracks), M.heat_cells(t.tracks, "match_id", "player_id"), p)
    cells = t.spark.read.parquet(f"{p}/heat_cells").groupBy(F.col("match_id").cast("bigint").alias("match_id"), "player_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("frames"))
    prof = t.spark.read.parquet(f"{p}/profiles").select(F.col("match_id").cast("bigint").alias("match_id"), "player_id")
    return prof.join(cells, ["match_id", "player_id"])


@query("src_snapshot", f"""SELECT match_id, team, count(DISTINCT player_id) AS players, count(*) AS rows FROM tracks GROUP BY match_id, team""")
def _(t):
    p = folder(t)
    W.write_state(p, heat_cells=M.heat_cells(t.tracks, "match_id", "team"), player_stats=t.tracks.groupBy("match_id", "team", "player_id").agg(F.count(F.lit(1)).alias("n")))
    heat = t.spark.read.parquet(f"{p}/heat_cells").groupBy("match_id", "team").agg(F.sum("n").alias("rows"))
    return t.spark.read.parquet(f"{p}/player_stats").groupBy("match_id", "team").agg(F.count(F.lit(1)).alias("players")).join(heat, ["match_id", "team"])


@query("snk_stamina", f"""{STAMINA.replace('WITH RECURSIVE', 'WITH RECURSIVE', 1)}, h AS (SELECT match_id, player_id, count(*) AS samples, CAST(min(s) AS BIGINT) AS lowest FROM s WHERE frame_n % 125 = 0 GROUP BY ALL)
  SELECT match_id, player_id, samples, lowest FROM h""")
def _(t):
    p = folder(t)
    W.write_stamina(M.stamina(t.tracks).filter(F.col("frame_n") % 125 == 0), M.sprints(t.tracks), p)
    d = t.spark.read.parquet(p).filter("history is not null")
    low = F.array_min(F.transform("history", lambda h: h["stamina"]))
    return d.select("match_id", "player_id", F.size("history").cast("bigint").alias("samples"), low.alias("lowest"))


@query("snk_gk_log", f"""WITH {CLEAN} SELECT gk_id, count(*) AS shots, count(*) FILTER (outcome = 'SAVE') AS saves, {PCT("count(*) FILTER (outcome = 'SAVE')", 'count(*)')} AS save_rate FROM clean GROUP BY gk_id""")
def _(t):
    p, s = folder(t), SH.clean_shots(t.shots)
    W.write_keeper_log(s.select("gk_id", "match_id", "frame_n", "outcome", "cell"), SH.keeper_log(s), p)
    n = t.spark.read.schema("gk_id bigint, outcome string").json(f"{p}/shots").groupBy("gk_id").agg(F.count(F.lit(1)).alias("shots"))
    return t.spark.read.schema("gk_id bigint, saves bigint, save_rate double").json(f"{p}/summary").join(n, "gk_id").select("gk_id", "shots", "saves", "save_rate")


@query("src_gallery", f"SELECT vec_id, player_id, {r4('list_sum([CAST(x AS DOUBLE) FOR x IN vec])')} AS total FROM vectors")
def _(t):
    p = folder(t)
    t.vectors.select("vec_id", "player_id", "vec").write.parquet(p)
    return _totals(R.read_gallery(t.spark, p))


def _totals(g):
    return rounded(g.select("vec_id", "player_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total")), "total")


@query("src_gallery_b64", f"SELECT vec_id, player_id, {r4('list_sum([CAST(x AS DOUBLE) FOR x IN vec])')} AS total FROM vectors")
def _(t):
    p = folder(t)
    W.write_gallery_b64(t.vectors, p, nested_below=48)
    return _totals(R.read_gallery_b64(t.spark, p))


@query("src_config", """SELECT 'hotkeys.' || event_type || '.' || team AS key, CAST(count(*) AS VARCHAR) AS value FROM match_events GROUP BY event_type, team""")
def _(t):
    """Parameter rows by key path, defaults overlaid by the counts found in the data."""
    from matchloom.operators.records import merge_params

    base = R.params_frame(t.spark, {"hotkeys": {k: {"team_a": 0, "team_b": 0} for k in ("goal", "shot", "save")}})
    found = t.match_events.groupBy(F.concat_ws(".", F.lit("hotkeys"), "event_type", "team").alias("key")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return merge_params(base, found)


@query("snk_state", "SELECT 'clubs' AS entity, count(*) AS n FROM clubs UNION ALL SELECT 'players', count(*) FROM players UNION ALL SELECT 'corrections', count(*) FROM match_events WHERE source = 'manual'")
def _(t):
    p = folder(t)
    W.write_state(p, clubs=t.clubs, players=t.players, corrections=t.match_events.filter("source = 'manual'"))
    out = None
    for name in ("clubs", "players", "corrections"):
        d = t.spark.read.parquet(f"{p}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("snk_match_facts", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY seq DESC) AS r FROM match_events)
  SELECT match_id, count(*) FILTER (event_type = 'goal' AND team = 'team_a') AS score_a, count(*) FILTER (event_type = 'goal' AND team = 'team_b') AS score_b, count(*) AS events, list(event_id ORDER BY seq) FILTER (r <= 25) AS last_events FROM e GROUP BY 1""")
def _(t):
    p = folder(t)
    last = E.newest(t.match_events, 25).groupBy("match_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_id"))), lambda s: s["event_id"]).alias("last_events"))
    goals = E.kind("goal")
    d = t.match_events.groupBy("match_id").agg(*[F.sum((goals & (F.col("team") == tm)).cast("bigint")).alias(f"score_{tm[-1]}") for tm in E.TEAMS], F.count(F.lit(1)).alias("events"))
    W.write_json(d.join(last, "match_id"), p)
    return t.spark.read.schema("match_id bigint, score_a bigint, score_b bigint, events bigint, last_events array<bigint>").json(p)


@query("snk_batch_result", f"""SELECT match_id, count(*) FILTER (event_type IN ('goal', 'save', 'missed_shot')) AS moments, count(*) FILTER (event_type = 'goal') AS goals FROM match_events GROUP BY 1""")
def _(t):
    """moments[] in bounded chunks of a match next to its summary{}."""
    p = folder(t)
    m = E.attempts(t.match_events).join(t.match_events.select("event_id", F.col("event_type").alias("outcome")), "event_id")
    m = m.groupBy("match_id", F.floor(F.col("seq") / 5000).alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "team", "attempt", "outcome"))).alias("moments"))
    s = t.match_events.groupBy("match_id").agg(F.sum(E.kind("goal").cast("bigint")).alias("goals"))
    W.write_json(m.join(s, "match_id").select("match_id", "part", "moments", F.struct("goals").alias("summary")), p)
    d = t.spark.read.schema("match_id bigint, moments array<struct<seq:bigint>>, summary struct<goals:bigint>").json(p)
    return d.groupBy("match_id").agg(F.sum(F.size("moments").cast("bigint")).alias("moments"), F.max("summary.goals").alias("goals"))


@query("snk_timeline_text", "SELECT printf('%02d:%02d', (frame_n // 25) // 60, (frame_n // 25) % 60) || ' [' || upper(replace(team, '_', ' ')) || '] ' || upper(replace(event_type, '_', ' ')) AS value FROM match_events")
def _(t):
    p = folder(t)
    d = t.match_events.orderBy("match_id", "seq").select(F.concat_ws(" ", clock(F.col("frame_n") / 25.0), event_text(F.col("team"), F.col("event_type"))).alias("value"))
    W.write_lines(d, p)
    return t.spark.read.text(p)


@query("ag_play_report", f"""WITH {BLOCK}, a AS (SELECT *, row_number() OVER (PARTITION BY match_id, team ORDER BY seq) AS attempt, CASE team WHEN 'team_a' THEN 'team_b' ELSE 'team_a' END AS other FROM match_events WHERE event_type IN ('goal', 'save', 'missed_shot')),
  sc AS (SELECT event_id, coalesce(count(*) FILTER (event_type = 'goal' AND team = 'team_a') OVER w, 0) AS ba, coalesce(count(*) FILTER (event_type = 'goal' AND team = 'team_b') OVER w, 0) AS bb FROM match_events WINDOW w AS (PARTITION BY match_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT a.event_id, a.match_id, a.team, a.event_type AS outcome, attempt, CASE WHEN attempt <= 15 THEN ['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth'][attempt] ELSE 'no. ' || attempt END AS title,
  printf('%02d:%02d', (greatest(a.frame_n - 100, 0) // 25) // 60, (greatest(a.frame_n - 100, 0) // 25) % 60) AS from_clock, printf('%02d:%02d', (a.frame_n // 25) // 60, (a.frame_n // 25) % 60) AS to_clock,
  ba || '-' || bb AS score_before, (ba + (a.event_type = 'goal' AND a.team = 'team_a')::BIGINT) || '-' || (bb + (a.event_type = 'goal' AND a.team = 'team_b')::BIGINT) AS score_after, player_id AS shooter_id,
  {r4('gap_px')} AS gap_px, list_filter([CASE WHEN gap_px >= 140 THEN 'gap' END], lambda x: x IS NOT NULL) AS findings
  FROM a JOIN sc USING (event_id) JOIN gp ON gp.match_id = a.match_id AND gp.frame_n = a.frame_n AND gp.team = a.other""")
def _(t):
    """One row per finishing attempt that has frames: number, clock range, score, shooter, defence."""
    ev = t.match_events
    a = E.attempts(ev).join(ev.select("event_id", "frame_n", F.col("event_type").alias("outcome"), F.col("player_id").alias("shooter_id")), "event_id")
    a = a.join(E.running_score(ev).drop("match_id", "seq"), "event_id")
    gap = S.largest_gap(t.tracks).select("match_id", "frame_n", F.col("team").alias("other"), "gap_px", "flagged")
    d = a.withColumn("other", opponent(F.col("team"))).join(gap, ["match_id", "frame_n", "other"])
    return rounded(d.select(
        "event_id", "match_id", "team", "outcome", "attempt", ordinal(F.col("attempt")).alias("title"),
        clock(F.greatest(F.col("frame_n") - 100, F.lit(0)) / 25.0).alias("from_clock"), clock(F.col("frame_n") / 25.0).alias("to_clock"),
        F.concat_ws("-", F.col("before_a").cast("string"), F.col("before_b").cast("string")).alias("score_before"),
        F.concat_ws("-", F.col("after_a").cast("string"), F.col("after_b").cast("string")).alias("score_after"), "shooter_id", "gap_px",
        F.array_compact(F.array(F.when(F.col("flagged"), "gap"))).alias("findings")), "gap_px")


