"""Streaming forms, run to completion over staged files of the given tables."""

import uuid

from pyspark.sql import functions as F

from matchloom.catalog.q_ball import TOUCH
from matchloom.catalog.q_motion import greedy
from matchloom.catalog.registry import query
from matchloom.operators import possession as B
from matchloom.session import checkpoint_dir
from matchloom.streaming import live as L


def staged(t, df, at, chunks=3, rows_per_file=1_000_000):
    """Write a table in chunks of time, each dealt over files of bounded size, then open it as a stream (one chunk per batch)."""
    path = f"{checkpoint_dir(t.spark)}/feeds/{uuid.uuid4().hex}"
    lo, hi, n = df.agg(F.min(at), F.max(at), F.count(F.lit(1))).first()
    step = (hi - lo) / chunks
    files = max(4, -(-n // (chunks * rows_per_file)))
    for i in range(chunks):
        part = df.filter((F.col(at) >= F.lit(lo + step * i)) & ((F.col(at) < F.lit(lo + step * (i + 1))) if i + 1 < chunks else F.lit(True)))
        part.repartition(files).write.mode("append").parquet(path)
    return L.source(t.spark, path, df.schema, files_per_batch=files)


def done(d):
    """Result without the batch number; instants as plain wall-clock times."""
    for c in ("start", "end"):
        if c in d.columns:
            d = d.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return d.drop("batch")


def events(t):
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


@query("st_ingest", "SELECT event_id, event_type FROM events")
def _(t):
    return done(L.run_available(staged(t, events(t), "ts").select("event_id", "event_type"), "append"))


_win = lambda n, s: f"SELECT make_timestamp(unnest(generate_series(CAST(floor((epoch(ts) - {n}) / {s}) + 1 AS BIGINT) * {s}, CAST(floor(epoch(ts) / {s}) AS BIGINT) * {s}, {s})) * 1000000) AS start, event_type FROM events"


@query("st_recent_window", f"SELECT start, event_type, count(*) AS n FROM ({_win(2700, 1800)}) GROUP BY ALL")
def _(t):
    return done(L.run_available(L.counts_in_window(staged(t, events(t), "ts"), "45 minutes", "30 minutes", "event_type"), "complete"))


@query("st_periodic", "SELECT make_timestamp(CAST(floor(epoch(ts) / 300) AS BIGINT) * 300000000) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    return done(L.run_available(L.counts_in_window(staged(t, events(t), "ts"), "5 minutes", None, "event_type"), "complete"))


@query("st_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def _(t):
    return done(L.run_available(L.sessions(staged(t, events(t), "ts"), "6 hours", "user_id"), "complete"))


@query("st_dedupe", "SELECT event_id, event_type FROM events")
def _(t):
    twice = events(t).unionByName(events(t).filter("value > 20"))
    return done(L.run_available(L.unique_events(staged(t, twice, "ts"), "event_id").select("event_id", "event_type"), "append"))


@query("st_live_stats", ", ".join(["SELECT match_id, team"] + [f"count(*) FILTER (event_type = '{k}') AS {k}s" for k in ("goal", "shot", "save", "pass")]) + " FROM match_events GROUP BY ALL")
def _(t):
    s = L.live_stats(staged(t, t.match_events.select("event_id", "match_id", "team", "event_type"), "event_id"))
    return L.newest_rows(L.run_available(s, "update"), ["match_id", "team"])


@query("st_debounce", greedy("z AS (SELECT 1)", "SELECT match_id, team, event_type, frame_n FROM match_events", ["match_id", "team", "event_type"], 150) + " SELECT match_id, team, event_type, frame_n FROM k")
def _(t):
    s = staged(t, t.match_events.select("event_id", "match_id", "team", "event_type", "frame_n"), "event_id")
    return done(L.run_available(L.debounce(s, ["match_id", "team", "event_type"], 150, "match_id bigint, team string, event_type string, frame_n bigint"), "append"))


@query("st_possession", f"WITH {TOUCH} SELECT match_id, frame_n, team, player_id, coalesce(held, 'none') AS from_team FROM touch WHERE pos = 6 AND held IS DISTINCT FROM team")
def _(t):
    h = B.holders(t.tracks, t.ball).select("match_id", "frame_n", "team", "player_id")
    return done(L.run_available(L.possession(staged(t, h, "frame_n")), "append"))


@query("st_goal_wait", "SELECT g.match_id, event_id, b.frame_n FROM match_events g JOIN ball b ON b.match_id = g.match_id AND b.frame_n BETWEEN g.frame_n - 100 AND g.frame_n + 37 WHERE event_type = 'goal'")
def _(t):
    def at(name):
        """The match's own clock: all matches run side by side, so one watermark is late for none of them."""
        return F.timestamp_millis(F.col("frame_n") * 40 + 1000).alias(name)  # a row at instant 0 would be late: the first watermark is 0

    goals = staged(t, t.match_events.filter("event_type = 'goal'").select("match_id", "event_id", at("goal_ts"), "frame_n"), "frame_n").drop("frame_n")
    frames = staged(t, t.ball.select("match_id", "frame_n", at("frame_ts")), "frame_n")
    return done(L.run_available(L.goal_windows(goals, frames, late="1 minutes"), "append"))


@query("st_absence", """WITH s AS (SELECT match_id, player_id, frame_n * 40 AS ms, lead(frame_n * 40) OVER (PARTITION BY match_id, player_id ORDER BY frame_n) AS next FROM tracks)
  SELECT match_id, player_id, ms AS last_seen_ms FROM s WHERE next - ms >= 5000 OR next IS NULL AND ms + 5000 < (SELECT max(frame_n) * 40 - 1000 FROM tracks)""")
def _(t):
    ts = F.timestamp_millis(F.col("frame_n") * 40 + 1000)  # a row at instant 0 would be late: the first watermark is 0
    rows = staged(t, t.tracks.select("match_id", "player_id", "frame_n", ts.alias("ts")), "frame_n")
    d = done(L.run_available(L.absence(rows, ["match_id", "player_id"], 5.0, "match_id bigint, player_id bigint, last_seen_ms bigint"), "append"))
    return d.withColumn("last_seen_ms", F.col("last_seen_ms") - 1000)


@query("st_ttl", """WITH r AS (SELECT track_id, CAST(raw_text AS BIGINT) AS number, conf_pct, frame_n FROM jersey_reads
   WHERE CASE WHEN regexp_full_match(raw_text, '[0-9]{1,2}') THEN CAST(raw_text AS BIGINT) BETWEEN 1 AND 99 ELSE false END AND conf_pct >= 55),
  g AS (SELECT *, CASE WHEN frame_n - lag(frame_n) OVER (PARTITION BY track_id, number ORDER BY frame_n) > 600 THEN 1 ELSE 0 END AS pause FROM r),
  i AS (SELECT *, sum(pause) OVER (PARTITION BY track_id, number ORDER BY frame_n) AS stay FROM g)
  SELECT track_id, number, CAST(sum(conf_pct) AS BIGINT) AS votes FROM i i WHERE stay = (SELECT max(stay) FROM i j WHERE j.track_id = i.track_id AND j.number = i.number) GROUP BY ALL""")
def _(t):
    from matchloom.functions.text import jersey_number

    r = t.jersey_reads.withColumn("number", jersey_number(F.col("raw_text"), F.col("conf_pct") / 100.0)).filter("number is not null")
    r = r.select("track_id", "number", "conf_pct", "frame_n", F.timestamp_millis(F.col("frame_n") * 1000 + 1000).alias("ts"))
    return L.newest_rows(L.run_available(L.votes_with_ttl(staged(t, r, "frame_n"), 600), "update"), ["track_id", "number"])


@query("snk_event_log", "SELECT event_id, match_id, event_type, team FROM match_events")
def _(t):
    """Continuous JSON event log: each micro-batch commits its own folder atomically."""
    s = staged(t, t.match_events.select("event_id", "match_id", "event_type", "team"), "event_id")
    path = f"{checkpoint_dir(t.spark)}/logs/{uuid.uuid4().hex}"
    q = s.writeStream.format("json").option("path", path).option("checkpointLocation", path + "_state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(s.schema).json(path)


@query("snk_broadcast", "SELECT 'screen' AS subscriber, event_id FROM match_events UNION ALL SELECT 'goals', event_id FROM match_events WHERE event_type = 'goal'")
def _(t):
    """Fan-out of each micro-batch to several subscribers' tables."""
    s = staged(t, t.match_events.select("event_id", "event_type"), "event_id")

    def fan_out(df, _batch, path):
        df = df.select(F.explode(F.array_compact(F.array(F.lit("screen"), F.when(F.col("event_type") == "goal", "goals")))).alias("subscriber"), "event_id")
        df.write.mode("overwrite").parquet(path)

    tagged = s.select(F.lit("").alias("subscriber"), "event_id", "event_type")
    return done(L.run_available(tagged, "append", fan_out)).select("subscriber", "event_id")
