"""Event statistics, look-backs, feeds, record maintenance."""

from pyspark.sql import functions as F

from matchloom.catalog.q_shots import PCT
from matchloom.catalog.registry import query, r1, r4
from matchloom.functions.common import count_if, pct
from matchloom.operators import calibrate as C, events as E, records as R
from matchloom.operators.motion import rounded
from matchloom.plans.ordered import number_rows, scan

N = lambda *k: "count(*) FILTER (event_type IN (" + ", ".join(f"'{x}'" for x in k) + "))"


@query("ag_tag_counts", "SELECT event_type, team, count(*) AS n FROM match_events GROUP BY ALL")
def _(t):
    return t.match_events.groupBy("event_type", "team").agg(F.count(F.lit(1)).alias("n")).orderBy("team", "event_type")


TEAM = f"""tm AS (SELECT match_id, team, {N('shot')} AS shots, {N('goal')} AS goals, {N('save')} AS saves, {N('fast_break')} AS fast_breaks,
  count(*) FILTER (event_type = 'possession_change' AND from_team <> 'none') AS turnovers, {N('foul')} AS fouls, {PCT(N('goal'), N('shot'))} AS efficiency FROM match_events GROUP BY match_id, team)"""


@query("ag_team_stats", f"WITH {TEAM} SELECT * FROM tm")
def _(t):
    return E.team_stats(t.match_events)


@query("ag_player_stats", f"""SELECT match_id, player_id, {N('shot')} AS shots, {N('goal')} AS goals, {N('save')} AS saves,
  count(*) FILTER (event_type = 'shot' AND x_cm < 900) AS shots_near, count(*) FILTER (event_type = 'shot' AND x_cm BETWEEN 900 AND 3100) AS shots_mid,
  count(*) FILTER (event_type = 'shot' AND x_cm > 3100) AS shots_far FROM match_events WHERE event_type IN ('shot', 'goal', 'save') GROUP BY ALL""")
def _(t):
    return E.player_stats(t.match_events)


@query("ag_shot_accuracy", f"SELECT team, {PCT(N('goal'), N('shot'))} AS accuracy FROM match_events GROUP BY team")
def _(t):
    return t.match_events.groupBy("team").agg(pct(count_if(E.kind("goal")), count_if(E.kind("shot"))).alias("accuracy"))


@query("ag_action_counts", f"SELECT player_id, {N('goal')} AS goals, {N('shot', 'goal')} AS shots, {N('pass')} AS passes, {N('save')} AS saves, {N('fast_break')} AS fast_breaks FROM match_events GROUP BY 1")
def _(t):
    return E.action_counts(t.match_events)


KPI = f"""kp AS (SELECT match_id, CASE WHEN event_type = 'save' THEN team WHEN team = 'team_a' THEN 'team_b' ELSE 'team_a' END AS team, {N('save')} AS saves, {N('goal')} AS conceded, {N('missed_shot')} AS off_target
  FROM match_events WHERE event_type IN ('save', 'goal', 'missed_shot') GROUP BY 1, 2),
  kpi AS (SELECT *, saves + conceded AS on_target, {PCT('saves', '(saves + conceded)')} AS save_pct FROM kp)"""


@query("ag_gk_kpi", f"WITH {KPI} SELECT * FROM kpi")
def _(t):
    return E.keeper_kpi(t.match_events)


PER = "pe AS (SELECT e.*, CASE WHEN e.seq > (SELECT min(seq) FROM match_events p WHERE p.match_id = e.match_id AND p.event_type = 'period_end') THEN 2 ELSE 1 END AS period FROM match_events e)"


@query("ag_period", f"WITH {PER} SELECT match_id, period, team, {N('goal')} AS goals, {N('shot')} AS shots, {N('fast_break')} AS fast_breaks, {PCT(N('goal'), N('shot'))} AS conversion FROM pe GROUP BY match_id, period, team")
def _(t):
    return E.period_stats(t.match_events)


@query("flt_timeline", f"WITH {PER} SELECT event_id, match_id, event_type FROM pe WHERE period = 2 AND event_type IN ('goal', 'save', 'fast_break')")
def _(t):
    return C.with_period(t.match_events).filter((F.col("period") == 2) & E.kind("goal", "save", "fast_break")).select("event_id", "match_id", "event_type")


@query("ag_technique", """SELECT CASE WHEN grouping(team) = 1 THEN 'all' ELSE team END AS team, event_type, count(*) AS n FROM match_events e
  WHERE frame_n >= (SELECT max(frame_n) FROM match_events m WHERE m.match_id = e.match_id) - 3000 GROUP BY GROUPING SETS ((event_type), (team, event_type))""")
def _(t):
    d = E.recent(t.match_events, 3000)
    return d.groupingSets([["event_type"], ["team", "event_type"]], "event_type", "team").agg(
        F.grouping("team").alias("g"), F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("team")).alias("team"), "event_type", "n")


_ms = ", ".join(f"count(*) FILTER (event_type = '{k}' AND team = '{tm}') AS {n}_{tm[-1]}" for tm in ("team_a", "team_b") for k, n in (("goal", "score"), ("shot", "shots"), ("save", "saves"), ("fast_break", "breaks")))


@query("ag_match_stats", f"WITH s AS (SELECT match_id, {_ms}, count(*) AS events FROM match_events GROUP BY 1) SELECT *, {PCT('score_a', 'shots_a')} AS accuracy_a, {PCT('score_b', 'shots_b')} AS accuracy_b FROM s")
def _(t):
    return E.match_stats(t.match_events)


@query("ag_strengths", f"""WITH {TEAM}, {KPI}, l AS (SELECT match_id, team, arg_max(player_id, (n, -player_id)) AS leader FROM (SELECT match_id, team, player_id, count(*) AS n FROM match_events WHERE event_type = 'foul' GROUP BY ALL HAVING n >= 2) GROUP BY ALL)
  SELECT match_id, team, list_filter([CASE WHEN shots >= 3 AND efficiency >= 55 THEN 'accurate' END, CASE WHEN fast_breaks >= 2 THEN 'counter_attack' END, CASE WHEN on_target >= 3 AND save_pct >= 35 THEN 'keeper' END], lambda x: x IS NOT NULL) AS strengths,
  list_filter([CASE WHEN shots >= 3 AND efficiency < 35 THEN 'inaccurate' END, CASE WHEN on_target >= 3 AND save_pct < 20 THEN 'keeper' END, CASE WHEN fouls >= 3 THEN 'fouls' END, CASE WHEN leader IS NOT NULL THEN 'gap_leader' END], lambda x: x IS NOT NULL) AS weaknesses
  FROM tm LEFT JOIN kpi USING (match_id, team) LEFT JOIN l USING (match_id, team)""")
def _(t):
    fouls = t.match_events.filter(E.kind("foul")).groupBy("match_id", "team", "player_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    lead = fouls.groupBy("match_id", "team").agg(F.max_by("player_id", F.struct("n", (-F.col("player_id")).alias("p"))).alias("leader"))
    return E.strengths(t.match_events, lead)


@query("wn_score", """SELECT event_id, match_id, seq, CAST(sum(CASE WHEN event_type = 'goal' AND team = 'team_a' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS after_a,
  CAST(sum(CASE WHEN event_type = 'goal' AND team = 'team_b' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS after_b,
  CAST(coalesce(sum(CASE WHEN event_type = 'goal' AND team = 'team_a' THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS before_a, CAST(coalesce(sum(CASE WHEN event_type = 'goal' AND team = 'team_b' THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT) AS before_b
  FROM match_events WINDOW w AS (PARTITION BY match_id ORDER BY seq), b AS (PARTITION BY match_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(t):
    return E.running_score(t.match_events)


@query("wn_score_delta", """SELECT match_id, seq, team, CAST(count(*) FILTER (team = 'team_a') OVER w AS BIGINT) AS a, CAST(count(*) FILTER (team = 'team_b') OVER w AS BIGINT) AS b
  FROM match_events WHERE event_type = 'goal' WINDOW w AS (PARTITION BY match_id ORDER BY seq)""")
def _(t):
    s = E.running_score(t.match_events).select("match_id", "seq", F.col("after_a").alias("a"), F.col("after_b").alias("b"))
    return E.score_timeline(s)


@query("wn_attack_no", "SELECT event_id, match_id, team, seq, row_number() OVER (PARTITION BY match_id, team ORDER BY seq) AS attempt FROM match_events WHERE event_type IN ('goal', 'save', 'missed_shot')")
def _(t):
    return E.attempts(t.match_events)


_clip = "row_number() OVER (PARTITION BY match_id, event_type, team ORDER BY seq)"


@query("plan_clips", f"""SELECT event_id, greatest(0e0, frame_n / 25e0 - 5e0) AS start_s, 8e0 AS length_s, event_type || '_' || team || '_' || lpad(CAST({_clip} AS VARCHAR), 3, '0') AS name FROM match_events""")
def _(t):
    return E.clip_plan(t.match_events, 25.0)


@query("wn_clip_seq", f"SELECT event_id, {_clip} AS n FROM match_events")
def _(t):
    d = t.match_events.select("event_id", "match_id", "event_type", "team", "seq")
    return number_rows(d, ["match_id", "event_type", "team"], "seq", "n").select("event_id", "n")


ASSIST = """pa AS (SELECT g.event_id, arg_max(p.player_id, p.seq) AS assist_id, max(p.frame_n) AS assist_frame FROM match_events g JOIN match_events p ON p.match_id = g.match_id AND p.team = g.team AND p.event_type = 'pass'
    AND p.seq < g.seq AND g.seq - p.seq <= 80 AND g.frame_n - p.frame_n <= 100 AND (p.to_player_id IS NULL OR p.to_player_id = g.player_id) WHERE g.event_type = 'goal' GROUP BY 1),
  asst AS (SELECT g.event_id, g.match_id, g.frame_n, g.player_id, assist_id, assist_frame FROM match_events g LEFT JOIN pa USING (event_id) WHERE event_type = 'goal')"""


@query("jn_assist_asof", f"WITH {ASSIST} SELECT * FROM asst")
def _(t):
    return E.assists(t.match_events)


@query("jn_shot_outcome", """WITH e AS (SELECT *, max(CASE WHEN event_type = 'shot' THEN seq END) OVER w AS ss, max(CASE WHEN event_type <> 'shot' THEN seq END) OVER w AS ds FROM match_events
   WHERE event_type IN ('shot', 'goal', 'save', 'missed_shot') WINDOW w AS (PARTITION BY match_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT *, CASE WHEN ss > coalesce(ds, -1) THEN ss END AS shot_seq FROM e WHERE event_type <> 'shot')
  SELECT f.event_id, f.match_id, f.event_type AS outcome, shot_seq, s.player_id AS shooter_id FROM f LEFT JOIN match_events s ON s.match_id = f.match_id AND s.seq = shot_seq""")
def _(t):
    return E.shot_outcomes(t.match_events)


@query("jn_event_window", """SELECT b.match_id, event_id, g.frame_n AS goal_frame, b.frame_n, bpx, bpy FROM match_events g JOIN ball b ON b.match_id = g.match_id AND b.frame_n BETWEEN g.frame_n - 100 AND g.frame_n + 37 WHERE event_type = 'goal'""")
def _(t):
    d = E.goal_windows(t.match_events.filter(E.kind("goal")), t.ball.select("match_id", "frame_n", "bpx", "bpy"))
    return d.select("match_id", "event_id", "goal_frame", "frame_n", "bpx", "bpy")


AWIN = f"""{ASSIST}, wi AS (SELECT event_id, b.match_id, b.frame_n, bpx, bpy, row_number() OVER w AS i, count(*) OVER (PARTITION BY event_id) AS n FROM asst a JOIN ball b ON b.match_id = a.match_id
   AND b.frame_n BETWEEN coalesce(assist_frame - 10, a.frame_n - 50) AND a.frame_n WINDOW w AS (PARTITION BY event_id ORDER BY b.frame_n)),
  aw AS (SELECT event_id, match_id, frame_n, bpx, bpy FROM wi WHERE i % 2 = 1 OR i = n)"""


@query("jn_assist_window", f"WITH {AWIN} SELECT * FROM aw")
def _(t):
    return E.assist_windows(E.assists(t.match_events), t.ball)


@query("jn_pass_endpoints", f"""WITH {AWIN}, r AS (SELECT aw.*, aw.match_id * 14 + event_id % 14 AS player_id FROM aw),
  f AS (SELECT event_id, min(r.frame_n) AS receive_frame FROM r JOIN tracks t ON t.match_id = r.match_id AND t.frame_n = r.frame_n AND t.player_id = r.player_id WHERE (px-bpx)*(px-bpx)+(py-bpy)*(py-bpy) < 8100 GROUP BY 1),
  e AS (SELECT event_id, arg_min(bpx, frame_n) AS start_x, arg_min(bpy, frame_n) AS start_y, arg_max(bpx, frame_n) AS end_x, arg_max(bpy, frame_n) AS end_y FROM r WHERE bpx IS NOT NULL GROUP BY 1)
  SELECT e.*, receive_frame FROM e LEFT JOIN f USING (event_id)""")
def _(t):
    w = E.assist_windows(E.assists(t.match_events), t.ball)
    who = w.select("event_id", (F.col("match_id") * 14 + F.col("event_id") % 14).alias("player_id")).distinct()
    return E.pass_endpoints(w, t.tracks, who)


@query("flt_recent", "SELECT event_id, match_id, frame_n FROM match_events e WHERE frame_n >= (SELECT max(frame_n) FROM match_events m WHERE m.match_id = e.match_id) - 1125")
def _(t):
    return E.recent(t.match_events, 1125).select("event_id", "match_id", "frame_n")


@query("tk_recent", "SELECT event_id, match_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY seq DESC) AS rank FROM match_events) WHERE rank <= 20")
def _(t):
    return E.newest(t.match_events, 20).select("event_id", "match_id", "rank")


@query("tk_ring", "SELECT event_id, ts FROM match_events ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(t):
    return t.match_events.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts")


@query("tk_candidates", "SELECT match_id, frame_n, cand, conf_pct FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_n ORDER BY conf_pct DESC, cand) AS r FROM candidates) WHERE r <= 2")
def _(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("match_id", "frame_n").orderBy(F.desc("conf_pct"), "cand")
    return t.candidates.withColumn("r", F.row_number().over(w)).filter("r <= 2").select("match_id", "frame_n", "cand", "conf_pct")


@query("tk_sample", """WITH n AS (SELECT match_id, frame_n, row_number() OVER (PARTITION BY match_id ORDER BY frame_n) AS rn, count(*) OVER (PARTITION BY match_id) AS n FROM ball)
  SELECT DISTINCT match_id, frame_n, rn FROM (SELECT *, unnest(generate_series(0, 7)) AS i FROM n) WHERE rn = floor(i * (n - 1) / 7e0) + 1""")
def _(t):
    return E.evenly_spaced(t.ball.select("match_id", "frame_n"), 8)


@query("tk_every_nth", "SELECT match_id, frame_n, state FROM ball WHERE frame_n % 2 = 0")
def _(t):
    return t.ball.filter(F.pmod("frame_n", F.lit(2)) == 0).select("match_id", "frame_n", "state")


_PERF = f"SELECT player_id, team, count(*) AS n, {PCT(N('goal'), N('shot', 'goal'))} AS performance FROM match_events GROUP BY player_id, team"


@query("so_profiles", _PERF)
def _(t):
    d = t.match_events.groupBy("player_id", "team").agg(F.count(F.lit(1)).alias("n"), pct(count_if(E.kind("goal")), count_if(E.kind("shot", "goal"))).alias("performance"))
    return d.orderBy(F.desc("performance"), "team", "player_id")


@query("so_players", "SELECT player_id, player_name, number, club_id FROM players")
def _(t):
    return t.players.select("player_id", "player_name", "number", "club_id").orderBy("club_id", "number", "player_name")


@query("un_feeds", """SELECT 'rules' AS feed, event_id, event_type AS kind, team, CAST(NULL AS VARCHAR) AS level FROM match_events WHERE source = 'auto'
  UNION ALL SELECT 'tags', event_id, event_type, team, NULL FROM match_events WHERE source = 'manual' UNION ALL SELECT 'alerts', event_id, alert_type, NULL, 'x' FROM alert_texts""")
def _(t):
    m = t.match_events.select("event_id", F.col("event_type").alias("kind"), "team", "source")
    return E.feeds(rules=m.filter("source = 'auto'").drop("source"), tags=m.filter("source = 'manual'").drop("source"),
                   alerts=t.alert_texts.select("event_id", F.col("alert_type").alias("kind"), F.lit("x").alias("level"))).select("feed", "event_id", "kind", "team", "level")


@query("un_detections", """SELECT match_id, frame_n, 'player' AS kind, player_id AS ref, px AS x, py AS y FROM tracks UNION ALL SELECT match_id, frame_n, 'ball', NULL, bpx, bpy FROM ball WHERE bpx IS NOT NULL
  UNION ALL SELECT match_id, frame_n, 'candidate', cand, cx, cy FROM candidates""")
def _(t):
    return E.feeds(player=t.tracks.select("match_id", "frame_n", F.col("player_id").alias("ref"), F.col("px").alias("x"), F.col("py").alias("y")),
                   ball=t.ball.filter("bpx is not null").select("match_id", "frame_n", F.col("bpx").alias("x"), F.col("bpy").alias("y")),
                   candidate=t.candidates.select("match_id", "frame_n", F.col("cand").alias("ref"), F.col("cx").alias("x"), F.col("cy").alias("y"))).withColumnRenamed("feed", "kind")


@query("ag_distinct_events", "SELECT DISTINCT match_id, '[' || upper(replace(team, '_', ' ')) || '] ' || upper(replace(event_type, '_', ' ')) AS line FROM match_events")
def _(t):
    from matchloom.functions.text import event_text

    return t.match_events.select("match_id", event_text(F.col("team"), F.col("event_type")).alias("line")).distinct().orderBy("match_id", "line")


@query("ag_status_dedupe", "SELECT match_id, player_id, min(seq) AS seq, count(*) AS pushes FROM match_events GROUP BY ALL")
def _(t):
    return t.match_events.groupBy("match_id", "player_id").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("pushes"))


@query("ag_latency", f"""SELECT event_type, {r4('avg(value)')} AS mean, {r4('quantile_cont(value, 0.5)')} AS median, {r4('quantile_cont(value, 0.9)')} AS p90, max(value) AS max FROM events GROUP BY 1""")
def _(t):
    p = F.expr("percentile(value, array(0.5D, 0.9D))")
    return rounded(t.events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.get(p, F.lit(0)).alias("median"), F.get(p, F.lit(1)).alias("p90"), F.max("value").alias("max")), "mean", "median", "p90")


@query("ag_recall", f"""WITH f AS (SELECT match_id, frame_n, bool_or(cand = 0 AND conf_pct >= 40) AS one, bool_or(conf_pct >= 40) AS anyc FROM candidates GROUP BY ALL)
  SELECT b.match_id, {r1('100e0 * count(*) FILTER (one) / count(*)')} AS single_pct, {r1('100e0 * count(*) FILTER (anyc) / count(*)')} AS union_pct FROM ball b LEFT JOIN f USING (match_id, frame_n) GROUP BY 1""")
def _(t):
    ok = F.col("conf_pct") >= 40
    f = t.candidates.groupBy("match_id", "frame_n").agg(F.bool_or((F.col("cand") == 0) & ok).alias("one"), F.bool_or(ok).alias("any"))
    d = t.ball.select("match_id", "frame_n").join(f, ["match_id", "frame_n"], "left")
    share = lambda c: pct(count_if(F.coalesce(F.col(c), F.lit(False))), F.count(F.lit(1)))
    return d.groupBy("match_id").agg(share("one").alias("single_pct"), share("any").alias("union_pct"))


# ---- absence, overrides, jersey votes ---------------------------------------
ABS = """ab AS (SELECT match_id, player_id, frame_n AS last_seen, frame_n + 125 AS alert_frame FROM (SELECT t.*, lead(frame_n) OVER (PARTITION BY match_id, player_id ORDER BY frame_n) AS nx, max(frame_n) OVER (PARTITION BY match_id) AS e FROM tracks t)
  WHERE coalesce(nx, e) - frame_n >= 125)"""


@query("wn_absence", f"WITH {ABS} SELECT * FROM ab")
def _(t):
    return E.absences(t.tracks, ["match_id", "player_id"], 125)


@query("al_absent", f"WITH {ABS} SELECT match_id, player_id, alert_frame, 'substitution' AS alert FROM ab")
def _(t):
    return E.absences(t.tracks, ["match_id", "player_id"], 125).select("match_id", "player_id", "alert_frame", F.lit("substitution").alias("alert"))


@query("team_override", """SELECT match_id, frame_n, player_id AS track_id, CASE WHEN s_nationkey % 2 = 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'team_b' ELSE 'team_a' END ELSE team END AS team
  FROM tracks LEFT JOIN supplier ON s_suppkey = player_id""")
def _(t):
    o = t.supplier.select(F.col("s_suppkey").alias("track_id"), F.when(F.col("s_suppkey") % 3 == 0, "team_b").otherwise("team_a").alias("team"), (F.col("s_nationkey") % 2 == 0).alias("locked"))
    return R.override_team(t.tracks.select("match_id", "frame_n", F.col("player_id").alias("track_id"), "team"), o)


@query("jn_label_join", """SELECT match_id, frame_n, t.player_id, coalesce(p.player_name, '#' || t.slot) AS label FROM tracks t LEFT JOIN players p ON p.player_id = t.player_id""")
def _(t):
    return t.tracks.join(t.players.select("player_id", "player_name"), "player_id", "left").select(
        "match_id", "frame_n", "player_id", F.coalesce("player_name", F.concat(F.lit("#"), F.col("slot").cast("string"))).alias("label"))


@query("jn_number_restore", """WITH r AS (SELECT match_id, frame_n, player_id, player_id % 10 + 1 AS number, row_number() OVER (PARTITION BY match_id, frame_n, player_id % 10 ORDER BY player_id) AS r FROM tracks)
  SELECT match_id, frame_n, player_id, CASE WHEN r = 1 THEN number END AS number FROM r""")
def _(t):
    d = t.tracks.select("match_id", "frame_n", "player_id", (F.col("player_id") % 10 + 1).alias("number"))
    own = d.groupBy("match_id", "frame_n", "number").agg(F.min("player_id").alias("owner"))
    return d.join(own, ["match_id", "frame_n", "number"]).select("match_id", "frame_n", "player_id", F.when(F.col("player_id") == F.col("owner"), F.col("number")).alias("number"))


@query("ag_jersey_vote", """WITH v AS (SELECT match_id, track_id, CAST(raw_text AS BIGINT) AS number, CAST(sum(conf_pct) AS BIGINT) AS v FROM jersey_reads
   WHERE CASE WHEN regexp_full_match(raw_text, '[0-9]{1,2}') THEN CAST(raw_text AS BIGINT) BETWEEN 1 AND 99 ELSE false END AND conf_pct >= 55 GROUP BY ALL),
  k AS (SELECT *, row_number() OVER w AS r, coalesce(lead(v) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY match_id, track_id ORDER BY v DESC, number)),
  o AS (SELECT *, row_number() OVER (PARTITION BY match_id, number ORDER BY v DESC, track_id) AS o FROM k WHERE r = 1 AND v >= 250 AND v - second >= 150)
  SELECT match_id, track_id, number, v AS votes FROM o WHERE o = 1""")
def _(t):
    from matchloom.functions.text import jersey_number

    r = t.jersey_reads.withColumn("number", jersey_number(F.col("raw_text"), F.col("conf_pct") / 100.0)).filter("number is not null").withColumn("conf", F.col("conf_pct"))
    return R.jersey_votes(r, lock=250, margin=150).withColumn("votes", F.col("votes").cast("bigint"))


# ---- record maintenance ------------------------------------------------------
_ORD = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_LAST = f"la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(c + ' DESC' for c in _ORD)}) AS r FROM lineitem) WHERE r = 1)"


@query("mt_shot_edit", f"""WITH {_LAST} SELECT o_orderkey AS shot_id, CASE WHEN l_returnflag = 'N' THEN 'SAVE' ELSE o_orderstatus END AS outcome, coalesce(l_suppkey, o_custkey) AS player_id
  FROM orders LEFT JOIN la ON l_orderkey = o_orderkey WHERE NOT coalesce(l_linestatus = 'F' AND l_returnflag = 'R', false)""")
def _(t):
    base = t.orders.select(F.col("o_orderkey").alias("shot_id"), F.col("o_orderstatus").alias("outcome"), F.col("o_custkey").alias("player_id"))
    ch = t.lineitem.select(F.col("l_orderkey").alias("shot_id"), F.when(F.col("l_returnflag") == "N", "SAVE").alias("outcome"), F.col("l_suppkey").alias("player_id"),
                           ((F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")).alias("deleted"), *_ORD)
    return R.apply_edits(base, ch, "shot_id", F.struct(*_ORD), ["outcome", "player_id"])


@query("mt_event_edit", """WITH ch AS (SELECT (event_id * 7) % (SELECT count(*) FROM events) AS target, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS et, event_type = 'error' AS del FROM events WHERE value > 20),
  la AS (SELECT target, arg_max(coalesce(et, ''), event_id) AS et, arg_max(del, event_id) AS del FROM ch GROUP BY 1)
  SELECT e.event_id, coalesce(nullif(et, ''), e.event_type) AS event_type FROM events e LEFT JOIN la ON target = e.event_id WHERE NOT coalesce(del, false)""")
def _(t):
    n = t.events.count()
    ch = t.events.filter("value > 20").select((F.col("event_id") * 7 % n).alias("event_id"), F.col("event_id").alias("at"),
                                              F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), (F.col("event_type") == "error").alias("deleted"))
    return R.apply_edits(t.events.select("event_id", "event_type"), ch, "event_id", F.col("at"), ["event_type"])


@query("mt_entity", """SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS name, arg_max(props, event_id) FILTER (value >= 30) AS note FROM events GROUP BY 1""")
def _(t):
    ch = t.events.select("user_id", "event_id", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("name"),
                         F.when(F.col("value") >= 30, F.col("props")).otherwise("").alias("note"))
    return R.partial_update(ch, "user_id", F.col("event_id"), ["name", "note"])


@query("mt_rename_delete", """WITH gone AS (SELECT s_suppkey AS player_id FROM supplier WHERE s_acctbal < 0)
  SELECT vec_id, v.player_id, 'P-' || v.player_id AS name FROM vectors v WHERE player_id NOT IN (SELECT player_id FROM gone)""")
def _(t):
    gone = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("player_id"))
    return t.vectors.join(gone, "player_id", "left_anti").select("vec_id", "player_id", F.concat(F.lit("P-"), F.col("player_id").cast("string")).alias("name"))


@query("mt_insert_ignore", """SELECT club_name FROM clubs UNION SELECT DISTINCT 'NATION_' || (c_nationkey + 10) FROM customer""")
def _(t):
    new = t.customer.select(F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 10).cast("string")).alias("club_name"))
    return R.insert_ignore(t.clubs.select("club_name"), new, "club_name")


@query("mt_clear", """SELECT event_id, match_id, event_type FROM match_events WHERE match_id NOT IN (SELECT match_id FROM match_events WHERE event_type = 'goal' GROUP BY 1 HAVING count(*) > 62)""")
def _(t):
    cleared = t.match_events.filter(E.kind("goal")).groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 62")
    return t.match_events.join(cleared, "match_id", "left_anti").select("event_id", "match_id", "event_type")


@query("mt_flip_swap", """SELECT event_id, match_id, team, CASE WHEN count(*) FILTER (event_type = 'period_end') OVER w % 2 = 1 THEN CASE team WHEN 'team_a' THEN 'team_b' ELSE 'team_a' END ELSE team END AS left_team
  FROM match_events WINDOW w AS (PARTITION BY match_id ORDER BY seq)""")
def _(t):
    d = scan(t.match_events.select("event_id", "match_id", "seq", "team", "event_type"), ["match_id"], "seq", sums={"flips": E.kind("period_end").cast("bigint")})
    return d.select("event_id", "match_id", "team", F.when(F.col("flips") % 2 == 1, C.opponent(F.col("team"))).otherwise(F.col("team")).alias("left_team"))


@query("mt_config_merge", """WITH d AS (SELECT p_brand || '.' || p_type AS key, max(p_size) AS value FROM part GROUP BY 1), o AS (SELECT p_brand || '.' || p_name AS key, max(p_size) + 100 AS value FROM part GROUP BY 1
   UNION ALL SELECT p_brand || '.' || p_type, 7 FROM part WHERE p_size > 45 GROUP BY 1)
  SELECT key, coalesce(o.value, d.value) AS value FROM d FULL JOIN o USING (key)""")
def _(t):
    path = lambda c: F.concat_ws(".", "p_brand", c).alias("key")
    d = t.part.groupBy(path("p_type")).agg(F.max("p_size").alias("value"))
    o = t.part.groupBy(path("p_name")).agg((F.max("p_size") + 100).alias("value")).unionByName(
        t.part.filter("p_size > 45").select(path("p_type")).distinct().withColumn("value", F.lit(7)))
    return R.merge_params(d, o)
