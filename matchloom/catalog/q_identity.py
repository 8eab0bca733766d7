"""Vector search, galleries, track stitching, team colours."""

from pyspark.sql import functions as F

from matchloom.catalog.registry import query, r4
from matchloom.functions import vectors as V
from matchloom.functions.common import count_if, r4 as c4
from matchloom.operators import colours as CO, identity as I
from matchloom.operators.motion import rounded
from matchloom.plans import inverted as IV
from matchloom.plans.knn import assign_greedy, chain_roots, top_k
from matchloom.plans.ordered import number_rows

ALL = """a AS MATERIALIZED (SELECT q.vec_id AS query_id, g.vec_id, g.player_id, q.player_id AS own_id, list_cosine_similarity(CAST(q.vec AS DOUBLE[]), CAST(g.vec AS DOUBLE[])) AS sim FROM vectors q JOIN vectors g ON g.vec_id <> q.vec_id)"""


def HITS(k):
    return f"{ALL}, h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM a) WHERE rank <= {k})"


def SCORES(k, best, least, where="true"):
    return f"""{HITS(k)}, n AS (SELECT player_id FROM vectors GROUP BY 1 HAVING count(*) >= {least}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, player_id ORDER BY sim DESC, vec_id) AS r FROM h WHERE player_id IN (FROM n) AND {where}),
  sc AS (SELECT query_id, player_id, avg(sim) AS score FROM r WHERE r <= {best} GROUP BY ALL)"""


DECIDE = """de AS (SELECT *, row_number() OVER w AS r, coalesce(lead(score) OVER w, 0) AS second FROM sc WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, player_id))"""


@query("vs_topk", f"WITH {HITS(5)} SELECT query_id, vec_id, rank, {r4('sim')} AS sim FROM h")
def _(t):
    d = top_k(I.as_queries(t.vectors), t.vectors, 5)
    return d.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), c4(F.col("sim")).alias("sim"))


@query("vs_topk_indexed")
def _(t):
    index = IV.build(t.vectors, lists=32)
    queries = I.as_queries(t.vectors)
    d = IV.search(index, queries, 5, IV.probes_for(index, queries, 5))
    return d.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), c4(F.col("sim")).alias("sim"))


@query("vs_match", f"WITH {SCORES(64, 8, 3)}, {DECIDE} SELECT query_id, player_id, {r4('score')} AS score, {r4('least(1e0, (score - second) * 4)')} AS confidence FROM de WHERE r = 1 AND score >= 0.1e0")
def _(t):
    return rounded(I.match(I.as_queries(t.vectors), t.vectors, accept=0.1), "score", "confidence").drop("second")


@query("vs_cross_session", f"WITH {SCORES(32, 8, 3, 'player_id <> 4')}, {DECIDE} SELECT query_id, player_id, {r4('score')} AS score FROM de WHERE r = 1 AND score >= 0.2e0")
def _(t):
    ex = t.supplier.filter("s_suppkey = 4").select(F.col("s_suppkey").alias("player_id"))
    return rounded(I.match(I.as_queries(t.vectors), t.vectors, k=32, accept=0.2, exclude=ex), "score").select("query_id", "player_id", "score")


@query("vs_direct", f"WITH {SCORES(16, 3, 1, 'sim > 0')}, {DECIDE} SELECT query_id, player_id, {r4('score')} AS score FROM de WHERE r = 1 AND score >= 0.2e0 AND player_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def _(t):
    active = t.supplier.filter("s_acctbal < 0").select(F.col("s_suppkey").alias("player_id"))
    return rounded(I.direct(I.as_queries(t.vectors), t.vectors, active, accept=0.2), "score")


ASP = "ap AS (SELECT player_id, 1.5e0 + player_id % 5 / 10e0 AS aspect FROM players), aq AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 6 > 0 THEN 1.4e0 + vec_id % 7 / 10e0 END AS q_aspect FROM vectors)"


@query("vs_recognize", f"""WITH {SCORES(64, 8, 5).replace('sc AS (', 's0 AS (')}, {ASP}, sc AS (SELECT query_id, player_id, CASE WHEN aspect > 0 AND q_aspect > 0 THEN score * 0.85e0 + (1e0 - least(abs(q_aspect - aspect) / greatest(q_aspect, aspect), 1e0)) * 0.15e0 ELSE score END AS score
  FROM s0 LEFT JOIN ap USING (player_id) LEFT JOIN aq USING (query_id)), {DECIDE} SELECT query_id, player_id, {r4('score')} AS score, {r4('least(1e0, (score - second) * 4)')} AS confidence FROM de WHERE r = 1 AND score >= 0.2e0""")
def _(t):
    ap = t.players.select("player_id", (F.col("player_id") % 5 / 10.0 + 1.5).alias("aspect"))
    aq = t.vectors.select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 6 > 0, F.col("vec_id") % 7 / 10.0 + 1.4).alias("q_aspect"))
    return rounded(I.recognise(I.as_queries(t.vectors), t.vectors, ap, aq, accept=0.2), "score", "confidence").drop("second")


@query("vs_profile_match", f"WITH {HITS(1)} SELECT query_id, player_id, {r4('sim')} AS score FROM h WHERE sim > 0.3e0")
def _(t):
    return rounded(I.best_sample(I.as_queries(t.vectors), t.vectors, 0.3), "score")


@query("vs_best_of_n", f"WITH {ALL}, b AS (SELECT query_id, arg_max(player_id, (sim, -vec_id)) AS player_id, max(sim) AS s FROM a WHERE player_id % 2 = own_id % 2 GROUP BY 1) SELECT query_id, player_id, {r4('s')} AS score FROM b WHERE s > 0.3e0")
def _(t):
    return rounded(I.best_of_team(t.vectors.withColumn("team", F.col("player_id") % 2), 0.3), "score")


PROTO = f"""u AS (SELECT player_id, vec_id, conf_pct, frame_n, generate_subscripts(vec, 1) - 1 AS pos, unnest(CAST(vec AS DOUBLE[])) / (sqrt(list_sum([x*x FOR x IN CAST(vec AS DOUBLE[])])) + 1e-8) AS x, unnest(CAST(vec AS DOUBLE[])) AS raw FROM vectors),
  pr AS (SELECT player_id, pos, v / (sqrt(sum(v*v) OVER (PARTITION BY player_id)) + 1e-8) AS value FROM (SELECT player_id, pos, avg(x) AS v FROM u GROUP BY ALL))"""


@query("ag_prototype", f"WITH {PROTO} SELECT player_id, CAST(pos AS BIGINT) AS pos, {r4('value')} AS value FROM pr")
def _(t):
    return rounded(I.prototypes(t.vectors), "value").withColumn("pos", F.col("pos").cast("bigint"))


@query("vs_prototype_dist", f"WITH {PROTO}, pa AS (SELECT player_id, list(value ORDER BY pos) AS p FROM pr GROUP BY 1) SELECT vec_id, {r4('list_cosine_similarity(CAST(vec AS DOUBLE[]), p)')} AS cosine FROM vectors JOIN pa USING (player_id)")
def _(t):
    p = I.as_arrays(I.prototypes(t.vectors), "player_id").withColumnRenamed("vec", "proto")
    return t.vectors.join(p, "player_id", "left").select("vec_id", c4(V.cosine(F.col("vec"), F.col("proto"))).alias("cosine"))


_last = "(SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY frame_n DESC, vec_id DESC) AS r FROM vectors)"


@query("ag_mean_vector", f"""WITH {PROTO}, l AS (SELECT vec_id FROM {_last} WHERE r <= 10), m AS (SELECT player_id, pos, avg(x) AS v FROM u WHERE vec_id IN (FROM l) GROUP BY ALL)
  SELECT player_id, CAST(pos AS BIGINT) AS pos, {r4('v / (sqrt(sum(v*v) OVER (PARTITION BY player_id)) + 1e-8)')} AS value FROM m""")
def _(t):
    return rounded(I.mean_of_last(t.vectors), "value").withColumn("pos", F.col("pos").cast("bigint"))


@query("ag_vector_ema", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY frame_n, vec_id) AS rn, CAST(vec AS DOUBLE[]) AS d FROM vectors WHERE conf_pct >= 65),
  e AS (SELECT player_id, rn, d AS v FROM n WHERE rn = 1 UNION ALL SELECT e.player_id, n.rn, [z[1] * 0.75e0 + z[2] * 0.25e0 FOR z IN list_zip(e.v, n.d)] FROM e JOIN n ON n.player_id = e.player_id AND n.rn = e.rn + 1),
  f AS (SELECT player_id, arg_max(v, rn) AS v FROM e GROUP BY 1) SELECT player_id, CAST(generate_subscripts(v, 1) - 1 AS BIGINT) AS pos, {r4('unnest(v)')} AS value FROM f""")
def _(t):
    return rounded(I.vector_ema(t.vectors), "value").withColumn("pos", F.col("pos").cast("bigint"))


@query("ag_aspect_median", f"""WITH l AS (SELECT match_id, player_id, (40 + noise % 30) * 1e0 / h_px AS aspect, row_number() OVER (PARTITION BY match_id, player_id ORDER BY frame_n DESC) AS r FROM tracks)
  SELECT match_id, player_id, {r4('quantile_cont(aspect, 0.5)')} AS aspect FROM l WHERE r <= 64 GROUP BY ALL""")
def _(t):
    return rounded(I.aspect_median(t.tracks.withColumn("aspect", (F.col("noise") % 30 + 40) / F.col("h_px"))), "aspect")


@query("ag_gallery_stats", "WITH n AS (SELECT player_id, count(*) AS n FROM vectors GROUP BY 1) SELECT count(*) AS players, count(*) FILTER (n >= 50) AS enrolled, CAST(sum(n) AS BIGINT) AS vectors FROM n")
def _(t):
    return I.enough_samples(t.vectors, 1).agg(F.count(F.lit(1)).alias("players"), count_if(F.col("samples") >= 50).alias("enrolled"), F.sum("samples").alias("vectors"))


@query("flt_min_samples", "SELECT vec_id, player_id FROM vectors WHERE player_id IN (SELECT player_id FROM vectors GROUP BY 1 HAVING count(*) >= 50)")
def _(t):
    return t.vectors.join(I.enough_samples(t.vectors, 50), "player_id", "left_semi").select("vec_id", "player_id")


@query("wn_gallery_roll", f"SELECT player_id, vec_id FROM {_last} WHERE r <= 30")
def _(t):
    return I.last_n(t.vectors, "player_id", 30).select("player_id", "vec_id")


@query("wn_gallery_diverse")
def _(t):
    return I.diverse_gallery(t.vectors, limit=0.5)


def _reads(t):
    return t.tracks.select("match_id", F.col("player_id").alias("track_id"), "frame_n", ((F.col("noise") + F.col("slot")) % 3).alias("best_id"), (F.col("conf_pct") / 100.0).alias("conf"))


@query("wn_identity_lock")
def _(t):
    return I.identity_lock(_reads(t))


@query("wn_enroll", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY match_id, player_id ORDER BY frame_n) AS rn FROM tracks)
  SELECT match_id, player_id, team, frame_n, row_number() OVER (PARTITION BY match_id, team ORDER BY frame_n, slot) AS number FROM n WHERE rn = 45""")
def _(t):
    return I.enrolments(t.tracks)


PIECES = """g0 AS (SELECT *, CASE WHEN frame_n - lag(frame_n) OVER w > 1 THEN 1 ELSE 0 END AS st FROM tracks WINDOW w AS (PARTITION BY match_id, player_id ORDER BY frame_n)),
  g1 AS (SELECT *, 1 + sum(st) OVER (PARTITION BY match_id, player_id ORDER BY frame_n) AS seg FROM g0),
  pc AS (SELECT match_id, CAST(player_id AS BIGINT) * 4294967296 + CAST(seg AS BIGINT) AS tid, player_id, seg, any_value(team) AS team, any_value(h_px) AS h_px, min(frame_n) AS f0, arg_min(px, frame_n) AS x0, arg_min(py, frame_n) AS y0, max(frame_n) AS f1, arg_max(px, frame_n) AS x1, arg_max(py, frame_n) AS y1,
   (arg_max(px, frame_n) - arg_min(px, frame_n)) * 1e0 / greatest(max(frame_n) - min(frame_n), 1) AS vx, (arg_max(py, frame_n) - arg_min(py, frame_n)) * 1e0 / greatest(max(frame_n) - min(frame_n), 1) AS vy FROM g1 GROUP BY match_id, player_id, seg),
  pv AS MATERIALIZED (SELECT pc.*, CAST(vec AS DOUBLE[]) AS vec FROM pc LEFT JOIN vectors ON vec_id = (pc.player_id * 7 + seg) % (SELECT count(*) FROM vectors))"""
_cos = "CASE WHEN n.vec IS NULL OR l.vec IS NULL THEN 0e0 ELSE list_cosine_similarity(n.vec, l.vec) END"


@query("jn_lost_match", f"""WITH {PIECES}, s AS (SELECT n.match_id, n.tid AS a, l.tid AS b, {_cos} * 0.7e0 + exp(-(pow(n.x0 - l.x1 - l.vx * (n.f0 - l.f1), 2) + pow(n.y0 - l.y1 - l.vy * (n.f0 - l.f1), 2)) / 45000e0) * 0.3e0 AS score
   FROM pv n JOIN pv l ON l.match_id = n.match_id AND n.f0 BETWEEN l.f1 + 1 AND l.f1 + 100)
  SELECT match_id, a, arg_max(b, (score, -b)) AS b, {r4('max(score)')} AS score FROM s WHERE score >= 0.3e0 GROUP BY match_id, a""")
def _(t):
    p = I.with_vectors(I.tracklets(t.tracks, split=1), t.vectors)
    return rounded(I.lost_matches(p, t.vectors, accept=0.3), "score")


_pred = lambda c: f"(l.{c}1 + l.v{c} * least(n.f0 - l.f1, 6) + l.v{c} * 0.92e0 * (1 - pow(0.92e0, greatest(n.f0 - l.f1 - 6, 0))) / 0.08e0)"
TSCORE = f"""{PIECES}, s AS (SELECT n.match_id, n.tid AS a, l.tid AS b, sqrt(pow(n.x0 - {_pred('x')}, 2) + pow(n.y0 - {_pred('y')}, 2)) AS away, 180e0 + 8e0 * greatest(n.f0 - l.f1 - 6, 0) AS reach, {_cos} AS cs,
    CASE WHEN n.vec IS NULL OR l.vec IS NULL THEN 0e0 ELSE (SELECT corr(abs(x), abs(y)) FROM (SELECT unnest(n.vec[1:8]) AS x, unnest(l.vec[1:8]) AS y)) END AS co,
    abs(n.h_px - l.h_px) * 1e0 / greatest(n.h_px, l.h_px) AS pr, n.team = l.team AS same FROM pv n JOIN pv l ON l.match_id = n.match_id AND n.f0 BETWEEN l.f1 + 1 AND l.f1 + 90),
  s2 AS (SELECT match_id, a, b, same, greatest(0e0, 1 - away / reach) * 0.35e0 + greatest(0e0, cs) * 0.35e0 + greatest(0e0, co) * 0.2e0 + greatest(0e0, 1 - pr * 3) * 0.1e0 AS score FROM s WHERE away <= reach * 2),
  ts AS (SELECT match_id, a, b, CASE WHEN same THEN least(1e0, score + 0.05e0) ELSE score END AS score FROM s2)"""


@query("jn_tracklet_score", f"WITH {TSCORE} SELECT match_id, a, b, {r4('score')} AS score FROM ts WHERE score >= 0.2e0")
def _(t):
    p = I.with_vectors(I.tracklets(t.tracks, split=1), t.vectors)
    return rounded(I.piece_scores(p, t.vectors, accept=0.2), "score")


@query("jn_greedy_assign")
def _(t):
    p = I.with_vectors(I.tracklets(t.tracks, split=1), t.vectors)
    return rounded(assign_greedy(I.piece_scores(p, t.vectors, accept=0.2)), "score")


@query("id_stitch", f"""WITH RECURSIVE {PIECES}, e AS (SELECT tid, lag(tid) OVER w AS p, f0 - lag(f1) OVER w AS gap FROM pc WINDOW w AS (PARTITION BY match_id, player_id ORDER BY seg)),
  r AS (SELECT tid AS id, tid AS root FROM e WHERE p IS NULL OR gap > 90 UNION ALL SELECT e.tid, r.root FROM r JOIN e ON e.p = r.id AND e.gap <= 90) SELECT id, root FROM r WHERE id <> root""")
def _(t):
    p = I.tracklets(t.tracks, split=1)
    prev = p.select("match_id", "player_id", (F.col("seg") + 1).alias("seg"), F.col("tid").alias("parent"), F.col("f1").alias("pf1"))
    e = p.join(prev, ["match_id", "player_id", "seg"]).filter(F.col("f0") - F.col("pf1") <= 90).select(F.col("tid").alias("id"), "parent")
    return chain_roots(e)


@query("vs_hist", f"""WITH RECURSIVE n AS MATERIALIZED (SELECT player_id, vec_id, row_number() OVER (PARTITION BY player_id ORDER BY frame_n, vec_id) AS rn, [abs(x) FOR x IN CAST(vec AS DOUBLE[])[1:8]] AS d FROM vectors),
  e AS (SELECT player_id, rn, d AS v FROM n WHERE rn = 1 UNION ALL SELECT e.player_id, n.rn, [z[1] * 0.7e0 + z[2] * 0.3e0 FOR z IN list_zip(e.v, n.d)] FROM e JOIN n ON n.player_id = e.player_id AND n.rn = e.rn + 1),
  f AS (SELECT player_id, arg_max(v, rn) AS g FROM e GROUP BY 1),
  s AS (SELECT vec_id, f.player_id, list_cosine_similarity([x - list_avg(d) FOR x IN d], [x - list_avg(g) FOR x IN g]) AS score FROM n, f)
  SELECT vec_id, arg_max(player_id, (score, -player_id)) AS player_id, {r4('max(score)')} AS score FROM s WHERE score >= 0.72e0 GROUP BY 1""")
def _(t):
    return CO.histogram_match(t.vectors)


@query("ex_lost", "SELECT match_id, player_id, frame_n FROM tracks a WHERE NOT EXISTS (SELECT 1 FROM tracks b WHERE b.match_id = a.match_id AND b.player_id = a.player_id AND b.frame_n = a.frame_n + 1)")
def _(t):
    nxt = t.tracks.select("match_id", "player_id", (F.col("frame_n") - 1).alias("frame_n"))
    return t.tracks.select("match_id", "player_id", "frame_n").join(nxt, ["match_id", "player_id", "frame_n"], "left_anti")


@query("ex_unmatched", """SELECT 'track' AS side, player_id FROM (SELECT DISTINCT player_id FROM tracks) WHERE player_id NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'slot', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT player_id FROM tracks)""")
def _(t):
    a, b = t.tracks.select("player_id").distinct(), t.supplier.select(F.col("s_suppkey").alias("player_id"))
    return a.join(b, "player_id", "left_anti").select(F.lit("track").alias("side"), "player_id").unionByName(
        b.join(a, "player_id", "left_anti").select(F.lit("slot").alias("side"), "player_id"))


@query("flt_confirmed", """WITH e AS (SELECT match_id, max(frame_n) AS e FROM tracks GROUP BY 1) SELECT match_id, player_id, count(*) AS seen FROM tracks JOIN e USING (match_id) GROUP BY ALL HAVING count(*) >= 6 AND max(frame_n) < any_value(e)""")
def _(t):
    end = t.tracks.groupBy("match_id").agg(F.max("frame_n").alias("e"))
    g = t.tracks.groupBy("match_id", "player_id").agg(F.count(F.lit(1)).alias("seen"), F.max("frame_n").alias("last"))
    return g.join(end, "match_id").filter((F.col("seen") >= 6) & (F.col("last") < F.col("e"))).select("match_id", "player_id", "seen")


@query("flt_protected", "SELECT vec_id, player_id FROM vectors WHERE player_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _(t):
    keep = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("player_id"))
    return t.vectors.join(keep, "player_id", "left_anti").select("vec_id", "player_id")


@query("ag_team_cluster")
def _(t):
    return CO.team_clusters(CO.colour_rows(t.tracks))


@query("ag_team_assign", """WITH c AS (SELECT match_id, frame_n, player_id, slot IN (0, 7) AS k, team, 60 + noise % 9 AS l, noise2 % 11 AS d FROM tracks), f AS (SELECT match_id, frame_n, player_id, l + CASE WHEN k THEN 120 ELSE 0 END AS l, CASE WHEN k THEN 128 WHEN team = 'team_a' THEN 200 ELSE 60 END + d AS a, CASE WHEN k THEN 200 WHEN team = 'team_a' THEN 90 ELSE 160 END - d AS b FROM c),
  d AS (SELECT *, pow(l-64,2)+pow(a-205,2)+pow(b-85,2) AS da, pow(l-64,2)+pow(a-65,2)+pow(b-155,2) AS db, pow(l-184,2)+pow(a-133,2)+pow(b-195,2) AS dg FROM f)
  SELECT match_id, frame_n, player_id, CASE WHEN da <= db AND da <= dg THEN 'team_a' WHEN db <= dg THEN 'team_b' ELSE 'goalkeeper' END AS team FROM d""")
def _(t):
    centres = {"team_a": (64, 205, 85), "team_b": (64, 65, 155), "goalkeeper": (184, 133, 195)}
    return CO.assign_team(CO.colour_rows(t.tracks), centres).select("match_id", "frame_n", "player_id", "team")
