"""Appearance vectors: search, few-shot matching, galleries, track stitching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from matchloom.functions import vectors as V
from matchloom.functions.common import dist
from matchloom.plans.knn import top_k
from matchloom.plans.ordered import number_rows, segments
from matchloom.plans.ranges import interval_join
from matchloom.plans.stateful import fold_rows
from matchloom.session import cut_lineage


def as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), "vec")


def enough_samples(vectors: DataFrame, n: int) -> DataFrame:
    """Players with at least n vectors (counted map-side, no window over a player)."""
    return vectors.groupBy("player_id").agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples") >= n)


def player_scores(hits: DataFrame, best: int) -> DataFrame:
    """Mean of the ``best`` highest hits per query and player; hits are at most k per query."""
    w = W.partitionBy("query_id", "player_id").orderBy(F.desc("sim"), "vec_id")
    d = hits.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= best)
    return d.groupBy("query_id", "player_id").agg(F.avg("sim").alias("score"))


def decide(scores: DataFrame, accept: float) -> DataFrame:
    """Best and second player of every query; accepted from ``accept`` on, with a margin confidence."""
    key = F.struct("score", (-F.col("player_id")).alias("neg"))
    top = F.slice(F.sort_array(F.collect_list(key), asc=False), 1, 2)  # at most k players per query
    d = scores.groupBy("query_id").agg(top.alias("t"))
    best, second = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    d = d.select("query_id", (-best["neg"]).alias("player_id"), best["score"].alias("score"), F.coalesce(second["score"], F.lit(0.0)).alias("second"))
    return d.filter(F.col("score") >= accept).withColumn("confidence", F.least(F.lit(1.0), (F.col("score") - F.col("second")) * 4.0))


def match(queries: DataFrame, vectors: DataFrame, k: int = 64, best: int = 8, accept: float = 0.50, min_samples: int = 3, exclude: DataFrame | None = None) -> DataFrame:
    hits = top_k(queries, vectors, k).join(enough_samples(vectors, min_samples).select("player_id"), "player_id", "left_semi")
    if exclude is not None:
        hits = hits.join(exclude, "player_id", "left_anti")
    return decide(player_scores(hits, best), accept)


def direct(queries: DataFrame, vectors: DataFrame, active: DataFrame, k: int = 16, best: int = 3, accept: float = 0.65) -> DataFrame:
    hits = top_k(queries, vectors, k).filter(F.col("sim") > 0)
    d = decide(player_scores(hits, best), accept)
    return d.join(active, "player_id", "left_anti").select("query_id", "player_id", "score")


def recognise(queries: DataFrame, vectors: DataFrame, aspects: DataFrame, query_aspect: DataFrame, weight: float = 0.15, accept: float = 0.50) -> DataFrame:
    """Few-shot scores blended with body-proportion similarity where both sides have one."""
    hits = top_k(queries, vectors, 64).join(enough_samples(vectors, 5).select("player_id"), "player_id", "left_semi")
    s = player_scores(hits, 8).join(aspects, "player_id", "left").join(query_aspect, "query_id", "left")
    p, q = F.col("aspect"), F.col("q_aspect")
    sim = 1.0 - F.least(F.abs(q - p) / F.greatest(q, p), F.lit(1.0))
    return decide(s.withColumn("score", F.when((p > 0) & (q > 0), F.col("score") * (1 - weight) + sim * weight).otherwise(F.col("score"))), accept)


def best_sample(queries: DataFrame, vectors: DataFrame, accept: float) -> DataFrame:
    """Single best stored vector of every query above ``accept``."""
    return top_k(queries, vectors, 1).filter(F.col("sim") > accept).select("query_id", "player_id", F.col("sim").alias("score"))


def best_of_team(vectors: DataFrame, accept: float = 0.68, team: str = "team") -> DataFrame:
    """Best vector within the query's own team, so teams never mix."""
    queries = vectors.select(F.col("vec_id").alias("query_id"), "vec", team)
    return top_k(queries, vectors, 1, within=team).filter(F.col("sim") > accept).select("query_id", "player_id", F.col("sim").alias("score"))


# ---- element-wise aggregates --------------------------------------------------
def weighted_vector(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, pos, value): weighted element-wise mean; element sums combine map-side."""
    d = rows.select(key, weight.alias("_w"), F.posexplode("vec").alias("pos", "x"))
    d = d.groupBy(key, "pos").agg((F.sum(F.col("_w") * F.col("x").cast("double")) / F.sum("_w")).alias("value"))
    return d


def renormalise(d: DataFrame, key: str) -> DataFrame:
    n = d.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    return d.join(n, key).select(key, "pos", (F.col("value") / (F.col("_n") + 1e-8)).alias("value"))


def prototypes(vectors: DataFrame) -> DataFrame:
    """Normalise rows, average, normalise again."""
    v = vectors.select("player_id", V.normalise(F.col("vec")).alias("vec"))
    return renormalise(weighted_vector(v, "player_id", F.lit(1.0)), "player_id")


def as_arrays(d: DataFrame, key: str) -> DataFrame:
    vals = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"])  # one vector's elements
    return d.groupBy(key).agg(vals.alias("vec"))


def last_n(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Newest n rows per key; the rank limit prunes map-side before the shuffle."""
    w = W.partitionBy(key).orderBy(F.desc("frame_n"), F.desc("vec_id"))
    ranked = rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)  # a plain rank, or Spark sets no limit
    return ranked.withColumn("back", F.col("back") - 1)


def mean_of_last(vectors: DataFrame, n: int = 10) -> DataFrame:
    v = last_n(vectors, "player_id", n).select("player_id", V.normalise(F.col("vec")).alias("vec"))
    return renormalise(weighted_vector(v, "player_id", F.lit(1.0)), "player_id")


def blend_weights(rows: DataFrame, key: str, keep: float) -> DataFrame:
    """Adds ``_w``, the weight of every row in the blend keep x old + (1 - keep) x new of its key.

    Rows are numbered in blocks, so a hot key spreads; the first row carries the rest of the weight.
    """
    d = number_rows(rows, [key], "frame_n", "_n", tie="vec_id").join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_t")), key)
    w = F.pow(F.lit(keep), F.col("_t") - F.col("_n")) * F.when(F.col("_n") == 1, F.lit(1.0)).otherwise(F.lit(1.0 - keep))
    return d.withColumn("_w", w)


def vector_ema(vectors: DataFrame, keep: float = 0.75, min_conf: int = 65) -> DataFrame:
    """Blend keep x old + (1 - keep) x new over confident samples."""
    d = blend_weights(vectors.filter(F.col("conf_pct") >= min_conf), "player_id", keep)
    d = d.select("player_id", "_w", F.posexplode("vec").alias("pos", "x"))
    return d.groupBy("player_id", "pos").agg(F.sum(F.col("_w") * F.col("x").cast("double")).alias("value"))


def aspect_median(rows: DataFrame, n: int = 64) -> DataFrame:
    w = W.partitionBy("match_id", "player_id").orderBy(F.desc("frame_n"))
    d = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return d.groupBy("match_id", "player_id").agg(F.expr("percentile(aspect, 0.5D)").alias("aspect"))


# ---- galleries ----------------------------------------------------------------
def diverse_gallery(vectors: DataFrame, size: int = 12, limit: float = 0.88) -> DataFrame:
    """Keep a vector only if it differs from the gallery; a full gallery replaces its most redundant one."""
    def start():
        return {"ids": [], "m": np.zeros((0, 0))}

    def step(st, row):
        if row is None:
            return st, [{"vec_id": int(i)} for i in st["ids"]]
        v = np.asarray(row["vec"], dtype=np.float64)
        v = v / max(float(np.sqrt(v @ v)), 1e-12)
        if not st["ids"]:
            return {"ids": [row["vec_id"]], "m": v[None, :]}, []
        if float((st["m"] @ v).max()) >= limit:
            return st, []
        if len(st["ids"]) < size:
            return {"ids": st["ids"] + [row["vec_id"]], "m": np.vstack([st["m"], v])}, []
        sims = st["m"] @ st["m"].T
        np.fill_diagonal(sims, -np.inf)
        worst = sims.max(axis=1)
        at = len(worst) - 1 - int(np.argmax(worst[::-1]))
        ids, m = list(st["ids"]), st["m"].copy()
        ids[at], m[at] = row["vec_id"], v
        return {"ids": ids, "m": m}, []

    return fold_rows(vectors.select("player_id", "frame_n", "vec_id", "vec"), ["player_id"], ["frame_n", "vec_id"], start, step, "player_id bigint, vec_id bigint")


def identity_lock(reads: DataFrame, lock: int = 150, cache: int = 120, margin: float = 0.12, accept: float = 0.50) -> DataFrame:
    """Identity per track row: cached for ``cache`` frames, and for ``lock`` frames only a clearly better rival takes over."""
    def start():
        return None  # (player, conf, frame, locked until)

    def step(st, row):
        if row is None:
            return st, []
        f, pid, conf = row["frame_n"], row["best_id"], row["conf"]
        if st and f - st[2] < cache:
            return st, [{"frame_n": f, "player_id": st[0], "conf": st[1]}]
        if st and f < st[3] and pid != st[0] and conf - st[1] < margin:
            return st, [{"frame_n": f, "player_id": st[0], "conf": st[1]}]
        if conf >= accept:
            return (pid, conf, f, f + lock), [{"frame_n": f, "player_id": pid, "conf": conf}]
        return None, []

    return fold_rows(reads, ["match_id", "track_id"], ["frame_n"], start, step, "match_id bigint, track_id bigint, frame_n bigint, player_id bigint, conf double")


def enrolments(tracks: DataFrame, stable: int = 45) -> DataFrame:
    """First frame on which a track is stable, numbered per team in that order."""
    d = number_rows(tracks.select("match_id", "player_id", "team", "slot", "frame_n"), ["match_id", "player_id"], "frame_n").filter(F.col("rn") == stable)
    return number_rows(d.drop("rn"), ["match_id", "team"], "frame_n", "number", tie="slot").select("match_id", "player_id", "team", "frame_n", "number")


# ---- track pieces ---------------------------------------------------------------
def tracklets(tracks: DataFrame, split: int = 5) -> DataFrame:
    """Pieces of a track between gaps of more than ``split`` frames: ends, last step, team, proportions."""
    keys = ["match_id", "player_id"]
    d = segments(tracks, keys, "frame_n", ["frame_n"], lambda p, c: c("frame_n") - p("frame_n") > split, "seg")
    g = d.groupBy(*keys, "seg").agg(
        F.first("team").alias("team"), F.first("h_px").alias("h_px"), F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("frame_n", "px", "py"), "frame_n").alias("a"), F.max_by(F.struct("frame_n", "px", "py"), "frame_n").alias("z"),
    )
    span = F.greatest(F.col("z.frame_n") - F.col("a.frame_n"), F.lit(1))
    return g.select(
        "match_id", (F.shiftleft(F.col("player_id").cast("bigint"), 32) + F.col("seg")).alias("tid"), "player_id", "seg", "team", "h_px", "n",
        F.col("a.frame_n").alias("f0"), F.col("a.px").alias("x0"), F.col("a.py").alias("y0"),
        F.col("z.frame_n").alias("f1"), F.col("z.px").alias("x1"), F.col("z.py").alias("y1"),
        ((F.col("z.px") - F.col("a.px")) / span).alias("vx"), ((F.col("z.py") - F.col("a.py")) / span).alias("vy"),
    )


def with_vectors(pieces: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pieces with the id of a vector each, dealt over all vectors (ids from 0 without gaps)."""
    n = vectors.agg(F.count(F.lit(1))).scalar()
    return pieces.withColumn("vec_id", (F.col("player_id") * 7 + F.col("seg")) % n)


def alike(pairs: DataFrame, vectors: DataFrame, colours: bool = False) -> DataFrame:
    """Pairs of pieces with ``cos``, the cosine of their vectors, and on demand ``cor``, the correlation of their histograms.

    Pieces meet by their ids; the vectors are looked up for the pairs that are left, and are no part of what is ordered before.
    """
    hist = F.transform(F.slice("vec", 1, 8), lambda x: F.abs(x.cast("double")))
    v = vectors.select("vec_id", V.unit(F.col("vec")).alias("unit"), *([V.centred_unit(hist).alias("hist")] if colours else []))
    n = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    d = pairs.join(v, "vec_id", "left").join(v.select(*[F.col(c).alias(f"l_{c}") for c in v.columns]), "l_vec_id", "left")
    d = d.withColumn("cos", V.sized_dot(F.col("unit"), F.col("l_unit"), n)).drop("unit", "l_unit")
    return d.withColumn("cor", V.sized_dot(F.col("hist"), F.col("l_hist"), min(n, 8))).drop("hist", "l_hist") if colours else d


def lost_pairs(pieces: DataFrame, max_gap: int) -> DataFrame:
    """Pieces that begin within ``max_gap`` frames after another one ended (bucketed interval join); they are read twice, so written once."""
    pieces = cut_lineage(pieces.drop("player_id", "seg", "n"))
    lost = pieces.select("match_id", *[F.col(c).alias(f"l_{c}") for c in pieces.columns if c != "match_id"])
    lost = lost.withColumn("lo", F.col("l_f1") + 1).withColumn("hi", F.col("l_f1") + max_gap)
    return interval_join(pieces, lost, ["match_id"], "f0", "lo", "hi", bucket=128)


def piece_scores(pieces: DataFrame, vectors: DataFrame, max_gap: int = 90, radius: float = 180.0, growth: float = 8.0, accept: float = 0.45) -> DataFrame:
    """Score of continuing a lost piece: position, vector, colour, proportions, team."""
    from matchloom.operators.motion import predict

    d = lost_pairs(pieces, max_gap).withColumn("gap", F.col("f0") - F.col("l_f1"))
    d = d.withColumn("px", predict(F.col("l_x1"), F.col("l_vx"), F.col("gap"))).withColumn("py", predict(F.col("l_y1"), F.col("l_vy"), F.col("gap")))
    away = dist(F.col("x0"), F.col("y0"), F.col("px"), F.col("py"))
    reach = F.lit(radius) + growth * F.greatest(F.col("gap") - 6, F.lit(0))
    d = d.withColumn("away", away).withColumn("reach", reach).filter(F.col("away") <= F.col("reach") * 2)
    zero = F.lit(0.0)
    d = alike(d, vectors, colours=True)
    prop = F.abs(F.col("h_px") - F.col("l_h_px")) / F.greatest("h_px", "l_h_px")
    score = (
        F.greatest(zero, 1.0 - F.col("away") / F.col("reach")) * 0.35 + F.greatest(zero, F.col("cos")) * 0.35
        + F.greatest(zero, F.col("cor")) * 0.20 + F.greatest(zero, 1.0 - prop * 3.0) * 0.10
        + F.when(F.col("team") == F.col("l_team"), F.lit(0.05)).otherwise(zero)
    )
    score = F.least(F.lit(1.0), score)
    return d.withColumn("score", score).filter(F.col("score") >= accept).select("match_id", F.col("tid").alias("a"), F.col("l_tid").alias("b"), "score")


def lost_matches(pieces: DataFrame, vectors: DataFrame, max_gap: int = 100, sigma: float = 150.0, accept: float = 0.85) -> DataFrame:
    """Best lost piece of a new one by .70 vector + .30 distance to the linear prediction."""
    d = alike(lost_pairs(pieces, max_gap), vectors)
    gap = F.col("f0") - F.col("l_f1")
    away = dist(F.col("x0"), F.col("y0"), F.col("l_x1") + F.col("l_vx") * gap, F.col("l_y1") + F.col("l_vy") * gap)
    score = F.col("cos") * 0.70 + F.exp(-(away * away) / (2 * sigma * sigma)) * 0.30
    d = d.withColumn("score", score).filter(F.col("score") >= accept)
    return d.groupBy("match_id", "tid").agg(F.max(F.struct("score", (-F.col("l_tid")).alias("neg"))).alias("m")).select(
        "match_id", F.col("tid").alias("a"), (-F.col("m.neg")).alias("b"), F.col("m.score").alias("score"))
