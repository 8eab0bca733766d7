"""Jersey colours and histograms as input columns: clusters, nearest centre, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchloom.functions import vectors as V
from matchloom.operators.identity import as_arrays, blend_weights
from matchloom.plans.knn import top_k
from matchloom.session import cut_lineage

def colour_rows(tracks: DataFrame) -> DataFrame:
    """A colour triple per track row."""
    keeper, a = F.col("slot").isin(0, 7), F.col("team") == "team_a"
    d = F.col("noise2") % 11
    return tracks.select(
        "match_id", "frame_n", "player_id",
        (F.lit(60) + F.col("noise") % 9 + F.when(keeper, 120).otherwise(0)).alias("l"),
        (F.when(keeper, 128).when(a, 200).otherwise(60) + d).alias("a"), (F.when(keeper, 200).when(a, 90).otherwise(160) - d).alias("b"))


#: Used where a match's own centres are too close: red, blue and yellow in 8-bit LAB.
FALLBACK = {"team_a": (136.0, 208.0, 195.0), "team_b": (82.0, 207.0, 20.0), "goalkeeper": (248.0, 106.0, 223.0)}


def team_clusters(colours: DataFrame, k: int = 3, apart: float = 18.0, rounds: int = 100, tol: float = 0.5, fallback: dict[str, tuple] = FALLBACK) -> DataFrame:
    """k-means of every match's colours, all matches at once; centres ranked by size as teams and keepers (`fallback` names them).

    Equal colours of a match count as one weighted point. The first centre is the most frequent colour, each further one the
    colour with the largest weight times squared distance to the centres so far (ties: lowest l, a, b). A round assigns points
    and averages them in grouped aggregations, so a match of any size spreads over tasks; matches whose centres moved by at most
    `tol` leave the loop. A match with fewer than k centres, or two nearer than `apart`, gets the fallback colours with a null
    size. Rows with a null colour count for nothing; a match without colours has no rows.
    """
    xyz = ("l", "a", "b")
    c = colours.select("match_id", *[F.col(v).cast("double").alias(v) for v in xyz]).dropna(subset=list(xyz))
    points = cut_lineage(c.groupBy("match_id", *xyz).agg(F.count(F.lit(1)).alias("n")))

    def d2(x):
        return sum(((F.col(v) - x[v]) * (F.col(v) - x[v]) for v in xyz[1:]), (F.col("l") - x["l"]) * (F.col("l") - x["l"]))

    def heaviest(weight):
        return F.max_by(F.struct(*xyz), F.struct(weight, *[-F.col(v) for v in xyz]))

    def assigned(state):
        near = F.array_min(F.transform("centres", lambda x, i: F.struct(d2(x).alias("d"), i.alias("i"))))
        return points.join(state.select("match_id", "centres"), "match_id").select("match_id", *xyz, "n", near["i"].alias("i"))

    state = points.groupBy("match_id").agg(F.array(heaviest(F.col("n"))).alias("centres"))
    for _ in range(k - 1):
        far = points.join(state, "match_id").withColumn("w", F.col("n") * F.array_min(F.transform("centres", d2)))
        more = far.where("w > 0").groupBy("match_id").agg(heaviest(F.col("w")).alias("next"))
        grown = F.when(F.col("next").isNull(), F.col("centres")).otherwise(F.concat("centres", F.array("next")))
        state = cut_lineage(state.join(more, "match_id", "left").select("match_id", grown.alias("centres")))

    done = []
    for _ in range(rounds):
        sums = assigned(state).groupBy("match_id", "i").agg(*[(F.sum(F.col("n") * F.col(v)) / F.sum("n")).alias(v) for v in xyz])
        means = sums.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*xyz)))).alias("m"))  # at most k entries
        new = F.transform("centres", lambda x, i: F.coalesce(F.col("m")[i], x))
        s = state.select("match_id", "centres").join(means, "match_id").select("match_id", F.col("centres").alias("old"), new.alias("centres"))
        shift = F.array_max(F.zip_with("old", "centres", lambda x, y: sum(((x[v] - y[v]) * (x[v] - y[v]) for v in xyz), F.lit(0.0))))
        s = cut_lineage(s.select("match_id", "centres", (shift > tol * tol).alias("moved")))
        done.append(s.where("NOT moved").select("match_id", "centres"))
        state = s.where("moved").select("match_id", "centres")
        if state.isEmpty():
            break
    for s in done:
        state = state.unionByName(s)

    sizes = assigned(state).groupBy("match_id", "i").agg(F.sum("n").alias("n")).groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("sizes"))
    ranked = F.array_sort(F.transform("centres", lambda x, i: F.struct((-F.coalesce(F.col("sizes")[i], F.lit(0))).alias("minus"), x["l"].alias("l"), x["a"].alias("a"), x["b"].alias("b"))))
    gap = F.flatten(F.transform("centres", lambda x, i: F.transform(F.slice(F.col("centres"), i + 2, k), lambda y: sum(((x[v] - y[v]) * (x[v] - y[v]) for v in xyz), F.lit(0.0)))))
    ok = (F.size("centres") == k) & ~F.exists(gap, lambda d: d < apart * apart)
    spare = F.array(*[F.struct(F.lit(None).cast("long").alias("minus"), *[F.lit(float(v)).alias(n) for n, v in zip(xyz, x, strict=True)]) for x in fallback.values()])
    d = state.join(sizes, "match_id").select("match_id", ok.alias("distinct_centres"), F.posexplode(F.when(ok, ranked).otherwise(spare)).alias("rank", "c"))
    label = F.get(F.array(*[F.lit(v) for v in fallback]), F.col("rank"))
    return d.select("match_id", label.alias("label"), (-F.col("c.minus")).alias("n"), *[F.floor(F.col(f"c.{v}") + 0.5).alias(v) for v in xyz], "distinct_centres")


def assign_team(colours: DataFrame, centres: dict[str, tuple]) -> DataFrame:
    def d2(c):
        return sum(((F.col(n) - v) * (F.col(n) - v) for n, v in zip(("l", "a", "b"), c)), F.lit(0))

    best = F.array_min(F.array(*[F.struct(d2(c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres.values())]))
    return colours.withColumn("team", F.get(F.array(*[F.lit(n) for n in centres]), best["i"]))


def histogram_match(vectors: DataFrame, keep: float = 0.70, accept: float = 0.72, bins: int = 8) -> DataFrame:
    """Best player of all by histogram correlation; a player's histogram is a blend over all its samples.

    Correlation is the cosine of centred arrays, so the exact block search finds the best player; ties go to the lower id.
    """
    h = vectors.select("player_id", "vec_id", "frame_n", F.transform(F.slice("vec", 1, bins), lambda x: F.abs(x.cast("double"))).alias("hist"))
    d = blend_weights(h, "player_id", keep).select("player_id", "_w", F.posexplode("hist").alias("pos", "x"))
    d = d.groupBy("player_id", "pos").agg(F.sum(F.col("_w") * F.col("x")).alias("value"))
    gallery = as_arrays(d, "player_id").select(F.col("player_id").alias("vec_id"), "player_id", V.centred_unit(F.col("vec")).alias("vec"))
    queries = h.select(F.col("vec_id").alias("query_id"), V.centred_unit(F.col("hist")).alias("vec"))
    s = top_k(queries, gallery, 1, skip_same_id=False).filter(F.col("sim") >= accept)
    return s.select(F.col("query_id").alias("vec_id"), "player_id", (F.floor(F.col("sim") * 1e4 + 0.5) / 1e4).alias("score"))
