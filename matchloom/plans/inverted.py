"""Opt-in approximate nearest neighbours by cosine: vectors in lists around coarse centroids, of which a query probes a few.

The centroids are fitted on a bounded sample, every vector is put into the list of its best centroid, and a query is
compared exactly with the vectors of its `probes` best lists. How many lists that takes for a wanted recall is measured
against the exact search (`probes_for`). `plans.knn.top_k` stays the exact default.

Bounds: `sample` vectors are fitted, `lists` centroids are sent to every task and `lists` list sizes are joined by
broadcast. A list of any size is cut into blocks of a fixed size, so a crowded list is no single task. Null and zero
vectors are like nothing: they are found only as the least similar of a probed list (zero) or not indexed (null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from matchloom.plans.knn import BLOCK_ROWS, best_of, block_products, top_k, unit
from matchloom.session import cut_lineage


@dataclass
class Index:
    rows: DataFrame  # (list_id, vec_id, player_id, vec), written
    centres: np.ndarray  # one unit row per list


def _some(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows, chosen by a hash of the key."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // most)))) == 0)


def _with_lists(rows: DataFrame, vec: str, centres: np.ndarray, probes: int) -> DataFrame:
    """`rows` with `lists`, the ids of the `probes` best lists, best first; ties go to the lower list."""
    cast = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for d in batches:
            if len(d):
                order = np.argsort(-(unit(d[vec]) @ cast.value.T), axis=1, kind="stable")[:, :probes]
                yield d.assign(lists=list(order.astype(np.int32)))

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "lists array<int>"])
    return rows.mapInPandas(run, schema)


def build(gallery: DataFrame, lists: int = 256, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> Index:
    """Index of (vec_id, player_id, vec) rows. Fewer different vectors than `lists` give fewer lists."""
    g = gallery.select("vec_id", "player_id", "vec").where("vec IS NOT NULL")
    some = _some(g.where(F.exists("vec", lambda x: x != 0)), "vec_id", sample).select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"))
    if some.isEmpty():
        centres = np.zeros((1, len(first.vec)) if (first := g.first()) else (1, 1))
    else:
        model = KMeans(k=lists, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(some)
        centres = unit(pd.Series(model.clusterCenters()))
    rows = _with_lists(g, "vec", centres, 1).select(F.col("lists")[0].alias("list_id"), "vec_id", "player_id", "vec")
    return Index(cut_lineage(rows), centres)


def probes_for(index: Index, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 500, skip_same_id: bool = True) -> int:
    """Least number of probed lists that holds `recall` of the exact k nearest of a sample of the queries."""
    some = cut_lineage(_some(queries.select("query_id", "vec"), "query_id", sample))
    exact = top_k(some, index.rows, k, skip_same_id).select("query_id", "vec_id")
    at = exact.join(index.rows.select("vec_id", "list_id"), "vec_id").join(_with_lists(some, "vec", index.centres, len(index.centres)).select("query_id", "lists"), "query_id")
    ranks = at.groupBy(F.array_position("lists", F.col("list_id")).alias("rank")).count().orderBy("rank").collect()  # one row a list at most
    need, upto = recall * sum(r["count"] for r in ranks), 0
    for r in ranks:
        upto += r["count"]
        if upto >= need:
            return int(r["rank"])
    return 1


def search(index: Index, queries: DataFrame, k: int, probes: int, skip_same_id: bool = True, rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, vec_id, player_id, sim, rank) of the k most similar vectors in each query's `probes` best lists."""
    q = _with_lists(queries.select("query_id", "vec").where("vec IS NOT NULL"), "vec", index.centres, probes)
    q = cut_lineage(q.select("query_id", F.col("vec").alias("qvec"), F.explode("lists").alias("list_id")))

    def blocks(of: DataFrame, name: str) -> DataFrame:
        return of.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))

    sizes = F.broadcast(blocks(q, "nq").join(blocks(index.rows, "ng"), "list_id"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, "list_id").withColumn("qb", F.pmod(F.hash("query_id"), "nq")).withColumn("gb", each("ng")).drop("nq", "ng")
    g = index.rows.join(sizes, "list_id").withColumn("gb", F.pmod(F.hash("vec_id"), "ng")).withColumn("qb", each("nq")).drop("nq", "ng")
    return best_of(block_products(q, g, ["list_id", "qb", "gb"], k, skip_same_id), k)


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (query_id, vec_id) pairs that were found."""
    pairs = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return float(pairs.agg(F.coalesce(F.count("hit") / F.count(F.lit(1)), F.lit(1.0))).first()[0])
