"""Shared helpers: Arrow passes over texts, row identity, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from matchloom.session import cut_lineage, delete_table  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: whatever else the input has cannot clash with what an operator adds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for added columns that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(len(taken) + 1) if (n := stem + "_" * k).lower() not in taken) for stem in stems]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """One Arrow pass; `make` runs once per task and gives the step for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            if b.num_rows:
                yield step(b)

    return df.mapInArrow(run, schema)


def raw_texts(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in b.column(name).cast(pa.large_binary()).to_pylist()]


def str_texts(b: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in b.column(name).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """A-Z only, as the contracts ask; lower() would also change other scripts."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(c: Column, mod: int, rest: int) -> Column:
    """Fold of a row by the CRC-32 of its id as text; a null id is in no fold."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod == rest, F.lit(False))


#: A key with more than one in HOT of all rows is hot: there are fewer than HOT of them, so what is kept of each may be broadcast.
HOT = 1000


def skewed_join(rows: DataFrame, names: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Inner join of `rows` with `names`, one row of each key; the keys in `hot` (a proven few) are broadcast, so no task gets all their rows."""
    hot = F.broadcast(hot.select(*on))
    few = rows.join(F.broadcast(names.join(hot, on, "left_semi")), on)
    return few.unionByName(rows.join(hot, on, "left_anti").join(names, on))


def all_stars(edges: DataFrame) -> bool:
    """Whether every node of the distinct links (a, b), a > b, either hangs on one node by one link or on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 OR up > 0 AND down > 0"))).first()[0] == 0


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long) links: one row (node, root) per linked node, root the smallest.

    Alternating large-star and small-star rounds: every node hangs its larger neighbours, then its smaller ones,
    on the smallest node it knows. Each round is a few joins on the node; links stay at one per node, no group is
    ever collected, and a round's links are written to the shared folder, so a lost executor re-reads them. The rounds
    end as soon as the links are stars, which one aggregation over their ends shows; links that come as stars need none.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not all_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
