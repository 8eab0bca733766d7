"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bits are cut into `blocks` parts. Two fingerprints at `distance` or fewer differing bits agree in at
least `blocks - distance` parts, so they share the key of one choice of that many parts: join on those keys, then
verify the Hamming distance. Exact copies meet before, as one row per distinct fingerprint.

A key shared by more than `crowd` distinct fingerprints is not paired up. There, each fingerprint names itself and all
values one bit away; fingerprints that name the same value are at most two bits apart, and any two that are two or
fewer apart share such a value. At most bits + 1 fingerprints can name one value, so this is linear in the crowd, whole,
and gives the same components.

Defined results: a null or empty text, or one of white space, has fingerprint zero and is linked like any other; one
or two words count as one shingle; repeated rows each get their row; a null doc_id is linked but never a component's
id unless the component has no other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.common import cut_lineage, fresh, map_batches, narrow, raw_texts, star_components

BITS, SEED = 64, 42


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash over word shingles of one UTF-8 text; long texts are counted in slices."""
    w = text.lower().split()  # bytes: A-Z only, and white space is 0x20, 0x09-0x0D
    if not w:
        return 0
    shingles = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else iter([b" ".join(w)])
    n = max(1, len(w) - words + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 15):
        k = min(1 << 15, n - at)
        h = np.fromiter((xxh64_intdigest(next(shingles), SEED) for _ in range(k)), np.uint64, k)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; text_hash tells rows of one id apart."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, words) for t in raw_texts(b)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

        return step

    rows = narrow(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, make, "doc_id long, text_hash long, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of blocks that a close pair can agree in."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in (sum(c) for c in combinations(part, blocks - distance))]


def links(fps: DataFrame, distance: int = 2, blocks: int = 5, crowd: int = 64) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that give the components of all pairs within the distance."""
    if distance != 2:
        raise ValueError("the midpoint form of crowded blocks is for a distance of 2")
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(blocks, distance)])).alias("choice", "key"))
    crowded = keyed.groupBy("choice", "key").count().where(F.col("count") > crowd).select("choice", "key")
    few = keyed.join(crowded, ["choice", "key"], "left_anti")
    a, b = few.select("choice", "key", F.col("fp").alias("a")), few.select("choice", "key", F.col("fp").alias("b"))
    pairs = a.join(b, (a.choice == b.choice) & (a.key == b.key) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    many = keyed.join(crowded, ["choice", "key"], "left_semi").select("fp").distinct()
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << i) - ((1 << 64) if i == 63 else 0))) for i in range(BITS)]
    middles = many.select("fp", F.explode(F.array(*near)).alias("middle")).groupBy("middle").agg(F.collect_set("fp").alias("fps"))
    stars = middles.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def components(rows: DataFrame, **how) -> DataFrame:
    """Adds component_id to (doc_id, text_hash, fp) rows: the smallest doc_id that links reach.

    `rows` is read several times, so it should be a written table.
    """
    reps = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = star_components(links(reps.select("fp"), **how))
    named = nodes.join(reps, nodes.node == reps.fp).select("node", "root", "rep")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    linked = named.join(least, "root").select(F.col("node").alias("fp"), F.col("least").alias("component_id"))
    per_fp = reps.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return rows.join(per_fp, "fp")


def hex16(c: Column) -> Column:
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int = 5, crowd: int = 64) -> DataFrame:
    """doc_id, text_hash, fingerprint (16 hex digits) and component_id of every row."""
    rows = cut_lineage(fingerprints(docs, words))
    out = components(rows, distance=distance, blocks=blocks, crowd=crowd)
    return out.select("doc_id", "text_hash", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: one of each component.

    The row with the component's id stays (of rows that share this id the one with the least text hash, of equal rows
    any one). Only ids and hashes are grouped; texts move once, to meet the kept ids.
    """
    return keep_rows(docs, simhash_groups(docs, **how))


def keep_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, given doc_id, text_hash and component_id of each."""
    by_id = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("k"))
    keep = cut_lineage(by_id.select(F.col("k.doc_id").alias("_keep_id"), F.col("k.text_hash").alias("_keep_hash")).distinct())
    row_id, row_hash, nth = fresh(docs, "_row_id", "_row_hash", "_nth")
    left = docs.withColumn(row_id, F.col("doc_id").cast("long")).withColumn(row_hash, F.xxhash64("text"))
    kept = left.join(keep, left[row_id].eqNullSafe(keep["_keep_id"]) & (left[row_hash] == keep["_keep_hash"]), "left_semi")
    again = Window.partitionBy(row_id, row_hash).orderBy(row_hash)
    return kept.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


PRODUCTION: dict[str, int] = {"words": 3, "distance": 2, "blocks": 5, "crowd": 64}
