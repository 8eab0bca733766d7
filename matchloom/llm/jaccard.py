"""Near-duplicates by exact Jaccard similarity of word shingles, without comparing every pair.

Two texts are near copies when their sets of word shingles have a Jaccard similarity of at least `percent` / 100. Under
any fixed order of shingles such sets share one of their first n - ceil(percent * n / 100) + 1 shingles (prefix filter),
so joining on those finds every pair and an exact count of the common shingles settles it. In between, the pairs of a key
must have SimHash fingerprints of `BITS` bits that differ in few enough of them: at 0.8 some 15 % differ, and 84 of 256 are
let through, which a pair at 0.8 exceeds with a chance below 4e-13. So a common line does not make pairs of all texts
that hold it. Fingerprints of under `SHORT` shingles say less and are not compared. Pigeonhole blocks do not do here, as
blocks for that many differing bits have too few bits each.

The order is by hash, with the commonest shingles last, so that a line that many texts hold does not bring them together.
Any choice of those gives the same pairs. Rows with one set of shingles are one node. A key that more than `crowd`
nodes share is worked through by blocks of nodes: every pair of blocks first drops the nodes without a partner by
fingerprint, so that only the others send their sets, and is then counted in one task of bounded size, which returns only
the links that connect its components.

Defined results: white space and case as in `op1_simhash`; fewer than `words` words are one shingle; null, empty and
blank texts are copies of each other. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.bloom import passing
from matchloom.llm.common import cut_lineage, delete_table, map_batches, narrow, raw_texts, star_components
from matchloom.llm.op1_simhash import SEED, keep_rows

PRODUCTION = {"words": 5, "percent": 80, "crowd": 128, "common": 256, "most_common": 100_000, "block": 2048}
NONE = np.zeros(0, np.uint64)
#: Bits of a fingerprint, in words of 64; sets of fewer shingles than SHORT are not told apart by it; standard deviations allowed.
BITS, SHORT, SURE = 256, 64, 8.0


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of one UTF-8 text."""
    w = text.lower().split()
    if not w:
        return NONE
    parts = map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else iter([b" ".join(w)])
    return np.unique(np.fromiter((xxh64_intdigest(s, SEED) for s in parts), np.uint64))


def lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([NONE, *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32()), pa.array(flat))


def fingerprint(s: np.ndarray) -> list[int]:
    """SimHash of a set of hashes as signed 64-bit words: a bit is 1 if it is in over half of the hashes."""
    out = []
    for word in range(BITS // 64):
        h = (s ^ np.uint64(0x9E3779B97F4A7C15 * (word + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0]))
    return out


def most_apart(percent: int) -> int:
    """Differing bits that a pair at `percent` exceeds with a chance of some 1e-13 only."""
    p = math.acos(2 * percent / (100 + percent)) / math.pi
    return int(BITS * p + SURE * math.sqrt(BITS * p * (1 - p)))


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_hash, node, fp, shingles) of every row; node is the hash of the set of shingles, fp its fingerprint."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, words) for t in raw_texts(b)]
            nodes = np.fromiter((xxh64_intdigest(s.tobytes(), SEED) for s in sets), np.uint64, len(sets)).view(np.int64)
            fps = pa.array([fingerprint(s) for s in sets], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes), fps, lists(sets)], ["doc_id", "text_hash", "node", "fp", "shingles"])

        return step

    rows = narrow(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return map_batches(rows, make, "doc_id long, text_hash long, node long, fp array<long>, shingles array<long>")


def prefixes(sets: DataFrame, percent: int, last: np.ndarray = NONE) -> DataFrame:
    """(key, node, n) of each row's prefix: by hash, with the shingles in the sorted `last` at the end."""
    late = sets.sparkSession.sparkContext.broadcast(last)

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            keys, sizes = [], []
            col = b.column(1)
            flat, offs = col.values.to_numpy().view(np.uint64), col.offsets.to_numpy()
            for lo, hi in zip(offs[:-1], offs[1:], strict=True):
                s, n = flat[lo:hi], hi - lo
                if n and len(late.value):
                    at = np.minimum(np.searchsorted(late.value, s), len(late.value) - 1)
                    common = late.value[at] == s
                    s = np.concatenate([s[~common], s[common]])
                keys.append(s[: n - -(-percent * n // 100) + 1])
                sizes.append(n)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), lists(keys)], ["node", "n", "keys"])

        return step

    rows = map_batches(sets.select("node", "shingles"), make, "node long, n long, keys array<long>")
    return rows.select(F.explode("keys").alias("key"), "node", "n")


def spanning(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs at `percent` or more connect; every pair is counted, over shared shingles."""
    size = np.array([len(s) for s in sets])
    shingle, start = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(start, kind="stable")
    holders = owner[order]
    first = np.searchsorted(start[order], np.arange(len(shingle) + 1))
    root, out, at = list(range(len(sets))), [], 0

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, n in enumerate(size):
        mine = start[at : at + n]
        at += n
        shared = [holders[first[k] : first[k + 1]] for k in mine if first[k + 1] - first[k] > 1]
        if not shared:
            continue
        both = np.bincount(np.concatenate(shared), minlength=len(sets))[:i]
        for j in np.flatnonzero(both * (100 + percent) >= percent * (size[:i] + n)):
            a, b = find(i), find(int(j))
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def with_partner(fp: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of these sets, given by fingerprints (rows) and sizes, have another that may reach `percent`; a few rows at a time."""
    out, all_ = np.zeros(len(n), bool), np.arange(len(n))
    for at in range(0, len(n), 256):
        rows = all_[at : at + 256]
        apart = sum(np.bitwise_count(fp[rows, None, k] ^ fp[None, :, k]).astype(np.int32) for k in range(fp.shape[1]))
        least, most = np.minimum(n[rows, None], n), np.maximum(n[rows, None], n)
        may = (least * 100 >= most * percent) & ((least < SHORT) | (apart <= most_apart(percent))) & (rows[:, None] != all_)
        out[rows] = may.any(1)
    return out


def links(sets: DataFrame, percent: int = 80, crowd: int = 128, common: int = 256, most_common: int = 100_000, block: int = 2048) -> DataFrame:
    """Links (a, b) between nodes that give the components of all pairs at `percent` or more. `sets` is read several times."""
    counts = prefixes(sets, percent).groupBy("key").count().where(F.col("count") > common)
    last = counts.orderBy(F.desc("count"), "key").limit(most_common).select("key").toArrow().column("key").to_numpy()
    keyed = prefixes(sets, percent, np.sort(last.view(np.uint64))).repartition("key").distinct()
    shared = cut_lineage(keyed.withColumn("m", F.expr("count(*) OVER (PARTITION BY key)")).where("m > 1"))
    crowded = shared.groupBy("node").agg(F.count_if(F.col("m") > crowd).alias("c"))

    # a pair holds at most its shared prefix keys and the rest of the text whose prefix ends first; shared keys are
    # counted, those of crowded keys taken as all
    words = [f"fp{k}" for k in range(BITS // 64)]
    fps = sets.select("node", *[F.col("fp")[k].alias(w) for k, w in enumerate(words)]).dropDuplicates(["node"])
    few = shared.where(F.col("m") <= crowd).join(fps, "node")
    a, b = (few.select("key", F.col("node").alias(x), F.col("n").alias(f"n{x}"), *[F.col(w).alias(w + x) for w in words]) for x in "ab")
    near = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    apart = sum((F.bit_count(F.col(w + "a").bitwiseXOR(F.col(w + "b"))) for w in words), F.lit(0))
    near &= (F.least("na", "nb") < SHORT) | (apart <= most_apart(percent))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & near).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both"))
    pairs = pairs.join(crowded.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(crowded.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    rest = F.ceil(F.greatest("na", "nb") * percent / 100) - 1
    pairs = cut_lineage(pairs.where((F.col("both") + F.least("ca", "cb") + rest) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b", "na", "nb"))

    many = shared.where(F.col("m") > crowd).join(fps, "node").withColumn("blocks", F.ceil(F.col("m") / block).cast("long"))
    many = many.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    many = many.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "n", *words)

    def close(group: pa.Table) -> pa.Table:
        fp = np.stack([group.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
        return group.select(["key", "i", "j", "node"]).filter(pa.array(with_partner(fp, group.column("n").to_numpy(), percent)))

    many = cut_lineage(many.groupBy("key", "i", "j").applyInArrow(close, "key long, i long, j long, node long"))

    used = cut_lineage(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(many.select("node")).distinct())
    of = cut_lineage(passing(sets.select("node", "shingles"), used, "node").join(used, "node", "left_semi").dropDuplicates(["node"]))
    pairs = pairs.join(of.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(of.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    pairs = pairs.where(F.size(F.array_intersect("sa", "sb")) * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")

    def counted(group: pa.Table) -> pa.Table:
        sets_ = [np.asarray(s.values.to_numpy()) for s in group.column("shingles")]
        found = spanning(group.column("node").to_numpy(), sets_, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    crowds = many.join(of, "node").groupBy("key", "i", "j").applyInArrow(counted, "a long, b long")
    return pairs.unionByName(crowds)


def groups(docs: DataFrame, words: int = 5, **how) -> DataFrame:
    """doc_id, text_hash and component_id (its smallest doc_id) of every row."""
    sets = cut_lineage(shingle_sets(docs, words))
    nodes = star_components(links(sets, **how))
    rows = sets.select("doc_id", "text_hash", "node").join(nodes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = cut_lineage(rows.select("doc_id", "text_hash", "root"))
    delete_table(sets)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with all their columns, that stay: one of each component."""
    return keep_rows(docs, groups(docs, **how))
