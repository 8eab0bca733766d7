"""MinHash near-duplicates by an LSH forest.

Every distinct set of word shingles gets one MinHash signature. Each tree of the forest is one sorted order of the
signatures: tree t reads the coordinates from t * `depth` on, cyclically, so that the first `depth` coordinates of the
trees are disjoint. Sets whose longest common prefix in an order is `depth` or more lie side by side there and form a
region. A region of at most `crowd` sets is taken as it is; a larger one is cut by the next `depth` coordinates, and
again, until it is small enough or `deepest` coordinates agree: depth follows the density of each region.

Candidates, kept if their signatures agree nearly as they should (`SURE`) and confirmed on the full sets:

1. each set and the pivot with which it shares the most regions. A region's pivot is the member whose regions hold
   the most sets, which in a crowd around one text is that text. Components of these links come first;
2. of what they leave apart, all pairs of small regions, and each set with the pivot of every crowded region it is in
   at any depth. So a crowd that its pivots hold together costs as many candidates as it has members;
3. of crowds that are still in several components, every member outside the crowd's main component with all members, and all
   those of the main component, in blocks of bounded size: first by signatures, then by the sets of those with a partner, of
   which a block returns only links that connect components.

So every pair that shares a region of any tree is settled. A pair at a Jaccard similarity s shares none with probability
(1 - s^depth)^trees, 4e-7 at 0.85 for 25 trees of depth 5. Sets, like shingles, are told apart by 64-bit hashes. Step 3 is quadratic
in the members outside, but no task holds more than two blocks.

Scale: signatures and sets are written once; a region's size is joined back with hot regions broadcast (at most `HOT` a
tree), copies of one text are one node from the start, and whole sets move only for sets that are candidates (a filter of fixed
size holds back the others before the shuffle).

Defined results: a text with fewer words than a shingle has one shingle, its word sequence; null, empty and blank texts
have none and are linked with nothing; repeated rows each get their row; a null doc_id is linked but names a component only
if no row of it has an id. Texts of any length are read whole; ties of pivots go to the smaller hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.bloom import passing
from matchloom.llm.common import HOT, cut_lineage, narrow, raw_texts, skewed_join, star_components
from matchloom.llm.jaccard import SEED, lists, shingles

PRODUCTION = {"words": 3, "percent": 85, "trees": 25, "depth": 5, "crowd": 32, "deepest": 30}
#: Shingles hashed at once; bounds the memory of a task whatever the batch.
SLICE = 1 << 17
#: Rows whose sets a task holds at once, and sends in one batch.
ROWS = 500
#: Standard deviations by which the signatures of a pair may agree less than its sets: a pair at the similarity falls below with 1e-9.
SURE = 6.0
#: A signature cut to a byte a coordinate.
BYTES = "transform(sig, x -> CAST(x % 256 - 128 AS TINYINT))"
#: Shingles of a block of a crowd's sets; a set counts as LIGHT at least, which bounds the sets of a block.
BLOCK, LIGHT = 1 << 19, 256


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures (rows) of sets of 64-bit hashes by multiply-shift; an empty set has zeros."""
    rng = np.random.default_rng(SEED)
    mul, add = rng.integers(0, 1 << 63, (2, size), np.uint64)
    mul, out = mul << np.uint64(1) | np.uint64(1), np.zeros((len(sets), size), np.int32)
    full = [k for k, s in enumerate(sets) if len(s)]
    lo = 0
    while lo < len(full):
        hi, n = lo, 0
        while hi < len(full) and (hi == lo or n + len(sets[full[hi]]) <= SLICE):
            n += len(sets[full[hi]])
            hi += 1
        part = [sets[k] for k in full[lo:hi]]
        flat, starts = np.concatenate(part), np.cumsum([0] + [len(s) for s in part[:-1]])
        for c in range(size):
            out[full[lo:hi], c] = np.minimum.reduceat((flat * mul[c] + add[c]) >> np.uint64(33), starts)
        lo = hi
    return out


def signed_batches(batches: Iterable[pa.RecordBatch], words: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of `signed_sets` for batches of (rid, doc_id, text), at most ROWS at once."""
    for big in batches:
        for at in range(0, big.num_rows, ROWS):
            b = big.slice(at, ROWS)
            sets = [shingles(t, words) for t in raw_texts(b)]
            nodes = [int(np.uint64(xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else None for s in sets]
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * size, pa.int32()), pa.array(signatures(sets, size).ravel()))
            cols = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), sig, lists(sets)]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "node", "n", "sig", "shingles"])


def signed_sets(docs: DataFrame, words: int, size: int) -> DataFrame:
    """(rid, doc_id, node, n, sig, shingles) of every row; rid numbers the rows, node is the hash of the set, null if it is empty."""
    rows = narrow(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda batches: signed_batches(batches, words, size), "rid long, doc_id long, node long, n long, sig array<int>, shingles array<long>")


def forest(nodes: DataFrame, trees: int, depth: int, crowd: int, deepest: int) -> DataFrame:
    """(d, tree, key, node, n, size) of every region of two or more sets, at depth d; nodes are (node, n, sig)."""
    total = nodes.count()
    nodes = nodes.select("node", "n", F.concat("sig", F.slice("sig", 1, deepest)).alias("sig"))
    found, left = None, nodes.withColumn("in_trees", F.sequence(F.lit(0), F.lit(trees - 1)))
    for d in range(depth, deepest + 1, depth):
        placed = left.select("node", "n", "sig", F.explode("in_trees").alias("tree"))
        placed = placed.select("node", "n", "tree", F.xxhash64("tree", F.slice("sig", F.col("tree") * depth + 1, d)).alias("key"))
        sizes = cut_lineage(placed.groupBy("tree", "key").agg(F.count("*").alias("size")).where("size > 1"))
        regions = cut_lineage(skewed_join(placed, sizes, ["tree", "key"], sizes.where(F.col("size") * HOT > total)).select(F.lit(d).alias("d"), "tree", "key", "node", "n", "size"))
        found = regions if found is None else found.unionByName(regions)
        crowded = regions.where(F.col("size") > crowd)
        if d + depth > deepest or crowded.isEmpty():
            break
        # only the sets of crowded regions go deeper, and only in those trees
        left = nodes.join(crowded.groupBy("node").agg(F.collect_set("tree").alias("in_trees")), "node")
    return found


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures, cut to a byte a coordinate, agree well enough for the similarity."""
    small = sets.select("node", F.size("sig").alias("size"), F.expr(BYTES).alias("sig"))
    a, b = small.select(F.col("node").alias("a"), "size", F.col("sig").alias("ga")), small.select(F.col("node").alias("b"), F.col("sig").alias("gb"))
    agree = F.expr("aggregate(zip_with(ga, gb, (x, y) -> IF(x = y, 1, 0)), 0, (n, x) -> n + x)")
    s = percent / 100
    least = F.col("size") * s - SURE * F.sqrt(F.col("size") * (s * (1 - s)))
    return pairs.join(a, "a").join(b, "b").where(agree >= least).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity; `sets` holds one row (node, n, shingles) of each candidate."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where(both * (100 + percent) >= (F.col("na") + F.col("nb")) * percent).select("a", "b")


def agreeing(sig: np.ndarray, n: np.ndarray, root: np.ndarray, outside: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have another of a different root, one of the two outside, that sizes and signatures (rows of bytes) do not rule out."""
    out, s, size = np.zeros(len(n), bool), percent / 100, sig.shape[1]
    least = size * s - SURE * (size * s * (1 - s)) ** 0.5
    for i in np.flatnonzero(outside):
        may = (root != root[i]) & (n * 100 >= n[i] * percent) & (n[i] * 100 >= n * percent)
        at = np.flatnonzero(may)
        at = at[(sig[at] == sig[i]).sum(1) >= least]
        out[at] = True
        out[i] |= len(at) > 0
    return out


def crossing(nodes: np.ndarray, root: np.ndarray, outside: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what the pairs of different roots, one of the two outside, at `percent` or more connect; shared shingles are counted."""
    size = np.array([len(s) for s in sets])
    start = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(start, kind="stable")
    holders = np.repeat(np.arange(len(sets)), size)[order]
    first = np.searchsorted(start[order], np.arange(start.max() + 2))
    ends = np.concatenate([[0], np.cumsum(size)])
    group = np.unique(root, return_inverse=True)[1]
    up, out = list(range(int(group.max()) + 1)), []

    def find(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i in np.flatnonzero(outside):
        both = np.zeros(len(sets), np.int64)
        for k in start[ends[i] : ends[i + 1]]:
            both[holders[first[k] : first[k + 1]]] += 1  # a set holds a shingle once
        for j in np.flatnonzero((both * (100 + percent) >= percent * (size + size[i])) & (root != root[i])):
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((int(nodes[i]), int(nodes[j])))
    return out


def crowd_links(regions: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, hot: DataFrame) -> DataFrame:
    """The links that crowds (`regions`, of one depth) still lack between the components `roots`; every pair of a crowd is settled.

    A crowd's main component is the largest one it holds. Comparison is by main component, not by region, as one crowd is a region of many trees.
    """
    rooted = cut_lineage(regions.select("tree", "key", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    weight = rooted.groupBy("root").agg(F.count("*").alias("w"))
    held = cut_lineage(rooted.groupBy("tree", "key", "root").agg(F.count("*").alias("_c")).drop("_c").join(weight, "root"))
    mains = held.groupBy("tree", "key").agg(F.max(F.struct("w", (-F.col("root")).alias("minus"), "root"))["root"].alias("main"), F.count("*").alias("parts"))
    mains = cut_lineage(mains.where("parts > 1").select("tree", "key", "main"))
    if mains.isEmpty():
        return roots.where("false").select(F.col("node").alias("a"), F.col("root").alias("b"))
    members = skewed_join(rooted, mains, ["tree", "key"], hot.join(mains, ["tree", "key"], "left_semi"))
    members = cut_lineage(members.select("main", "node", "n", "root", (F.col("root") != F.col("main")).alias("outside")).distinct())
    heavy, all_ = F.greatest("n", F.lit(LIGHT)), members.count()
    blocks = members.groupBy("main").agg(F.count("*").alias("c"), *[F.ceil(F.sum(F.when(F.col("outside") == x, heavy).otherwise(0)) / BLOCK).cast("long").alias(c) for c, x in (("bo", True), ("bm", False))])
    dealt = skewed_join(members, blocks, ["main"], blocks.where(F.col("c") * HOT > all_))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("bo")).otherwise(F.col("bm"))))
    # blocks of members outside come first in the numbering, those of the main component after them
    own, other = F.when(F.col("outside"), F.col("own")).otherwise(F.col("bo") + F.col("own")), F.col("other")
    dealt = dealt.withColumn("at", own).withColumn("other", F.explode(F.when(F.col("outside"), F.sequence(F.lit(0), F.col("bo") + F.col("bm") - 1)).otherwise(F.sequence(F.lit(0), F.col("bo") - 1))))
    dealt = dealt.select("main", F.least("at", other).alias("i"), F.greatest("at", other).alias("j"), "node", "n", "root", "outside")
    by, kept = ["main", "i", "j"], "main long, i long, j long, node long, n long, root long, outside boolean"

    def close(group: pa.Table) -> pa.Table:
        sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        n, root, outside = (group.column(c).to_numpy() for c in ("n", "root", "outside"))
        return group.drop_columns(["sig"]).filter(pa.array(agreeing(sig, n, root, outside, percent)))

    def counted(group: pa.Table) -> pa.Table:
        full = [np.asarray(s.values.to_numpy()) for s in group.column("shingles")]
        found = crossing(*(group.column(c).to_numpy() for c in ("node", "root", "outside")), full, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    short = sets.select("node", F.expr(BYTES).alias("sig"))
    dealt = cut_lineage(dealt.join(short, "node").select(*by, "node", "n", "root", "outside", "sig").groupBy(*by).applyInArrow(close, kept))
    return dealt.join(sets.select("node", "shingles"), "node").groupBy(*by).applyInArrow(counted, "a long, b long")


def links(written: DataFrame, percent: int = 85, trees: int = 25, depth: int = 5, crowd: int = 32, deepest: int = 30) -> DataFrame:
    """Links (a, b) between nodes; `written` is the table of `signed_sets`, read several times."""
    first = cut_lineage(written.where("node IS NOT NULL").groupBy("node").agg(F.min("rid").alias("rid")))
    nodes = cut_lineage(written.select("rid", "n", "sig").join(first, "rid").select("node", "n", "sig"))
    regions = forest(nodes, trees, depth, crowd, deepest)
    weight = regions.where(F.col("d") == depth).groupBy("node").agg(F.sum("size").alias("weight"))
    regions = cut_lineage(regions.join(weight, "node"))
    pivots = regions.groupBy("d", "tree", "key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), "node", "n")).alias("p")).select("d", "tree", "key", F.col("p.node").alias("pivot"), F.col("p.n").alias("np"))
    near = (F.col("n") * 100 >= F.col("np") * percent) & (F.col("np") * 100 >= F.col("n") * percent)
    hot = regions.groupBy("d", "tree", "key").agg(F.count("*").alias("c")).where(F.col("c") * HOT > nodes.count())
    stars = skewed_join(regions, pivots, ["d", "tree", "key"], hot).where((F.col("node") != F.col("pivot")) & near)
    stars = cut_lineage(stars.groupBy("node", "pivot").agg(F.count("*").alias("shared"), F.max((F.col("size") > crowd).cast("int")).alias("crowded")))
    best = stars.groupBy("node").agg(F.max(F.struct("shared", "pivot")).alias("k")).select(F.least("node", "k.pivot").alias("a"), F.greatest("node", "k.pivot").alias("b")).distinct()
    used = cut_lineage(regions.select("node").distinct().join(first, "node"))
    sets = cut_lineage(passing(written.select("rid", "n", "sig", "shingles"), used, "rid").join(used, "rid").select("node", "n", "sig", "shingles"))
    one = cut_lineage(confirmed(cut_lineage(alike(best, sets, percent)), sets, percent))

    roots = star_components(one)
    rooted = regions.where(F.col("size") <= crowd).join(roots, "node", "left").select("d", "tree", "key", "node", "n", F.coalesce("root", "node").alias("root"))
    a = rooted.select("d", "tree", "key", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"))
    b = rooted.select("d", "tree", "key", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))
    close = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    pairs = a.join(b, ["d", "tree", "key"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & close).select("a", "b")
    far = stars.where("crowded = 1").join(roots.select("node", F.col("root").alias("ra")), "node", "left").join(roots.select(F.col("node").alias("pivot"), F.col("root").alias("rb")), "pivot", "left")
    far = far.where(F.coalesce("ra", "node") != F.coalesce("rb", "pivot")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
    rest = cut_lineage(alike(pairs.unionByName(far).distinct(), sets, percent))
    found = cut_lineage(one.unionByName(confirmed(rest, sets, percent)))
    crowds = regions.where((F.col("d") == depth) & (F.col("size") > crowd))
    if crowds.isEmpty():
        return found
    return found.unionByName(crowd_links(crowds, sets, star_components(found), percent, hot.where(F.col("d") == depth).select("tree", "key")))


def groups(docs: DataFrame, words: int = 3, percent: int = 85, trees: int = 25, depth: int = 5, crowd: int = 32, deepest: int = 30) -> DataFrame:
    """doc_id, n_shingles, component_id (its smallest doc_id) and kept (whether the two ids are one) of every row."""
    written = cut_lineage(signed_sets(docs, words, trees * depth))
    rows = written.select("doc_id", "n", "node")
    full = rows.where("node IS NOT NULL")
    roots = star_components(links(written, percent, trees, depth, crowd, deepest))
    per_node = cut_lineage(full.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    rooted = per_node.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut_lineage(rooted.join(least, "root").select("node", "component_id", "copies"))
    hot = named.where(F.col("copies") * HOT > full.count()).select("node")
    out = skewed_join(full, named.select("node", "component_id"), ["node"], hot).select("doc_id", "n", "component_id")
    out = out.unionByName(rows.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: DuckDB SQL of the query: every pair of distinct sets that share a shingle is counted.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS g FROM words),
docs AS (SELECT doc_id, len(g) AS n, sha256(array_to_string(g, chr(10))) AS node, g FROM sets),
nodes AS (SELECT node, any_value(g) AS g, any_value(n) AS n FROM docs WHERE n > 0 GROUP BY node),
items AS (SELECT node, n, unnest(g) AS s FROM nodes),
links AS (
  SELECT a.node AS a, b.node AS b FROM items a JOIN items b ON a.s = b.s AND a.node <> b.node AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT node, node AS other FROM nodes UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT r.node, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.node = r.other GROUP BY r.node)
SELECT d.doc_id, d.n AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(l.component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN least l ON l.node = d.node AND d.n > 0
"""
