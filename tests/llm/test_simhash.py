import random

import numpy as np
import xxhash
from llm.conftest import as_rows

from matchloom.llm import op1_simhash as op
from matchloom.llm.common import all_stars, star_components
from matchloom.session import cut_lineage


def slow_fp(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", w) if x]
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, distance=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def test_fingerprints_and_components_match_brute_force(spark, docs, rows):
    fps = [slow_fp(t) for _, t in rows]
    comp = slow_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp, strict=True):
        least.setdefault(c, []).append(i)
    want = [(i, f"{f:016x}", min([x for x in least[c] if x is not None], default=None)) for (i, _), f, c in zip(rows, fps, comp, strict=True)]
    assert as_rows(op.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def test_crowded_blocks_and_pairs_agree_with_brute_force(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):  # chains and crowds of close values
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    crowd = rng.getrandbits(64)
    fps += [crowd ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(12)) for _ in range(60)] + [0, 1, (1 << 64) - 1]
    rows = [(i, 0, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    df = cut_lineage(spark.createDataFrame(rows, "doc_id long, text_hash long, fp long"))
    want = sorted(enumerate(slow_components(fps)))
    for crowd_size in (2, 8, 1000):
        got = sorted((r.doc_id, r.component_id) for r in op.components(df, crowd=crowd_size).collect())
        assert got == want, crowd_size


def test_keep_one_keeps_one_row_of_each_group(docs, no_docs):
    kept = op.keep_one(docs)
    groups = op.simhash_groups(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.component_id for r in groups.collect()})
    assert op.keep_one(no_docs).count() == 0
    assert op.simhash_groups(no_docs).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(8)
    path = [(i, i + 1) for i in range(100, 140)]
    order = list(range(200, 260))
    rng.shuffle(order)
    ring = list(zip(order, order[1:] + order[:1], strict=True))
    shapes = [path, ring, [(300, 300 + k) for k in range(1, 30)], [(k, 431) for k in range(401, 431)], [(1, 2), (2, 1), (3, 3)], [(-5, 7), (7, -9)]]
    want = {}
    for shape in shapes:
        nodes = {x for a, b in shape if a != b for x in (a, b)}
        want |= dict.fromkeys(nodes, min(nodes, default=0))
    edges = [(a, b) for s in shapes for a, b in s]
    rng.shuffle(edges)
    got = star_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert star_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert all_stars(spark.createDataFrame([(5, 1), (4, 1), (9, 8)], "a long, b long"))
    assert not all_stars(spark.createDataFrame([(5, 1), (5, 2)], "a long, b long"))
    assert not all_stars(spark.createDataFrame([(5, 3), (3, 2)], "a long, b long"))
