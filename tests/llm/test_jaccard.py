import random

import numpy as np
from llm.conftest import WORDS

import corpus_pipeline
from matchloom.llm import jaccard as op


def slow_set(t, words=5):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def slow_groups(texts, percent=80):
    sets = [slow_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) * 100 >= percent * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def near_copies():
    """Originals, copies with 1 to 4 changed words (Jaccard about 0.6 to 0.97), a crowd around one text, a common line."""
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    line = prose(12)
    out = [None, "", " \n", "one", "ONE", "one two", line, line + " x"]
    for _ in range(30):
        base = prose(rng.choice([8, 30, 60, 150]))
        out.append(base)
        for _ in range(3):
            w = base.split()
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = "new"
            out.append(" ".join(w))
    base = prose(90).split()
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        out.append(" ".join(w))
    return out + [prose(40) + "\n" + line for _ in range(40)]


def test_groups_match_brute_force_jaccard_for_any_crowd(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = dict(enumerate(slow_groups(texts)))
    for how in ({}, {"crowd": 4, "common": 3, "block": 16}, {"crowd": 2, "common": 8, "most_common": 2}):
        got = {r.doc_id: r.component_id for r in op.groups(docs, **how).collect()}
        assert got == want, how


def test_stage_of_the_pipeline_drops_near_copies_at_eight_tenths(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(slow_groups(texts))


def test_repeated_and_null_rows(docs, rows, no_docs):
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(slow_groups([t for _, t in rows])))
    assert op.keep_one(no_docs).count() == 0


def test_a_common_line_moves_no_sets(spark, monkeypatch):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    line = prose(25)
    texts = [line + " " + prose(95) for _ in range(50)] + [line + " " + (tail := prose(95)), line + " " + tail[:-3] + "new"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    moved, whole = [], op.passing
    monkeypatch.setattr(op, "passing", lambda rows, keys, on: moved.append(keys.count()) or whole(rows, keys, on))
    for how in ({}, {"crowd": 4, "common": 100}):
        got = {r.doc_id: r.component_id for r in op.groups(docs, **how).collect()}
        assert got == dict(enumerate(slow_groups(texts)))
    assert moved == [2, 2]


def test_fingerprints_of_pairs_at_the_similarity_pass():
    rng = np.random.default_rng(4)
    for n in (64, 90, 300):
        apart = []
        for _ in range(200):
            s = rng.integers(0, 1 << 63, 10 * n // 9 + 1, np.uint64)
            a, b = (np.array(op.fingerprint(x)).view(np.uint64) for x in (s[:n], s[-n:]))  # Jaccard 0.8
            apart.append(int(np.bitwise_count(a ^ b).sum()))
        assert 33 < np.mean(apart) < 43 and max(apart) <= op.most_apart(80) == 84
        far = [np.array(op.fingerprint(rng.integers(0, 1 << 63, n, np.uint64))).view(np.uint64) for _ in range(2)]
        assert np.bitwise_count(far[0] ^ far[1]).sum() > 84
