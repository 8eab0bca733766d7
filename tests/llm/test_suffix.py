import hashlib
import random
from collections import Counter

import numpy as np
from llm.conftest import WORDS, as_rows, texts

from matchloom.llm import op7_suffix as op


def slow(ts, length=400):
    raw = [(t or "").encode() for t in ts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        upto = 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[max(i, upto) : i + length] = True
                upto = i + length
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum())
        left = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def corpus():
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    common, other = say(70), say(60)
    long = say(900)
    out = texts() + [say(20) + common + say(30), say(45) + common + say(5), common, say(3) + other + say(3) + other, long, long[:2000] + "Z" + long[2001:], long[700:1500], "ab" * 900, "ab" * 450 + say(30)]
    near = say(250)
    for _ in range(40):  # near copies: one crowded bucket after the other
        k = rng.randrange(len(near))
        out.append(near[:k] + "é" + near[k:] + say(rng.randrange(4)))
    out += [near[: 400 + d] + "@" for d in (-1, 0, 1)]
    rng.shuffle(out)
    return out


def test_rows_match_brute_force_however_crowded(spark):
    ts = corpus()
    docs = spark.createDataFrame([(None if i % 17 == 3 else i // 2, t, "clash") for i, t in enumerate(ts)], "doc_id long, text string, key string").repartition(5)
    want = sorted(((None if i % 17 == 3 else i // 2, *r) for i, r in enumerate(slow(ts))), key=repr)
    for crowd, block in ((2000, 3 << 20), (3, 20_000)):
        got = op.repeats(docs, crowd=crowd, block_bytes=block)
        assert as_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want, crowd
    kept = op.repeats(docs, kept=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept)
    assert op.repeats(docs.limit(0)).count() == 0


def test_cover_meets_every_pair_of_residues():
    assert {(a - b) % op.MODULUS for a in op.COVER for b in op.COVER} == set(range(op.MODULUS))


def test_block_order_groups_equal_strings():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 100, 700).astype(np.uint8)
    parts = [base[:600], base[:600].copy(), base[:600].copy()]
    parts[1][410] = 35
    parts[2][7] = 36
    buf, ends = np.concatenate(parts), np.array([0, 600, 1200, 1800])
    owner, inside, cls = op.repeated_in_block(buf, ends, np.array([1, 1, 1]), np.array([180, 180, 180]), np.array([200, 200, 200]), 400)
    raw = [bytes(buf[ends[o] + i : ends[o] + i + 400]) for o, i in zip(owner, inside, strict=True)]
    groups = {}
    for c, i, r in zip(cls, inside, raw, strict=True):
        groups.setdefault((i, r), set()).add(c)
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_runs_cover_every_start_once():
    rng = random.Random(1)
    ts = [bytes(rng.choice(b"abcdef ") for _ in range(n)) for n in (0, 399, 400, 401, 5000, 3)] + [b"x" * 1500]
    buf, ends = np.frombuffer(b"".join(ts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in ts])])
    text, first, stop, anchor, _ = op.runs(buf, ends, 400)
    got = sorted((int(t), p) for t, a, b in zip(text, first, stop, strict=True) for p in range(a, b))
    assert got == [(k, int(ends[k]) + i) for k, t in enumerate(ts) for i in range(len(t) - 399)]
    assert all(a <= m and m + op.GRAM <= b - 1 + 400 for a, b, m in zip(first, stop, anchor, strict=True))


def test_the_second_hash_does_not_follow_from_the_first(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in ("", "a", "some words")], "text string")
    rows = df.select(*op.two_hashes("text"), F.xxhash64("text", F.lit("second")).alias("chained")).collect()
    assert all(r.h2 not in (r.h1, r.chained) for r in rows)
