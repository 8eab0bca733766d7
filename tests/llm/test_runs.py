"""Periodic runs against a plain search of every start and period."""

import random
from hashlib import sha256

import numpy as np
import pytest
from llm.conftest import WORDS

from matchloom.llm import op12_runs as op
from matchloom.llm import queries


def slow_runs(words, least=12):
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            e = i
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e + p - i >= max(least, 2 * p):
                out.setdefault((i, e + p - i), p)
            i = e
    return sorted((s, k, p) for (s, k), p in out.items())


def slow_digests(doc_id, text):
    words = op.periodic_tail(doc_id, (text or "").encode().split())
    found = slow_runs(words)
    drop = {i for s, k, p in found for i in range(s + p, s + k)}
    best = min(((-k, s, p) for s, k, p in found), default=None)
    first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *first, sha256("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()).hexdigest(), sha256(kept).hexdigest())


def word_lists():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 500, list("ab") * 40, list("aab") * 30 + list("aab")[:2], list("abc") * 4 + list("abd") * 4]
    for letters in ("ab", "abc", "abcdefgh"):
        out += [rng.choices(letters, k=rng.randrange(10, 160)) for _ in range(40)]
    for _ in range(40):  # powers inside powers, cut off anywhere
        w = rng.choices("abc", k=rng.randrange(1, 8))
        v = w * rng.randrange(2, 9) + rng.choices("ab", k=rng.randrange(4))
        out.append((v * rng.randrange(1, 6))[rng.randrange(4) :] + rng.choices("abc", k=9))
    fib = ["a"], ["a", "b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    return [[x.encode() for x in w] for w in [*out, fib[1]]]


@pytest.mark.parametrize("least", [12, 2, 5])
def test_runs_match_a_plain_search(least, monkeypatch):
    texts = word_lists()
    want = [slow_runs(t, least) for t in texts]
    for cut in (1 << 20, 97):  # slices of the grid in the middle of a period
        monkeypatch.setattr(op, "SLICE", cut)
        assert [[tuple(map(int, r)) for r in f] for f in op.runs_of(texts, least)] == want


def test_extensions_match_a_plain_comparison():
    rng = np.random.default_rng(1)
    words = np.concatenate([[100], rng.integers(0, 2, 400), [101], np.tile(rng.integers(0, 2, 30), 9), [102]])
    g = op.Grammar(words, words >= 100)
    i = rng.integers(1, len(words) - 2, 4000)
    j = np.minimum(i + 1 + rng.integers(0, 200, 4000), len(words) - 2)
    i, j = i[i < j], j[i < j]

    def plain(a, b, d):
        k = 0
        while words[a] == words[b] and words[a] < 100:
            a, b, k = a + d, b + d, k + 1
        return k

    assert g.extend(i, j, True).tolist() == [plain(a, b, 1) for a, b in zip(i, j, strict=True)]
    assert g.extend(i, j, False).tolist() == [plain(a, b, -1) for a, b in zip(i, j, strict=True)]


def test_query_on_odd_rows_equals_brute_force(spark, docs, rows, no_docs, tmp_path, monkeypatch):
    rng = random.Random(8)
    more = [(1000 + k, " ".join(rng.choices(WORDS, k=rng.randrange(1, 150)))) for k in range(60)]
    many = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    monkeypatch.setattr(op, "CHUNK", 500)
    many.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((slow_digests(i, t) for i, t in [*rows, *more]), key=repr)
    assert op.runs(no_docs).count() == 0


def test_very_long_text_of_one_phrase(spark):
    text = "alpha beta gamma " * 100_000
    r = op.runs(spark.createDataFrame([(1, text), (2, "x y " + text)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [[tuple(x) for x in row.runs] for row in r] == [[(0, 300_000, 3)], [(2, 300_000, 3)]]
    assert [row.collapsed for row in r] == ["alpha beta gamma", "x y alpha beta gamma"]
