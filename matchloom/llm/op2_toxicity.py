"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct words and their 4- and 5-byte beginnings (which carry stems through endings), hashed
into `2 ** hash_bits` numbers. A second-order factorization machine scores them: besides one weight per term, each term
has a short vector, and the product of two vectors is the weight of that pair, so an insult next to a group mention can
count for more than both alone.

The fit takes at most `sample` labelled rows of each class of the training fold, chosen by a hash of their id, keeps the
terms that tell the classes apart (G-squared over `min_g2`, at most `terms`), and runs on those. Only hashed terms of the
sample reach the driver. Scoring covers every document in one pass, with the small model in the closure.

Defined results: null and empty texts score as the bias says; repeated rows score alike; labels of unknown or null ids
and null labels are not used; ids labelled twice count twice; without labels of both classes every score is the share of toxic rows
(0 without any).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.common import held_out, map_batches, narrow, raw_texts

PRODUCTION = {"sample": 5000, "terms": 4096, "factors": 8, "hash_bits": 22, "threshold": 0.3}
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(word: bytes, bits: int) -> list[int]:
    """Hashed terms of one word."""
    mask = (1 << bits) - 1
    out = [xxh64_intdigest(b"w" + word) & mask]
    for k in (4, 5):
        if len(word) > k:
            out.append(xxh64_intdigest(b"p" + word[:k]) & mask)
    return out


def words_in(text: bytes) -> set[bytes]:
    return set(text.lower().translate(LETTERS).split())


def term_sets(docs: DataFrame, bits: int) -> DataFrame:
    """(toxic, terms) of rows with text and toxic."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [sorted({t for w in words_in(x) for t in terms_of(w, bits)}) for x in raw_texts(b)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], ["toxic", "terms"])

        return step

    return map_batches(docs.select("toxic", "text"), make, "toxic int, terms array<int>")


def g_squared(pos: np.ndarray, neg: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio of class and presence for each term."""
    total, out = n1 + n0, np.zeros(len(pos))
    for have, n in ((pos, n1), (neg, n0)):
        for seen, all_seen in ((have, pos + neg), (n - have, total - pos - neg)):
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(seen > 0, 2 * seen * np.log(seen * total / (all_seen * n)), 0)
    return out


class FactorizationMachine:
    """w0 + sum of weights + sum over pairs of vector products, over present terms; fitted by AdaGrad on log loss."""

    def __init__(self, n: int, factors: int, bias: float, seed: int = 5):
        self.w0, self.w = bias, np.zeros(n)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, factors))

    def logits(self, idx: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows are idx[ends[i]:ends[i + 1]]."""
        cw = np.concatenate([[0.0], np.cumsum(self.w[idx])])
        v = self.v[idx]
        cv = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, 0)])
        cs = np.concatenate([[0.0], np.cumsum((v * v).sum(1))])
        s = cv[ends[1:]] - cv[ends[:-1]]
        return self.w0 + cw[ends[1:]] - cw[ends[:-1]] + 0.5 * ((s * s).sum(1) - (cs[ends[1:]] - cs[ends[:-1]]))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.15, l2: float = 1e-4, seed: int = 5) -> FactorizationMachine:
        rng = np.random.default_rng(seed)
        gw, gv, g0 = np.full(len(self.w), 1e-6), np.full(self.v.shape, 1e-6), 1e-6
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                sizes = np.array([len(rows[i]) for i in part])
                idx = np.concatenate([rows[i] for i in part]).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                err = 1 / (1 + np.exp(-np.clip(self.logits(idx, ends), -35, 35))) - y[part]
                e = np.repeat(err, sizes) / len(part)
                v = self.v[idx]
                cv = np.concatenate([np.zeros((1, v.shape[1])), np.cumsum(v, 0)])
                s = np.repeat(cv[ends[1:]] - cv[ends[:-1]], sizes, axis=0)
                dw, dv = np.bincount(idx, e, len(self.w)) + l2 * self.w, l2 * self.v
                for f in range(self.v.shape[1]):
                    dv[:, f] += np.bincount(idx, e * (s[:, f] - v[:, f]), len(self.w))
                d0 = float(err.mean())
                gw, gv, g0 = gw + dw * dw, gv + dv * dv, g0 + d0 * d0
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= 0.3 * rate * dv / np.sqrt(gv)
                self.w0 -= rate * d0 / np.sqrt(g0)
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5000, terms: int = 4096, factors: int = 8, hash_bits: int = 22, min_g2: float = 12.0) -> tuple[dict[int, int], FactorizationMachine]:
    """Kept terms (hash to row) and the machine, from the training fold's labels."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("_id"), 4, 2)).withColumn("_order", F.xxhash64("_id"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    taken = known.where("toxic = 0").orderBy("_order").limit(sample).unionByName(known.where("toxic = 1").orderBy("_order").limit(sample))
    text = narrow(docs, "doc_id", "text").join(taken.select("_id", "toxic"), F.col("doc_id") == F.col("_id")).select("toxic", "text")
    got = term_sets(text, hash_bits).toArrow()
    y = np.array(got.column("toxic").to_pylist(), float)
    bias = float(np.log(min(max(share, 1e-6), 1 - 1e-6) / (1 - min(max(share, 1e-6), 1 - 1e-6))))
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        return {}, FactorizationMachine(0, factors, bias)
    rows = [np.array(x, np.int64) for x in got.column("terms").to_pylist()]
    size = 1 << hash_bits
    pos = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=size)
    neg = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if not t]), minlength=size)
    seen = np.flatnonzero(pos + neg >= 3)
    g2 = g_squared(pos[seen].astype(float), neg[seen].astype(float), n1, n0)
    best = seen[np.argsort(-g2, kind="stable")][: min(terms, int((g2 >= min_g2).sum()))]
    at = {int(t): k for k, t in enumerate(best)}
    where = np.full(size, -1)
    where[best] = np.arange(len(best))
    kept = [(k := where[r])[k >= 0] for r in rows]
    return at, FactorizationMachine(len(best), factors, bias).fit(kept, y)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, hash_bits: int = 22, **how) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    at, fm = fit(docs, labels, hash_bits=hash_bits, **how)

    def make():
        cache: dict[bytes, tuple[int, ...]] = {}

        def terms(text: bytes) -> set[int]:
            out: set[int] = set()
            for w in words_in(text):
                k = cache.get(w)
                if k is None:
                    if len(cache) > 500_000:
                        cache.clear()
                    k = cache[w] = tuple(at[t] for t in terms_of(w, hash_bits) if t in at)
                if k:
                    out.update(k)
            return out

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [sorted(terms(t)) for t in raw_texts(b)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
            x = fm.logits(np.array([i for r in rows for i in r], np.int64), ends)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], ["doc_id", "score"])

        return step

    out = map_batches(narrow(docs, "doc_id", "text"), make, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
