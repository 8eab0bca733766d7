"""Periodic runs of words by recompression.

A run is a stretch of words with smallest period q, at least max(`least`, 2 q) words long, that no neighbour extends.
The words of many texts, set apart by separators that occur once each, are compressed level by level: stretches of one
symbol become one symbol (block compression), then neighbours from a left and a right half of the alphabet become one
symbol (pair compression), in turn. This is a run-length grammar whose rules are parsed alike wherever the same words
stand, but for the first symbol of a level. So the longest common extension of two places climbs the levels while their
symbols agree, one step a level, and comes down again at the first that differ.

A run with period p holds two neighbouring places of the grid 0, p, 2p, ... of its text. For every p, neighbouring grid
places with equal words are candidates; extensions to both sides give the run exactly. There are n log n of them for a
text of n words, worked through in slices of bounded size. No suffix array is built.

Each text is judged whole in the task that reads it; nothing is shuffled. Defined results: a null, empty or blank text
has no words and no runs; repeated rows each get their row; a null doc_id stays null; a text of any length is one
grammar, whose memory grows with that text alone; of equal stretches found for several periods the smallest counts.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import map_batches, narrow, raw_texts

PRODUCTION = {"least": 12}
#: Words put into one grammar (a longer text has one of its own), and grid places looked at in one slice.
CHUNK, SLICE = 1 << 17, 1 << 20
Words = list[bytes]


class Level:
    """One string of the grammar and how its symbols make up those of the next."""

    def __init__(self, sym: np.ndarray, sep: np.ndarray, block: bool, rng: np.random.Generator):
        self.sym, self.block = sym, block
        if block:
            starts = np.flatnonzero(np.append(True, sym[1:] != sym[:-1]))
            size = np.diff(np.append(starts, len(sym)))
            code = sym[starts] * (int(size.max()) + 1) + size
            same = len(starts) == len(sym)
        else:
            self.right = rng.random(int(sym.max()) + 1)[sym] < 0.5
            pair = ~self.right[:-1] & self.right[1:] & ~sep[:-1] & ~sep[1:]
            starts = np.flatnonzero(np.append(True, ~pair))
            paired = np.append(pair, False)[starts]
            after = np.where(paired, sym[np.minimum(starts + 1, len(sym) - 1)] + 1, 0)
            code = sym[starts] * (int(sym.max()) + 2) + after
            same = not paired.any()
        self.first = np.append(starts, len(sym))
        marks = np.zeros(len(sym), np.int64)
        marks[starts] = 1
        self.up = np.cumsum(marks) - 1
        self.above = sym[starts] if same else np.unique(code, return_inverse=True)[1]
        self.above_sep = sep[starts]

    def ahead(self, a: np.ndarray) -> np.ndarray:
        """Symbols from each place to the end of its block."""
        return self.first[self.up[a] + 1] - a

    def behind(self, a: np.ndarray) -> np.ndarray:
        return a - self.first[self.up[a]] + 1


class Grammar:
    """Run-length grammar over `words` (numbers, with a separator first and after each text); levels are made when asked for."""

    def __init__(self, words: np.ndarray, sep: np.ndarray):
        self.rng = np.random.default_rng(len(words))
        self.levels = [Level(words, sep, True, self.rng)]

    def level(self, k: int) -> Level:
        while len(self.levels) <= k:
            below = self.levels[-1]
            self.levels.append(Level(below.above, below.above_sep, not below.block, self.rng))
        return self.levels[k]

    def extend(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from places i and j (i < j) on, ahead or, with i and j included, behind."""
        step = 1 if forward else -1
        ids, a, b, parted, k = np.arange(len(i)), i, j, [], 0
        while len(ids):
            lv = self.level(k)
            same = lv.sym[a] == lv.sym[b]
            left = [(ids[~same], a[~same], b[~same])]
            ids, a, b = ids[same], a[same], b[same]
            if lv.block:
                ra, rb = (lv.ahead(a), lv.ahead(b)) if forward else (lv.behind(a), lv.behind(b))
                m, whole = np.minimum(ra, rb) * step, ra == rb
                a, b = a + m, b + m
                left.append((ids[~whole], a[~whole], b[~whole]))
                ids, a, b = ids[whole], a[whole], b[whole]
            else:  # a right symbol may end a pair begun before the place, a left one may begin a pair ended after it
                single = (lv.right[a] if forward else ~lv.right[a]) * step
                a, b = a + single, b + single
            parted.append([np.concatenate(x) for x in zip(*left, strict=True)])
            a, b, k = lv.up[a], lv.up[b], k + 1
        ids, a, b = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(len(parted) - 1, -1, -1):
            lv = self.levels[k]
            if len(ids):
                a, b = (lv.first[a], lv.first[b]) if forward else (lv.first[a + 1] - 1, lv.first[b + 1] - 1)
                same = lv.sym[a] == lv.sym[b]
                if lv.block:
                    m = np.minimum(lv.ahead(a), lv.ahead(b)) if forward else np.minimum(lv.behind(a), lv.behind(b))
                else:
                    m = np.ones(len(a), np.int64)
                a, b = a + m * same * step, b + m * same * step
            ids, a, b = (np.concatenate(x) for x in zip((ids, a, b), parted[k], strict=True))
        out = np.empty(len(i), np.int64)
        out[ids] = (a - i[ids]) * step
        return out


def candidates(words: np.ndarray, at: np.ndarray, size: np.ndarray, least: int):
    """Slices (text, grid place i, period p) with equal words at i and i + p, of all periods of texts of `least` words or more."""
    text = np.repeat(np.arange(len(size)), np.where(size >= least, size // 2, 0))
    if not len(text):
        return
    p = np.arange(len(text)) - np.searchsorted(text, text) + 1
    ends = np.cumsum((size[text] - 1) // p)
    for lo in range(0, int(ends[-1]), SLICE):
        hi = min(lo + SLICE, int(ends[-1]))
        r0, r1 = np.searchsorted(ends, lo, "right"), np.searchsorted(ends, hi, "left") + 1
        begin = np.append(0, ends)[r0:r1]
        count = np.minimum(ends[r0:r1], hi) - np.maximum(begin, lo)
        row = np.repeat(np.arange(r0, r1), count)
        i = at[text[row]] + (np.arange(lo, hi) - np.repeat(begin, count)) * p[row]
        ok = words[i] == words[i + p[row]]
        yield text[row[ok]], i[ok], p[row[ok]]


def runs_of(texts: list[Words], least: int = 12) -> list[np.ndarray]:
    """Rows (start, length, period) of each text's runs, by start, then period; all texts share one grammar."""
    names: dict[bytes, int] = {}
    size = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(size + 1) - size
    words = np.empty(int(size.sum()) + len(size) + 1, np.int64)
    sep = np.zeros(len(words), bool)
    sep[np.append(0, at + size)] = True
    words[~sep] = [names.setdefault(w, len(names)) for t in texts for w in t]
    words[sep] = len(names) + np.arange(len(size) + 1)
    grammar, found = Grammar(words, sep), []
    for text, i, p in candidates(words, at, size, least):
        ahead = grammar.extend(i, i + p, True)
        behind = grammar.extend(i - 1, i + p - 1, False)
        length = ahead + behind + p
        ok = (behind < p) & (length >= np.maximum(least, 2 * p))
        found.append(np.stack([text[ok], (i - behind - at[text])[ok], length[ok], p[ok]], axis=1))
    rows = np.concatenate([np.zeros((0, 4), np.int64), *found])
    rows = rows[np.lexsort(rows.T[::-1])]  # text, start, length, period: the smallest period of a stretch comes first
    rows = rows[np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1))] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    return np.split(rows[:, 1:], np.searchsorted(rows[:, 0], np.arange(1, len(texts))))


def collapsed(words: Words, runs: np.ndarray) -> bytes:
    """The words that no run repeats: of each run only the first period stays."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def as_read(doc_id: int | None, words: Words) -> Words:
    return words


def periodic_tail(doc_id: int | None, words: Words) -> Words:
    """The query's own change of one document in ten: from some word on, one stretch of words over and over."""
    h = crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def runs(docs: DataFrame, least: int = 12, words_of: Callable[[int | None, Words], Words] = as_read) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [words_of(i, t.split()) for i, t in zip(b.column(0).to_pylist(), raw_texts(b), strict=True)]
            found, some, total = [], [], 0
            for t in texts:
                if some and total + len(t) > CHUNK:
                    found += runs_of(some, least)
                    some, total = [], 0
                some.append(t)
                total += len(t)
            found += runs_of(some, least)
            flat = np.concatenate(found)
            ends = np.append(0, np.cumsum([len(f) for f in found]))
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"]))
            kept = pa.array([collapsed(t, f) for t, f in zip(texts, found, strict=True)], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), spans, kept], ["doc_id", "n_words", "runs", "collapsed"])

        return step

    rows = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return map_batches(rows, make, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the longest run (of equally long ones the first) and digests of what `runs` found."""
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS minus, r.start, r.period)))")
    listed = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period) || '\n'), '')")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("b.start"), (-F.col("b.minus")).alias("length"), F.col("b.period"),
        F.expr("-b.minus * 1000 div b.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
