"""Phrases of words that stand together more often than their parts foretell, per language.

The layout follows external-memory language model estimation. For each length there is one stream of counted phrases,
held in prefix order (by its first words) and in suffix order (by its last). A phrase's record carries the counts of all
its beginnings and all its ends: the stream of n words merged in prefix order with the stream of n - 1 words takes over
that record's beginnings and its own count, merged in suffix order its ends. The same two orders, read the other way,
give a phrase the largest count of a phrase that extends it by a word to the right or to the left. All these joins are
sort-merge joins of sorted streams in lockstep; no table of counts is held in memory or looked up by hash.

Counting: tasks count the phrases of bounded portions of their texts, Spark adds the portions up. A phrase reaches `least`
only if both phrases of one word less do, so streams of three and more words are counted over those alone: a filter of fixed
size lets them pass (when full it lets others pass too, which the counts then drop).

Counts and products are exact: products are decimals of 38 digits, good for phrases that occur up to 10^16 times.

Defined results: a null or empty text has no words; a null language is `unknown`; repeated rows count each time; phrases
never cross the separators . , ; : ! ? and line ends; ties of cuts go to the shorter first part, ties of rank to the larger
count, then to the phrase in UTF-8 byte order; texts of any length are read whole, in portions of `chunk` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.bloom import filter_from, gathered, sized
from matchloom.llm.common import cut_lineage, narrow, raw_texts

PRODUCTION = {"least": 10, "longest": 3, "top": 2000, "share": 50, "unknown": "und"}
BREAKS = b".,;:!?\n\x0b\x0c\r"
MARKS = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")
#: Seed of Spark's xxhash64; its hash of several columns takes each as the seed of the next.
SEED = 42
#: Words counted at once by a task, rows of one Arrow batch.
CHUNK, ROWS = 1 << 20, 1 << 16


def tokens(text: bytes) -> list[bytes]:
    """Words of one text with a line feed wherever a piece ends."""
    return [w for w in text.lower().translate(MARKS).replace(b"\n", b" \n ").split(b" ") if w] + [b"\n"]


class Counter:
    """Counts of the phrases of some lengths in one language's words, over numbers of this portion's distinct words."""

    def __init__(self, lang: str):
        self.lang, self.names, self.ids = lang, {b"\n": 0}, []

    def add(self, text: bytes) -> int:
        names, new = self.names, tokens(text)
        self.ids.append(np.array([names.setdefault(w, len(names)) for w in new], np.int64))
        return len(new)

    def streams(self, lengths: tuple[int, ...], seen) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """(numbers of the first, second, ... word, counts) of each length's phrases.

        With `seen`, only phrases whose two parts of one word less pass that filter.
        """
        ids, v = np.concatenate(self.ids), len(self.names)
        words = list(self.names)
        code, ok, parts = ids, ids != 0, [np.arange(v)]
        hashes = [xxh64_intdigest(w, xxh64_intdigest(self.lang.encode(), SEED)) for w in words] if seen else []
        for n in range(1, max(lengths) + 1):
            if n > 1:
                both = ok[:-1] & (ids[n - 1 :] != 0)
                if seen and n == max(lengths):
                    passed = np.append(seen.has(np.array(hashes, np.uint64)), False)  # a portion may hold no phrase
                    both &= passed[code[:-1]] & passed[code[1:]]
                ok = both
                pairs, inverse = np.unique(code[:-1][ok] * v + ids[n - 1 :][ok], return_inverse=True)
                code = np.zeros(len(ok), np.int64)
                code[ok] = inverse
                before, last = pairs // v, pairs % v
                parts = [p[before] for p in parts] + [last]
                if seen and n < max(lengths):
                    hashes = [xxh64_intdigest(words[w], hashes[b]) for b, w in zip(before.tolist(), last.tolist(), strict=True)]
            if n in lengths:
                counts = np.bincount(code[ok], minlength=len(parts[0]))
                some = np.flatnonzero(counts)
                yield [p[some] for p in parts], counts[some]


def counted(docs: DataFrame, lengths: tuple[int, ...], seen: bytes | None = None, unknown: str = "und", chunk: int = CHUNK) -> DataFrame:
    """(lang, w1, w2, ..., c): counts of each portion's phrases of these lengths; shorter ones end in nulls."""
    width = max(lengths)
    cast = docs.sparkSession.sparkContext.broadcast(seen)

    def flush(by_lang: dict[str, Counter], known) -> Iterator[pa.RecordBatch]:
        for lang, counter in by_lang.items():
            words = pa.array(list(counter.names), pa.binary()).cast(pa.string())
            for parts, counts in counter.streams(lengths, known):
                for at in range(0, len(counts), ROWS):
                    n = min(ROWS, len(counts) - at)
                    cols = [words.take(pa.array(p[at : at + n])) for p in parts] + [pa.nulls(n, pa.string())] * (width - len(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * n), *cols, pa.array(counts[at : at + n])], ["lang", *[f"w{k + 1}" for k in range(width)], "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_lang, total = filter_from(cast.value) if cast.value else None, {}, 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), raw_texts(b), strict=True):
                if lang not in by_lang:
                    by_lang[lang] = Counter(lang)
                total += by_lang[lang].add(text)
                if total >= chunk:
                    yield from flush(by_lang, known)
                    by_lang, total = {}, 0
        yield from flush(by_lang, known)

    rows = narrow(docs, "lang", "text").select(F.coalesce("lang", F.lit(unknown)).alias("lang"), "text")
    return rows.mapInArrow(run, "lang string, " + ", ".join(f"w{k + 1} string" for k in range(width)) + ", c long")


def words(n: int, first: int = 1) -> list[str]:
    return [f"w{k}" for k in range(first, first + n)]


def filter_of(stream: DataFrame, n: int, bits: int | None) -> bytes:
    """Filter over the phrases of a stream, of 16 MB at most."""
    return gathered(stream.select(F.xxhash64("lang", *words(n)).alias("key")), bits or sized(stream.count()))


def with_contexts(stream: DataFrame, shorter: DataFrame, n: int) -> DataFrame:
    """Adds `lefts`, the counts of the first 1 .. n - 1 words, and `rights`, those of the last n - 1 .. 1, by two merge joins."""
    here, there = words(n - 1), words(n - 1, 2)
    left = shorter.select("lang", *here, F.concat("lefts", F.array("f")).alias("lefts"))
    right = shorter.select("lang", *[F.col(a).alias(b) for a, b in zip(here, there, strict=True)], F.concat(F.array("f"), "rights").alias("rights"))
    in_prefix_order = stream.join(left.hint("merge"), ["lang", *here])
    return in_prefix_order.join(right.hint("merge"), ["lang", *there]).select("lang", *words(n), "f", "lefts", "rights")


def with_extension(stream: DataFrame, longer: DataFrame, n: int) -> DataFrame:
    """Adds `extended`, the largest count of a phrase of one word more that begins or ends with the phrase."""
    here, there = words(n), words(n, 2)
    right = longer.groupBy("lang", *here).agg(F.max("f").alias("right"))
    left = longer.groupBy("lang", *there).agg(F.max("f").alias("left")).select("lang", *[F.col(b).alias(a) for a, b in zip(here, there, strict=True)], "left")
    out = stream.join(right.hint("merge"), ["lang", *here], "left").join(left.hint("merge"), ["lang", *here], "left")
    return out.withColumn("extended", F.coalesce(F.greatest("right", "left"), F.lit(0))).drop("right", "left")


def scored(stream: DataFrame) -> DataFrame:
    """Adds k, l, r and score of the cut with the lowest score from `f`, `lefts` and `rights`."""
    big = "CAST({} AS DECIMAL(20, 0))".format
    score = f"(({big('f')} * {big('f')}) * 1000000BD) div ({big('lefts[i]')} * {big('rights[i]')})"
    cuts = F.expr(f"transform(sequence(0, size(lefts) - 1), i -> struct({score} AS score, i + 1 AS k, lefts[i] AS l, rights[i] AS r))")
    return stream.withColumn("cut", F.array_min(cuts)).withColumns({c: F.col(f"cut.{c}") for c in ("k", "l", "r", "score")}).drop("cut")


def streams(docs: DataFrame, least: int = 10, longest: int = 3, unknown: str = "und", chunk: int = CHUNK, bits: int | None = None) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(lang, n) totals and, by length, the stream of phrases that occur `least` times or more with their contexts."""
    short = counted(docs, (1, 2), None, unknown, chunk).groupBy("lang", "w1", "w2").agg(F.sum("c").alias("f"))
    short = cut_lineage(short.where((F.col("f") >= least) | F.col("w2").isNull()))
    totals = short.where("w2 IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<long>")
    out = {1: short.where(F.col("w2").isNull() & (F.col("f") >= least)).select("lang", "w1", "f", none.alias("lefts"), none.alias("rights"))}
    for n in range(2, longest + 1):
        if n == 2:
            stream = short.where("w2 IS NOT NULL")
        else:
            seen = filter_of(out[n - 1], n - 1, bits)
            stream = counted(docs, (n,), seen, unknown, chunk).groupBy("lang", *words(n)).agg(F.sum("c").alias("f")).where(F.col("f") >= least)
        out[n] = cut_lineage(with_contexts(stream, out[n - 1], n))
    return totals, out


def phrases(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, share: int = 50, unknown: str = "und", **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `top` phrases of 2 .. `longest` words.

    A phrase goes if a longer one that holds it occurs `share` percent as often; a longer one by more than a word is held by one
    of a single word more that occurs as often or more, so only those are looked at.
    """
    totals, by_length = streams(docs, least, longest, unknown, **how)
    found = []
    for n in range(2, longest + 1):
        stream = by_length[n]
        if n < longest:
            stream = with_extension(stream, by_length[n + 1], n).where(F.col("extended") * 100 < F.col("f") * share)
        found.append(scored(stream).select("lang", F.concat_ws(" ", *words(n)).alias("phrase"), F.col("f").alias("a"), "l", "r", "score"))
    all_lengths = found[0]
    for more in found[1:]:
        all_lengths = all_lengths.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = all_lengths.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the query.
SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM words),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.*, i AS cut, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM cand c, (VALUES (1), (2)) t(i) WHERE i < k),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, h.f AS l, t.f AS r, cut, (c.a::HUGEINT * c.a * 1000000) // (h.f::HUGEINT * t.f) AS score
  FROM cuts c JOIN counts h ON h.lang = c.lang AND h.phrase = c.head JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored),
longer AS (
  SELECT lang, part, max(a) AS extended FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS part FROM cand WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY lang, part),
kept AS (
  SELECT s.* FROM lowest s LEFT JOIN longer g ON g.lang = s.lang AND g.part = s.phrase WHERE s.o = 1 AND 100 * coalesce(g.extended, 0) < 50 * s.a),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
