"""Repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Whether a suffix's first `length`
bytes occur twice shows in a suffix order cut at that depth, which is built bucket by bucket:

1. buckets: a suffix goes by the minimiser (the least 16-byte hash) of its first `length` bytes, so equal strings share
   a bucket and an offset from the minimiser. One record carries the run of suffixes with one minimiser, some 200 of
   them, as one slice of text. Only small keys are grouped first; a bucket with one record holds no repeat.
2. copies of whole texts stand for one another: a text that occurs twice loses all its bytes if it has `length` of them,
   and only one row of it goes on.
3. one block of buckets at a time is sorted in a task: by the first bytes, and ties by ranks of cover samples. Sampled
   places (offset from the minimiser, modulo 31, in a difference cover) get ranks of 31, 62, 124 and 248 bytes by
   doubling, before the sort; a tie is settled by a few rank look-ups instead of comparing bytes, so memory is bounded
   by the block.
4. a bucket with over `crowd` records is dealt over tasks. Suffixes that repeat within a task's share are settled
   there; the others, and one of each repeated kind, are counted by a 128-bit hash over all shares.

Defined results: null and empty texts have no bytes; texts shorter than `length` lose nothing; repeated rows are copies;
matches never cross texts; positions count UTF-8 bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm.common import cut_lineage, map_batches, narrow

PRODUCTION = {"length": 400, "crowd": 2000, "block_bytes": 1 << 20}
GRAM = 16
#: A perfect difference set, every remainder modulo 31 is a difference of two of these.
COVER, MODULUS = (0, 1, 3, 8, 12, 18), 31
NEXT = np.array([min((c - r) % MODULUS for c in COVER) for r in range(MODULUS)])
NTH = np.array([sum(c < r for c in COVER) for r in range(MODULUS)])
C1, C2, C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def eight(buf: np.ndarray) -> np.ndarray:
    """Big-endian number of the eight bytes from each place; the last seven places are padded with zeros."""
    n = len(buf)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    out = np.empty(n + 8 - n % 8 if n % 8 else n, np.uint64)
    for o in range(8):
        out[o::8] = np.frombuffer(padded, ">u8", len(out) // 8, o)
    return out[:n]


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ a >> np.uint64(32)) * C1
    a = (a ^ a >> np.uint64(29)) * C3
    return a ^ a >> np.uint64(32)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, from running minima of blocks to both sides."""
    n = len(v)
    pad = -n % w
    x = np.concatenate([v, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def runs(buf: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of suffixes with one minimiser over texts laid end to end (ends: their borders, from 0).

    Returns text number, first start, one past the last start, place of the minimiser, its key.
    """
    w, block = length - GRAM + 1, 1 << 20
    parts = []
    for lo in range(0, max(0, len(buf) - length + 1), block - length):
        piece = buf[lo : lo + block]
        if len(piece) < length:
            break
        words = eight(piece)
        grams = mixed(words[: len(piece) - GRAM + 1] * C2 ^ mixed(words[8 : len(piece) - GRAM + 9]))
        # leftmost of equal hashes: places in a window grow from left to right
        least = sliding_min(grams & ~np.uint64(block - 1) | np.arange(len(grams), dtype=np.uint64), w)[: block - length]
        anchor = (least & np.uint64(block - 1)).astype(np.int64)
        start = lo + np.arange(len(anchor))
        text = np.searchsorted(ends, start, "right") - 1
        ok = start + length <= ends[text + 1]
        new = ok & np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(new)
        if len(first):
            stop = np.flatnonzero(ok & np.concatenate([(anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~ok[1:], [True]]))
            parts.append((text[first], start[first], start[stop] + 1, lo + anchor[first], grams[anchor[first]]))
    if not parts:
        e = np.zeros(0, np.int64)
        return e, e, e, e, e.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and their borders."""
    t = texts.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = t.buffers()
    at = np.frombuffer(offs, np.int64)[t.offset : t.offset + len(t) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def ranked(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows in lexicographic order of the columns."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class CoverRanks:
    """Ranks of the sampled places of slices laid end to end, for 31 * 2 ** i bytes."""

    def __init__(self, words: np.ndarray, ends: np.ndarray, offset: np.ndarray, levels: int = 3):
        """offset: for each slice, minus the place of its minimiser, so that places count from there."""
        owner = np.repeat(np.arange(len(offset)), np.diff(ends))
        inside = np.arange(ends[-1]) - ends[owner]
        self.residue = (inside + offset[owner]) % MODULUS
        left = ends[owner + 1] - np.arange(ends[-1])
        sampled = np.isin(self.residue, COVER)
        self.at = np.full(ends[-1], -1)
        own = np.flatnonzero(sampled & (left >= MODULUS))
        self.at[own] = np.arange(len(own))
        tail = words[own + 24] >> np.uint64(8) if len(own) else words[:0]
        self.ranks = [ranked(words[own], words[own + 8], words[own + 16], tail)]
        left = left[own]
        for i in range(levels):
            span = MODULUS << i
            far = np.where(left >= 2 * span, self.at[np.minimum(own + span, ends[-1] - 1)], -1)
            r = self.ranks[-1]
            self.ranks.append(np.where(far >= 0, ranked(r, np.where(far >= 0, r[far], -1)), -1))

    def of(self, level: int, places: np.ndarray) -> np.ndarray:
        return self.ranks[level][self.at[places]]


def repeated_in_block(buf: np.ndarray, ends: np.ndarray, bucket: np.ndarray, rel: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the suffixes of a block of buckets to the given depth.

    Slice i holds count[i] suffixes, its minimiser is rel[i] bytes in, bucket numbers are ints. Returns the slice and
    place of every suffix, and the number of its class: equal numbers, equal strings.
    """
    words = np.concatenate([eight(buf), np.zeros(32, np.uint64)])
    ranks = CoverRanks(words, ends, -rel)
    owner = np.repeat(np.arange(len(count)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = ends[owner] + inside
    key = bucket[owner] * np.int64(2 * length) + (rel[owner] - inside)  # bucket and offset from the minimiser
    # by bucket and the first eight bytes
    order = np.lexsort((words[place], key))
    k, w = key[order], words[place[order]]
    same = (k[1:] == k[:-1]) & (w[1:] == w[:-1])
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    cls = np.empty(len(place), np.int64)
    cls[order] = np.cumsum(~np.concatenate([[False], same]))
    # ties: the bytes before the first sampled place, ranks from there on, and what the ranks leave at the end
    t = order[tied]
    if len(t):
        p = place[t]
        q = p + NEXT[ranks.residue[p]]
        columns, reach, level = [cls[t], words[p + 5]], q, len(ranks.ranks) - 1
        while level >= 0:
            span = MODULUS << level
            fits = bool((reach + span <= p + length).all())
            if fits:
                columns.append(ranks.of(level, reach))
                reach = reach + span
            else:
                level -= 1
        end = p + length
        for back in range(8, int((end - reach).max()) + 8, 8):
            columns.append(words[np.maximum(end - back, p)])
        cls[t] = len(place) + 1 + ranked(*columns)
    return owner, inside, cls


def window_hashes(buf: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the `length` bytes at each place, from running sums of powers."""
    out = []
    table = mixed(np.arange(1, 513, dtype=np.uint64) * C2)
    for odd, half in ((0x9E3779B97F4A7C15, table[:256]), (0xD6E8FEB86659FD93, table[256:])):
        n = len(buf) + 1
        power = np.multiply.accumulate(np.full(n, odd, np.uint64))
        inverse = np.multiply.accumulate(np.full(n, pow(odd, -1, 1 << 64), np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(half[buf] * power[:-1])])
        out.append(mixed((sums[place + length] - sums[place]) * inverse[place]))
    return out[0], out[1]


SLICE = "key long, share int, crowded boolean, rel int, n int, start long, h1 long, h2 long, body binary"


def slices(texts: DataFrame, length: int) -> DataFrame:
    """Records of the texts' repeated minimisers: (h1, h2, text, keys) to SLICE rows."""

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 500):
                b = big.slice(at, 500)
                buf, ends = laid_out(b.column(2))
                text, first, stop, anchor, key = runs(buf, ends, length)
                key = key.view(np.int64)
                wanted = b.column(3)
                flat, sizes = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
                keys, shares = flat.field("key").to_numpy(), flat.field("shares").to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                known = dict(zip(zip(row.tolist(), keys.tolist(), strict=True), shares.tolist(), strict=True))
                hit = np.array([known.get(x, 0) for x in zip(text.tolist(), key.tolist(), strict=True)], np.int64)
                take = hit > 0
                if not take.any():
                    continue
                text, first, stop, anchor, key = (x[take] for x in (text, first, stop, anchor, key))
                hit = hit[take]
                h1, h2 = (b.column(i).to_numpy()[text] for i in (0, 1))
                share = (h1 ^ first) % hit
                raw = buf.tobytes()
                body = [raw[s : e + length - 1] for s, e in zip(first.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(share.astype(np.int32)), pa.array(hit > 1), pa.array((anchor - first).astype(np.int32)), pa.array((stop - first).astype(np.int32)), pa.array(first - ends[text]), pa.array(h1), pa.array(h2), pa.array(body, pa.binary())],
                    [c.split()[0] for c in SLICE.split(", ")])

    return texts.mapInArrow(run, SLICE)


#: Settled starts (from, upto), or an open suffix with its hash; of repeated open ones one row stands for them (start null).
SORTED = "h1 long, h2 long, start long, upto long, w1 long, w2 long, times int"


def sorted_blocks(records: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """Sorts records, dealt and ordered by bucket, one block of whole buckets at a time."""

    def settle(t: pa.Table):
        names = t.column_names
        col = {c: t.column(c).combine_chunks() for c in names}
        num = {c: col[c].to_numpy(zero_copy_only=False) for c in names if c != "body"}
        buf, ends = laid_out(col["body"])
        change = np.concatenate([[True], (num["key"][1:] != num["key"][:-1]) | (num["share"][1:] != num["share"][:-1])])
        owner, inside, cls = repeated_in_block(buf, ends, np.cumsum(change), num["rel"].astype(np.int64), num["n"].astype(np.int64), length)
        order = np.argsort(cls, kind="stable")
        same = cls[order][1:] == cls[order][:-1]
        twice = np.zeros(len(cls), bool)
        twice[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        # runs of repeated starts, slice by slice
        begin = twice & np.concatenate([[True], ~twice[:-1] | (owner[1:] != owner[:-1])])
        end = twice & np.concatenate([~twice[1:] | (owner[1:] != owner[:-1]), [True]])
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        null = np.zeros(len(b), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(num["h1"][owner[b]]), pa.array(num["h2"][owner[b]]), pa.array(num["start"][owner[b]] + inside[b]), pa.array(num["start"][owner[b]] + inside[e] + 1), *[pa.nulls(len(b), pa.int64())] * 2, pa.array(null.astype(np.int32))], [c.split()[0] for c in SORTED.split(", ")])
        hot = num["crowded"][owner]
        if hot.any():
            one = np.zeros(len(cls), bool)
            one[order[np.concatenate([[True], ~same])]] = True  # the first of each class
            o = np.flatnonzero(hot & one)
            w1, w2 = window_hashes(buf, ends[owner[o]] + inside[o], length)
            single = ~twice[o]
            start = pa.array(num["start"][owner[o]] + inside[o], mask=~single)
            yield pa.RecordBatch.from_arrays([pa.array(num["h1"][owner[o]]), pa.array(num["h2"][owner[o]]), start, pa.nulls(len(o), pa.int64()), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(np.where(single, 1, 2).astype(np.int32))], [c.split()[0] for c in SORTED.split(", ")])

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for big in batches:
            t = pa.Table.from_batches([big])
            at = 0
            while at < t.num_rows:
                part = t.slice(at, 2000)
                at += part.num_rows
                held.append(part)
                size += part.column("body").nbytes
                if size >= block_bytes:
                    whole = pa.concat_tables(held)
                    key, share = (whole.column(c).to_numpy() for c in ("key", "share"))
                    cut = np.flatnonzero((key[1:] != key[:-1]) | (share[1:] != share[:-1]))
                    if len(cut):  # the last bucket may go on
                        yield from settle(whole.slice(0, int(cut[-1]) + 1))
                        whole = whole.slice(int(cut[-1]) + 1)
                    held, size = [whole], whole.column("body").nbytes
        if held:
            yield from settle(pa.concat_tables(held))

    return records.mapInArrow(run, SORTED)


def removed_ranges(starts: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Maximal runs of bytes covered by strings that start in these ranges."""
    out: list[list[int]] = []
    for s, u in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], u - 1 + length)
        else:
            out.append([s, u - 1 + length])
    return out


def two_hashes(name: str) -> list[Column]:
    """h1 and h2 of a text. Columns are hashed in turn, each seeded by the one before, so the literal comes first."""
    return [F.xxhash64(name).alias("h1"), F.xxhash64(F.lit("second"), name).alias("h2")]


def repeats(docs: DataFrame, length: int = 400, crowd: int = 2000, block_bytes: int = 1 << 20, kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; with `kept`, the remaining bytes too."""
    if length < MODULUS * 8 + 2 * MODULUS:
        raise ValueError("the ranks used reach 248 bytes and more")
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *two_hashes("text"))
    copies = cut_lineage(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")))

    def keys_of():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            h1, h2 = (b.column(i).to_numpy() for i in (0, 1))
            out: list[list] = [[], [], [], []]
            for at in range(0, b.num_rows, 500):
                text, _, _, _, key = runs(*laid_out(b.column(2).slice(at, 500)), length)
                both = np.stack([key.view(np.int64), text])
                u, times = np.unique(both, axis=1, return_counts=True)
                for to, x in zip(out, (u[0], h1[at + u[1]], h2[at + u[1]], times), strict=True):
                    to.append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["key", "h1", "h2", "times"])

        return step

    found = cut_lineage(map_batches(rows.where(F.octet_length("text") >= length).select("h1", "h2", "text"), keys_of, "key long, h1 long, h2 long, times long"))
    by_key = found.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("times").alias("most"), F.sum("times").alias("n"))
    wanted = by_key.where("lo < hi OR most > 1").select("key", F.ceil(F.col("n") / crowd).cast("int").alias("shares"))
    lists = found.join(wanted, "key").groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "shares")).alias("keys"))
    reps = lists.join(copies, ["h1", "h2"]).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "rep", "n", "keys")
    texts = rows.join(reps, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("h1", "h2", "text", "keys", "n")
    texts = cut_lineage(texts)
    records = slices(texts.select("h1", "h2", "text", "keys"), length)
    out = cut_lineage(sorted_blocks(records.repartition("key", "share").sortWithinPartitions("key", "share"), length, block_bytes))
    again = out.where("w1 IS NOT NULL").groupBy("w1", "w2").agg(F.sum("times").alias("all")).where("all > 1").select("w1", "w2")
    late = out.where("w1 IS NOT NULL AND start IS NOT NULL").join(again, ["w1", "w2"]).select("h1", "h2", "start", (F.col("start") + 1).alias("upto"))
    starts = out.where("w1 IS NULL").select("h1", "h2", "start", "upto").unionByName(late)
    # texts with copies go whole; only the others are cut
    ranges = starts.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "upto")).alias("starts"))
    parts = texts.where("n = 1").select("h1", "h2", "text").join(ranges, ["h1", "h2"])

    def cut():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            removed, spans, digest, rest = [], [], [], []
            for t, s in zip(b.column(2).cast(pa.large_binary()).to_pylist(), b.column(3).to_pylist(), strict=True):
                rs = removed_ranges([(x["start"], x["upto"]) for x in s], length)
                left = b"".join(t[a:z] for a, z in zip([0, *[r[1] for r in rs]], [*[r[0] for r in rs], len(t)], strict=True))
                removed.append(len(t) - len(left))
                spans.append(len(rs))
                digest.append(hashlib.sha256(left).hexdigest())
                rest.append(left if kept else None)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(rest, pa.binary())], ["r1", "r2", "removed", "spans", "digest", "rest"])

        return step

    done = map_batches(parts, cut, "r1 long, r2 long, removed long, spans long, digest string, rest binary")
    many = copies.where("n > 1").select(F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    size = F.octet_length("text").cast("long")
    # rows go on with sizes and digests, not texts (unless the remaining bytes are asked for)
    lean = rows.select("doc_id", "h1", "h2", size.alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"), *([F.col("text").cast("binary").alias("all")] if kept else []))
    lean = lean.join(done, (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left").join(many, (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
    gone = F.col("c1").isNotNull() & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    columns = [
        F.col("doc_id"), F.col("n_bytes"), F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("digest", "whole")).alias("kept_sha256"),
    ]
    if kept:
        columns.append(F.when(gone, F.lit(b"")).when(F.col("r1").isNotNull(), F.col("rest")).otherwise(F.col("all")).alias("kept"))
    return lean.select(*columns)
