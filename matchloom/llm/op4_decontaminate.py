"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into item-sized windows (`window` consecutive words, or the whole of a shorter item). A
window's shingles (`shingle` consecutive words) are ordered by how rare they are in the documents. Containment of the
whole window is asked for, so its necessary prefix is one token: a document that holds the window holds its rarest
shingle. The passes:

1. find the benchmark's shingles in all documents, once; each document keeps their places and the words around them,
   neighbouring stretches as one, so a row is at most as long as its text and 16 bytes a place;
2. count them (partial counts per task, then summed) and pick each window's rarest shingle with its offset, the prefix index;
3. carry each prefix shingle found with the `window` words around it;
4. join on the shingle, apply the positional and length bounds (the window must start and end inside the document at
   that offset), and compare the words exactly.

Both passes test shingles against a Bloom filter of a fixed number of bits, the only thing sent to every task; beyond
its capacity it lets more through, and the joins, which are exact and shuffle both sides, sort it out.

Defined results: null or wordless texts have no words and hit nothing; null or wordless items have no windows; an item
whose words another item repeats is counted by its own id; repeated documents each get their row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.bloom import Bloom, filter_from, gathered
from matchloom.llm.common import cut_lineage, map_batches, narrow, raw_texts

WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
PRODUCTION = {"window": 13, "shingle": 3, "bits": 1 << 23, "percent": 5}


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_BYTES).split()


def key_of(words: list[bytes]) -> int:
    return xxh64_intdigest(b" ".join(words), 7)


def windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(window_id, item_id, words, shingle, offset): every shingle of every window. Grows with the benchmark alone."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows: list[tuple] = []
            for item, text in zip(b.column(0).to_pylist(), raw_texts(b), strict=True):
                w = words_of(text)
                for at in range(max(1, len(w) - window + 1)) if w else ():
                    part = w[at : at + window]
                    whole = b" ".join(part)
                    g = min(shingle, len(part))
                    rows += [(hashlib.sha256(whole).hexdigest()[:32], item, whole, len(part), k, key_of(part[k : k + g])) for k in range(len(part) - g + 1)]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.uint64()]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            arrays[5] = arrays[5].view(pa.int64())
            return pa.RecordBatch.from_arrays(arrays, ["window_id", "item_id", "words", "n", "offset", "key"])

        return step

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_batches(items, make, "window_id string, item_id string, words binary, n int, offset int, key long")


def xxh(b: bytes) -> int:
    return xxh64_intdigest(b, 7)


class KnownWords(dict):
    """Whether the filter of words lets a word through, remembered for up to `most` words."""

    def __init__(self, words: Bloom, most: int = 500_000):
        self.words, self.most = words, most

    def of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in set(words) if w not in self]
        if new:
            if len(self) + len(new) > self.most:
                self.clear()
                new = list(set(words))
            h = np.fromiter((xxh64_intdigest(w, 42) for w in new), np.uint64, len(new))
            self.update(zip(new, self.words.has(h).tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), bool, len(words))


def candidates_in(words: list[bytes], lengths: list[int], known: KnownWords, keys: Bloom) -> list[tuple[int, int]]:
    """(position, key) of the shingles of one document that both filters let through."""
    out: list[tuple[int, int]] = []
    n = len(words)
    ok = known.of(words)
    for g in lengths:
        if n >= g:
            run = ok[: n - g + 1].copy()
            for i in range(1, g):
                run &= ok[i : n - g + 1 + i]
            at = np.flatnonzero(run)
            if len(at):
                h = np.fromiter((xxh(b" ".join(words[i : i + g])) for i in at.tolist()), np.uint64, len(at))
                hit = keys.has(h)
                out += zip(at[hit].tolist(), h[hit].tolist(), strict=True)
    return out


def stretches_of(places: list[int], window: int, n: int) -> list[tuple[int, int]]:
    """Disjoint stretches (from, to) of the words within `window` of the ascending places, in a text of n words."""
    out: list[tuple[int, int]] = []
    for at in places:
        lo, hi = max(0, at - window + 1), min(n, at + window)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 3, bits: int = 1 << 23, percent: int = 5) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, item_ids (sorted strings), contaminated, one row per document row."""
    spark = docs.sparkSession
    wins = cut_lineage(windows(benchmark, window, shingle))
    lengths = sorted(r[0] for r in wins.select(F.least("n", F.lit(shingle)).alias("g")).distinct().collect())  # at most `shingle` values
    texts = narrow(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def bloom(keys: DataFrame):
        return gathered(keys.distinct(), bits)

    in_shingle = F.slice(F.split(F.col("words").cast("string"), " "), F.col("offset") + 1, F.least("n", F.lit(shingle)))
    known = spark.sparkContext.broadcast((bloom(wins.select("key")), bloom(wins.select(F.explode(in_shingle).alias("w")).select(F.xxhash64("w")))))

    def find():
        keys, words = map(filter_from, known.value)
        words = KnownWords(words)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            sizes, at_, key_, ends = [], [], [], [0]
            first_, words_, stretches = [], [], [0]
            for t in raw_texts(b):
                w = words_of(t)
                sizes.append(len(w))
                found = candidates_in(w, lengths, words, keys)
                at_ += [at for at, _ in found]
                key_ += [key for _, key in found]
                for lo, hi in stretches_of(sorted({at for at, _ in found}), window, len(w)):
                    first_.append(lo)
                    words_.append(b" ".join(w[lo:hi]))
                ends.append(len(at_))
                stretches.append(len(first_))
            places = pa.StructArray.from_arrays([pa.array(at_, pa.int64()), pa.array(np.array(key_, np.uint64).view(np.int64))], ["at", "key"])
            parts = pa.StructArray.from_arrays([pa.array(first_, pa.int64()), pa.array(words_, pa.binary())], ["first", "words"])
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((ends, places), (stretches, parts))]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), *lists], ["doc_id", "text_hash", "n_words", "places", "parts"])

        return step

    rows = cut_lineage(map_batches(texts, find, "doc_id long, text_hash long, n_words long, places array<struct<at:long,key:long>>, parts array<struct<first:long,words:binary>>"))
    seen = rows.select(F.explode("places.key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    ranked = wins.join(seen, "key", "left").groupBy("window_id").agg(
        F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key", "offset")).alias("rarest"), F.first("words").alias("words"), F.first("n").alias("n"),
        F.min(F.coalesce("times", F.lit(0))).alias("times"))
    # a window with a shingle that no document holds is in no document
    prefix = cut_lineage(ranked.where("times > 0").select("window_id", "words", "n", F.col("rarest.key").alias("key"), F.col("rarest.offset").alias("offset")))
    wanted = spark.sparkContext.broadcast(bloom(prefix.select("key")))

    def carry():
        keys = filter_from(wanted.value)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            row, at_, key_, before_, around_ = [], [], [], [], []
            for r, (places, parts) in enumerate(zip(b.column("places"), b.column("parts"), strict=True)):
                at, key = (places.values.field(i).to_numpy() for i in (0, 1))
                hit = keys.has(key.view(np.uint64))
                at, key = at[hit], key[hit]
                if len(at):
                    first = parts.values.field(0).to_numpy()
                    of = np.searchsorted(first, at, "right") - 1
                    split: dict[int, list[bytes]] = {}
                    for a, k, i in zip(at.tolist(), key.tolist(), of.tolist(), strict=True):
                        if i not in split:
                            split[i] = parts.values.field(1)[i].as_py().split(b" ")
                        here = a - int(first[i])
                        lo = max(0, here - window + 1)
                        row.append(r)
                        at_.append(a)
                        key_.append(k)
                        before_.append(here - lo)
                        around_.append(b" ".join(split[i][lo : here + window]))
            ids = [b.column(i).take(pa.array(row, pa.int64())) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*ids, pa.array(at_, pa.int64()), pa.array(key_, pa.int64()), pa.array(before_, pa.int64()), pa.array(around_, pa.binary())], ["doc_id", "text_hash", "at", "key", "before", "around"])

        return step

    # repeated rows bring their hits again; the distinct spans and windows below drop them map-side
    found = map_batches(rows.where("size(places) > 0"), carry, "doc_id long, text_hash long, at long, key long, before long, around binary")
    start = F.col("at") - F.col("offset")
    around = F.split(F.col("around").cast("string"), " ")
    inside = F.slice(around, (F.col("before") - F.col("offset") + 1).cast("int"), F.col("n"))
    hits = found.join(prefix, "key").where("before >= offset").where(F.size(around) >= F.col("before") - F.col("offset") + F.col("n"))
    hits = cut_lineage(hits.where(F.array_join(inside, " ") == F.col("words").cast("string")).select("doc_id", "text_hash", "window_id", start.alias("start"), (start + F.col("n")).alias("end")))
    spans = hits.select("doc_id", "text_hash", "start", "end").distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("upto"))
    add = lambda s, x: F.struct((s["covered"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["upto"], x["start"]))).alias("covered"), F.greatest(s["upto"], x["end"]).alias("upto"))
    covered = spans.select("doc_id", "text_hash", F.aggregate("spans", zero, add, lambda s: s["covered"]).alias("n_hit"))
    named = hits.select("doc_id", "text_hash", "window_id").distinct().join(wins.select("window_id", "item_id").where("item_id IS NOT NULL").distinct(), "window_id")
    items = named.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    both = covered.join(items, (covered.doc_id.eqNullSafe(items.doc_id)) & (covered.text_hash == items.text_hash), "left").select(covered.doc_id.alias("d"), covered.text_hash.alias("h"), "n_hit", "item_ids")
    out = rows.select("doc_id", "text_hash", "n_words").join(both, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), ((n_hit > 0) & (n_hit * 100 >= F.col("n_words") * percent)).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs`, with all their columns, that are not contaminated."""
    bad = cut_lineage(contamination(docs, benchmark, **how).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_hash"]), "left_anti")
