"""Personal data: base patterns, and terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. The information-theoretic part judges every term of
three or more letters by the documents it shares with a protected entity e (an address or number), wherever in them it
stands. With document shares p: IC(e) = -log2 p(e), PMI(e; t) = log2 p(e, t) / (p(e) p(t)), which is IC(e) when t always
comes with e. A term with PMI >= `disclosure` * IC exceeds the threshold wherever it stands, if so many common documents
are no chance: their probability for independent e and t (Chernoff's bound), times the number of pairs judged, is at most
`significance`. One common document is enough only where few pairs are judged. `sanitise` removes a term if it gives e away fully
and writes a general mark otherwise.

Passes: find spans and the terms of their documents; count the documents of candidate terms; find the disclosing terms. Candidates are the
terms that could still pass if only the documents with entities held them, which spares the common words and changes no result. Only
fixed-size filters of terms are sent to every task; the exact joins shuffle both sides.

Defined results: null and empty texts hold nothing; repeated rows each get their row; texts repeated word for word (copies) count as
one document.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.bloom import Bloom, filter_from, gathered
from matchloom.llm.common import cut_lineage, fresh, map_batches, narrow, str_texts

PRODUCTION = {"disclosure": 0.95, "significance": 0.05, "bits": 1 << 23}
KINDS = ["email", "ip", "card", "phone"]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number is tried at its first digit only and taken whole, so long runs of digits stay linear
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]+")


def emails(text: str):
    """Spans of the e-mail pattern, found from each @ outwards: the same matches, without a scan per letter."""
    done, seen = 0, 0
    at = text.find("@")
    while at >= 0:
        lo = max(done, seen)
        start = lo + len(text[lo:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        seen = at + 1
        at = text.find("@", max(seen, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = digits_of(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def entity_of(kind: str, value: str) -> int:
    return xxh64_intdigest(f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else digits_of(value)}".encode())


def signed(values, n: int | None = None) -> np.ndarray:
    return np.fromiter(values, np.uint64, -1 if n is None else n).view(np.int64)


def term_of(word: str) -> int:
    return xxh64_intdigest(word.lower().encode())


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def company(docs: DataFrame) -> DataFrame:
    """(doc, entities, terms, cut) of every row with base spans: its entities and terms; copies have one doc.

    Terms in `cut` are what a span leaves of a longer word, so the text need not hold them as words.
    """

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            doc, ent, terms, cut = [], [], [], []
            for key, t in zip(b.column(0).to_pylist(), str_texts(b), strict=True):
                own = base_spans(t)
                if own:
                    doc.append(key)
                    ent.append(signed({entity_of(k, t[s:e]) for k, s, e in own}))
                    outside, held = terms_outside(t, own), set(WORD.findall(t))
                    terms.append(signed({term_of(x) for x in outside}))
                    cut.append(signed({term_of(x) for x in outside - held}))
            kind = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), *[pa.array(x, kind) for x in (ent, terms, cut)]], ["doc", "entities", "terms", "cut"])

        return step

    rows = narrow(docs, "text").select(text_key().alias("doc"), "text")
    return map_batches(rows, make, "doc long, entities array<long>, terms array<long>, cut array<long>").dropDuplicates(["doc"])


def terms_outside(text: str, own: list[tuple[str, int, int]]) -> set[str]:
    """Words of three or more letters that are no part of a base span."""
    out, at = set(), 0
    for _, s, e in sorted(own, key=lambda x: x[1]):
        out.update(WORD.findall(text, at, max(at, s)))
        at = max(at, e)
    out.update(WORD.findall(text, at))
    return {w for w in out if len(w) > 2}


class TermFilter:
    """Which words of a text a filter lets through, remembered for up to `most` words."""

    def __init__(self, f: Bloom, most: int = 400_000):
        self.filter, self.most, self.known, self.empty = f, most, {}, not f.table.any()

    def hits(self, words: set[str]) -> dict[str, int]:
        if self.empty:
            return {}
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > self.most:
                self.known.clear()
                new = list(words)
            h = np.fromiter((term_of(w) for w in new), np.uint64, len(new))
            self.known.update(zip(new, np.where(self.filter.has(h), h, 0).tolist(), strict=True))
        return {w: k for w in words if (k := self.known[w])}


def counts_of(docs: DataFrame, terms: DataFrame, bits: int) -> DataFrame:
    """(term, docs): different texts that hold each of the terms, over all rows; partial counts per batch."""
    rows = narrow(docs, "text").withColumn("doc", text_key())
    copies = rows.groupBy("doc").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = rows.join(copies, "doc", "left").select("text", (1 / F.coalesce("copies", F.lit(1))).alias("share"))
    wanted = docs.sparkSession.sparkContext.broadcast(gathered(terms, bits))

    def make():
        f = TermFilter(filter_from(wanted.value))

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            c: Counter = Counter()
            if not f.empty:
                for t, share in zip(str_texts(b), b.column(1).to_pylist(), strict=True):
                    for k in set(f.hits(set(WORD.findall(t))).values()):
                        c[k] += share
            return pa.RecordBatch.from_arrays([pa.array(signed(c.keys(), len(c))), pa.array(list(c.values()), pa.float64())], ["term", "docs"])

        return step

    return map_batches(rows, make, "term long, docs double").groupBy("term").agg(F.round(F.sum("docs")).cast("long").alias("docs"))


def surprise(both: str, of: str, share: str, n: int) -> Column:
    """Least -ln of the probability that `of` documents hold `both` or more of what `share` of n documents hold."""
    q, r = F.col(both) / F.col(of), F.least(F.col(share) / F.lit(float(n)), F.lit(1 - 1e-12))
    rest = F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - r))).otherwise(0.0)
    return F.when(q > r, F.col(of) * (q * F.ln(q / r) + rest)).otherwise(0.0)


def disclosing(docs: DataFrame, disclosure: float = 0.95, significance: float = 0.05, bits: int = 1 << 23) -> DataFrame:
    """(term, full): terms over the threshold for some entity; full where the term never comes without it."""
    seen = cut_lineage(company(docs))
    one = seen.select("doc", F.explode("entities").alias("entity"), "terms")
    pairs = cut_lineage(one.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("together")))
    entities = one.groupBy("entity").agg(F.count("*").alias("entity_docs"))
    n, judged = max(1, docs.select(text_key().alias("doc")).distinct().count()), pairs.count()
    if judged >= significance * n:  # one common document has a probability of 1 / n at least
        pairs = pairs.where("together > 1")
    both = pairs.join(entities, "entity")
    ic = -F.log2(F.col("entity_docs") / F.lit(float(n)))

    def over(of: str) -> Column:
        """Whether a term in `of` documents is over the threshold; the fewer documents, the likelier."""
        pmi = F.log2(F.col("together") * F.lit(float(n)) / (F.col("entity_docs") * F.col(of)))
        sure = F.greatest(surprise("together", "entity_docs", of, n), surprise("together", of, "entity_docs", n))
        return (ic > 0) & (pmi >= disclosure * ic) & (sure >= float(np.log(max(1, judged) / significance)))

    # a term is in no fewer documents than those with entities that hold it; only terms that could pass so are counted
    least = seen.select(F.explode(F.array_except("terms", "cut")).alias("term")).groupBy("term").agg(F.count("*").alias("least"))
    both = both.join(least, "term", "left").withColumn("least", F.coalesce("least", F.lit(1)))
    both = cut_lineage(both.where(over("least")).drop("least"))
    terms = counts_of(docs, both.select("term").distinct(), bits)
    both = both.join(terms, "term").where(over("docs"))
    return cut_lineage(both.groupBy("term").agg(F.max(F.col("together") >= F.col("docs")).alias("full")))


def spans(docs: DataFrame, disclosure: float = 0.95, significance: float = 0.05, bits: int = 1 << 23) -> DataFrame:
    """doc_id, text_hash, base and all: span strings `kind:start:end` of every row, terms after the base kinds."""
    terms = disclosing(docs, disclosure, significance, bits)
    wanted = docs.sparkSession.sparkContext.broadcast(gathered(terms.select("term"), bits))

    def make():
        f = TermFilter(filter_from(wanted.value))

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            base, found = [], []
            for t in str_texts(b):
                own = base_spans(t)
                base.append([f"{k}:{s}:{e}" for k, s, e in own])
                hits = {} if f.empty else f.hits(set(WORD.findall(t)))
                rows = []
                if hits:
                    taken = [(s, e) for _, s, e in own]
                    for m in WORD.finditer(t):
                        if m.group() in hits and not any(s < m.end() and m.start() < e for s, e in taken):
                            rows.append({"term": int(np.uint64(hits[m.group()]).view(np.int64)), "start": m.start(), "end": m.end()})
                found.append(rows)
            kind = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, pa.list_(pa.string())), pa.array(found, kind)], ["doc_id", "text_hash", "base", "found"])

        return step

    rows = narrow(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = cut_lineage(map_batches(rows, make, "doc_id long, text_hash long, base array<string>, found array<struct<term:long,start:long,end:long>>"))
    flat = rows.where("size(found) > 0").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("found").alias("f")).select("doc_id", "text_hash", "f.*")
    sure = flat.join(terms, "term").groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "full"))).alias("terms"))
    out = rows.join(sure, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    none = F.array().cast("array<struct<start:long,end:long,full:boolean>>")
    return out.select("doc_id", "text_hash", "base", F.coalesce("terms", none).alias("terms"))


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, the counts per base kind, base_spans and all_spans (comma-joined) of every row."""
    s = spans(docs, **how)
    count = lambda k: F.size(F.filter("base", lambda x: F.startswith(x, F.lit(k + ":")))).cast("long").alias(f"n_{k}")
    terms = F.transform("terms", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    return s.select("doc_id", *[count(k) for k in KINDS], F.array_join("base", ",").alias("base_spans"), F.array_join(F.concat("base", terms), ",").alias("all_spans"))


def sanitise(docs: DataFrame, **how) -> DataFrame:
    """`docs` with base spans written as [KIND], disclosing terms as [TERM] and fully disclosing ones removed; other columns stay."""
    base_, terms_ = fresh(docs, "_s_base", "_s_terms")
    s = spans(docs, **how).where("size(base) + size(terms) > 0").dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("_s_id"), F.col("text_hash").alias("_s_hash"), F.col("base").alias(base_), F.col("terms").alias(terms_))
    joined = docs.join(s, docs["doc_id"].cast("long").eqNullSafe(s["_s_id"]) & (F.xxhash64(docs["text"]) == s["_s_hash"]), "left")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, (base, terms) in enumerate(zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist(), strict=True)):
                marks = [(int(x), int(y), f"[{k.upper()}]") for k, x, y in (p.split(":") for p in base or [])]
                marks += [(t["start"], t["end"], "" if t["full"] else "[TERM]") for t in terms or []]
                for x, y, mark in joined_marks(marks):
                    texts[i] = texts[i][:x] + mark + texts[i][y:]
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.select(*[docs[f"`{c}`"] for c in names], base_, terms_).mapInArrow(run, docs.schema)


def joined_marks(marks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Replacements from the last to the first; overlapping ones merge under the first one's mark."""
    out: list[tuple[int, int, str]] = []
    for s, e, m in sorted(marks):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), out[-1][2])
        else:
            out.append((s, e, m))
    return out[::-1]


