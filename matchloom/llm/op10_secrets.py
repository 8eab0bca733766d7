"""Secret scanning with a random forest that removes false positives.

Candidates are tokens of eight or more key characters with a digit, and values given to a name that speaks of a secret.
Each gets figures on its length, characters and character transitions, how far words near it cover it, whether it stands
in a path, URL or address, and its neighbouring words. A forest trained on labelled findings tells secrets from the rest.

`scan` takes labelled findings from its caller as a column expression over findings; `by_format` is the default: well
known formats and named high-entropy values are secrets; card and phone groups, addresses, paths, placeholders and
word-like tokens are not; everything else has no label and is left to the forest. Training collects the figures of at
most `sample` labelled findings, chosen by a hash; the candidate search and the scores cover every document.

Defined results: null and empty texts have no candidates; repeated rows each get their row; where the labels hold one
class only, no forest is grown and the labels decide (unlabelled: no secret).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from matchloom.llm.common import cut_lineage, map_batches, narrow, str_texts

PRODUCTION = {"sample": 4000, "trees": 25, "depth": 8}
TOKEN = re.compile(r"[A-Za-z0-9_+/-]{8,}={0,2}")
DIGIT = re.compile(r"[0-9]")
GIVEN = re.compile(r"([A-Za-z_-]{3,})[\"']?[ \t]?[=:][ \t]?[\"']?([^\s\"',;]{6,})")
NAMES = re.compile(r"pass|pwd|secret|token|key|auth|credential", re.I)
HASHES = re.compile(r"sha|md5|commit|digest|uuid|checksum|rev|build", re.I)
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|test|x{4,}|\*{3,}|0{8,}|123456", re.I)
WORD = re.compile(r"[^\W\d_]{3,}")
#: Published token formats.
FORMATS = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20}")
FIGURES = ["length", "entropy", "digits", "upper", "lower", "other", "class_changes", "hex", "known_pairs", "word_cover", "slashes", "path", "address", "given", "quoted", "secret_name", "hash_name", "placeholder", "left_words", "repeats"]
NEAR = 300


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def figures(text: str, start: int, end: int) -> list[float]:
    """What the forest sees of a candidate: itself, and up to NEAR characters on each side."""
    v = text[start:end]
    n = len(v)
    left, right = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    before = left[-40:]
    counts = Counter(v)
    kinds = [kind_of(c) for c in v]
    low = v.lower()
    words = {w.lower() for w in WORD.findall(left) + WORD.findall(right)}
    pairs = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
    own = [low[i : i + 2] for i in range(n - 1) if kinds[i] in (1, 2) and kinds[i + 1] in (1, 2)]
    cover, at = 0, 0
    longest = max(map(len, words), default=0)
    while at < n:  # greedy cover by words seen nearby
        size = next((k for k in range(min(longest, n - at), 2, -1) if low[at : at + k] in words), 0)
        cover, at = cover + size, at + max(1, size)
    glue = (left[-1:], right[:1])
    given = bool(re.search(r"[=:][ \t]?[\"']?$", before))
    return [
        float(n), -sum(k / n * math.log2(k / n) for k in counts.values()), kinds.count(0) / n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1), float(all(c in "0123456789abcdefABCDEF" for c in v)),
        sum(p in pairs for p in own) / max(1, len(own)), cover / n, float(v.count("/")), float(any(g in "/\\." for g in glue if g) or "://" in before),
        float("@" in (left[-1:] + right[:1]) or "@" in before.rsplit(" ", 1)[-1]), float(given), float(glue[0] in ("'", '"') and glue[0] != ""),
        float(bool(NAMES.search(before))), float(bool(HASHES.search(before[-16:]))), float(bool(PLACEHOLDER.search(v))), float(len(before.split())), max(counts.values()) / n,
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in order, in code points; of overlapping ones the first, then the longer."""
    spans = {m.span() for m in TOKEN.finditer(text) if DIGIT.search(m.group())}
    if "=" in text or ":" in text:
        spans |= {m.span(2) for m in GIVEN.finditer(text) if NAMES.search(m.group(1))}
    out: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def by_format(text: str, start: int, end: int, f: list[float]) -> int | None:
    """Label of a finding by its format alone: 1 secret, 0 not, None unknown."""
    v, x = text[start:end], dict(zip(FIGURES, f, strict=True))
    if x["placeholder"]:
        return 0
    if FORMATS.fullmatch(v):
        return 1
    if x["given"] and x["secret_name"] and x["length"] >= 12 and x["entropy"] >= 2.5 and x["digits"] > 0:
        return 1
    if x["digits"] + x["other"] == 1 or x["path"] or x["address"] or x["word_cover"] >= 0.6 or x["hash_name"]:
        return 0
    return None


class Forest:
    """Random forest of small CART trees, kept as flat arrays (feature, threshold, left, right, value)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self.build(x[rows], y[rows], depth, rng, nodes)
            self.trees.append(np.array(nodes))

    def build(self, x, y, depth, rng, nodes) -> int:
        at, p = len(nodes), float(y.mean())
        nodes.append([-1, 0, 0, 0, p])
        if depth and 0 < p < 1 and len(y) >= 4:
            best = (1e-9, -1, 0.0)
            whole = p * (1 - p)
            for f in rng.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if len(cut):
                    nl = cut + 1.0
                    nr, pl = len(y) - nl, ones[cut] / nl
                    pr = (ones[-1] - ones[cut]) / nr
                    fall = whole - (nl * pl * (1 - pl) + nr * pr * (1 - pr)) / len(y)
                    k = int(fall.argmax())
                    if fall[k] > best[0]:
                        best = (float(fall[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
            if best[1] >= 0:
                left = x[:, best[1]] <= best[2]
                a = self.build(x[left], y[left], depth - 1, rng, nodes)
                b = self.build(x[~left], y[~left], depth - 1, rng, nodes)
                nodes[at] = [best[1], best[2], a, b, p]
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean vote of the trees."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), int)
            while True:
                f = t[at, 0].astype(int)
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > t[at, 1]
                at = np.where(inner, np.where(right, t[at, 3], t[at, 2]).astype(int), at)
            total += t[at, 4]
        return total / len(self.trees)


FOUND = "array<struct<start:long,end:long,figures:array<double>,label:int>>"


def findings(docs: DataFrame, label=by_format) -> DataFrame:
    """(doc_id, found) of every row: its candidates with figures and labels."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t in str_texts(b):
                rows = []
                for s, e in candidates(t):
                    f = figures(t, s, e)
                    rows.append({"start": s, "end": e, "figures": f, "label": label(t, s, e, f)})
                out.append(rows)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("figures", pa.list_(pa.float64())), ("label", pa.int32())]))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], ["doc_id", "found"])

        return step

    return map_batches(narrow(docs, "doc_id", "text"), make, f"doc_id long, found {FOUND}")


def train(found: DataFrame, sample: int = 4000, trees: int = 25, depth: int = 8) -> Forest | None:
    """Forest from at most `sample` labelled findings of each class, None where a class is missing."""
    rows = found.select("doc_id", F.explode("found").alias("f")).select("f.*", F.xxhash64("doc_id", "f.start", "f.figures").alias("_order")).where("label IS NOT NULL")
    parts = [rows.where(F.col("label") == k).orderBy("_order").limit(sample).select("figures", "label").collect() for k in (0, 1)]
    if not all(parts):
        return None
    both = parts[0] + parts[1]
    return Forest(np.array([r["figures"] for r in both]), np.array([r["label"] for r in both], float), trees, depth)


def is_secret(forest: Forest | None, figs: np.ndarray, labels: list) -> np.ndarray:
    if forest is None:
        return np.array([x == 1 for x in labels], bool)
    return forest.predict(figs) >= 0.5 if len(figs) else np.zeros(0, bool)


def scan(docs: DataFrame, sample: int = 4000, trees: int = 25, depth: int = 8, label=by_format) -> DataFrame:
    """doc_id, n_candidates, n_secrets and spans (start:end in code points, comma-joined) of every row."""
    found = cut_lineage(findings(docs, label))
    forest = train(found, sample, trees, depth)

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [r or [] for r in b.column(1).to_pylist()]
            flat = [x for r in rows for x in r]
            hit = iter(is_secret(forest, np.array([x["figures"] for x in flat]), [x["label"] for x in flat]).tolist())
            spans = [[f"{x['start']}:{x['end']}" for x in r if next(hit)] for r in rows]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array([",".join(s) for s in spans], pa.string())], ["doc_id", "n_candidates", "n_secrets", "spans"])

        return step

    return map_batches(found, make, "doc_id long, n_candidates long, n_secrets long, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]", sample: int = 4000, trees: int = 25, depth: int = 8, label=by_format) -> DataFrame:
    """`docs` with secrets in `text` replaced by the mark and n_chars, where it is there, counted anew; other columns stay."""
    forest = train(cut_lineage(findings(docs, label).where("size(found) > 0")), sample, trees, depth)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, t in enumerate(texts):
                spans = candidates(t) if t else []
                if spans:
                    figs = [figures(t, s, e) for s, e in spans]
                    hit = is_secret(forest, np.array(figs), [label(t, s, e, f) for (s, e), f in zip(spans, figs, strict=True)])
                    for (s, e), h in reversed(list(zip(spans, hit, strict=True))):
                        if h:
                            t = t[:s] + mark + t[e:]
                    texts[i] = t
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
