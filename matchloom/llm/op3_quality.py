"""Quality rules: a learned decision list over text statistics, DataFrame functions only.

`statistics` computes per-document figures with Spark's own functions. `learn` fits rules that reject a document by
sequential covering: grow a conjunction of thresholds by FOIL gain on two thirds of the labelled figures, prune its tail
on the other third, keep it if it is precise there, take away what it covers, and go on. `verdict` writes the rules as
one ordered CASE expression.

Only the fit leaves Spark: it collects the figures (not the texts) of at most `sample` labelled rows, chosen by a hash of
their id. Everything else covers all rows and shuffles nothing but the labelled ids.

Defined results: a null or empty text has no words, fails the base rule and is not kept; rows without a label, or with a
null id or label, take no part in the fit; an id labelled twice counts twice; without usable labels the list is empty and
rejects nothing beyond the base rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm.common import cut_lineage, fresh, narrow

PRODUCTION = {"sample": 20_000}
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test.
RATES = ["symbol_rate", "upper_rate", "repeat_rate", "dup_line_rate", "distinct_rate", "word_length", "words"]


@dataclass(frozen=True)
class Test:
    column: str
    above: bool
    value: float

    def holds(self, row) -> bool:
        return row[self.column] > self.value if self.above else row[self.column] <= self.value

    def expression(self) -> Column:
        return F.col(self.column) > F.lit(self.value) if self.above else F.col(self.column) <= F.lit(self.value)


Rule = tuple[Test, ...]


def let(value: Column, use) -> Column:
    """`use(value)` with the value worked out once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def covered(starts: Column) -> Column:
    """Words covered by windows at these ascending starts."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    add = lambda s, x: F.struct((s["n"] + x + WINDOW - F.greatest(s["upto"], x)).alias("n"), (x + WINDOW).alias("upto"))
    return F.aggregate(starts, zero, add, lambda s: s["n"])


def repeated_words(words: Column, n: Column) -> Column:
    """Words inside windows that the text holds twice or more. Windows are told apart by a 64-bit hash within one text."""
    hashes = F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def twice(ordered: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False))
        return covered(F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["i"])))

    def of(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, twice))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, of)).cast("long")


def count_of(text: Column, others: str) -> Column:
    """Characters left when the runs of others are taken out."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def with_statistics(rows: DataFrame, name: str = "_q") -> DataFrame:
    """Adds the struct `name` of all figures to rows with a `text`."""
    w_, s_ = fresh(rows, "_w", "_s")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(F.translate(x, "\t\x0b\x0c\r", "    "))) > 0)

    def of_words(w: Column) -> Column:
        return let(F.size(w), lambda n: F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w, n).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        ))

    rows = rows.withColumn(w_, let(words, of_words))
    rows = rows.withColumn(s_, F.struct(count_of(text, "[^#*$%&|<>]+").alias("n_symbols"), count_of(text, "[^A-Z]+").alias("n_upper"), let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n_lines")))
    w, s = rows[w_], rows[s_]
    n, chars = F.greatest(F.lit(1), w["n_words"]), F.greatest(F.lit(1), w["word_chars"])
    return rows.withColumn(name, F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        (s["n_symbols"] / chars).alias("symbol_rate"), (s["n_upper"] / chars).alias("upper_rate"), (w["n_repeat_words"] / n).alias("repeat_rate"),
        (s["n_dup_lines"] / F.greatest(F.lit(1), s["n_lines"])).alias("dup_line_rate"), (w["n_distinct"] / n).alias("distinct_rate"),
        (w["word_chars"] / n).alias("word_length"), w["n_words"].cast("double").alias("words"),
        ((w["n_words"] < 20) | (100 * w["n_repeat_words"] > 30 * w["n_words"])).alias("base_failed"),
    )).drop(w_, s_)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the figures of every row."""
    return with_statistics(narrow(docs, "doc_id", "text")).select("doc_id", "_q.*")


def gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else -1.0


def best_test(bad: list, good: list) -> Test | None:
    """The threshold with the highest FOIL gain, by one ordered sweep per column."""
    best, found = 1e-9, None
    p0, n0 = len(bad), len(good)
    for c in RATES:
        ordered = sorted([(r[c], 1) for r in bad] + [(r[c], 0) for r in good])
        p = n = 0
        for k, (v, is_bad) in enumerate(ordered):
            p, n = p + is_bad, n + 1 - is_bad
            if k + 1 == len(ordered) or ordered[k + 1][0] == v:
                continue
            cut = (v + ordered[k + 1][0]) / 2
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                if (g := gain(p0, n0, p1, n1)) > best:
                    best, found = g, Test(c, above, cut)
    return found


def grow(bad: list, good: list, most: int) -> Rule:
    tests: list[Test] = []
    while good and bad and len(tests) < most and (t := best_test(bad, good)):
        tests.append(t)
        bad, good = [r for r in bad if t.holds(r)], [r for r in good if t.holds(r)]
    return tuple(tests)


def covers(rule: Rule, row) -> bool:
    return all(t.holds(row) for t in rule)


def worth(rule: Rule, bad: list, good: list) -> float:
    p, n = sum(covers(rule, r) for r in bad), sum(covers(rule, r) for r in good)
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(rows: list, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, support: int = 2) -> list[Rule]:
    """Ordered rules that reject, from rows with the rates, `bad` and `fold` (2 prunes, 0 and 1 grow)."""
    bad, good = [r for r in rows if r["bad"]], [r for r in rows if not r["bad"]]
    rules: list[Rule] = []
    while bad and len(rules) < most_rules:
        part = lambda rs, prune: [r for r in rs if (r["fold"] == 2) == prune]
        rule = grow(part(bad, False), part(good, False), most_tests)
        if not rule:
            break
        pb, pg = part(bad, True), part(good, True)
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda x: worth(x, pb, pg))
        p, n = sum(covers(rule, r) for r in bad), sum(covers(rule, r) for r in good)
        if p < support or p < precision * (p + n):
            break
        rules.append(rule)
        bad, good = [r for r in bad if not covers(rule, r)], [r for r in good if not covers(rule, r)]
    return rules


def learn(stats: DataFrame, labels: DataFrame, sample: int = 20_000) -> list[Rule]:
    """Rules from the figures of labelled documents that the base rule passes."""
    known = labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 0).cast("int").alias("bad"))
    rows = stats.where("NOT base_failed").join(known, F.col("doc_id") == F.col("_id"))
    rows = rows.select(*RATES, "bad", F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(3)).cast("int").alias("fold"), F.xxhash64("_id").alias("_order"))
    return learn_rules([r.asDict() for r in rows.orderBy("_order", *RATES).limit(sample).collect()])


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """Number of the first rule that rejects the row, 0 if none: an ordered CASE over the figures."""
    out = None
    for k, rule in enumerate(rules, 1):
        hit = None
        for t in rule:
            e = Test(prefix + t.column, t.above, t.value).expression()
            hit = e if hit is None else hit & e
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and the number of the rejecting rule (0: none), for every row."""
    stats = cut_lineage(statistics(docs))
    rules = learn(stats, labels, sample)
    out = stats.withColumn("rule", verdict(rules))
    return out.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The rows of `docs`, with all their columns, that the base rule and the list keep.

    The figures are worked out once and written beside the rows; the fit and the verdict both read them there.
    """
    (q,) = fresh(docs, "_q")
    rows = cut_lineage(with_statistics(docs, q))
    rules = learn(rows.select("doc_id", f"{q}.*"), labels, sample)
    return rows.where(~F.col(f"{q}.base_failed") & (verdict(rules, f"{q}.") == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])
