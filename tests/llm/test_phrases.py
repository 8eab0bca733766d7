"""Phrase mining against counting in plain Python, and against the query's SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb

from matchloom.llm import op11_phrases as op
from matchloom.llm import queries


def slow_phrases(rows, least=10, longest=3, top=2000, share=50):
    f = defaultdict(Counter)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            for n in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        n, kept = sum(a for p, a in c.items() if len(p) == 1), []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n, -s))
    return sorted(out)


def corpus():
    rng = random.Random(6)
    letters = ["New", "york", "city", "a", "éa", "日本", "b", "of", "the", "state"]
    out = [("en", None), (None, "a b"), ("en", ""), ("fr", " \t\n"), ("de", "one"), (None, "x y z. " * 30), ("en", "new york. york CITY, new york city " * 9)]
    for _ in range(60):
        w = []
        for _ in range(rng.randrange(1, 60)):
            w += rng.choice([["new", "york"], ["new", "york", "city"], [rng.choice(letters)], [rng.choice(letters)], ["of\tthe", "state"]])
            if rng.random() < 0.1:
                w[-1] += rng.choice(".,;:!?\n\r\x0b\x0c")
        out.append((rng.choice(["en", "en", "fr", None, "und"]), " ".join(w)))
    return out + [out[-1]] * 3


def got(df):
    return sorted(map(tuple, df.collect()))


def test_phrases_match_plain_counting(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, k, "clash", "clash") for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, w1 string, f string").repartition(4)
    want = slow_phrases(rows)
    assert len(want) > 50
    assert got(op.phrases(docs)) == want
    assert got(op.phrases(docs, chunk=50, bits=64)) == want  # many portions, a filter that lets all pass
    assert got(op.phrases(docs, least=3, longest=4, top=25, share=80)) == slow_phrases(rows, 3, 4, 25, 80)


def test_empty_and_odd_rows(spark, docs, rows, no_docs):
    assert op.phrases(no_docs).count() == 0
    assert got(op.phrases(docs, least=2)) == slow_phrases([("en", t) for _, t in rows], 2)


def test_scores_are_exact_beyond_64_bits(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        f = rng.randrange(1, 10 ** rng.randrange(1, 17))
        rows.append((f, [rng.randrange(f, f * 9 + 2) for _ in range(2)], [rng.randrange(f, f * 9 + 2) for _ in range(2)]))
    rows += [(10**16 - 1, [10**16 - 1, 10**16], [10**16, 10**16 - 1]), (3 * 10**9, [3 * 10**9 + 1] * 2, [3 * 10**9] * 2)]
    df = op.scored(spark.createDataFrame(rows, "f long, lefts array<long>, rights array<long>"))
    for r in df.collect():
        s, k = min((10**6 * r.f * r.f // (x * y), k) for k, (x, y) in enumerate(zip(r.lefts, r.rights, strict=True), 1))
        assert (r.score, r.k, r.l, r.r) == (s, k, r.lefts[k - 1], r.rights[k - 1])


def test_sql_agrees(spark, tmp_path):
    rows = corpus() + [("en", " ".join(f"w{i % 7} w{i % 11}" for i in range(900)))]
    spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(op.SQL).fetchall()) == got(queries.op11_phrase_collocations(spark, str(tmp_path))) == slow_phrases(rows)
