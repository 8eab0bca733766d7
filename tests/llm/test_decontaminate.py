import re

from llm.conftest import as_rows

from matchloom.llm import op4_decontaminate as op


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def items(rows):
    w = [words(t) for _, t in rows]
    long = max(w, key=len)
    return [(1, " ".join(long[100:160])), (2, "one"), (3, "stone water"), (4, None), (5, "..."), (6, " ".join(w[12][5:18])), (7, " ".join(w[12][5:18]).upper()), (10, "no such words anywhere in here at all"), (11, "again again"), (None, "one two"), (12, " ".join(long[300:313]) + " zzz")]


def slow(t, bench):
    d = words(t)
    hit, found = set(), set()
    for i, x in bench:
        b = words(x)
        k = min(13, len(b))
        wins = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
        for p in range(len(d) - k + 1) if wins else ():
            if tuple(d[p : p + k]) in wins:
                hit.update(range(p, p + k))
                found.add(i)
    found = sorted(str(i) for i in found if i is not None)
    return len(d), len(hit), len(found), found, len(hit) > 0 and 20 * len(hit) >= len(d)


def test_matches_brute_force(spark, docs, rows, no_docs):
    bench = items(rows)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(((i, *slow(t, bench)) for i, t in rows), key=repr)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "item_ids", "contaminated")
    assert as_rows(op.contamination(docs, b), *cols) == want
    assert as_rows(op.contamination(docs, b, bits=64), *cols) == want  # a full filter only costs time
    kept = op.drop_contaminated(docs, b)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in want)
    assert op.contamination(no_docs, b).count() == 0
    assert op.contamination(docs, b.limit(0)).where("n_hit > 0").count() == 0
