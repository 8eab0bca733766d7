"""LSH forest groups against brute-force Jaccard components."""

import random

import duckdb
import numpy as np
import pyarrow as pa
from llm.conftest import WORDS
from llm.test_jaccard import near_copies

from matchloom.llm import op13_minhash as op
from matchloom.llm import queries


def slow_set(t, words=3):
    w = (t or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def slow_groups(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) by comparing every pair of sets."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and len(a & sets[j]) * 100 >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), (c := least.get(find(i))), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_groups_match_brute_force_on_odd_rows(spark, docs, rows, no_docs):
    assert got(op.groups(docs)) == slow_groups(rows)
    assert op.groups(no_docs).count() == 0


def test_groups_match_brute_force_on_near_copies_for_any_crowd(spark):
    rows = list(enumerate(near_copies()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = slow_groups(rows)
    for how in ({}, {"crowd": 20, "trees": 40, "depth": 3, "deepest": 12}):
        assert got(op.groups(df, **how)) == want, how
    tight = {d: c for d, _, c, _ in got(op.groups(df, crowd=4))}  # crowds are cut far below their size: no false link, few lost
    true = {d: c for d, _, c, _ in want}
    assert all(true[d] == true[c] for d, c in tight.items())
    assert sum(tight[d] == c for d, c in true.items()) >= 0.95 * len(true)


def crowd(n, size, changes, rng):
    base = [rng.choice(WORDS) + str(rng.randrange(900)) for _ in range(size)]
    out = [" ".join(base)]
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(size), changes):
            w[at] = f"new{k}x{at}"
        out.append(" ".join(w))
    return out


def test_crowds_around_one_text_stay_whole(spark):
    """Copies that reach 0.85 with the common text but not with each other: only its pivot holds them together."""
    rng = random.Random(4)
    star = crowd(400, 200, 4, rng)  # about 0.89 with the text, 0.78 with each other
    dense = crowd(300, 200, 1, rng)
    rows = list(enumerate([*star, *dense, *crowd(50, 200, 20, rng)]))
    sets = [slow_set(t) for t in (star[0], star[1], star[2])]
    assert len(sets[0] & sets[1]) * 100 >= 85 * len(sets[0] | sets[1]) and len(sets[1] & sets[2]) * 100 < 85 * len(sets[1] | sets[2])
    assert got(op.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == slow_groups(rows)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:850], rng.integers(0, 1 << 63, 150).astype(np.uint64)])
    s = op.signatures([a, op.shingles(b"", 3), b], 2000)
    assert abs((s[0] == s[2]).mean() - 850 / 1150) < 0.05 and not s[1].any()


def test_sql_agrees(spark, rows, tmp_path):
    keep = [(i, t) for i, t in rows if i is not None] + [(5000 + i, t) for i, t in enumerate(near_copies())]
    spark.createDataFrame(keep, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(op.SQL).fetchall(), key=repr) == got(queries.op13_minhash_near_dedup(spark, str(tmp_path))) == slow_groups(keep)


def test_a_task_holds_few_sets_at_once():
    texts = [f"word{k % 7} and {k} more words of text {k // 2}" if k % 50 else None for k in range(1201)]
    big = pa.RecordBatch.from_pydict({"rid": list(range(1201)), "doc_id": list(range(1201)), "text": pa.array(texts, pa.string())})
    out = list(op.signed_batches(iter([big, big.slice(3, 0)]), 3, 10))
    assert [b.num_rows for b in out] == [500, 500, 201]
    sets = [op.shingles((t or "").encode(), 3) for t in texts]
    got = pa.Table.from_batches(out)
    assert got.column("rid").to_pylist() == list(range(1201)) and got.column("n").to_pylist() == [len(s) for s in sets]
    assert np.array_equal(np.array(got.column("sig").to_pylist()), op.signatures(sets, 10))


def windows(n):
    """Windows that slide along one text: only neighbours reach 0.85, so no pivot holds the crowd together; and some texts apart."""
    rng = random.Random(8)
    base = [rng.choice(WORDS) + str(rng.randrange(9000)) for _ in range(7 * n + 200)]
    return [" ".join(base[k : k + 200]) for k in range(0, 7 * n, 7)] + [" ".join(base[k : k + 60]) for k in (3, 90)]


def test_crowds_without_a_common_text_are_settled_pair_by_pair(spark):
    rows = list(enumerate(windows(24)))
    assert got(op.groups(spark.createDataFrame(rows, "doc_id long, text string"), crowd=2, trees=12, depth=1, deepest=1)) == slow_groups(rows)


def test_blocks_of_a_crowd_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 3000)
    texts = windows(90)
    sets = [op.shingles(t.encode(), 3) for t in texts]
    sig = op.signatures(sets, 125)
    table = [(k, len(s), x.tolist(), s.view(np.int64).tolist()) for k, (s, x) in enumerate(zip(sets, sig, strict=True))]
    table = spark.createDataFrame(table, "node long, n long, sig array<int>, shingles array<long>")
    regions = spark.createDataFrame([(t, 5, k, len(s)) for t in (0, 1) for k, s in enumerate(sets)], "tree int, key long, node long, n long")
    roots = spark.createDataFrame([(k, 0) for k in range(30)], "node long, root long")  # what is linked already
    found = op.crowd_links(regions, table, roots, 85, regions.select("tree", "key").distinct()).collect()
    assert len(found) < 400  # only links that connect
    whole = {d: c for d, _, c, _ in slow_groups(list(enumerate(texts)))}
    assert all(whole[a] == whole[b] for a, b in found)
    root = [0 if k < 30 else k for k in range(len(texts))]
    for _ in texts:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert dict(enumerate(root)) == whole
