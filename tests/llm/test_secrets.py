import numpy as np
from llm.conftest import as_rows

from matchloom.llm import op10_secrets as op


def test_spans_are_code_points_and_match_a_plain_scan(docs, rows, no_docs):
    want = []
    for i, t in rows:
        c = op.candidates(t or "")
        hit = [s for s in c if op.by_format(t, *s, op.figures(t, *s)) == 1]
        want.append((i, len(c), len(hit), ",".join(f"{a}:{b}" for a, b in hit)))
    assert as_rows(op.scan(docs), "doc_id", "n_candidates", "n_secrets", "spans") == sorted(want, key=repr)
    assert sum(w[2] for w in want) == 3
    assert op.scan(no_docs).count() == 0


def test_redact_keeps_rows_and_other_columns(docs, rows):
    out = op.redact(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows)
    for i, t in rows:
        if t and "AKIA" in t:
            assert got[i].text == "[SECRET]" and got[i].n_chars == 8
    assert out.where("text IS NULL").count() == sum(t is None for _, t in rows)


def test_forest_separates_held_out_rows():
    rng = np.random.default_rng(2)
    x = rng.random((900, len(op.FIGURES)))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.6)).astype(float)
    f = op.Forest(x[:600], y[:600], trees=20, depth=8)
    assert ((f.predict(x[600:]) >= 0.5) == y[600:]).mean() > 0.9


def test_one_class_of_labels_falls_back_to_them(spark, docs):
    only = docs.where("text LIKE 'AKIA%'")
    assert op.train(op.findings(only)) is None
    assert [r.n_secrets for r in op.scan(only).collect()] == [1]
