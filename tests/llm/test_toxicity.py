import random
import zlib

import numpy as np
from llm.conftest import WORDS

from matchloom.llm import op2_toxicity as op


def corpus(spark, n=600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        bad = rng.random() < 0.2
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["grumwald", "Grumwaldig,", "zounder!", "blecko"]))
        rows.append((i, " ".join(w), "clash"))
        labels.append((i, 1, int(bad)))
    rows += [(None, None, "x"), (9999, "", "x"), (9999, "", "x")]
    labels += [(None, 1, 1), (5, 1, None), (123456, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    docs, labels = corpus(spark)
    got = op.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.where("toxic IS NOT NULL").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus(spark, 200)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert sorted(map(tuple, op.score(docs, labels).where("doc_id IS NOT NULL").collect())) == sorted(map(tuple, op.score(docs, turned).where("doc_id IS NOT NULL").collect()))


def test_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 30)
    assert {r.predicted for r in op.score(docs, labels.limit(0)).collect()} == {0}
    assert op.score(docs.limit(0), labels).count() == 0


def test_machine_learns_a_pair_that_no_single_term_shows():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([k for k, on in enumerate((a, b, rng.random() < 0.5)) if on], np.int64))
        y.append(float(a == b))
    fm = op.FactorizationMachine(3, 4, 0.0).fit(rows[:1000], np.array(y[:1000]), epochs=120)
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows[1000:]])])
    assert ((fm.logits(np.concatenate(rows[1000:]), ends) > 0) == np.array(y[1000:])).mean() > 0.9
