import re
from collections import defaultdict

from llm.conftest import as_rows

from matchloom.llm import op3_quality as op


def slow(t):
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    rep = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), n < 20 or 100 * len(rep) > 30 * n


def labels_for(spark, rows):
    return spark.createDataFrame([(i, int("again" not in (t or "")), 0) for i, t in rows if i is not None] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_base_figures_match_brute_force(spark, docs, rows):
    want = sorted(((i, *slow(t)) for i, t in rows), key=repr)
    got = as_rows(op.judge(docs, labels_for(spark, rows)), "doc_id", *op.BASE, "base_failed")
    # n_words first in both
    assert got == [(w[0], *w[1:]) for w in want]


def test_rules_are_learned_and_ordered():
    rows = [{c: 0.0 for c in op.RATES} | {"symbol_rate": 0.3 if k % 5 == 0 else 0.01, "upper_rate": 0.9 if k % 7 == 0 else 0.02, "words": float(k), "bad": int(k % 5 == 0 or k % 7 == 0), "fold": k % 3} for k in range(300)]
    rules = op.learn_rules(rows)
    assert {t.column for r in rules for t in r} == {"symbol_rate", "upper_rate"}
    assert all(any(op.covers(r, x) for r in rules) == bool(x["bad"]) for x in rows)
    text = str(op.verdict(rules))
    assert text.count("WHEN") == len(rules)


def test_keep_good_and_empty_tables(spark, docs, rows, no_docs):
    labels = labels_for(spark, rows)
    kept = op.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == op.judge(docs, labels).where("kept").count()
    assert {r[0] for r in kept.select("_q").collect()} == {"clash"}  # a column of that name stays as it was
    assert op.judge(no_docs, labels).count() == 0
    assert op.judge(docs, labels.limit(0)).where("rule > 0").count() == 0


def test_main_path_has_no_python(spark, docs):
    plan = op.statistics(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
