import hashlib
import random
import re

from llm.conftest import WORDS, as_rows

from matchloom.llm import op6_pii as op

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def slow(t):
    out = []
    for kind, p in KINDS:
        for m in re.finditer(p, t or ""):
            d = [int(x) for x in re.sub("[^0-9]", "", m.group())]
            ok = True
            if kind == "ip":
                ok = all(int(x) <= 255 for x in m.group().split("."))
            elif kind == "card":
                s = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
                ok = 16 <= len(d) <= 19 and s % 10 == 0
            elif kind == "phone":
                ok = 8 <= len(d) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_match_the_patterns_on_random_texts():
    rng = random.Random(4)
    bits = ["a.b", "@", "x@y.z", "1.2.3.4", "256.1.1.1", "+1 (499) 555-6503", "4539 5787 6362 1486", "4539578763621486", "-", " ", ".", "%", "é", "@a.b.c-d", "..", "9", "00", "+", "+4", "(", "\n", "a@b@c.d.e", "1.2.3.4.5.6.7.8"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert op.base_spans(t) == slow(t), t
    assert op.base_spans("1" * 50_000 + "a" * 50_000) == []


def test_rows_match_brute_force(docs, rows, no_docs):
    want = []
    for i, t in rows:
        s = slow(t)
        want.append((i, *[sum(k == kind for k, _, _ in s) for kind in op.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest()))
    from pyspark.sql import functions as F

    got = op.find(docs).withColumn("sha", F.sha2("base_spans", 256))
    assert as_rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "sha") == sorted(want, key=repr)
    assert op.find(no_docs).count() == 0


def test_disclosing_terms_are_found_and_common_ones_left(spark):
    rng = random.Random(2)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, f"{fill(9)} Quibble {fill(1)} ann.lee@corp.example {fill(9)}", 0) for k in range(6)]
    rows += [(100 + k, f"{fill(20)}", 0) for k in range(60)]
    rows += [(300, f"here QUIBBLE stands alone {fill(5)}", 0), (301, None, 0), (302, "", 0)]
    rows += [(400 + k, "same words around bob@x.example every time", 0) for k in range(8)]  # copies: one surrounding
    docs = spark.createDataFrame(rows, "doc_id long, text string, _s_id int")
    got = {r.doc_id: r for r in op.find(docs, disclosure=0.9).collect()}
    assert all("term:" in got[k].all_spans for k in range(6))
    assert got[300].all_spans == "term:5:12"
    assert not any("term:" in got[k].all_spans for k in [*range(100, 160), *range(400, 408)])
    clean = {r.doc_id: r.text for r in op.sanitise(docs, disclosure=0.9).collect()}
    assert "[EMAIL]" in clean[0] and "Quibble" not in clean[0] and "QUIBBLE" not in clean[300] and clean[301] is None and clean[302] == ""
    assert clean[400] == "same words around [EMAIL] every time"


def test_terms_far_from_an_entity_are_judged_by_the_documents_they_share(spark):
    rng = random.Random(6)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(k, f"Quibble {fill(80)} ann.lee@corp.example {fill(9)}") for k in range(3)]
    rows += [(10, f"Hapax {fill(30)} bob@x.example {fill(9)}")]
    rows += [(100 + k, fill(25)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.all_spans for r in op.find(docs).collect()}
    assert all("term:0:7" in got[k] for k in range(3))  # 80 words away
    assert sum("term:" in x for x in got.values()) == 3  # one common document is no evidence


def test_only_terms_that_can_pass_are_counted(spark, monkeypatch):
    rng = random.Random(8)
    fill = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(10 * k + i, f"Quibble{k} {fill(80)} ann.lee{k}@corp.example {fill(9)}") for k in range(12) for i in range(3)]
    rows += [(500, f"Quibble3 {fill(20)}"), *((1000 + k, fill(25)) for k in range(400))]
    docs = spark.createDataFrame([(i, re.sub(r"Quibble(\d+)", lambda m: "Quibble" + "abcdefghijkl"[int(m[1])], t)) for i, t in rows], "doc_id long, text string")
    counted, whole = [], op.counts_of

    def spy(docs, terms, bits):
        counted.append({r.term for r in terms.collect()})
        return whole(docs, terms, bits)

    monkeypatch.setattr(op, "counts_of", spy)
    found = {r.term: r.full for r in op.disclosing(docs).collect()}
    names = {op.signed([op.term_of("Quibble" + c)], 1)[0]: c for c in "abcdefghijkl"}
    assert {names[t]: full for t, full in found.items()} == dict.fromkeys("abcefghijkl", True)  # d also stands without its address
    assert counted == [set(names)]  # the common words beside every address are not
