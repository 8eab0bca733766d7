from llm.conftest import as_rows

from matchloom.llm import op9_licences as op

BSD = """Copyright (c) X. All rights reserved.
 * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that:
 * Redistributions of source code must retain the above copyright notice.
 * Redistributions in binary form must reproduce the above copyright notice.
"""
CASES = {
    "Prose here.\nReleased under the MIT License.": ["MIT"],
    "x\nLicensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.": ["Apache-2.0", "GPL-3.0"],
    "Licensed under CC BY-NC 4.0.": ["CC-BY-NC"],
    BSD: ["BSD-2-Clause"],
    BSD + " * Neither the name of X nor the names of its contributors may be used.": ["BSD-3-Clause"],
    "You can redistribute it and/or modify it under the terms of the GNU General Public License; either version 2 of the License, or (at your option) any later version.": ["GPL-2.0-or-later"],
    "Released under the Example Public Licence.": ["UNKNOWN"],
    "A driver's licence is a card.": [],
    "": [],
}


def test_known_texts():
    for text, want in CASES.items():
        assert [n for n, _, _ in op.licences(text)] == want, text


def test_a_sentence_serves_one_rule_and_spans_are_code_points():
    t = "é " * 10 + "\nReleased under the MIT License.\nReleased under the MIT License."
    assert [(n, t[s:e]) for n, s, e in op.licences(t)] == [("MIT", "Released under the MIT License.")] * 2


def test_rows(docs, rows, no_docs):
    want = [(i, ",".join(dict.fromkeys(n for n, _, _ in op.licences(t or "")))) for i, t in rows]
    assert as_rows(op.scan(docs), "doc_id", "licences") == sorted(want, key=repr)
    assert op.scan(no_docs).count() == 0


def test_wrapped_lines_are_joined_before_sentences_are_read():
    cases = {
        "Some prose.\nThis file is released under the\nMIT License.\nMore prose.": ("MIT", "This file is released under the\nMIT License."),
        "// Licensed under the\n// Apache License, Version 2.0.": ("Apache-2.0", "// Licensed under the\n// Apache License, Version 2.0."),
        "licensed under the\nApache License, Version 2.0": ("Apache-2.0", "licensed under the\nApache License, Version 2.0"),
        "The text is dedicated to the public\ndomain.": ("Public-Domain", "The text is dedicated to the public\ndomain."),
        "A Title\nReleased under the\nMIT License\nOther Title": ("MIT", "Released under the\nMIT License"),
        "İ’ A Title\nReleased under the Example\nLicence": ("UNKNOWN", "Released under the Example\nLicence"),
    }
    got = {t: [(n, t[s:e]) for n, s, e in op.licences(t)] for t in cases}
    assert {k: v for k, v in got.items() if not k.startswith("İ")} == {t: [w] for t, w in cases.items() if not t.startswith("İ")}
    assert [n for n, _ in got["İ’ A Title\nReleased under the Example\nLicence"]] == ["UNKNOWN"]
    assert [k for k, *_ in op.recognised('the software is provided\n# "as\n# is", without warranty of any kind')] == ["as_is"]


def test_places_follow_the_normalised_sentence():
    for t in ["", "  a  b ", "// x 'y'\n * Z\n#  İq", '"', " * ", "a\n--\n;; b", *CASES]:
        assert len(op.places(t)) == len(op.normalised(t)), t
