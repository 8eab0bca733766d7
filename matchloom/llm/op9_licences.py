"""Licence scan by sentence rules.

A text's sentences are normalised (case, spaces, quotes, comment marks, copyright holders) and mapped to identifiers of
known licence sentences; lines of a sentence are joined first. The sequence of identifiers is then read by ordered licence rules, longest evidence first. A
rule is a sequence that must occur in order; a sentence used by one rule is not used again by a later one.

Defined results: null and empty texts hold no licence; repeated rows each get their row; several licences are listed in
the order of the text; a licence-like sentence no rule knows is reported as UNKNOWN.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from matchloom.llm.common import map_batches, narrow, str_texts

#: Sentences of public licence texts and notices, normalised; {v} is a version.
SENTENCES: list[tuple[str, str]] = [
    ("mit_notice", r"(released|licensed|distributed|available) under the (terms of the )?mit licen[cs]e"),
    ("mit_grant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("mit_condition", r"the above copyright notice and this permission notice shall be included in all"),
    ("as_is", r"the software is provided as is,? without warranty of any kind"),
    ("apache2_notice", r"licensed under the apache licen[cs]e,? version 2(\.0)?"),
    ("apache2_use", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache2_copy", r"you may obtain a copy of the licen[cs]e at"),
    ("gpl_notice", r"licensed under the (terms of the )?gnu general public licen[cs]e,? (version|v) ?(?P<v>[123])(\.0)?( or (any )?later)?"),
    ("gpl_free", r"you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl_either", r"either version (?P<v>[123]) of the licen[cs]e,? or (\(at your option\) )?any later version"),
    ("lgpl_notice", r"gnu lesser general public licen[cs]e"),
    ("agpl_notice", r"gnu affero general public licen[cs]e"),
    ("bsd_redistribute", r"redistribution and use in source and binary forms,? with or without modification"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the name of .{1,80} nor the names of its contributors"),
    ("bsd_notice", r"licensed under the bsd licen[cs]e"),
    ("mpl_notice", r"subject to the terms of the mozilla public licen[cs]e,? (version|v\.?) ?(?P<v>[12])"),
    ("isc_grant", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose"),
    ("cc_notice", r"(licensed|released|available) under (a |the )?(cc|creative commons)[ -](?P<v>by(-nc)?(-sa|-nd)?|zero|0)( \d\.\d)?"),
    ("public_domain", r"(dedicated to|placed in|released into) the public domain"),
    ("unlicense", r"this is free and unencumbered software"),
]
#: Ordered: the first rules ask for more and win.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_grant", "mit_condition", "as_is")),
    ("GPL-{v}.0-or-later", ("gpl_free", "gpl_either")),
    ("Apache-2.0", ("apache2_notice", "apache2_use", "apache2_copy")),
    ("Unlicense", ("unlicense", "public_domain")),
    ("MIT", ("mit_grant",)), ("MIT", ("mit_notice",)), ("Apache-2.0", ("apache2_notice",)), ("GPL-{v}.0", ("gpl_notice",)), ("GPL", ("gpl_free",)),
    ("AGPL", ("agpl_notice",)), ("LGPL", ("lgpl_notice",)), ("BSD", ("bsd_redistribute",)), ("BSD", ("bsd_notice",)), ("MPL-{v}.0", ("mpl_notice",)),
    ("ISC", ("isc_grant",)), ("CC-{v}", ("cc_notice",)), ("Unlicense", ("unlicense",)), ("Public-Domain", ("public_domain",)),
]
HINT = re.compile(r"licen[cs]e|creative commons|public domain|redistribut|permission|provided as is|unencumbered|neither the name|\bcc[ -]")
#: The same on a raw text without its quotes, where line breaks and comment marks may stand between words.
TEXT_HINT = re.compile(HINT.pattern.replace(" ", r"\W+").replace(r"[\W+-]", r"\W"), re.I)
UNKNOWN = re.compile(r"\b(licensed|released|distributed) under\b|\blicen[cs]e\b.{0,20}\bversion\b")
SENTENCE_END = re.compile(r"(?<=[.;:!?])\s+(?=[A-Z\"'(*#/])|\n\s*\n")
LINE_START = re.compile(r"\n(?=[A-Z])")
COMMENT = re.compile(r"(?m)^\s*(//|/\*+|\*+/?|#+|--|;+|<!--)")
QUOTES = "\"“”‘’`´'"
QUOTE = re.compile(f"[{QUOTES}]")
KNOWN = [(k, re.compile(p)) for k, p in SENTENCES]


def normalised(sentence: str) -> str:
    s = QUOTE.sub("", COMMENT.sub(" ", sentence).lower())
    return re.sub(r"\s+", " ", s).strip()


def places(sentence: str) -> list[int]:
    """For each character of the normalised sentence, the place it comes from."""
    marks = {k for m in COMMENT.finditer(sentence) for k in range(*m.span())}
    out, blank = [], True
    for k, c in enumerate(sentence):
        if k not in marks and c in QUOTES:
            continue
        if k in marks or c.isspace():
            if not blank:
                out.append(k)
            blank = True
        else:
            out += [k] * len(c.lower())
            blank = False
    return out[:-1] if blank and out else out


def sentences(text: str):
    """(start, end, sentence) in code points; a line break ends a sentence at a blank line only."""
    at = 0
    for m in SENTENCE_END.finditer(text):
        yield at, m.start(), text[at : m.start()]
        at = m.end()
    yield at, len(text), text[at:]


def recognised(text: str) -> list[tuple[str, str, int, int]]:
    """(sentence id, version, start, end) of the known licence sentences of a text, in order.

    A span goes from the start of the line that the words start in, if a capital begins it, to the end of the sentence or
    the last line break before a capital.
    """
    out = []
    if not TEXT_HINT.search(QUOTE.sub("", text)):
        return out
    for s, e, raw in sentences(text):
        n = normalised(raw)
        if not HINT.search(n):
            continue
        ids = sorted((m.start(), m.end(), k, (m.groupdict().get("v") or "")) for k, p in KNOWN for m in p.finditer(n))
        unknown = [m.span() for m in UNKNOWN.finditer(n)]
        if not ids and not unknown:
            continue
        of, cuts = places(raw), [m.start() for m in LINE_START.finditer(raw)]

        def span(a: int, b: int, s=s, e=e, of=of, cuts=cuts) -> tuple[int, int]:
            return s + max((c + 1 for c in cuts if c < of[a]), default=0), min((s + c for c in cuts if c > of[b - 1]), default=e)

        found = [(a, k, v, *span(a, b)) for a, b, k, v in ids]
        for a, b in unknown:
            x, y = span(a, b)
            if not any(p < y and x < q for *_, p, q in found):
                found.append((a, "unknown", "", x, y))
        out += [f[1:] for f in sorted(found)]
    return out


def licences(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of a text in order: rules over the sequence of sentence identifiers."""
    seq = recognised(text)
    used, found = [False] * len(seq), []
    for name, need in RULES:
        at = 0
        while True:
            take: list[int] = []
            for k in range(at, len(seq)):
                if not used[k] and seq[k][0] == need[len(take)]:
                    take.append(k)
                    if len(take) == len(need):
                        break
            if len(take) < len(need):
                break
            version = next((seq[k][1] for k in take if seq[k][1]), "")
            for k in take:
                used[k] = True
            found.append((seq[take[0]][2], seq[take[-1]][3], name.replace("{v}", version.upper())))
            at = take[0] + 1
    found += [(s, e, "UNKNOWN") for u, (k, _, s, e) in zip(used, seq, strict=True) if k == "unknown" and not u]
    return [(n, s, e) for s, e, n in sorted(found)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), n_licences, licences (comma-joined, distinct, in order) and spans (name:start:end) of every row."""

    def make():
        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            known, found = [], []
            for t in str_texts(b):
                known.append(sum(k != "unknown" for k, *_ in recognised(t)))
                found.append(licences(t))
            names = [list(dict.fromkeys(n for n, _, _ in f)) for f in found]
            return pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(known, pa.int64()), pa.array([len(n) for n in names], pa.int64()), pa.array([",".join(n) for n in names], pa.string()), pa.array([",".join(f"{n}:{s}:{e}" for n, s, e in f) for f in found], pa.string())],
                ["doc_id", "n_sentences", "n_licences", "licences", "spans"])

        return step

    return map_batches(narrow(docs, "doc_id", "text"), make, "doc_id long, n_sentences long, n_licences long, licences string, spans string")
