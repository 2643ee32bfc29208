import random
import re

from emberlog.llm import op3_license_scan as op

DOCS = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, "Released UNDER the MIT-license; under the mit license"), (3, "CC BY-NC 4.0 and CC_BY_NC"), (4, None), (5, ""), (6, "no words about it"),
    (7, "under the mit licenses"), (8, "This work is licensed under the GNU General Public License, version 3."), (9, "cc by nc cc by nc cc by"), (10, "Permission is hereby granted, free of charge, to any person obtaining a copy of"),
    (11, "SPDX-License-Identifier: BSD 3-Clause License"), (12, "All rights reserved."), (12, "All rights reserved."), (13, "x " * 30_000 + "under the mit license"),
]


def test_keywords_lose_nothing():
    """Without any keyword a rule finds the same."""
    for _, t in DOCS:
        s = " " + " ".join(words(t)) + " "
        for label, pattern, need, keywords, _, _ in op.rules():
            if len(s) < 10_000 and re.search(pattern, s):
                assert need in s and any(k in s for k in keywords.split("|")), (label, s)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """(n_words, n_base, first, last, base labels, labels, score) by a plain loop over the rules."""
    w = words(text)
    at = [(i, label) for phrase, label in op.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base = sorted({label for _, label in at})
    s = " " + " ".join(w) + " "
    found = [(m.start(), m.end(), p, label, sure) for label, pattern, need, keywords, p, sure in op.rules() if w and need in s and any(k in s for k in keywords.split("|")) for m in re.finditer(pattern, s)]
    found.sort(key=lambda x: (x[0], -x[1], x[2], x[3], x[4]))
    stay = [x for i, x in enumerate(found) if not any(y[2] <= x[2] and y[1] >= x[1] for y in found[:i])]
    score = max([x[4] for x in stay] + [0.95 if base else 0.0])
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted({*base, *(x[3] for x in stay)})), score


def test_brute_force(spark):
    docs = spark.createDataFrame([(d, t, "x", 3) for d, t in DOCS], "doc_id long, text string, labels string, n_base int")
    got = op.scan_licenses(docs).collect()
    assert len(got) == len(DOCS)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(r.text)
    assert op.scan_licenses(docs.limit(0)).count() == 0


def test_rules():
    rules = op.rules()
    assert len(rules) > 250
    for _, pattern, need, keywords, priority, sure in rules:
        assert re.compile(pattern) and 0 <= priority <= 3 and 0 < sure <= 1 and need + keywords
    by_id = {d: brute(t)[5] for d, t in DOCS}
    assert by_id[8] == "gpl-3,license-mention" and by_id[10] == "mit" and by_id[11] == "bsd-3" and by_id[1] == "apache-2" and by_id[12] == "proprietary"


def test_gate_lets_every_spelling_through(spark):
    texts = ["MPL 2.0", "EPL v1.0", "CDDL 1.0", "GPLv2", "mit no attribution", "boost software", "WTFPL", "CC0", "LGPL 2.1", "AGPL-3", "0 clause BSD", "Eclipse distribution license", "Python Software Foundation", "GNU free documentation license", "CC\nBY", "creative commons zero", "Apache 2", "gnu lesser gpl 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.labels for r in op.scan_licenses(docs).collect()}
    assert got == {t: brute(t)[5] for t in texts} and sum(map(bool, got.values())) >= 17
    assert all(any(stem in pattern.lower() or stem in need + keywords for stem in op.GATE) or label.startswith("cc") for label, pattern, need, keywords, _, _ in op.rules())


def ungated(text):
    """Labels by every rule's regex alone: no needed text, no keyword, no gate."""
    w = words(text)
    s = " " + " ".join(w) + " "
    base = {label for phrase, label in op.BASE if f" {phrase} " in s}
    found = [(m.start(), m.end(), p, label, sure) for label, pattern, _, _, p, sure in op.rules() if w for m in re.finditer(pattern, s)]
    found.sort(key=lambda x: (x[0], -x[1], x[2], x[3], x[4]))
    return ",".join(sorted(base | {x[3] for i, x in enumerate(found) if not any(y[2] <= x[2] and y[1] >= x[1] for y in found[:i])}))


def spelling(nodes, rng):
    """A text that a parsed regex matches."""
    out = ""
    for kind, a in nodes:
        name = str(kind)
        if name == "LITERAL":
            out += chr(a)
        elif name == "ANY":
            out += "x"
        elif name == "BRANCH":
            out += spelling(rng.choice(a[1]), rng)
        elif name == "SUBPATTERN":
            out += spelling(a[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(spelling(a[2], rng) for _ in range(rng.randint(a[0], min(a[1], a[0] + 2))))
        elif name == "IN":
            one, value = rng.choice(a)
            out += chr(value) if str(one) == "LITERAL" else "7"
        else:
            assert name == "ASSERT"
    return out


def test_filter_loses_nothing(spark):
    """Spellings of every rule, and texts that hold no word license, get all labels that the regexes alone give."""
    rng = random.Random(0)
    texts = ["Released under MIT.", "Distributed under the BSD 3-Clause", "Provided to you\nby the terms of the ISC", "Made available WITH vim", "shared, under Ruby",
        "Copyright 2020 X. Redistributions must keep this. Neither the name of X nor the names of its contributors may be used", "Neither the name of X nor\nthe names of its contributors may"]
    for _, pattern, _, _, _, _ in op.rules():
        texts += [spelling(re._parser.parse(pattern), rng) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in op.scan_licenses(docs).collect()}
    want = {i: ungated(t) for i, t in enumerate(texts)}
    assert all(want.values()) and "mit" in want[0] and "bsd-3" in want[1] and "bsd-3" in want[5]
    assert got == want
