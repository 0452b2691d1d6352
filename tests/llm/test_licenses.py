import random
import re
import time

import pytest

from tessera.llm.license_texts import TEMPLATES
from tessera.llm.licenses import PHRASES, LicenseScanner, TemplateAutomaton, scan_licenses

TEXTS = [
    "", None, "Released under the MIT License.", "mit  LICENSE; mit license", "permit license",
    "Licensed under the Apache License, Version 2.0.", "See the Apache-License file",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
    "Copyright (c) 2020 Some Body. All rights reserved.", "é MIT LICENSÉ mit license" + " x" * 30000, "mit\x80license",
]


def test_base_equals_brute_force(spark):
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (None, "mit license")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(docs).collect())
    want = []
    for key, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        want.append((-1 if key is None else key, len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert scan_licenses(docs.limit(0)).count() == 0


def test_labels(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, r.score) for r in scan_licenses(docs).collect()}
    assert got[0] == got[1] == ("", 0.0)
    assert got[2] == ("mit,mit-notice", 1.0)
    assert got[4] == ("", 0.0)
    assert got[5] == ("apache,apache-2.0", 1.0)
    assert got[6] == ("apache", 0.5)
    assert got[7] == ("gpl,gpl-3.0", 1.0)
    assert got[8] == ("cc-by-nc", 1.0)
    assert got[9] == ("all-rights-reserved", 1.0)


def test_automaton():
    a = TemplateAutomaton("start <<opt>>maybe <<opt>>more<</opt>><</opt>> here <<var 2>> end")
    words = lambda s: s.encode().split()
    for text, end in {"start here end": 3, "start maybe here x end": 5, "start maybe more here x y end": 7, "start more here end": None, "start here x y z end": None, "start here": None}.items():
        assert a.accepts(words(text), 0) == end, text
    with pytest.raises(ValueError):
        TemplateAutomaton("<<opt>>x")
    with pytest.raises(ValueError):
        TemplateAutomaton("<<var 2>> x")


def as_pattern(markup):
    """The template as an ordinary pattern over space-joined words."""
    out = ""
    for part in re.findall(r"<<opt>>|<</opt>>|<<var \d+>>|[^\s<>]+", markup):
        if part == "<<opt>>":
            out += "(?:"
        elif part == "<</opt>>":
            out += ")?"
        elif part.startswith("<<var"):
            out += rf"(?:[^ ]+ ){{0,{part[6:-2]}}}"
        else:
            out += re.escape(part) + " "
    return re.compile(r"(?<![^ ])" + out)


def wording(rng, markup):
    """A random accepted wording, its words mixed in case and punctuation."""
    out, skip = [], 0
    for part in re.findall(r"<<opt>>|<</opt>>|<<var \d+>>|[^\s<>]+", markup):
        if part == "<<opt>>":
            skip = skip + 1 if skip or rng.random() < 0.5 else 0
        elif part == "<</opt>>":
            skip = max(0, skip - 1)
        elif not skip:
            out += [f"x{rng.randrange(9)}" for _ in range(rng.randint(0, int(part[6:-2])))] if part.startswith("<<var") else [part]
    return "".join(rng.choice([w, w.upper(), w.title()]) + rng.choice([" ", ", ", ".\n", " (", "; "]) for w in out)


def test_templates_equal_brute_force():
    rng, scanner = random.Random(6), LicenseScanner(PHRASES, TEMPLATES)
    patterns = {label: as_pattern(m) for label, m in TEMPLATES.items()}
    found = 0
    for label, markup in list(TEMPLATES.items()) * 12:
        text = wording(rng, markup)
        words = text.split()
        kind = rng.randrange(3)
        if kind == 1:  # one mandatory or optional word is another one
            words[rng.randrange(len(words))] = "other"
        elif kind == 2:  # or it is missing
            del words[rng.randrange(len(words))]
        text = f"before {' '.join(words)} after it"
        line = " ".join(re.findall(r"[a-z0-9]+", text.lower())) + " "
        want = {k for k, p in patterns.items() if p.search(line)}
        assert set(scanner.scan(text)[3]) == want, text
        found += label in want
        assert kind or label in want
    assert found > 80


def test_many_places_take_linear_time():
    start = time.perf_counter()
    n, starts, *_ = LicenseScanner(PHRASES, TEMPLATES).scan("mit license " * 200_000)
    assert (n, len(starts), starts[-1]) == (400_000, 200_000, 399_998)
    assert time.perf_counter() - start < 15
