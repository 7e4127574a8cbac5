import random
import re

import pytest

from regolith.llm import licenses as L

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(label, i) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(places, key=lambda x: x[1])


def test_base_equals_brute_force():
    r = random.Random(1)
    parts = ["MIT", "license", "Apache", "mit license", "general public", "é", "1", "-", "\n", " ", "_", "GENERAL", "public", "\x7f", "ſ", "K"]
    for _ in range(3000):
        text = "".join(r.choice(parts) + r.choice([" ", "", ", ", "\n"]) for _ in range(r.randint(0, 14)))
        n, places, _ = L.scan(text)
        assert (n, sorted(places, key=lambda x: x[1])) == brute(text), repr(text)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0", ["Apache-2.0"]),
        ("released under the MIT License", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
        ("under the terms of the GNU Lesser General Public License version 2.1", ["LGPL-2.1"]),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["CC-BY-NC-SA-4.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", ["MIT"]),
        ("All rights reserved.", ["all-rights-reserved"]),
        ("she got her license to drive with permission", []),
        ("", []),
        (None, []),
    ],
)
def test_detections(text, labels):
    assert [d.label for d in L.scan(text)[2]] == labels


def test_keywords_occur_in_every_match():
    for name in L.NAMES.values():
        plain = name.replace("V", "version ")
        for option in re.split(r"\|(?![^(]*\))", plain):
            text = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\[(.)[^\]]*\]", r"\1", option)).replace("?", "").replace("\\w*", "x")
            for r in L.rules():
                line = f" {text} ".encode()
                if r.match.search(line) and r.keywords:
                    assert any(k in line for k in r.keywords), (r.label, text)


def test_suppression_keeps_the_best():
    f = L.Found
    assert L.suppressed([f("a", 4, 0, 3), f("b", 1, 0, 3), f("c", 4, 2, 5), f("d", 4, 1, 2)]) == [f("b", 1, 0, 3), f("c", 4, 2, 5)]


def test_many_detections_stay_linear():
    n, base, found = L.scan("mit license " * 20000)
    assert (n, len(base), len(found)) == (40000, 20000, 20000)


def test_op4(spark, sf, sample):
    got = {r.doc_id: r for r in L.op4_license_scan(spark, sf).collect()}
    for r in sample.collect():
        n, places = brute(r.text)
        x = got[r.doc_id]
        at = [i for _, i in places]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (n, len(places), min(at, default=None), max(at, default=None))
        assert x.base_labels == ",".join(sorted({label for label, _ in places}))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1


def test_odd_rows(documents, nothing):
    assert L.scan_licenses(documents, "doc_id", "text").count() == documents.count()
    assert L.scan_licenses(nothing, "doc_id", "text").count() == 0


@pytest.mark.parametrize(("text", "label"), [("https://scripts.sil.org/OFL", "OFL-1.1"), ("gnu.org/copyleft/fdl", "GFDL"), ("MIT No Attribution", "MIT-0")])
def test_detections_without_common_words(text, label):
    assert [d.label for d in L.scan(text)[2]] == [label]


def options(expression):
    """Texts that an expression matches, one at least through each of its alternatives."""
    import re._parser as parser

    def texts(parsed):
        out = [""]
        for op, av in parsed:
            op = str(op)
            if op == "LITERAL":
                new = [chr(av)]
            elif op == "IN":
                new = [chr(av[0][1]) if str(av[0][0]) == "LITERAL" else "x"]
            elif op == "ANY":
                new = ["x"]
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                new = [t * n for n in {av[0], min(max(av[0], 1), av[1])} for t in texts(av[2])]
            elif op == "SUBPATTERN":
                new = texts(av[3])
            elif op == "BRANCH":
                new = [t for branch in av[1] for t in texts(branch)]
            else:
                raise ValueError(op)
            # all options of this part with the first ones before it, and the others with its first
            out = [out[0] + t for t in new] + [t + new[0] for t in out[1:]]
        return list(dict.fromkeys(out))

    return texts(parser.parse(expression))


def test_every_alternative_is_found_through_scan():
    missed = []
    for r in L.rules():
        for t in options(r.match.pattern.decode().removesuffix("(?= )")):
            if r.match.search(f" {t.strip()} ".encode()) and not L.scan(t)[2]:
                missed.append((r.label, t))
    assert not missed
