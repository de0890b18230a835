import random
import re

from tablesift.llm.license import BASE, by_keyword, license_scan, rules, scan

GATED = by_keyword(rules())


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in BASE.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", " .,", "Licensed under CC BY-NC 4.0.", "CC-BY cc by, CC\nBY!", "xcc by ccby cc byx", "ÉTÉ all Rights  reserved é",
    "This work is licensed under the GNU General Public License, version 3.", "general public license general public license",
    "all rights reserved " * 3000, "k" * 500000, "SPDX-License-Identifier: MIT", "a [b] `c` {d} 1.0",
]


def test_base_columns_against_brute_force(spark):
    rows = [(i, t, "x", "clash") for i, t in enumerate(TEXTS)] + [(None, "cc by", None, None), (None, "cc by", None, None)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(TEXTS):
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def matches(pattern, most=400):
    """Strings that the regex matches: every branch, every repeat at its least and one more."""

    def walk(items):
        out = {""}
        for op, arg in items:
            kind = str(op)
            if kind == "LITERAL":
                parts = {chr(arg)}
            elif kind == "IN":
                parts = {chr(x[1] if str(x[0]) == "LITERAL" else x[1][0]) for x in arg[:2]}
            elif kind == "ANY":
                parts = {"x"}
            elif kind == "SUBPATTERN":
                parts = walk(arg[3])
            elif kind == "BRANCH":
                parts = set().union(*(walk(x) for x in arg[1]))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                once = walk(arg[2])
                parts = {x * n for x in once for n in {arg[0], min(arg[1], arg[0] + 1)}}
            else:
                assert kind == "ASSERT_NOT", kind
                parts = {""}
            out = set(sorted({a + b for a in out for b in parts}, key=lambda x: (len(x), x))[:most])
        return out

    return walk(re._parser.parse(pattern.pattern.decode()))


def test_there_are_hundreds_of_rules_and_keywords_gate_them_safely():
    ordered = rules()
    assert len(ordered) > 400 and len({(r.label, r.pattern.pattern) for r in ordered}) == len(ordered)
    for rule in ordered:
        found = [m for m in matches(rule.pattern) if rule.pattern.fullmatch(m.encode())]
        assert found and all(rule.keyword in m.encode() for m in found), rule


def test_suppression_against_brute_force():
    r = random.Random(2)
    lines = sorted(min(matches(x.pattern), key=len) for x in rules())
    for _ in range(60):
        text = " ".join(x for _ in range(6) for x in (r.choice(lines), *r.choices(["word", "all rights reserved", "under the", "cc by"], k=r.randrange(3))))
        found = [(-x.priority, -(m.end() - m.start()), text[: m.start()].count(" "), x.label, text[: m.end()].count(" ")) for x in rules() for m in x.pattern.finditer(text.encode())]
        taken = []
        for hit in sorted(found):
            if not any(t[2] <= hit[2] and hit[4] <= t[4] for t in taken):
                taken.append(hit)
        got = scan(text.encode(), GATED)
        base = {label for phrase, label in BASE.items() if f" {phrase} " in f" {text} "}
        assert got["labels"] == ",".join(sorted({t[3] for t in taken} | base)) and (got["n_detections"], got["n_suppressed"]) == (len(found), len(found) - len(taken))


def test_priority_and_containment():
    assert scan(b"Licensed under the Apache License, Version 2.0.", GATED)["labels"] == "apache-2.0"
    found = scan(b"Licensed under CC BY-NC 4.0.", GATED)
    assert found["labels"] == "cc-by,cc-by-nc" and found["n_suppressed"] > 0
    assert scan(b"Released under the MIT License.", GATED)["labels"] == "mit"
    assert scan(b"SPDX-License-Identifier: Apache-2.0", GATED)["labels"] == "apache-2.0"
    assert scan(b"plain words only", GATED)["labels"] == "" and scan(b"", GATED)["score"] == 0


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
