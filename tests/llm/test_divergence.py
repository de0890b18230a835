import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablesift.llm import divergence
from tablesift.llm.divergence import audit, columns_of, shares

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, s string, part string, m string"
LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, min_docs):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def p(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda x, y: (x - y) ** 2 // (x + y)
        own = {s: p(count[lang, s]) for s in sources}
        whole = p(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(own[s][t], whole[t])) for t in kept if count[lang, s][t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 10)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return out


def rows(n=500, sources=9):
    r = random.Random(4)
    words = [w + c for w in ("The", "cat", "É", "straße", "漢", "zz", "qu", "Ab") for c in ("", "a", "B", "é", "1x")]
    out = []
    for i in range(n):
        source = r.choice(["s0"] * 4 + [f"s{k}" for k in range(sources)] + [None, "", "Ü"])
        k = len(source or "x") * 7 + i % 3
        out.append((" ".join(r.choice(words[k % 20 :]) for _ in range(r.choice([0, 1, 8, 60]))), r.choice(["en", "en", "en", "de", None]), source))
    return [*out, (None, "en", "nothing"), ("", "en", "nothing"), ("12 !!", "xx", "a"), ("rare words only", "xx", "b"), ("alone", "yy", "one"), ("the " * 5000, "en", "s1"), *[("the same row", "en", "s2")] * 30]


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [256, 4])
def test_against_brute_force(spark, size):
    data = rows()
    df = spark.createDataFrame([(i, *x, "", "", "", "", "") for i, x in enumerate(data)], SCHEMA)
    want = sorted(brute(data, 10))
    assert result(audit(df.repartition(7), size=size)) == want
    assert {x[2] for x in want} == {"pair", "term"} and ("xx", "a", "pair", "b", 0, 1) in want and not any(x[0] == "yy" for x in want)
    assert result(audit(df, min_docs=1, size=size)) == sorted(brute(data, 1))


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    data = rows(60)
    batch = divergence.pa.RecordBatch.from_arrays([divergence.pa.array([x[k] or "" for x in data]) for k in (1, 2, 0)], names=["lang", "source", "text"])

    def total():
        out, parts = Counter(), 0
        for b in divergence._counted(iter([batch, batch])):
            parts += 1
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns)):
                out[lang, source, term, "n"] += n
                out[lang, source, term, "docs"] += docs
        return out, parts

    at_once, few = total()
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "STRETCH", 50)
    in_parts, many = total()
    assert at_once == in_parts and many > few


def test_columns_are_evaluated_once_and_keep_their_first_terms(spark):
    data = [("en", f"t{i:03}", [(0, 5), (3, 1)]) for i in range(40)] + [("en", "other", [(0, 5)]), ("de", "t000", [(0, 5)])]
    got = columns_of(spark.createDataFrame(data, "lang string, term string, column array<struct<s:int,n:long>>"), 10).collect()
    assert sorted((r.lang, r.m, r.terms) for r in got) == [("de", 1, ["t000"]), ("en", 1, ["other"]), ("en", 40, [f"t{i:03}" for i in range(10)])]


def test_shares_are_exact_for_large_counts(spark):
    r = random.Random(1)
    for _ in range(300):
        total = r.randrange(10 ** r.randrange(1, 15))
        n, kept = r.randrange(total + 1), r.randrange(1, 10**6)
        want = 1 + 10**9 * (n + 2) // (total + 2 * kept)
        assert shares(np.array([n]), np.array([total]), kept)[0] == want
    assert spark.range(1).select(divergence.share("987654321987L", "9876543219876L", "123456L")).first()[0] == 1 + 10**9 * 987654321989 // (9876543219876 + 2 * 123456)


def test_an_empty_table_and_a_single_source(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert audit(df).collect() == [] and audit(df).columns == ["lang", "source", "part", "item", "value", "rank"]
    one = spark.createDataFrame([(i, "a b c", "en", "s", "", "", "", "", "") for i in range(12)], SCHEMA)
    assert audit(one).collect() == []
