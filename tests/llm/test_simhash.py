import random

import numpy as np
import xxhash

from tablesift.llm import simhash as simhash_module
from tablesift.llm.simhash import simhash, simhash_components, trie_join, trie_links

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id string"


def brute_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        least[x] = min(least.get(x, i), i)
    return [least[x] for x in label]


def texts():
    r = random.Random(1)
    words = ["the", "Of", "and", "é", "ÉTÉ", "x1", "tea", "one", "two"]
    base = [" ".join(r.choice(words) + str(r.randrange(40)) for _ in range(r.choice([0, 1, 2, 3, 4, 60, 200]))) for _ in range(40)]
    near = []
    for t in base[20:]:
        w = t.split(" ")
        for _ in range(3):
            w[r.randrange(len(w))] = "changed"
            near.append(" ".join(w))
    return [*base, *near, *base[:9], None, "", " \t\n", "a b c", "A\tb\nc  d", "a b c d", "x " * 70000]


def test_fingerprints_and_components_against_brute_force(spark):
    rows = [(i, t, None, "s", 0, "clash", "clash") for i, t in enumerate(texts())]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [brute_print(r[1]) for r in rows]
    assert [got[r[0]][0] for r in rows] == prints
    assert [got[r[0]][1] for r in rows] == brute_components([r[0] for r in rows], prints)


def test_trie_links_connects_what_brute_force_connects():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 36, 12, dtype=np.uint64)
    near = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << r.integers(0, 36, 12, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 36, 12, dtype=np.uint64)) for _ in range(60)]))
    i, j = trie_links(np.zeros(len(near), dtype=np.int64), near)
    mine = list(range(len(near)))
    for a, b in zip(i, j):
        x, y = mine[a], mine[b]
        mine = [y if m == x else m for m in mine]
    want = brute_components(list(range(len(near))), [int(x) for x in near])
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_edge_tables(spark):
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b", None, None, 0, "", ""), (7, "a b", None, None, 0, "", ""), (None, "a b", None, None, 0, "", ""), (None, "zz", None, None, 0, "", "")]
    got = sorted(simhash_components(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "component_id").collect(), key=str)
    assert [tuple(x) for x in got] == [(7, 7), (7, 7), (None, 7), (None, None)]


def test_large_nodes_are_split(spark, monkeypatch):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << i for i in r.sample(range(64), r.choice([0, 1, 2]))) for b in base for _ in range(120)} | {r.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    for bucket in (1 << 16, 7, 1):
        monkeypatch.setattr(simhash_module, "BUCKET", bucket)
        links = trie_join(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
        label = {x: x for x in signed}
        for u, v in links:
            a, b = label[u], label[v]
            label = {k: b if x == a else x for k, x in label.items()}
        want = brute_components(list(range(len(prints))), prints)
        mine = [label[x] for x in signed]
        assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))
