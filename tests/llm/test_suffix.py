import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tablesift.llm import suffix
from tablesift.llm.suffix import dedup_substrings, runs_of

SCHEMA = "doc_id long, text string, key string, lo string, n string"


def brute(texts, depth):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + depth] for t in data for i in range(len(t) - depth + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = [True] * depth
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(depth):
    r = random.Random(depth)
    some = lambda n: "".join(r.choice("abé d\n日") for _ in range(n))
    shared = [some(n) for n in (depth - 1, depth, depth + 3, 3 * depth, 9 * depth)]
    out = []
    for i in range(40):
        parts = [some(r.choice([0, 1, depth // 2, 2 * depth])) for _ in range(4)]
        for _ in range(r.choice([0, 1, 2])):
            parts.insert(r.randrange(5), r.choice(shared))
        out.append("".join(parts))
    long = list(out[3] + shared[4] + some(depth))
    for _ in range(12):  # near copies
        near = long[:]
        near[r.randrange(len(near))] = "X"
        out.append("".join(near))
    return [*out, None, "", "a" * depth, "b" * (5 * depth), "xy" * (3 * depth), some(depth), out[0], out[0], shared[0], shared[0], some(4 * depth) + shared[2]]


@pytest.mark.parametrize("depth,gram,piece", [(12, 4, 1 << 20), (40, 16, 300), (200, 64, 1 << 20), (9, 8, 50)])
def test_against_brute_force(spark, monkeypatch, depth, gram, piece):
    monkeypatch.setattr(suffix, "PIECE", piece)
    data = texts(depth)
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(data)]
    for group in (suffix.GROUP, 1):  # sorted within a task, and over the cluster
        monkeypatch.setattr(suffix, "GROUP", group)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA), depth, gram).collect()}
        assert [got[i] for i in range(len(data))] == brute(data, depth)
        if depth == 200:
            break


def test_runs_cover_every_window_once():
    r = random.Random(1)
    parts = [bytes(r.choice(b"ab") for _ in range(n)) for n in (3, 50, 9, 10, 400, 0, 11)]
    lo, hi, at = runs_of(b"".join(parts), [len(p) for p in parts], 10, 4)
    covered = [i for a, b in zip(lo, hi) for i in range(a, b + 1)]
    want, base = [], 0
    for p in parts:
        want += range(base, base + max(0, len(p) - 9))
        base += len(p)
    assert covered == want and all(a <= p and p + 4 <= a + 10 and b <= p for a, b, p in zip(lo, hi, at))


def test_sort_finds_equal_prefixes_within_groups():
    r = random.Random(3)
    for depth in (1, 7, 8, 9, 20, 24):
        data = bytes(r.choice(b"ab") for _ in range(600)) + bytes(60) + b"\xff" * 60
        at = np.array([i for i in range(len(data) - depth + 1) if r.random() < 0.7])
        group = np.sort(np.array([r.randrange(5) for _ in at]))
        seen = Counter((g, data[a : a + depth]) for a, g in zip(at.tolist(), group.tolist()))
        want = [i for i, (a, g) in enumerate(zip(at.tolist(), group.tolist())) if seen[g, data[a : a + depth]] > 1]
        assert suffix.sort_equal(data, at, group, depth).tolist() == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "q" * 150 + "z" * 150, "", "", "")] * 2 + [(None, "solo " * 10, "", "", "")]
    got = sorted((r.n_bytes, r.n_removed) for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(50, 0), (300, 300), (300, 300)]
    assert dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0
