"""Sets against sets in tiles: exact, and no rows but the result's."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tablesift.operators import search, tiles


def sets_of(spark, n=90):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, 0, [w for w in words[:12] if r.random() < 0.9] + r.sample(words[12:], r.choice([0, 4, 40]))) for i in range(n)]
    rows += [(n + i, 0, rows[i][2][:-1] + ["odd"]) for i in range(20)]
    return {t: set(x) for t, _, x in rows}, tiles.value_sets(spark.createDataFrame(rows, "table_id long, column_id int, all array<string>").select("table_id", "column_id", F.explode("all").alias("value")))


def small_tiles(monkeypatch):
    for name, value in (("TILE", 7), ("VALUES", 90), ("AT_ONCE", 3), ("PAIRS", 5)):
        monkeypatch.setattr(tiles, name, value)


def test_pairs_and_the_best_against_brute_force(spark, monkeypatch):
    small_tiles(monkeypatch)
    data, sets = sets_of(spark)
    for least in (0.2, 0.6):
        got = {(x.r_table_id, x.s_table_id): (x.size_intersection, x.size_r_col, x.size_s_col) for x in search.similar_sets(sets, least).collect()}
        assert got == {(a, b): (len(data[a] & data[b]), len(data[a]), len(data[b])) for a, b in itertools.combinations(sorted(data), 2) if data[a] & data[b] and round(len(data[a] & data[b]) / len(data[a] | data[b]) + 1e-9, 3) >= least}
    for k in (1, 10, 500):
        got = {(x.r_table_id, x["rank"]): (x.s_table_id, x.k) for x in search.top_k_sets(sets, F.col("table_id") % 10 == 0, k).collect()}
        want = {a: sorted((b for b in data if b != a and data[a] & data[b]), key=lambda b: (-len(data[a] & data[b]), b))[:k] for a in data if a % 10 == 0}
        assert got == {(a, i + 1): (b, len(data[a] & data[b])) for a, bs in want.items() for i, b in enumerate(bs)}


def test_values_that_all_sets_have_make_no_rows(spark):
    """Each two of these sets have 40 values in common and are far from similar: 500,000 pairs, none of which may be a row that is sorted or shuffled."""
    rows = spark.range(1000).selectExpr("id as table_id", "0 as column_id", "transform(sequence(0, 39), x -> concat('all', x)) || transform(sequence(0, 299), x -> concat(id, '_', x)) as ids")
    sets = rows.select("table_id", "column_id", F.transform("ids", lambda x: F.xxhash64(x)).alias("ids"))
    found = search.similar_sets(sets, 0.2)
    assert found.count() == 0 and not any(x in found._jdf.queryExecution().executedPlan().toString() for x in ("SortMergeJoin", "Exchange"))


def test_texts_as_sets(spark):
    rows = [(1, "a  b\ta"), (1, "c"), (2, None), (3, " "), (4, "B b"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = tiles.text_sets(df, F.col("doc_id"), F.split(F.lower("text"), r"[ \t\n\r\f]+"))
    assert sorted((x.table_id or 0, len(x.ids)) for x in got.collect()) == [(0, 1), (1, 3), (4, 1)]
    found = search.similar_sets(got, 0.2).collect()
    assert [(x.r_table_id, x.s_table_id, x.size_intersection) for x in found] == [(1, 4, 1)] and np.isclose(found[0].jaccard, 0.333)
    none = tiles.value_sets(spark.createDataFrame([], "table_id string, column_id int, value string"))
    assert search.similar_sets(none, 0.2).count() == 0 and search.top_k_sets(none, F.lit(True), 3).count() == 0


def kinds_of_sets(n=240, size=60):
    """Sets of two kinds, each with frequent values of its own and a few of all, and near copies."""
    r = random.Random(7)
    every = [set(r.sample(range(10_000 * (i % 2), 10_000 * (i % 2) + 3 * size), size // 2)) | {20_000 + r.randrange(9) for _ in range(3)} | set(range(30_000 + 1000 * i, 30_000 + 1000 * i + size // 2)) for i in range(n)]
    return every + [set(sorted(x)[: int(len(x) * r.uniform(0.25, 1))]) | {-1 - i} for i, x in enumerate(every[:40])]


def test_most_pairs_are_ruled_out_and_not_counted(spark, monkeypatch):
    def counted(a, b):
        raise AssertionError("all pairs were counted")

    monkeypatch.setattr(tiles, "common", counted)
    monkeypatch.setattr(tiles, "LEFT", 0.2)
    monkeypatch.setattr(tiles, "MOST", 1 << 15)
    for size, names in ((60, {}), (700, {}), (60, {"ROWS": 7, "COUNTED": 3, "PAIRS": 50, "COLUMNS": (4, 16)})):  # 700: more than the digits hold at once
        for name, value in names.items():
            monkeypatch.setattr(tiles, name, value)
        data = kinds_of_sets(size=size)
        sets = spark.createDataFrame([(i, 0, sorted(x)) for i, x in enumerate(data)], "table_id long, column_id int, ids array<long>")
        all_ = tiles.blocks(sets, wide=True)
        batch = all_.select(*[F.col(c).alias(f"{x}_{c}") for x in "rs" for c in all_.columns]).toArrow().combine_chunks().to_batches()[0]
        for least in (0.2, 0.5):
            got = {}
            for p, q in itertools.product(range(batch.num_rows), repeat=2):
                a, b = tiles._Block(batch, p, "r"), tiles._Block(batch, q, "s")
                got |= {(a.keys[0][int(i)].as_py(), b.keys[0][int(j)].as_py()): int(k) for i, j, k in zip(*tiles.near(a, b, least))}
            want = {(i, j): len(x & y) for i, x in enumerate(data) for j, y in enumerate(data) if len(x & y) >= least * len(x | y)}
            assert got == want and len(want) > len(data)


def test_blocks_hold_one_kind_of_sets(spark, monkeypatch):
    monkeypatch.setattr(tiles, "NARROW", 20)
    data = kinds_of_sets()[:240]
    sets = spark.createDataFrame([(i, 0, sorted(x)) for i, x in enumerate(data)], "table_id long, column_id int, ids array<long>")
    found = [[i % 2 for i in x.tables] for x in tiles.blocks(sets, wide=True).collect()]
    assert sum(map(len, found)) == 240 and sum(min(sum(x), len(x) - sum(x)) for x in found) <= 20 * len(found) // 2
    monkeypatch.setattr(tiles, "LEFT", -1)  # then all are counted
    got = {(x.r_table_id, x.s_table_id): x.k for x in tiles.pairs_within(sets, 0.2).collect()}
    assert got == {(i, j): len(data[i] & data[j]) for i, j in itertools.combinations(range(240), 2) if len(data[i] & data[j]) >= 0.2 * len(data[i] | data[j])}
