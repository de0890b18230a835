import random
import re
from fractions import Fraction

from tablesift.llm.mixing import mix, sainte_lague, targets, within

SCHEMA = "doc_id long, text string, source string, size string, shard string, target string"


def brute_targets(sizes, weights):
    out, total = {}, Fraction(sum(sizes))
    while True:
        rest = [i for i in range(len(sizes)) if i not in out]
        if not rest:
            break
        left, w = total - sum(out.values()), sum(weights[i] for i in rest)
        over = [i for i in rest if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            out.update({i: left * weights[i] / w for i in rest})
            break
        out.update({i: Fraction(3 * sizes[i]) for i in over})
    return [float(out[i]) for i in range(len(sizes))]


def test_targets_and_seats():
    for sizes in ([100, 1, 1, 50], [0, 0], [5], [1000, 10, 10, 10, 10, 3], []):
        w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        assert all(abs(a - b) < 1e-6 for a, b in zip(targets(sizes, w), brute_targets(sizes, w)))
    assert sainte_lague([53, 24, 23], 7) == [3, 2, 2] and sainte_lague([0, 0], 5) == [0, 0] and sainte_lague([1, 1], 1) == [1, 0]
    votes = [340, 280, 160, 60, 15]
    quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(200)))[:100]
    assert sainte_lague(votes, 100) == [sum(i == j for _, j in quotients) for i in range(5)]


def test_limits_are_kept_and_what_is_over_goes_on():
    assert within([5, 1, 0], [3, 9, 9]) == [3, 3, 0] and within([2, 2], [3, 3]) == [2, 2] and within([4, 4], [3, 3]) == [3, 3]


def rows():
    r = random.Random(2)
    out = [(i, " ".join("w" for _ in range(r.choice([0, 3, 50, 400]))), r.choice(["a", "a", "a", "é", "b", None]), "", "", "") for i in range(900)]
    return [*out, (900, None, "b", "", "", ""), (901, " \t\n", "zz", "", "", ""), (902, "one two\vthree x", "tiny", "", "", ""), (903, "w " * 90000, "a", "", "", ""), (None, "x y", "a", "", "", ""), (5, "x", "c5", "", "", ""), (5, "x", "c5", "", "", "")]


def test_mix_against_its_rules(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mix(df).collect()
    again = mix(df.repartition(7)).collect()
    assert len(got) == len(data) and sorted(map(str, got)) == sorted(map(str, again))
    size = {(d, s): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, s, *_ in data}
    by = {}
    for r in got:
        assert r["size"] == size[r.doc_id, r.source] and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    goal = brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, n, g in zip(names, sizes, goal):
        assert all(r.source_size == n and abs(r.target - g) < 1e-6 for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - g) <= max(1, 0.02 * g), (s, g)


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mix(spark.createDataFrame([(1, None, None, "", "", "")], SCHEMA)).collect()] == [0]


def test_a_tiny_source_beside_a_huge_one(spark):
    rows = [(i, "w " * 400000, "huge", "", "", "") for i in range(50)] + [(100 + i, "w " * n, s, "", "", "") for s, n in (("s1", 20), ("s2", 150), ("s3", 900)) for i in range(2)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    for s in ("huge", "s1", "s2", "s3"):
        goal = next(r.target for r in got if r.source == s)
        assert goal > 0 and abs(sum(r.taken for r in got if r.source == s) - goal) <= 0.02 * goal, s


def test_dealing_at_once_gives_the_same_seats():
    r = random.Random(4)
    for _ in range(200):
        votes = [r.choice([0, 1, 1, 7, 50, r.random() * 1000, 10**6]) for _ in range(r.randrange(1, 9))]
        seats = r.randrange(300)
        quotients = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v for k in range(seats)))[:seats]
        assert sainte_lague(votes, seats) == [sum(i == j for _, j in quotients) for i in range(len(votes))]
    assert sum(sainte_lague([5e9, 1e5, 3.0], 5_000_100_003)) == 5_000_100_003


def test_very_uneven_sources_one_word_documents_and_null_ids(spark):
    rows = [(None if i % 3 == 0 else i, "w", "b", "", "", "") for i in range(5000)] + [(10000 + i, "w " * 500000, "a", "", "", "") for i in range(50)] + [(20000, "w " * 9, "c", "", "", "")]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for s, target in (("b", 15000), ("c", 27)):
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - target) < 1e-6 and r.taken == 3 * r["size"] for r in own) and sum(r.taken for r in own) == target
    own = [r for r in got if r.source == "a"]
    assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_twenty_thousand_sources(spark):
    df = spark.range(60000).selectExpr("id as doc_id", "repeat('w ', cast(id % 7 + 1 as int)) as text", "concat('s', id % 20000) as source")
    rows = mix(df).collect()
    taken, goal = {}, {}
    for r in rows:
        taken[r.source], goal[r.source] = taken.get(r.source, 0) + r.taken, r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert len(rows) == 60000 and all(abs(taken[s] - goal[s]) <= 1 for s in goal)
