import random
from itertools import combinations

import corpus_pipeline
from tablesift.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """Ids kept: the smallest of each component of five-word Jaccard >= 0.8."""

    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        common = len(sets[i] & sets[j])
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common) and label[i] != label[j]:
            a, b = label[i], label[j]
            label = [a if x == b else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min(least.get(x, i), i)
    return sorted(least.values())


def test_near_dedup_against_brute_force_jaccard(spark):
    r = random.Random(5)
    base = [[f"w{r.randrange(5000)}" for _ in range(n)] for n in (3, 5, 30, 60, 90, 120, 150, 200, 250, 269, 400) for _ in range(8)]
    texts = [" ".join(w) for w in base]
    for w in base:
        for edits in (1, 1, 2, 3, 5, 9):  # copies on both sides of the threshold
            c = list(w)
            for _ in range(edits):
                c[r.randrange(len(c))] = f"new{r.randrange(5000)}"
            texts.append(" ".join(c))
    chain = [f"c{i}" for i in range(130)]
    texts += [" ".join(chain[i : i + 100]) for i in range(0, 30, 4)]  # neighbours are similar, ends are not
    texts += [None, "", " \t\n", "a b c", "A\tb\nc  d", "a b c d"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == brute(rows)


def test_a_large_cluster_just_below_and_above_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "BLOCK", 20)
    r = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(160):  # copies of one text with three to five edits: many pairs lie around 0.8
        c = list(base)
        for k in r.sample(range(200), r.choice([3, 4, 5])):
            c[k] = f"n{i}_{k}"
        texts.append(" ".join(c))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == brute(rows) and 1 < len(kept) < 160


def test_a_template_with_too_much_of_their_own_needs_no_pairs(spark):
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):  # eight edits in blocks of their own: Jaccard of two about 0.7
        c = list(base)
        for k in r.sample(range(2, 196, 6), 7):
            c[k] = f"n{i}_{k}"
        rows.append((i, i, 7, " ".join(c)))
    near = [(1000, 1000, 7, " ".join(base)), (1001, 1001, 7, " ".join([*base, "more"])), (2000, 5, 8, "a b c d e f"), (2001, 5, 8, "a b c d e f g")]
    df = nearcopies.materialize(spark.createDataFrame(rows + near, "node long, comp long, cluster long, text string"), "own")
    kept = sorted(x.node for x in nearcopies.with_partners(df.select("node", "comp", "cluster"), df.select("node", "text")).collect())
    assert kept == [1000, 1001]  # two that are similar; the last two are in one component already


def test_no_pair_is_lost_by_the_bound(spark):
    r = random.Random(13)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[: r.randrange(20, 60)]) for _ in range(40)] + [" ".join(r.sample(words, 30)) for _ in range(20)]
    sets = [nearcopies.shingles(t.encode()) for t in texts]
    df = nearcopies.materialize(spark.createDataFrame([(i, i, 0, t) for i, t in enumerate(texts)], "node long, comp long, cluster long, text string"), "own")
    kept = {x.node for x in nearcopies.with_partners(df.select("node", "comp", "cluster"), df.select("node", "text")).collect()}
    assert kept >= {i for a, b in combinations(range(60), 2) if nearcopies.similar(sets[a], sets[b]) for i in (a, b)}


def test_empty_and_repeated(spark):
    assert corpus_pipeline.near_dedup(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    rows = [(None, "a b", None, None, 0), (7, "a b", None, None, 0), (7, "a b", None, None, 0), (None, "zz", None, None, 0)]
    assert sorted(str(x.doc_id) for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()) == ["7", "None"]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(i % 7, f"w{i % 5} x y z", "k", "g", "o", i % 2) for i in range(20)], "doc_id long, text string, key string, gone string, of string, `x.y` int")
    kept = corpus_pipeline.near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == brute([(i % 7, f"w{i % 5} x y z") for i in range(20)]) and all(r.key == "k" and r.gone == "g" and r.of == "o" for r in kept.collect())
