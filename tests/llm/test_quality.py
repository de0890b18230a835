import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tablesift.llm import quality
from tablesift.llm.quality import LABELLERS, classify, estimate, posterior, statistics, votes

SCHEMA = "doc_id long, text string, score string, weak string, keep string"


def test_em_recovers_the_accuracies_of_labellers():
    r = np.random.default_rng(1)
    truth = r.random(40000) < 0.7
    right, active = np.array([0.95, 0.9, 0.8, 0.7, 0.6]), np.array([0.9, 0.5, 0.8, 0.7, 0.9])
    correct = r.random((len(truth), 5)) < right
    v = np.where(correct == truth[:, None], 2, 1) * (r.random((len(truth), 5)) < active)
    patterns, counts = np.unique((v * 3 ** np.arange(5)).sum(1), return_counts=True)
    prior, chance = estimate(patterns, counts.astype(float), 5)
    assert abs(prior - 0.7) < 0.03
    found = chance[1, :, 2] / (chance[1, :, 1] + chance[1, :, 2])
    assert np.abs(found - right).max() < 0.05
    sure = posterior((v * 3 ** np.arange(5)).sum(1), prior, chance) > 0.5
    assert (sure == truth).mean() > 0.94


def test_votes():
    good = b"The cat sat on the mat and looked at the dog, which was not pleased with it at all. Then they went home."
    assert votes(statistics(good)).count(1) == 0 and votes(statistics(good)).count(2) >= 6
    assert votes(statistics(b"SHOUT!! " * 40)).count(1) >= 4 and votes(statistics(b"one two")) == [0] * len(LABELLERS)
    assert votes(statistics(b"a| b | c | d | e | f | g | h | i"))[5] == 1


def test_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = classify(docs).join(labels, "doc_id").select("score", "keep", "quality").collect()
    good, bad = [r for r in rows if r.quality], [r for r in rows if not r.quality]
    assert sum(r.keep for r in good) / len(good) > 0.98 and sum(not r.keep for r in bad) / len(bad) > 0.8


def test_edge_rows(spark):
    rows = [(1, None, "", "", ""), (2, "", "", "", ""), (3, "日本語 " * 30000, "", "", ""), (3, "日本語 " * 30000, "", "", ""), (None, "the cat and the dog", "", "", "")]
    got = classify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and 0 <= r.weak <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert classify(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_statistics(text):
    """The ten statistics, told from the labellers' names, character by character."""
    space, b = " \t\n\r\v\f", text.encode()
    words = [w for w in re.split(r"[ \t\n\r\v\f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    n = len(words)
    if n < 8:
        return None
    solid = sum(chr(x) not in space for x in b)
    letters = sum(65 <= x <= 90 or 97 <= x <= 122 or x >= 128 for x in b)
    symbols = sum(33 <= x < 127 and chr(x) not in ".,;:'\"!?()-" and not chr(x).isalnum() for x in b)
    triples = [tuple(words[i : i + 3]) for i in range(n - 2)]
    lines = [x for x in text.split("\n") if x]
    windows = [words] if n < 400 else [words[i : i + 400] for i in [*range(0, n - 399, 400), n - 400]]
    return [
        sum(65 <= x <= 90 for x in b) / max(1, letters), symbols / solid, sum(text.count(x) for x in ("!!", "??", "$$")) / n,
        sum(words[i] == words[i + 1] for i in range(n - 1)) / n, 1 - len(set(triples)) / len(triples), sum(w in "|-*" for w in words) / n,
        1 - len(set(lines)) / max(1, len(lines)), sum(w.encode() in quality.FUNCTION_WORDS for w in words) / n, solid / n, min(len(set(w)) / len(w) for w in windows),
    ]


def brute(texts, buckets=quality.BUCKETS):
    """(weak, score) of each text: expectation-maximisation over single documents, then gradient steps, all in doubles."""
    stats = [plain_statistics(t or "") for t in texts]
    votes = []
    for s in stats:
        row = []
        for _, i, bad, good in quality.LABELLERS:
            low = good < bad
            row.append(0 if s is None else 1 if (s[i] >= bad if low else s[i] <= bad) else 2 if (s[i] <= good if low else s[i] >= good) else 0)
        votes.append(row)
    post = [0.5 if not any(v) else v.count(2) / (10 - v.count(0)) for v in votes]
    old = None
    for _ in range(200):
        chance = [[[1 + sum(p if k else 1 - p for v, p in zip(votes, post) if v[i] == x) for x in range(3)] for i in range(10)] for k in range(2)]
        chance = [[[c / sum(one) for c in one] for one in labeller] for labeller in chance]
        prior = (sum(post) + 1) / (len(votes) + 2)
        ratio = [math.log(prior / (1 - prior)) + sum(math.log(chance[1][i][x] / chance[0][i][x]) for i, x in enumerate(v)) for v in votes]
        post = [1 / (1 + math.exp(-r)) for r in ratio]
        if old and max(abs(a - b) for k in range(2) for i in range(10) for a, b in zip(chance[k][i], old[k][i])) < 1e-7:
            break
        old = chance
    x = np.zeros((len(texts), buckets))
    for row, (t, s) in enumerate(zip(texts, stats)):
        b = (t or "").encode()
        for i in range(len(b) - 2):
            x[row, (b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32 >> 21] += 1
        x[row] = np.sqrt(x[row] / max(1, len(b) - 2))
        for j, value in enumerate(s or ()):
            x[row, (j * 64 + sum(value > e for e in quality.EDGES)) * 2654435761 % 2**32 >> 21] += 1
    train = sorted({t: i for i, t in enumerate(texts)}.values())
    xs, ys = x[train], np.array([post[i] for i in train])
    w, b, dw, db = np.zeros(buckets), 0.0, np.zeros(buckets), 0.0
    for _ in range(300):
        e = 1 / (1 + np.exp(-(xs @ w + b))) - ys
        dw, db = 0.9 * dw - 0.5 * (xs.T @ e / len(xs) + 1e-4 * w), 0.9 * db - 0.5 * e.mean()
        w, b = w + dw, b + db
    return [(p, float(1 / (1 + np.exp(-(r @ w + b))))) for p, r in zip(post, x)]


def test_the_whole_query_against_brute_force(spark, tmp_path):
    r = random.Random(8)
    good = "the cat and the dog of a house in which they have been for years and it was not as cold as that".split()
    texts = []
    for i in range(150):
        n = r.choice([0, 5, 8, 30, 200, 450, 900])
        texts.append(" ".join(r.choice(good) + (f"{r.randrange(50)}" if r.random() < 0.4 else "") for _ in range(n)) if i % 3 else "BUY $$ NOW!! | - * " * (n // 5) + "é" * (n % 7))
    texts += [None, "", texts[4], texts[4], texts[4], "same line\n" * 60]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in quality.op1_quality(spark, str(tmp_path)).collect()}
    want = brute(texts)
    assert len(got) == len(texts)
    for i, (weak, score) in enumerate(want):
        assert abs(got[i].weak - weak) < 1e-5 and abs(got[i].score - score) < 5e-3, (i, got[i], weak, score)
        assert got[i].keep == (got[i].score >= 0.5) and got[i].n_votes == sum(x > 0 for x in quality.votes(plain_statistics(texts[i] or "")))


def test_texts_repeated_often_train_the_scorer_too(spark):
    good = "the cat and the dog of a house in which they have been for years and it was not as cold as that. ".split()
    r = random.Random(9)
    texts = [" ".join(r.choice(good) for _ in range(60)) if i % 2 else f"BUY {i} $$ NOW!! | - * " * 12 for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {x.doc_id: x.score for x in quality.classify(df).collect()}
    many = df.join(spark.range(20_000).select(F.lit(1).alias("one"))).drop("one").repartition(8)
    got = quality.classify(many).groupBy("doc_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.count("*").alias("n")).collect()
    assert len(got) == 40 and all(x.n == 20_000 and x.lo == x.hi for x in got)
    assert len({x.lo for x in got}) > 20 and {x.lo >= 0.5 for x in got} == {True, False}
    assert max(abs(x.lo - want[x.doc_id]) for x in got) < 0.02  # as if each text were there once


def test_the_scorer_is_fit_on_no_more_than_the_sample(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('the text number ', id % 500, ' of all that is said here and there') as text")
    order = F.xxhash64("text", F.lit(quality.SEED))
    least = df.select(order.alias("h")).distinct().orderBy("h").limit(64).agg(F.max("h")).first()[0]
    assert df.where(order <= least).select("text").distinct().count() == 64
    assert quality.classify(df, sample=64).count() == 3000 and quality.classify(df.limit(0)).count() == 0
