"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on each document. The counts of vote patterns over all
documents (at most 3 to the number of labellers) are all that expectation-maximisation needs to estimate the prior
and each labeller's accuracies. The posterior labels of a sample of `SAMPLE` distinct texts, in expectation, then train a
logistic regression on hashed features (byte trigrams and the labellers' binned statistics), which scores every document.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, map_rows, slices, table

#: Distinct texts that the scorer is trained on, at most about (each once, however often it occurs); the posterior labels themselves come from all rows.
SAMPLE = 4096
#: Hashed features.
BUCKETS = 2048
SEED = 11
KEEP = 0.5

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that was for on are as with at be this from or by an not he she they we you have had has but"
    " der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an dem im wird sind"
    " le la les de des un une et est que qui dans pour par sur pas au aux du en il elle ce"
    " el los las y o que se del por con no una su al lo como más es son".encode().split()
)
UPPER, LETTER = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"!?()-")
SPACE = b" \t\n\r\v\f"

#: name | statistic | bad from | good to: the labeller votes bad from the one value, good up to the other, else it abstains.
#: Where good is above bad, it votes the other way round.
LABELLERS = [
    ("capitals", 0, 0.30, 0.10),
    ("symbols", 1, 0.06, 0.02),
    ("shouting", 2, 0.10, 0.00),
    ("same word again", 3, 0.10, 0.02),
    ("same three words", 4, 0.35, 0.10),
    ("separators", 5, 0.08, 0.00),
    ("same lines", 6, 0.40, 0.10),
    ("function words", 7, 0.04, 0.12),
    ("word length", 8, 11.0, 7.5),
    ("vocabulary", 9, 0.25, 0.45),
]
#: A text of fewer words gets no votes.
LEAST_WORDS = 8
#: Bin edges of the statistics as features.
EDGES = np.array([0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 4, 6, 8, 11])


def statistics(text: bytes) -> list[float] | None:
    """The labellers' statistics of one text; None if it is too short for any."""
    words = text.lower().split()
    n = len(words)
    if n < LEAST_WORDS:
        return None
    without = lambda chars: len(text) - len(text.translate(None, chars))
    lines = [x for x in text.split(b"\n") if x]
    solid = len(text) - without(SPACE)
    return [
        without(UPPER) / max(1, without(LETTER)),
        without(SYMBOL) / solid,
        (text.count(b"!!") + text.count(b"??") + text.count(b"$$")) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2),
        (words.count(b"|") + words.count(b"-") + words.count(b"*")) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(map(FUNCTION_WORDS.__contains__, words)) / n,
        solid / n,
        len(set(words[:400])) / min(n, 400) if n < 400 else min(len(set(words[i : i + 400])) / 400 for i in [*range(0, n - 399, 400), n - 400]),
    ]


def votes(stats: list[float] | None) -> list[int]:
    """0 abstains, 1 is bad, 2 is good."""
    if stats is None:
        return [0] * len(LABELLERS)
    out = []
    for _, i, bad, good in LABELLERS:
        x = stats[i]
        out.append((1 if x >= bad else 2 if x <= good else 0) if good < bad else (1 if x <= bad else 2 if x >= good else 0))
    return out


def pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over pattern counts: the prior of good, and chance[class, labeller, vote], class 1 is good.
    Starts from the share of good votes among those cast."""
    v = patterns[:, None] // 3 ** np.arange(labellers) % 3
    cast = (v > 0).sum(1)
    post = np.where(cast > 0, (v == 2).sum(1) / np.maximum(cast, 1), 0.5)
    prior, chance = 0.5, np.full((2, labellers, 3), 1 / 3)
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        new = np.stack([[[(w[v[:, i] == x]).sum() + 1 for x in range(3)] for i in range(labellers)] for w in weight])
        new /= new.sum(2, keepdims=True)
        prior = float((weight[1].sum() + 1) / (counts.sum() + 2))
        settled = np.abs(new - chance).max() < 1e-7
        chance = new
        post = posterior(patterns, prior, chance)
        if settled:
            break
    return prior, chance


def posterior(patterns: np.ndarray, prior: float, chance: np.ndarray) -> np.ndarray:
    v = patterns[:, None] // 3 ** np.arange(chance.shape[1]) % 3
    logs = np.log(chance[:, np.arange(chance.shape[1]), v]).sum(2)
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -500, 500)))


def features(texts: list[bytes], stats: list[list[float] | None]) -> np.ndarray:
    """Hashed features, a row for each text: square roots of trigram shares, and ones for the bins of its statistics."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, (text, s) in enumerate(zip(texts, stats)):
        counts = np.zeros(BUCKETS)
        for at in range(0, len(text) - 2, 1 << 20):
            b = np.frombuffer(text[at : at + (1 << 20) + 2], dtype=np.uint8).astype(np.uint32)
            counts += np.bincount((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761) >> np.uint32(21), minlength=BUCKETS)
        out[i] = np.sqrt(counts / max(1, len(text) - 2))
        if s is not None:
            for j, level in enumerate(np.searchsorted(EDGES, s)):
                out[i, (j * 64 + int(level)) * 2654435761 % 2**32 >> 21] += 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.5, shrink: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias, from soft labels, by gradient steps with momentum."""
    y = y.astype(np.float32)
    w, speed, b, speed_b = np.zeros(x.shape[1], dtype=np.float32), np.zeros(x.shape[1], dtype=np.float32), 0.0, 0.0
    for _ in range(rounds if len(x) else 0):
        error = (1 / (1 + np.exp(-(x @ w + np.float32(b)))) - y).astype(np.float32)
        speed = 0.9 * speed - rate * (x.T @ error / len(x) + shrink * w).astype(np.float32)
        speed_b = 0.9 * speed_b - rate * float(error.mean())
        w, b = w + speed, b + speed_b
    return np.append(w, b)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0, 8 << 20):
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(statistics(t))) for t in byte_texts(batch.column(0))], pa.int64())], names=["pattern"])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 0, 8 << 20):
        texts = byte_texts(batch.column(0))
        stats = [statistics(t) for t in texts]
        x = features(texts, stats).astype(np.float16)
        yield pa.RecordBatch.from_arrays([pa.array([pattern(votes(s)) for s in stats], pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["pattern", "x"])


def classify(docs: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """docs: doc_id, text, more columns or none. For each of its rows: doc_id, weak (posterior of good from the votes), score
    (of the linear scorer), keep (score of KEEP or more), n_votes.

    A null text is empty; a text of fewer than LEAST_WORDS words gets no votes, so `weak` is the prior. Repeated rows are
    scored alike, and count each in the estimates. An empty table gives an empty result. Texts of any length are read whole;
    other columns are not read.
    """
    spark = docs.sparkSession
    counted = docs.select("text").transform(map_rows, _voted, "pattern long").groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r["pattern"] for r in counted], dtype=np.int64), np.array([r["n"] for r in counted], dtype=float)
    prior, chance = estimate(patterns, counts, len(LABELLERS)) if len(patterns) else (0.5, np.full((2, len(LABELLERS), 3), 1 / 3))
    order = F.xxhash64("text", F.lit(seed))  # the texts with the least hashes, each once, however often they come
    last = docs.select(order.alias("hash")).distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    part = F.lit(False) if last is None else order <= F.lit(last)
    drawn = docs.where(part).groupBy(F.xxhash64("text"), F.xxhash64(F.lit(seed), "text")).agg(F.first("text").alias("text"))
    drawn = drawn.select("text").transform(map_rows, _featured, "pattern long, x binary").toArrow()
    x = np.frombuffer(b"".join(drawn["x"].to_pylist()), dtype=np.float16).reshape(-1, BUCKETS).astype(np.float32)
    label = posterior(np.asarray(drawn["pattern"]), prior, chance) if len(x) else np.zeros(0)
    order = np.argsort([r.tobytes() for r in x]) if len(x) else np.zeros(0, dtype=int)  # sums don't depend on how tasks end
    weights = spark.sparkContext.broadcast(logistic(x[order], label[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in slices(batches, 1, 4 << 20):
            texts = byte_texts(batch.column(1))
            stats = [statistics(t) for t in texts]
            v = [votes(s) for s in stats]
            score = np.concatenate([1 / (1 + np.exp(-np.clip(features(texts[i : i + 256], stats[i : i + 256]) @ w[:-1] + w[-1], -60, 60))) for i in range(0, len(texts), 256)])
            weak = posterior(np.array([pattern(p) for p in v], dtype=np.int64), prior, chance)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weak), pa.array(score.astype(np.float64)), pa.array(score >= KEEP), pa.array([sum(p > 0 for p in q) for q in v], pa.int64())], names=["doc_id", "weak", "score", "keep", "n_votes"])

    return docs.select("doc_id", "text").transform(map_rows, run, f"doc_id {dict(docs.dtypes)['doc_id']}, weak double, score double, keep boolean, n_votes long")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


QUERIES = {"op1_weak_quality": op1_quality}
ORACLE: dict[str, str] = {}
