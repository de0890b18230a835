import hashlib
import random
import re

from pyspark.sql import functions as F

from tablesift.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, key string, need string, n_chars string"


def test_peeling_recovers_the_differing_digests(spark):
    r = random.Random(7)
    rows = []
    for i in range(60):
        common = [r.randrange(-(2**63), 2**63) for _ in range(r.choice([0, 3, 20]))]
        a, b = ([r.randrange(-(2**63), 2**63) for _ in range(r.choice([0, 1, 3, 8]))] for _ in range(2))
        rows.append((i, common + a, common[::-1] + b, a, b))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>, x array<long>, y array<long>")
    got = df.select("*", fp.peel(fp.subtract(fp.sketch(F.col("a"), 24), fp.sketch(F.col("b"), 24)), 24).alias("p")).collect()
    for r in got:
        assert r.p.ok and sorted((f.key, f.n) for f in r.p.found) == sorted([(k, 1) for k in r.x] + [(k, -1) for k in r.y])


def test_too_small_a_sketch_says_so_and_a_larger_one_is_right(spark):
    r = random.Random(8)
    sets = [[r.randrange(-(2**63), 2**63) for _ in range(32)] for _ in range(2)]
    df = spark.createDataFrame([(sets[0], sets[1] + sets[0][:4]), (sets[0], sets[0]), ([], []), ([], sets[0][:5])], "a array<long>, b array<long>")
    assert not df.select(fp.peel(fp.subtract(fp.sketch(F.col("a"), 8), fp.sketch(F.col("b"), 8)), 8)["ok"].alias("ok")).first().ok
    pairs = df.where("a <> b").withColumns({"i": F.monotonically_increasing_id(), "j": F.lit(1)}).select("i", "j", "a", "b")
    assert sorted(x.differ for x in fp.differences(fp.materialize(pairs, "pairs"), 8).collect()) == [5, 60]


def test_every_difference_is_peeled_by_sketches_that_grow(spark):
    r = random.Random(10)
    key = lambda: r.randrange(-(2**63), 2**63)
    rows = []
    for i, n in enumerate([1, 2, 30, 90, 200, 700, 3000]):
        common = [key() for _ in range(50)]
        rows.append((i, common + [key() for _ in range(n)], common[::-1] + [key() for _ in range(n // 2)]))
    pairs = fp.materialize(spark.createDataFrame(rows, "i int, a array<long>, b array<long>").selectExpr("i", "i % 3 as j", "a", "b"), "pairs")
    assert sorted((x.i, x.differ) for x in fp.differences(pairs).collect()) == [(i, len(set(a) ^ set(b))) for i, a, b in rows]
    assert fp.differences(pairs.limit(0)).collect() == []
    assert "array_except" not in open(fp.__file__).read()  # the sketches decide alone


def test_few_pairs_need_more_than_their_own_row(spark, monkeypatch):
    """Texts that differ wholly, partly and by size: the second try is as large as the first says, so pairs that are written and tried again are few."""
    r = random.Random(11)
    text = lambda i, n: "".join(f"Sentence {r.randrange(10**9)} of {i}. " for _ in range(n))
    rows = [(i, text(i, r.choice([1, 20, 60, 150])), "", "", "") for i in range(150)]
    asked, once = [], fp.differences
    monkeypatch.setattr(fp, "differences", lambda pairs, *x: asked.append(pairs.count()) or once(pairs, *x))
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute([x[:2] for x in rows])
    assert {x.doc_id: (x.n_chars, x.edited_sha256, round(x.near_edited, 6), round(x.near_next, 6)) for x in got} == want
    assert sum(asked) <= 15, asked  # of 300


def paragraphs(text):
    return re.findall(fp.PARAGRAPH, text)


def brute(texts):
    """doc_id, n_chars, edited text, likeness to it and to the next, over lists of (id, text)."""
    order = sorted(texts, key=lambda x: -x[0])

    def like(a, b):
        a, b = set(paragraphs(a)), set(paragraphs(b))
        return len(a & b) / len(a | b) if a | b else 1.0

    out = {}
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        need = len(text) // 3
        edited = text[: len(text) - need] + after[:need]
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), round(like(text, edited), 6), round(like(text, after), 6))
    return out


def texts():
    r = random.Random(9)
    word = lambda: r.choice(["the", "été", "o", "日本", "lang\n", "end.", "x|", "😀"]) + str(r.randrange(9))
    out = [(3 * i, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 40, 300])))) for i in range(80)]
    return [*out, (1000, out[5][1]), (1001, "a" * 50000), (1002, ".\n" * 9000), (-5, "One. Two. Three.")]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 10)
    data = texts()
    got = fp.fingerprints(spark.createDataFrame([(i, t, "c", "c", "c") for i, t in data], SCHEMA)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 6), round(r.near_next, 6)) for r in got} == brute(data)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(data)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values()) and len(set().union(*by_text.values())) == len(by_text)


def test_edge_rows(spark):
    rows = [(1, "One. Two.", "", "", ""), (1, "One. Two.", "", "", ""), (None, None, "", "", ""), (2, None, "", "", ""), (None, "x", "", "", "")]
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == ["1", "1", "2", "None", "None"] and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fp.fingerprints(spark.createDataFrame([(1, "abcdef", "", "", "")], SCHEMA)).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_long_texts_are_compared_by_single_paragraphs(spark):
    long = [f"Sentence {i} of a long text." for i in range(200)]
    changed = [f"Other {i}." if i % 40 == 0 else x for i, x in enumerate(long)]
    rows = [(i, "".join(t), "", "", "") for i, t in ((3, long), (2, ["New. ", *long]), (1, changed))]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    for doc, after in ((3, 2), (2, 1), (1, 3)):
        a, b = (set(paragraphs(next(t for i, t, *_ in rows if i == x))) for x in (doc, after))
        assert got[doc].next_doc_id == after and abs(got[doc].near_next - len(a & b) / len(a | b)) < 1e-9 and got[doc].near_next > 0.9


def test_paragraphs():
    assert paragraphs("One. Two!? Three\nfour") == ["One.", " Two!?", " Three\n", "four"] and paragraphs("..a.") == ["..", "a."] and paragraphs("") == []
    long = " ".join(f"{'bcwt'[i * i % 4]}o{i}{'aestn'[i * 7 % 5]}" for i in range(3000))
    for text in (long, long + ".", "a" * 128000, "x" * 399 + "." + long):
        assert "".join(paragraphs(text)) == text and max(map(len, paragraphs(text))) <= 401
    a, b = set(paragraphs(long)), set(paragraphs("inserted words here " + long))
    assert len(a & b) / len(a | b) > 0.9


def test_an_inserted_and_a_deleted_sentence(spark):
    for n in (1000, 4000):
        text = "".join(f"Sentence {i} of a text of some length. " for i in range(n))
        rows = [(3, text, "", "", ""), (2, "One more. " + text, "", "", ""), (1, text.replace("Sentence 500 of a text of some length. ", ""), "", "", "")]
        got = {r.doc_id: r.near_next for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
        # the sentence behind the inserted one gets a blank before it
        assert abs(got[3] - (n - 1) / (n + 2)) < 2e-3 and abs(got[1] - (n - 1) / n) < 2e-3, got


def test_stretches_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(fp, "STRETCH", 10)
    r = random.Random(3)
    rows = [(r.choice([None, None, 7, 7, 7, 8, i]), f"text {i}.", "", "", "") for i in range(300)]
    got = fp.fingerprints(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "next_doc_id").collect()
    order = sorted((x[0] for x in rows), key=lambda x: (x is None, -(x or 0)))
    want = sorted(zip(order, order[1:] + order[:1]), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_no_python_on_the_main_path(spark):
    plan = fp.fingerprints(spark.createDataFrame([(1, "One. Two.", "", "", ""), (2, "x", "", "", "")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
