import random
import re

import pytest
import test_decontaminate
import test_linededup
import test_mixing
import test_nearcopies

import corpus_pipeline
from tablesift.llm.langid import identify

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Clean, copied, nearly copied, contaminated, boilerplate-ridden and wordless documents."""
    r = random.Random(12)
    en = "the of and to in is that it was for on with as his they at be this from have".split()
    de = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()
    text = lambda words, n: " ".join(r.choice(words) + (f"{r.choice('abcdefgh')}{r.choice('stuvw')}" if r.random() < 0.6 else "") for _ in range(n))
    items = [(i, text(en, 30)) for i in range(5)]
    rows = []
    for i in range(260):
        words, lang = (en, "en") if i % 3 else (de, "de")
        body = text(words, r.choice([60, 120, 300]))
        if i % 10 == 0:
            body = body[:80].rpartition(" ")[0] + " " + items[i % 5][1][: 30 + i // 2] + " " + body[80:]
        if i % 2:
            body += "\nthis line stands on every site"
        rows.append([i, body, lang if i % 7 else None, f"site{i % 14}"])
    for i in range(260, 300):
        rows.append([i, rows[i - 200][1], "en", f"site{i % 14}"])
    for i in range(300, 320):
        words = rows[i - 200][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([i, " ".join(words), "en", f"site{i % 14}"])
    rows += [[400, None, "en", "site1"], [401, "", None, None], [402, "123 -- 456", "de", "site2"], [403, "this line stands on every site", "en", "site3"], [404, text(en, 20000), "en", None]]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], items


def brute_lines(rows):
    found = test_linededup.brute([(d, t, s, 0) for d, t, _, s, _ in rows], 10)
    kept = {}
    for x in found:
        d, t, _, n = eval(x)
        if not n or t.strip():
            kept[d] = t
    return [(d, kept[d], lang, s, len(kept[d])) for d, _, lang, s, _ in rows if d in kept]


def brute_near(rows):
    kept = set(test_nearcopies.brute([(r[0], r[1]) for r in rows]))
    return [r for r in rows if r[0] in kept]


def brute_clean(rows, items):
    bad = {eval(x)[0] for x in test_decontaminate.brute([(r[0], r[1]) for r in rows], items) if eval(x)[-1]}
    return [r for r in rows if r[0] not in bad]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = corpus()
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_and_run_against_brute_force(spark, folder, tmp_path):
    rows, items = corpus()
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), [c.split()[0] for c in SCHEMA.split(", ")]
    pred = {r.doc_id: r.lang_pred for r in identify(docs).collect()}
    want = [(d, t, pred[d], s, n) for d, t, _, s, n in rows if re.search(r"[^\W\d_]", t or "")]
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:4], (lambda x: x, brute_lines, brute_near, lambda x: brute_clean(x, items))):
        want = brute(want)
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns
        assert sorted(map(tuple, docs.collect())) == sorted(want, key=lambda r: r[0]), name
    assert 100 < len(want) < len(rows)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert sorted(got) == sorted(r[0] for r in want)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in want}
    names = sorted({r[3] for r in want}, key=lambda s: (s is None, s or ""))
    total = [sum(size[r[0]] for r in want if r[3] == s) for s in names]
    goal = dict(zip(names, test_mixing.brute_targets(total, [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert all(got[d]["size"] == n and 0 <= got[d].taken <= 3 * n for d, n in size.items())
    for s in names:
        taken = sum(got[r[0]].taken for r in want if r[3] == s)
        assert all(abs(got[r[0]].target - goal[s]) < 1e-6 for r in want if r[3] == s) and abs(taken - goal[s]) <= 0.05 * goal[s] + 10


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2 + [(None, "the cat and the hat", "en", None, 19), (7, "the cat and the hat", "en", "s", 19), (7, "the cat and the hat", "en", "s", 19)]])
def test_edge_tables_and_clashing_columns(spark, tmp_path, rows):
    more = ["key", "for_key", "cuts", "kept", "gone", "of", "n_lines", "n_removed", "_key", "_cut", "_bad", "w", "hash", "group", "x.y"]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"'{c}' as `{c}`" for c in more])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some benchmark text of more than ten words that no document here has at all")] if rows else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        assert docs.columns == df.columns, name
        assert all(r[c] == c for r in docs.collect() for c in more), name
    assert [r.doc_id for r in docs.collect()] == ([7] if rows else [])
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == ([7] if rows else [])
