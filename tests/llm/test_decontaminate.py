import hashlib
import random
import re

from tablesift.llm.decontaminate import contamination, without_contaminated

SCHEMA = "doc_id long, text string, lang string, key string, w string, n string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item, t, *_ in items:
            v = words(t)
            n = min(10, len(v))
            spans = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in spans:
                    hit.update(range(i, i + n))
                    found.add("null" if item is None else str(item))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def rows(short=True):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(30)] + ["É", "é", "ÉT", "x"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([10, 11, 25, 60])))) for i in range(30)]
    if short:
        items += [(40, "only three words"), (41, "x"), (42, None), (43, " .,"), (44, "One, TWO three w1 w2 w3 w4 w5 w6"), (3, "again item three with other words and a few more of them"), (None, "the null item has exactly ten words in it, no more")]
    docs = []
    for i in range(60):
        parts = [r.choice(vocab) for _ in range(r.choice([0, 5, 9, 10, 40, 300]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            v = words(r.choice(items)[1])
            a = r.randrange(max(1, len(v)))
            parts[r.randrange(len(parts) + 1) :] = v[a : a + r.choice([9, 10, 14, 60])] + parts[:20]
        docs.append((i, "-".join(p.upper() if r.random() < 0.3 and p.isascii() else p for p in parts), "en", "c", "c", "c"))
    docs += [(70, None, None, "", "", ""), (71, "", None, "", "", ""), (72, items[0][1] + " tail", None, "", "", ""), (72, items[0][1] + " tail", None, "", "", ""), (None, items[1][1], None, "", "", ""), (73, "q " * 60000 + items[2][1] + " q" * 500, None, "", "", "")]
    return docs, items


def test_against_brute_force(spark):
    for short in (False, True):
        docs, items = rows(short)
        got = contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got.collect()) == brute(docs, items)


def test_filter_and_empty_tables(spark):
    docs, items = rows(False)
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    kept = without_contaminated(df, bench)
    bad = {str(r[0]) for r in contamination(df, bench).where("contaminated").select("doc_id").collect()}
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d[0]) for d in docs if str(d[0]) not in bad) and len(bad) > 3
    assert contamination(df.limit(0), bench).count() == 0
    assert [r.n_hit for r in contamination(df, bench.limit(0)).collect()] == [0] * len(docs)


def test_no_python_on_the_main_path(spark):
    docs, items = rows(False)
    plan = contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
