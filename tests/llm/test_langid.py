import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from tablesift.llm import langid
from tablesift.llm.langid import code_lengths, fit, identify, train

SCHEMA = "doc_id long, text string, lang string, source string, score string, held_out string"
TEXTS = {"en": ["the cat and the hat that was there", "this is the thing", "and then the other"], "de": ["der hund und die katze", "über den fluß gehen wir", "das ist nicht gut"], "es": ["el niño está aquí con la señora", "los años que vienen"]}


def brute_bits(train_texts, text, alphabet, kept):
    """PPM by its definition, a byte at a time, without tables."""
    trees = defaultdict(Counter)
    for t in train_texts:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                trees[data[i - k : i]][data[i]] += 1

    @cache
    def prob(context, sym):
        if context is None:
            return 1 / len(alphabet)
        shorter = context[1:] if context else None
        seen = trees[context] if len(context) < 2 or context in kept else {}
        n, d = sum(seen.values()), len(seen)
        if not n:
            return prob(shorter, sym)
        if sym in seen:
            return seen[sym] / (n + d)
        return d / (n + d) * prob(shorter, sym) / sum(prob(shorter, s) for s in alphabet if s not in seen)

    data = b"\0\0\0" + text.encode()
    return -sum(math.log2(prob(data[i - 3 : i], data[i])) for i in range(3, len(data)))


def grams(texts):
    out = Counter()
    for lang, own in texts.items():
        for t in own:
            data = b"\0\0\0" + t.encode()
            out.update((lang, int.from_bytes(data[i - 3 : i + 1], "big")) for i in range(3, len(data)))
    k = list(out)
    return np.array([x[0] for x in k], dtype=object), np.array([x[1] for x in k]), np.array([out[x] for x in k])


def test_code_lengths_against_the_definition(monkeypatch):
    monkeypatch.setattr(langid, "LEAST_SEEN", 1)
    model = fit(*grams(TEXTS))
    every = [b"\0\0\0" + t.encode() for own in TEXTS.values() for t in own]
    alphabet = set(range(256))
    kept = {t[i - k : i] for t in every for i in range(3, len(t)) for k in (2, 3)}
    for text in ("the katze", "señor", "", "der die das", "xyz!", "tha", "日本 the"):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        got = code_lengths(model, data, np.array([0, len(data)]))[0]
        assert got == pytest.approx([brute_bits(TEXTS[l], text, alphabet, kept) for l in model.languages], rel=1e-4), text


def test_every_context_is_a_distribution():
    model = fit(*grams({k: v * 3 for k, v in TEXTS.items()}))
    assert model.triples.escape.shape[0] > 5 and model.pairs.escape.shape[0] > 5
    for context in (b"", b"e", b"th", b"the", b" th", b"\xc3\xbc", b"zzz", b"d \xf0", b"a\0b"):
        with_each = np.frombuffer(b"".join(context + bytes([x]) for x in range(256)), dtype=np.uint8)
        n = len(context)
        whole = code_lengths(model, with_each, np.arange(257) * (n + 1))
        before = code_lengths(model, np.frombuffer(context, dtype=np.uint8), np.array([0, n]))
        assert np.allclose(np.exp2(before - whole).sum(0), 1, atol=1e-3), context


def test_scripts_beyond_latin_keep_their_bytes():
    texts = {"zh": ["我们在这里学习中文的语言", "这是一个很好的例子"], "ru": ["это очень хороший пример", "мы учим русский язык здесь"], "ar": ["هذا مثال جيد جدا", "نحن نتعلم اللغة هنا"], **TEXTS}
    model = fit(*grams({k: v * 3 for k, v in texts.items()}))
    for lang, own in texts.items():
        for t in own:
            data = np.frombuffer(t.encode(), dtype=np.uint8)
            assert model.languages[code_lengths(model, data, np.array([0, len(data)]))[0].argmin()] == lang


def test_batches_do_not_mix_rows():
    model = fit(*grams(TEXTS))
    texts = [b"the cat", b"", b"der", b"", b"que \0 \xc3"]
    offsets = np.cumsum([0, *map(len, texts)])
    both = code_lengths(model, np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    alone = np.vstack([code_lengths(model, np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)])) for t in texts])
    assert np.allclose(both, alone)


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97


def test_lang_of_the_held_out_third_is_not_read(spark):
    rows = [(i, t, lang, "s", "", "") for i, (lang, t) in enumerate((x, t) for _ in range(9) for x in TEXTS for t in TEXTS[x])]
    false = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, s, "", "") for i, t, lang, s, *_ in rows]
    a, b = (sorted(map(str, identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, false))
    assert a == b


def test_edge_rows(spark):
    rows = [(0, "the cat and the hat", "en", None, "", ""), (2, "der hund und", "de", None, "", ""), (3, None, "en", None, "", ""), (4, "", None, None, "", ""), (5, "12 -- 34", None, None, "", ""), (None, "the", None, None, "", ""), (6, "the " * 100000, None, None, "", ""), (6, "the " * 100000, None, None, "", ""), (7, "日本", None, None, "", "")]
    got = {(r.doc_id, i): r for i, r in enumerate(identify(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect())}
    pred = [r.lang_pred for r in got.values()]
    assert [pred[i] for i in (2, 3, 4)] == ["und"] * 3 and set(pred) <= {"en", "de", "und"} and len(pred) == 9 and pred[5] == "en"
    assert identify(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.lang_pred for r in identify(spark.createDataFrame([(1, "abc", None, None, "", "")], SCHEMA)).collect()] == ["und"]


def test_few_long_texts_of_a_language_are_learned_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 64 << 10)
    ids = [i for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(ids[k], (" ".join(TEXTS[lang]) + " ") * 60_000, lang, "", "", "") for k, lang in enumerate(TEXTS)]  # one text of some 4 MB each
    assert min(len(r[1]) for r in rows) > 2_000_000
    model = train(spark.createDataFrame(rows, SCHEMA))
    assert sorted(model.languages) == sorted(TEXTS)


def test_the_sample_of_many_languages_stays_within_its_bound(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_BYTES", 1 << 20)
    taken = {}
    whole = langid.fit

    def counting(lang, gram, n):
        taken["bytes"], taken["languages"] = int(n.sum()), len(set(lang))
        return whole(lang, gram, n)

    monkeypatch.setattr(langid, "fit", counting)
    ids = [i for i in range(6100) if zlib.crc32(str(i).encode()) % 3 != 1][:4000]
    rows = [(i, f"l{k % 100:02} " * 2500, f"l{k % 100:02}", "", "", "") for k, i in enumerate(ids)]
    model = train(spark.createDataFrame(rows, SCHEMA))
    assert taken["languages"] == len(model.languages) >= 95  # pieces are drawn by hash: of 40 documents a language sends about two
    assert 0.5 * (1 << 20) < taken["bytes"] < 1.5 * (1 << 20)
