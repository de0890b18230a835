import hashlib
import random
import re

import numpy as np

from tablesift.llm import infill
from tablesift.llm.infill import ROW, automaton, cuts, fill_in_middle, restored

SCHEMA = "doc_id long, text string, n string, form string, output string"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    x, y, z = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 50:
        return len(units), "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return len(units), "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


def texts():
    r = random.Random(5)
    bits = ["a", "\n", "é", "漢", "😀", "<", "<P", "<S", "P>", ">", "word ", "\r\n", "<<M", "\0", "‏"]
    out = ["".join(r.choice(bits) for _ in range(r.choice([0, 1, 5, 60, 700, 3000]))) for _ in range(120)]
    for k in range(ROW - 4, ROW + 4):  # a sentinel, a code point and a line's end across the border of two rows
        out += ["x" * k + "<P>" + "y" * 50, "x" * k + "😀\n" + "é" * 400, "x" * k + "\n", "x" * k + "<P\n>"]
    return [*out, None, "", "\n", "\n\n\n", "no end", "<M>", "a<S", "x\n" * 5000, "é" * 300_000, "line of words\n" * 20_000 + "<S>"]


def test_against_brute_force(spark):
    data = [(i, t, "", "", "") for i, t in enumerate(texts())] + [(None, "a\nb\nc\n", "", "", ""), (5, "a\nb", "", "", ""), (5, "a\nb", "", "", "")]
    df = spark.createDataFrame(data, SCHEMA)
    done = fill_in_middle(df)
    got = done.select("*", restored(done.output, done.form).alias("text")).collect()
    assert len(got) == len(data)
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in got))) == sorted(map(repr, ((d, *brute(d, t), t or "") for d, t, *_ in data)))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_every_cut_of_a_text_is_found():
    dfa = automaton()
    text = ("é\n" * 300 + "漢字 and a long line without an end " * 60 + "\n" + "x" * 600).encode()
    ends = [m.end() for m in re.finditer(rb"[^\n]*\n|[^\n]+", text)]
    n, marked, at, point = cuts(dfa, [text, b"", text], lambda n: np.minimum(np.arange(400)[None, :], n[:, None]))
    assert n.tolist() == [len(ends), 0, len(ends)] and not marked.any()
    for k in range(400):
        where = ([0, *ends])[min(k, len(ends))]
        assert at[0, k] == at[2, k] == where and point[0, k] == point[2, k] == len(text[:where].decode()) and at[1, k] == 0


def test_the_automaton_forgets_its_start():
    dfa, r = automaton(("<begin>", "<end>")), random.Random(1)

    def run(data):
        state = 0
        for byte in data:
            state = int(dfa.next[state * 256 + byte])
        return state

    data = "".join(r.choice(["<begin", "<", "e", "nd", "end>", "é", "漢", "😀", "\n"]) for _ in range(900)).encode()
    assert len({run(data[:i]) for i in range(len(data))}) == len(dfa.next) // 256  # every state is met
    for i in range(dfa.warm, len(data)):
        assert run(data[:i]) == run(data[i - dfa.warm : i])
    data = ("<begin" * 3 + "<begin>é<en<end>").encode()
    _, marked, _, _ = cuts(dfa, [data, data[:-9], b"<begin"], lambda n: np.zeros((3, 1), dtype=np.int64))
    assert marked.tolist() == [True, True, False]


def test_the_query_and_an_empty_table(spark, tmp_path):
    data = list(enumerate(texts()[:60]))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in infill.op13_infill(spark, str(tmp_path)).collect()}
    for i, t in data:
        n, form, x, y, output = brute(i, t)
        assert tuple(got[i]) == (i, n, form, x, y, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.form for r in fill_in_middle(spark.createDataFrame([(1, "a\nb", "", "", "")], SCHEMA), rate=0).collect()} == {"plain"}
