import hashlib

import corpus_pipeline
from tablesift.llm.linededup import boilerplate, dedup_lines, without_boilerplate

SCHEMA = "doc_id long, text string, source string, n_chars long, h string, n_lines string"


def brute(rows, sites):
    def counted(line):
        return line.strip(" \t\n\v\f\r") != ""

    where = {}
    for doc, text, source, *_ in rows:
        for line in (text or "").split("\n"):
            if counted(line):
                where.setdefault(line.strip(" "), []).append((source, doc))
    cut = {line: min((d for _, d in w if d is not None), default=None) for line, w in where.items() if len({s for s, _ in w}) >= sites}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (counted(x) and x.strip(" ") in cut and cut[x.strip(" ")] != doc)]
        out.append((doc, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(map(str, out))


def rows():
    out = []
    for i in range(40):
        lines = [f"own line number {i} here", "all sites have this line", " all sites have this line ", "two words", ""]
        lines += ["half of the sites have this"] * (i % 12 < 6) + ["nine sites are too few"] * (i % 12 < 9) + ["ten sites are just enough"] * (i % 12 < 10)
        out.append((i, "\n".join(lines), f"s{i % 12}", 10, "", ""))
    long = "\n".join(f"line {i} of a long text" for i in range(20000))
    out += [(100, None, "s1", 0, "", ""), (101, "", None, 0, "", ""), (102, "all sites have this line", None, 24, "", ""), (102, "all sites have this line", None, 24, "", "")]
    out += [(103, long, "s1", 0, "", ""), (None, "all sites have this line\nx", "s2", 0, "", ""), (104, "ten sites are just enough\r\nq", "s2", 0, "", "")]
    return out


def test_against_brute_force(spark):
    data = rows()
    for sites in (6, 10, 13):
        got = dedup_lines(spark.createDataFrame(data, SCHEMA), sites)
        assert sorted(str((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect()) == brute(data, sites)


def test_far_from_the_threshold_the_sketch_decides(spark):
    data = [(i, "a line of many sites\na line of some sites" if i < 100 else "a line of many sites", f"s{i}", 0, "", "") for i in range(3000)]
    found = {r.exact: r.spread for r in boilerplate(spark.createDataFrame(data, SCHEMA), 100).collect()}
    assert found[True] == 100 and abs(found[False] - 3000) < 300


def test_emptied_documents_go_and_columns_stay(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = without_boilerplate(df)
    ids = [r.doc_id for r in kept.collect()]
    assert 102 not in ids and 101 in ids and 100 in ids and 0 in ids and kept.columns == df.columns
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.doc_id == 5)


def test_clashing_columns_stay(spark):
    names = ["key", "_KEY", "for_key", "cuts", "kept", "n_lines", "n_removed", "a b", "x.y"]
    df = spark.createDataFrame([(*r[:4], *names) for r in rows()], "doc_id long, text string, source string, n_chars long, key string, _KEY string, for_key string, cuts string, kept string, n_lines string, n_removed string, `a b` string, `x.y` string")
    kept = without_boilerplate(df)
    plain = without_boilerplate(df.select("doc_id", "text", "source", "n_chars"))
    assert kept.columns == df.columns and sorted(str(tuple(r)[:4]) for r in kept.collect()) == sorted(str(tuple(r)) for r in plain.collect())
    assert {tuple(r)[4:] for r in kept.collect()} == {tuple(names)}


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_pipeline_cuts_short_lines_and_scripts_without_spaces(spark):
    short = ["Les.", "And ornd.", "这一行在每个网站上都有", "tab\tparted\tline", "全角　空格　的行"]
    data = [(i, "\n".join([f"own {i}", *short, "", " ", "\r"]), f"s{i}", 0, "", "") for i in range(12)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(data, SCHEMA), "").collect()}
    assert got[0] == data[0][1] and all(got[i] == f"own {i}\n\n \n\r" for i in range(1, 12))
