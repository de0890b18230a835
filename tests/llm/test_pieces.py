import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tablesift.llm import pieces
from tablesift.llm.pieces import MARK, chunks, decode, default_model, encode, processor

SCHEMA = "doc_id long, text string, ids string, chunk string, own string, key string"


def texts():
    r = random.Random(3)
    bits = ["the", "word", "zażółć", "漢字", "😀", " ", "  ", "     ", "\n", "\t", MARK, MARK + " ", "<s>", "</s>", "<0x0A>", "<unk>", "\0", "x" * 40, "1234567", "http://a.b/c?d=e", " ", "　", "ﬁ", "é"]
    out = ["".join(r.choice(bits) for _ in range(r.choice([1, 2, 5, 30, 200]))) for _ in range(150)]
    return [*out, None, "", " ", "  ", " a", "a ", "\n", MARK, MARK + "a", " " * 60, "same words again " * 400, "b" * 3000, " ".join(f"w{i}" for i in range(3000))]


@pytest.mark.parametrize(("frequent", "held"), [(0, 0), (7, 20), (0, 10**6), (100_000, 200_000)])
def test_ids_and_texts_are_the_librarys(spark, frequent, held):
    library = processor(default_model())
    data = [(i, t, "", "", "", "") for i, t in enumerate(texts())] + [(None, "a null id", "", "", "", "")] * 3 + [(4, "an id twice", "", "", "", ""), (4, "an id  twice", "", "", "", "")]
    got = decode(encode(spark.createDataFrame(data, SCHEMA).repartition(5), frequent=frequent, held=held)).collect()
    want = [(d, ids := library.encode(t or ""), library.decode(ids)) for d, t, *_ in data]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_stretches(spark, monkeypatch):
    library = processor(default_model())
    monkeypatch.setattr(pieces, "STRETCH", 3)
    for t in texts():
        assert "".join(MARK + c for part in chunks(t) for c in part) == (MARK + t.replace(" ", MARK) if t else "")
        ids = library.encode(t or "")
        assert [i for part in chunks(t) for c in part for i in pieces.segment(library, c)] == ids
        marked = np.array([library.id_to_piece(i).startswith(MARK) for i in range(library.get_piece_size())])
        assert pieces._decoded(library, marked, np.array(ids, dtype=int)) == library.decode(ids)


def test_each_frequent_chunk_is_counted_and_segmented_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, "to be or not to be " + "q" * (i % 3)) for i in range(500)], "doc_id long, text string")
    got = {r.chunk: r.n for r in pieces.chunk_table(df.repartition(6), default_model()).collect()}
    assert [sorted(r.chunk for r in pieces.chunk_table(df, default_model(), n).collect()) for n in (0, 2, 3, 4)] == [[], ["be", "to"], ["be", "to"], ["be", "not", "or", "to"]]
    assert got == {"to": 1000, "be": 1000, "or": 500, "not": 500, "": 167, "q": 167, "qq": 166}
    monkeypatch.setattr(pieces, "HELD", 2)  # counts of a task come in several parts, and add up
    batches = [pa.RecordBatch.from_arrays([pa.array(["a a b c a", None, "b d"])], names=["text"])] * 2
    parts, total = 0, Counter()
    for out in pieces._counted(iter(batches)):
        parts += 1
        total.update(dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist())))
    assert parts > 1 and total == {"a": 6, "b": 4, "c": 2, "d": 2}


def test_a_model_whose_pieces_reach_over_a_marker_is_refused():
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(default_model())
    model.pieces.add(piece=f"of{MARK}the", score=-1e6)
    with pytest.raises(ValueError, match="marker"):
        processor(model.SerializeToString())


def test_the_query_and_an_empty_table(spark, tmp_path):
    library = processor(default_model())
    data = list(enumerate(texts()[-60:]))
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in pieces.op12_pieces(spark, str(tmp_path)).collect()}
    for i, t in data:
        ids = library.encode(t or "")
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    empty = decode(encode(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == [] and empty.columns == ["doc_id", "ids", "text"]
