import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from catalith.llm import sentencepiece_lattice as m
from catalith.llm.queries import op1_sentencepiece

TEXTS = ["", " ", "  a  b\n c \n\n  ä<s>日本 😀 end.", "Hello, world. It's 3.14, e.g. this... ok,", "x" * 300, "the " * 30, "▁mark ▁▁ two", "\t tab\x01", "a,b.c,", "ÀÉ. ñ, ß.", "www.example.com/path?q=1&r=2", "    deep indent\n\tcode();\n", "\n", ".", "thonly hetion ererst"]


def run(spark, rows, path=None):
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, ids int").repartition(2)
    return m.encode(df, path)


def test_same_ids_as_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=m.model_file())
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (99, None), (3, TEXTS[3])]
    out = m.decode(run(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {i: t for i, t in rows}
    for r in out:
        t = by[r.doc_id]
        assert r.ids == (None if t is None else sp.encode(t))
        assert r.decoded == (None if t is None else t.replace("▁", " ")) and r.round_trip in (None if t is None else True, True)


def test_viterbi_of_a_unigram_model(spark, tmp_path):
    model = pb.ModelProto()
    with open(m.model_file(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.type == 1:
            p.score = max(p.score, -40000.0) / 1000 - len(p.piece) % 3 - p.score % 7 / 100
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["the house and the thonly hetion", "Hello world", "internationalisation", "mixed words of several kinds"]
    got = {r.doc_id: r.ids for r in run(spark, list(enumerate(texts)), str(path)).collect()}
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(m, "CHUNK_WORDS", 3)
    sp = sentencepiece.SentencePieceProcessor(model_file=m.model_file())
    rows = [(i, f"word{i} of text {i % 5}, and.") for i in range(40)]
    assert {r.doc_id: r.ids for r in run(spark, rows).collect()} == {i: sp.encode(t) for i, t in rows}


def test_empty_table(spark):
    assert run(spark, []).collect() == []


def test_whole_table(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=m.model_file())
    out = {r.doc_id: r for r in op1_sentencepiece(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(out) == len(docs) and all(out[d.doc_id].ids == sp.encode(d.text) and out[d.doc_id].round_trip for d in docs)


def test_hot_and_long_segments(spark, monkeypatch):
    """Segments that fit one mask, an array, or neither; hot, rare, and hot ones beyond the table's bound."""
    sp = sentencepiece.SentencePieceProcessor(model_file=m.model_file())
    long = [("ab" * 90)[:n] + "the" * k for n, k in ((58, 1), (60, 1), (61, 3), (120, 5), (150, 60))]
    texts = [f"the and then {'rare' * (i % 3)}{i} {long[i % 5]} 日本   {'e' * (i * 9)}" for i in range(30)] + ["the end, the end. " * 20] * 3
    for most in (400_000, 5, 0):
        monkeypatch.setattr(m, "HOT_SEGMENTS", most)
        assert {r.doc_id: r.ids for r in run(spark, list(enumerate(texts))).collect()} == {i: sp.encode(t) for i, t in enumerate(texts)}


def test_segments_are_cut_where_no_piece_holds_both_characters():
    pieces = m._pieces(m.model_file())
    pairs = {p[i : i + 2] for p, *_ in pieces.rows for i in range(len(p) - 1)}
    texts = [*TEXTS, "", "", "日本 é́ 😀😀", "▁", "\n\n a", "ß" * 3]
    segments, ends = pieces.segments(m.pa.array(texts))
    for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        whole = m.MARK + t.replace(" ", m.MARK) if t else ""
        cuts = [i for i in range(1, len(whole)) if whole[i - 1 : i + 1] not in pairs]
        assert segments[a:b].to_pylist() == ([whole[i:j] for i, j in zip([0, *cuts], [*cuts, None], strict=True)] if t else [])
    part = m.pa.array(["cut off", *texts, "cut off"])[1:-1]
    assert pieces.segments(part)[0].equals(segments) and list(pieces.segments(part)[1]) == list(ends)


def test_codes_of_a_chunk():
    """A rare segment has one code in its chunk, parts or not; characters in no piece are their bytes."""
    pieces = m._pieces(m.model_file())
    codes = m._Codes(m.pa.array(["▁the", "▁and"]), pieces)
    lone = "\U00010348"
    assert lone not in pieces.single
    first, null, last = codes.of(m.pa.array(["the rarest and", None, f"rarest\n{lone}"]))
    assert first[0] == 256 and first[-1] == 257 and len(null) == 0
    assert list(last[-4:]) == list(lone.encode()) and last[0] == first[1] >= 258
    again = codes.of(m.pa.array(["rarest", "x" * 0, "e" * 300]))
    assert again[0][0] == first[1] and len(codes.rare) == len(set(codes.rare.to_pylist()))
    codes.next_chunk()
    assert len(codes.rare) == len(codes.long) == 0
