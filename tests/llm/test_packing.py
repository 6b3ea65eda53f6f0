import itertools
import struct
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from catalith.llm import packing as m
from catalith.llm.queries import op6_packing


def ids_of(texts):
    t = Tokenizer.from_file(m.tokenizer_file())
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def check(docs, rows, window, padding=None):
    """docs: (doc_id, text) with different ids."""
    ids = dict(zip([d for d, _ in docs], ids_of([t or "" for _, t in docs]), strict=True))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, total in [(pieces[d], len(i)) for d, i in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= window if total is None else at == total
    pad = sum(window - n for n in (sum(x[1] for x in s) for s in sequences.values()) if n & (n - 1))
    assert pad <= (window if padding is None else padding)


def test_whole_table(spark, small):
    rows = op6_packing(spark, small).collect()
    check([(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()], rows, 2048)


@pytest.mark.parametrize("window", [8, 32])
def test_small_windows(spark, window):
    docs = [(i, " ".join(f"w{j}" for j in range(i % 23))) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    check(docs, m.pack(df, window=window).collect(), window)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "It's DON'T    é <|endoftext|>x 　 ΑΣ 12 34"), (5, "x" * 30_000), (6, "long words " * 20_000), (None, "a")]
    rows = m.pack(spark.createDataFrame([(*d, 1, "z") for d in docs], "doc_id long, text string, part int, offset string")).collect()
    check(docs, rows, 2048)
    same = m.pack(spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string")).collect()
    assert sorted(r.length for r in same) == [3] * 5
    assert m.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_forgetting_words(monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 5)
    texts = ["a b c d e f g", "c d x y z", "a " + "q" * 80, "a b"]
    t = m.WordTokenizer(m.tokenizer_file())
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for x in texts for b in t.encode([x])] == [i[:-1] for i in ids_of(texts)]


def test_long_words_that_are_another_and_one_byte_more():
    t = m.WordTokenizer(m.tokenizer_file())
    words = [f"https://example.com/{'path/' * 12}{i}?page=1" for i in range(40)]
    for texts in ([w + end for w in words for end in ("", "2", ".")], [w + end for w in words for end in (".", "2", "")], ["".join(w) for i in range(40) for w in (("a" * 70 + str(i), "."), ("a" * 70 + str(i),))]):
        got = t.encode([" ".join(texts)])
        assert list(struct.unpack(f"<{len(got[0]) // 4}I", got[0])) == ids_of([" ".join(texts)])[0][:-1]
        assert max(map(len, t.known)) <= m.LONG_WORD
    for a, b in itertools.permutations(("x" * 65, "x" * 66, "x" * 67), 2):
        assert len(t.encode([f"{a} {b}"])) == 1 and max(map(len, t.known)) <= m.LONG_WORD


def test_punctuation_at_the_end_is_a_word_of_its_own():
    t = m.WordTokenizer(m.tokenizer_file())
    packed, pack = [], t._pack
    t._pack = lambda words: packed.extend(words) or pack(words)
    text = "alpha alpha!! alpha, alpha&&& (alpha) été. été*** 3.5% 3.5"
    assert list(struct.unpack(f"<{len(b := t.encode([text])[0]) // 4}I", b)) == ids_of([text])[0][:-1]
    assert sorted(w.decode() for w in packed) == sorted(["alpha", "!!", ",", "&&&", "(alpha", ")", "été", ".", "***", "3.5", "%"])
    t.encode(["beta!! alpha* *"])
    assert [w.decode() for w in packed[11:]] == ["beta", "*"] and len(set(t.known)) == len(t.known)


def test_ends_that_are_no_words_of_their_own():
    ends = ["", ".", "!!", "'s", "'s.", "'", ",'", ">", "|>", "...", ">!", "\u0301.", "$$$"]
    cores = ["", "x", "İ", "é", "e\u0301", "×", "÷", "ß", "½", "٣", "ΑΣ", "日本", "don't", "x'", "<|endoftext|>", "<|endoftext", "a<|endoftext|>b", "Ÿ", "K", "a>", ".x", "3"]
    texts = [" ".join(c + e for c in cores for e in ends)] + [f"{c}{e}" for c in cores for e in ends] + ["", " ", None]
    t = m.WordTokenizer(m.tokenizer_file())
    want = [i[:-1] for i in ids_of([x or "" for x in texts])]
    for _ in range(2):
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in t.encode([x or "" for x in texts])] == want
    assert t.encode(["", " \n"]) == [b"", b""]


def test_no_more_words_are_remembered_than_said():
    t = m.WordTokenizer(m.tokenizer_file(), remembered=20)
    for i in range(30):
        text = " ".join(f"w{'abcdefghij'[j % 10]}{'x' * (j // 10)}" for j in range(i, 2 * i))
        b = t.encode([text])[0]
        assert list(struct.unpack(f"<{len(b) // 4}I", b)) == ids_of([text])[0][:-1] and len(t.known) <= 20
