"""Queries over documents that have no SQL, by brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from catalith.operators import documents as D
from catalith.operators.documents import all_positions
from catalith.plans.documents import quantities


def test_quantities_of_whole_texts(spark, tmp_path):
    rng, units, expected, rows = random.Random(8), ["V", "mm", "°C", "inches", "percent", "kg/m", ""], defaultdict(list), []
    for i in range(40):
        text = "a text without a number. " * (i % 7)
        for _ in range(i % 11):
            number, unit = rng.choice(["5", "12.5", "0,25", "-7", "1000"]), rng.choice(units)
            expected[unit or None].append(float(number.replace(",", ".")))
            text += f"{rng.choice(['', '<= ', '≥'])}{number}{rng.choice(['', ' '])}{unit}; " + "other words, some more; " * rng.randrange(9)
        rows.append((i, text))
    spark.createDataFrame([*rows, (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.unit: (r.n, r.largest) for r in quantities(spark, str(tmp_path)).collect()}
    assert got == {u: (len(x), max(x)) for u, x in expected.items()} and len(got) == len(units)


def test_all_positions(spark):
    texts = ["", None, "anan", "ananan anan", "xanananx", "aaaa", "日anan😀anan", "(a.b\\Eanan"]
    for needle in ("anan", "aa", ".", "\\E", "(a", "n", "😀"):
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", all_positions(F.col("text"), needle).alias("at")).collect()
        assert all(r.at == (None if r.text is None else [i + 1 for i in range(len(r.text)) if r.text.startswith(needle, i)]) for r in rows)


def test_quotes_of_any_length(spark, monkeypatch):
    """Short and long quotes, few and many: every text that holds a quote is found, at its first place."""
    from catalith.operators import documents as D

    texts = [(1, "one two three four five six seven"), (2, "xone twos"), (3, "three four"), (4, ""), (5, None), (6, "a b c d a b c"), (7, "aab cc"), (8, "six seven one two three"), (9, "two  three")]
    quotes = [(i, q) for i, q in enumerate(["one two three four five six", "two three four five", "wo three fou", "one two", "e", "a b", "ab c", "three", "a b c", "", None, "two  three", "seven one", "zz", "ne tw"])]
    docs, asked = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(quotes, "q int, quote string")
    want = sorted((d, q, t.find(s) + 1) for d, t in texts for q, s in quotes if t and s and s in t)
    for most in (1_000, 0):
        monkeypatch.setattr(D, "BROADCAST_QUOTES", most)
        got = sorted((r.doc_id, r.q, r.at) for r in D.locate_quotes(docs, asked, "text", "quote", "doc_id", "q").collect())
        assert got == want
    assert D.locate_quotes(docs, asked.limit(0), "text", "quote", "doc_id", "q").count() == 0


def test_phrases_that_share_all_their_words_meet_queries_as_one_set(spark):
    """400 copies of two sets of words on both sides: pairs are formed of sets, and the smallest ids of the best sets are found."""
    phrases = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["b", "a", "c"]) for i in range(400)], "id long, words array<string>")
    found = D.phrase_search(phrases, phrases.where("id < 40"), 3)
    out = sorted(map(tuple, found.select("query_id", "position", "phrase_id").collect()))
    assert out == sorted((q, n + 1, 2 * n + q % 2) for q in range(40) for n in range(3))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join Inner, (word" in line)
    below = [line for line in lines[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > lines[at].index("Join")]
    assert below and not any("phrase_id#" in line or "query_id#" in line for line in below)
