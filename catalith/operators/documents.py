"""Operators over document texts: stores by content, quotes, lines, phrases, neighbours, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.functions import hashing as H
from catalith.functions.text import excerpt


def by_content(docs: DataFrame) -> DataFrame:
    """(sha, doc_id, copies): the smallest doc_id of each text. Only digests are shuffled, never texts."""
    return docs.select("doc_id", H.sha256("text").alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def integrity(pages: DataFrame, text: str, recorded: str) -> DataFrame:
    """Adds status: OK, HASH_DRIFT or MISSING_HASH."""
    own = H.sha256(text)
    return pages.withColumn("status", F.when(F.col(recorded).isNull(), "MISSING_HASH").when(own != F.col(recorded), "HASH_DRIFT").otherwise("OK"))


#: Quotes of one or two words that are sent to all executors at most; more are joined by their first letters.
BROADCAST_QUOTES = 1_000
#: Letters of a short quote that it is joined by.
LETTERS = 4


def _by_inner_words(docs: DataFrame, quotes: DataFrame, text: str, quote: str, id_col: str, quote_id: str) -> DataFrame:
    """(id_col, quote_id) of quotes of three words or more that a text may hold: the text has up to three of the quote's inner words in a row."""
    words, w = F.split(F.col(quote), " "), F.col("_w")
    key = lambda of, at, n: F.xxhash64(*[F.get(of, at + j) for j in range(n)])
    size = F.size(words) - 2
    keyed = quotes.select(quote_id, F.least(size, F.lit(3)).alias("_n"), F.when(size == 1, key(words, F.lit(1), 1)).when(size == 2, key(words, F.lit(1), 2)).otherwise(key(words, F.lit(1), 3)).alias("_k"))
    lengths = sorted(r["_n"] for r in keyed.select("_n").distinct().collect())  # 1, 2 or 3
    split = docs.select(id_col, F.split(F.col(text), " ").alias("_w"))
    runs = lambda n: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: key(w, i, n)))
    all_ = None
    for n in lengths:
        found = split.where(F.size("_w") >= n).select(id_col, F.explode(runs(n)).alias("_k")).join(keyed.where(F.col("_n") == n).select(quote_id, "_k"), "_k").select(id_col, quote_id)
        all_ = found if all_ is None else all_.unionByName(found)
    if all_ is None:
        return docs.sparkSession.createDataFrame([], f"{id_col} {dict(docs.dtypes)[id_col]}, {quote_id} {dict(quotes.dtypes)[quote_id]}")
    return all_.distinct()


def _by_letters(docs: DataFrame, quotes: DataFrame, text: str, quote: str, id_col: str, quote_id: str) -> DataFrame:
    """(id_col, quote_id) of short quotes whose first letters a text holds."""
    keyed = quotes.select(quote_id, F.substring(quote, 1, LETTERS).alias("_g"))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n)))
    out = None
    for n in range(1, LETTERS + 1):
        own = docs.where(F.length(text) >= n).select(id_col, F.explode(F.array_distinct(grams(n))).alias("_g")).join(keyed.where(F.length("_g") == n), "_g").select(id_col, quote_id)
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def locate_quotes(docs: DataFrame, quotes: DataFrame, text: str, quote: str, id_col: str, quote_id: str) -> DataFrame:
    """Pairs of a text and a quote that it holds, with the first place (1-based) and what surrounds it.

    All but the first and last of a quote's space-separated words are whole words of any text that
    holds it, so quotes of three words or more meet texts by an equi-join on the hash of up to
    three of them. Shorter quotes are compared with every text if they are few, else they meet texts
    by their first letters. Only ids and hashes are exploded; texts join the pairs that are left. Ids
    are unique; a null or empty quote is in no text.
    """
    quotes = quotes.where(F.length(quote) > 0)
    keyable = F.size(F.split(F.col(quote), " ")) >= 3
    pairs, short = _by_inner_words(docs, quotes.where(keyable), text, quote, id_col, quote_id), quotes.where(~keyable)
    few = short.limit(BROADCAST_QUOTES + 1).count() <= BROADCAST_QUOTES
    if not few:
        pairs = pairs.unionByName(_by_letters(docs, short, text, quote, id_col, quote_id))
    found = docs.join(pairs, id_col).join(quotes, quote_id).where(F.col(text).contains(F.col(quote)))
    if few:
        found = found.unionByName(docs.join(F.broadcast(short), F.col(text).contains(F.col(quote))))
    found = found.withColumn("at", F.position(F.col(quote), F.col(text)))
    return found.withColumn("context", excerpt(text, "at", 60, F.length(quote)))


def lines(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(id_col, ln, start, line): lines with the 0-based offset of each."""
    exploded = docs.select(id_col, F.posexplode(F.split(F.col(text), "\n", -1)).alias("ln", "line"))
    before = Window.partitionBy(id_col).orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    return exploded.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))


def neighbours(rows: DataFrame, by: list[str], order: str, flag: Column, reach: int) -> DataFrame:
    """Rows within reach of a flagged row of the same group."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn("near", F.max(flag.cast("int")).over(frame)).where("near = 1").drop("near")


def all_positions(text: Column, needle: str) -> Column:
    """Every 1-based place of needle, overlapping ones too; null for a null text, none for an empty needle.

    The text is cut before each place, so that each part but the first starts at one.
    """
    if not needle:
        return F.when(text.isNotNull(), F.array().cast("array<int>"))
    quoted = needle.replace("\\E", "\\E\\\\E\\Q")
    parts = F.split(text, f"(?=\\Q{quoted}\\E)", -1)
    state = lambda at, places: F.struct(at.alias("at"), places.alias("places"))
    add = lambda acc, part: state(acc["at"] + F.length(part), F.when((acc["at"] > 1) | text.startswith(needle), F.concat(acc["places"], F.array(acc["at"]))).otherwise(acc["places"]))
    return F.aggregate(parts, state(F.lit(1), F.array().cast("array<int>")), add, lambda acc: acc["places"])


def phrase_search(phrases: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, phrase_id, score, position): the best phrases for each query by shared tokens.

    Both sides have (id, words). Score: Jaccard plus a quarter of the share of the phrase's
    tokens that the query has. The score is one of sets of tokens, so distinct sets meet, in an equi-join on tokens, and
    not every phrase and query that has them; of phrases with one set only the top by id can be among the best.
    """
    of = lambda rows, name: rows.select(F.col("id").alias(f"{name}_id"), F.array_sort(F.array_distinct("words")).alias(f"{name}_words"))
    p, q = of(phrases, "phrase"), of(queries, "query")
    first = p.withColumn("n", F.row_number().over(Window.partitionBy("phrase_words").orderBy("phrase_id"))).where(F.col("n") <= top).select("phrase_words", "phrase_id")
    pw, qw = p.select("phrase_words").distinct(), q.select("query_words").distinct()
    both = (
        pw.select("phrase_words", F.explode("phrase_words").alias("word")).join(qw.select("query_words", F.explode("query_words").alias("word")), "word")
        .groupBy("query_words", "phrase_words").agg(F.count(F.lit(1)).alias("both"))
    )
    np, nq = F.size("phrase_words"), F.size("query_words")
    scored = both.withColumn("score", F.round(F.col("both") / (np + nq - F.col("both")) + 0.25 * F.col("both") / np, 9))
    sets = Window.partitionBy("query_words").orderBy(F.col("score").desc())
    near = scored.withColumn("place", F.rank().over(sets)).where(F.col("place") <= top)  # sets with equal scores are told apart by their phrases' ids alone
    best = Window.partitionBy("query_words").orderBy(F.col("score").desc(), "phrase_id")
    found = near.join(first, "phrase_words").withColumn("position", F.row_number().over(best).cast("long")).where(F.col("position") <= top)
    return q.join(found, "query_words").select("query_id", "phrase_id", "score", "position")
