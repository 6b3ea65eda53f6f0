"""Line deduplication by a suffix array over line-ID sequences, with DataFrame functions only.

A line's ID is the hash of its text, so it needs no exchange. Only lines that occur
more than once can lie in a repeated run; the suffixes of stretches of such lines are
ranked by distributed prefix doubling: the distinct pairs of ranks of the 2**j lines
at a place and the 2**j lines after them are sorted over all partitions, and a pair's
place in that order is the rank of those 2**(j+1) lines. So a rank orders suffixes by
their first lines, and suffixes that share n lines, an interval of the suffix array whose
longest common prefix is n or more, are those with the same ranks for the two powers of
two that cover the n lines. Pairs are made distinct before they are sorted, so a very
common run is one row there.

A run of lines is repeated if it has MIN_WORDS words or more and is found earlier,
in the order of doc_id (nulls last) and line, without overlapping that first place.
Every line of a repeated run is deleted, so maximal runs go whole: it is enough to
look at the shortest run from each line forward, and back, that has the words, since
these cover every longer one.

Defined results: a null text stays null and has no lines; an empty text is one empty
line. A text all of whose lines go becomes empty. Repeated rows are documents of
their own, of which the first stays. The first copy is never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.llm.common import numbered, settle

MIN_WORDS = 50
#: Changed documents whose runs are sent to all executors at most; beyond it they are joined by exchange.
BROADCAST_DOCS = 100_000
#: Ranks of one round (24 bytes each), and lines found more than once (8), that are sent to all executors at most; beyond it they are joined by exchange.
BROADCAST_RANKS = 20_000


def _lines(rows: DataFrame, min_words: int) -> DataFrame:
    """(rid, doc_id, ln, h, w): words are counted up to min_words, as more makes no difference."""
    line = F.col("line")
    rows = rows.where("text IS NOT NULL").select("rid", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ln", "line"))
    return rows.select("rid", "doc_id", "ln", F.xxhash64(line).alias("h"), F.least(F.regexp_count(line, F.lit("[^ \\t-\\r]+")), F.lit(min_words)).cast("long").alias("w"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Lines found more than once, numbered by stretch of neighbours with min_words words at least, and their running sums."""
    often = settle(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "often")
    if often.count() <= BROADCAST_RANKS:
        often = F.broadcast(often)
    doc = Window.partitionBy("rid").orderBy("ln")
    rows = lines.join(often, "h", "left_semi").withColumn("new", (F.col("ln") - F.lag("ln", 1, -2).over(doc) > 1).cast("int"))
    rows = rows.withColumn("seg", F.sum("new").over(doc)).drop("new")
    seg = Window.partitionBy("rid", "seg")
    rows = rows.withColumns({"cum": F.sum("w").over(seg.orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("w").over(seg), "lo": F.min("ln").over(seg), "hi": F.max("ln").over(seg)})
    return rows.where(F.col("total") >= min_words)


def _shortest_runs(rows: DataFrame, min_words: int) -> DataFrame:
    """Adds `end` of the shortest run from the line forward and `start` of the one back to it; null where the words run out."""
    seg = Window.partitionBy("rid", "seg")
    rows = rows.withColumn("before", F.col("cum") - F.col("w"))
    after = F.min("ln").over(seg.orderBy("before").rangeBetween(min_words, 2 * min_words)) - 1
    past = F.max("ln").over(seg.orderBy("cum").rangeBetween(-2 * min_words, -min_words)) + 1
    return rows.withColumns({
        "end": F.coalesce(after, F.when(F.col("total") - F.col("before") >= min_words, F.col("hi"))),
        "start": F.coalesce(past, F.when(F.col("cum") >= min_words, F.col("lo"))),
    })


def _levels(n: int) -> int:
    return max(0, n.bit_length() - 1)


def _ranked(rows: DataFrame, longest: int) -> DataFrame:
    """rows with r0, r1, ...: the rank of the 1, 2, 4, ... lines from each line on, as far as runs go; null where a stretch has too few."""
    stretch = Window.partitionBy("rid", "seg").orderBy("ln")
    rows = rows.withColumn("r0", F.col("h"))
    for j in range(_levels(longest)):
        pair = [f"r{j}", "then"]
        rows = rows.withColumn("then", F.lead(f"r{j}", 1 << j).over(stretch))
        ranks = rows.where("then IS NOT NULL").select(*pair).distinct().orderBy(*pair)
        ranks = settle(ranks.withColumn(f"r{j + 1}", F.monotonically_increasing_id()), "ranks")  # rises with the order of the sort
        if ranks.count() <= BROADCAST_RANKS:
            ranks = F.broadcast(ranks)
        rows = settle(rows.join(ranks, pair, "left").drop("then"), "suffixes")
    return rows


def _pick(levels: int, level: Column, at: Column) -> Column:
    """The rank of a level at a place of the stretch."""
    place = F.get(F.col("places"), at)
    out = place["r0"]
    for j in range(1, levels):
        out = F.when(level == j, place[f"r{j}"]).otherwise(out)
    return out


def _ranked_runs(rows: DataFrame, longest: int) -> DataFrame:
    """(rid, doc_id, first line a, lines n, left, right): runs with the ranks of the powers of two that cover them."""
    runs = F.flatten(F.collect_list(F.filter(F.array(
        F.when(F.col("end").isNotNull(), F.struct(F.col("ln").alias("a"), (F.col("end") - F.col("ln") + 1).alias("n"))),
        F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("a"), (F.col("ln") - F.col("start") + 1).alias("n"))),
    ), lambda x: x.isNotNull())))
    levels = _levels(longest) + 1
    places = F.sort_array(F.collect_list(F.struct("ln", *[f"r{j}" for j in range(levels)])))
    packed = _ranked(rows, longest).groupBy("rid", "doc_id", "seg").agg(places.alias("places"), F.array_distinct(runs).alias("runs"), F.min("ln").alias("lo"))

    def ranked(run: Column) -> Column:
        level, at = F.floor(F.log2(run["n"].cast("double") + 0.5)).cast("int"), run["a"] - F.col("lo")
        power = F.element_at(F.array(*[F.lit(1 << j) for j in range(levels)]), level + 1)
        return F.struct(run["a"].alias("a"), run["n"].alias("n"), _pick(levels, level, at).alias("left"), _pick(levels, level, at + run["n"] - power).alias("right"))

    return packed.select("rid", "doc_id", F.explode(F.transform("runs", ranked)).alias("x")).select("rid", "doc_id", "x.*")


def _later_copies(runs: DataFrame) -> DataFrame:
    """(rid, a, b): runs that are found earlier, clear of that place."""
    place = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("rid"), F.col("a"))
    keys = ["left", "right", "n"]
    firsts = runs.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    first = F.col("first")
    clear = (first["rid"] != F.col("rid")) | (first["a"] + F.col("n") <= F.col("a"))
    return runs.join(firsts, keys).where(clear).select("rid", "a", (F.col("a") + F.col("n") - 1).alias("b")).distinct()


def _maximal(copies: DataFrame) -> DataFrame:
    """(rid, runs, removed): the copies of a document joined to maximal runs, in order."""
    doc = Window.partitionBy("rid").orderBy("a", "b")
    reach = F.max("b").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    rows = copies.withColumn("new", F.coalesce((F.col("a") > reach + 1).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(doc)).groupBy("rid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return rows.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"), F.sum(F.col("b") - F.col("a") + 1).alias("removed"))


def _without(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, joined again."""
    head = F.transform(runs, lambda r, i: F.slice(lines, F.coalesce(F.get(runs, i - 1)["b"] + 2, F.lit(1)), r["a"] - F.coalesce(F.get(runs, i - 1)["b"] + 1, F.lit(0))))
    last = F.element_at(runs, -1)["b"] + 1
    tail = F.slice(lines, last + 1, F.size(lines) - last)
    return F.array_join(F.flatten(F.concat(head, F.array(tail))), "\n")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cleared of later copies, and n_lines and n_removed (columns of docs by these names are replaced)."""
    plain = docs.drop("n_lines", "n_removed").withColumn("text", F.col("text").cast("string"))
    rows = numbered(plain)
    slim = rows.select("rid", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    runs = settle(_shortest_runs(_stretches(settle(_lines(slim, min_words), "lines"), min_words), min_words), "runs")
    longest = runs.agg(F.max(F.greatest(F.col("end") - F.col("ln"), F.col("ln") - F.col("start")) + 1)).first()[0] or 1
    marks = settle(_maximal(_later_copies(_ranked_runs(runs, longest))), "marks")
    if marks.count() <= BROADCAST_DOCS:
        marks = F.broadcast(marks)
    lines = F.split(F.col("doc.text"), "\n", -1)
    joined = rows.join(marks, "rid", "left")
    text = F.when(F.col("runs").isNull(), F.col("doc.text")).otherwise(_without(lines, F.col("runs")))
    columns = [text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in plain.columns]
    n_lines = F.when(F.col("doc.text").isNull(), F.lit(0)).otherwise(F.length("doc.text") - F.length(F.replace(F.col("doc.text"), F.lit("\n"), F.lit(""))) + 1)
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"))
