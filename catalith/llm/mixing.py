"""Mixing sources to target weights by a low-discrepancy schedule.

Sources in the order of code points, null last, weigh WEIGHTS in turn and share
the words of all documents; no source gets more than MOST times its words, and
what is over is shared again by weight. A source's documents, shuffled by a hash of
doc_id, lie end to end in a stream that is cut into blocks of BLOCK words; its quota,
the rounded target, is so many slots, each of which takes the next block, from the
front again after the last. The slots of all sources lie side by side in a line
of 2**bits places, in proportion to what they take. Van der Corput's points, which are
the places' numbers with their bits reversed, run through that line; a point in
a source's part is that source's next slot, and points beyond the last part are passed
over. So any stretch of the schedule holds the sources near their share, and each
source gets exactly its quota. Only slim rows are shuffled, and slots and documents
meet block by block, so no task gets a whole source.

Defined results: a null text has no words, and a document without words takes part
with taken 0. A null doc_id is hashed as an empty one. Rows alike in doc_id, source and
size are told apart, but which of them takes more is open. If no document has a
word, targets are 0. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import settle
from catalith.llm.running import running

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block.
BLOCK = 1_024
#: Slots that one row is exploded into.
CHUNK = 16_384
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """documents: a row each, with start in its source's stream; sources: a row each; slots: the schedule; block: words of a block."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): documents by id, source and number of words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds target to (weight, source_size): shares by weight, at most so many times the size, the rest shared again.

    A round finds the sources whose share is above their limit; their number only
    grows, and the rounds end when it stays. Three sums reach the driver.
    """
    limit = F.col("source_size") * most
    total = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    room, weight, held = total.n or 0, total.w or 1, 0
    while True:
        share = F.lit(float(room)) * F.col("weight") / F.lit(float(weight))
        over = sources.where(share > limit).agg(F.count(F.lit(1)).alias("k"), F.sum(limit).alias("n"), F.sum("weight").alias("w")).first()
        if over.k == held:
            return sources.withColumn("target", F.when(share > limit, limit.cast("double")).otherwise(share))
        room, weight, held = total.n - over.n, total.w - over.w, over.k


def sources_of(rows: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """A row for each source: (source, source_size, target, quota, blocks, slots, first_word, first_slot), settled."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    placed = running(found, [F.col("source").asc_nulls_last()], {"place": "one", "first_word": "source_size"}, "sources")
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    out = targets(weighed, most).withColumn("quota", F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * most))
    out = out.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    needs = F.expr(f"CASE WHEN source_size = 0 THEN 0L ELSE quota div source_size * blocks + (quota % source_size + {block - 1}) div {block} END")
    return running(out.withColumn("slots", needs), [F.col("place")], {"first_slot": "slots"}, "targets")


def reversed_bits(number: Column, bits: int) -> Column:
    """Van der Corput's point of a number, times 2**bits."""
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long")


def slots_of(sources: DataFrame, block: int) -> DataFrame:
    """The schedule: (slot, place, block, epoch, words), a row for each slot; slots in ascending order are the mix."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    bits = max(1, (total - 1).bit_length())
    chunks = sources.where("slots > 0").select("place", "source_size", "quota", "blocks", "slots", "first_slot", F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK}L)")).alias("chunk"))
    points = chunks.repartition("place", "chunk").withColumn("at", F.explode(F.expr(f"sequence(chunk, least(chunk + {CHUNK - 1}, slots - 1))")))
    points = points.select("place", "source_size", "quota", "blocks", "first_slot", reversed_bits(F.col("first_slot") + F.col("at"), bits).alias("slot"), F.lit(1).cast("long").alias("one"))
    ranked = running(points, [F.col("place"), F.col("slot")], {"earlier": "one"}, "slots")
    ranked = ranked.withColumn("rank", F.col("earlier") - F.col("first_slot"))
    ranked = ranked.withColumns({"epoch": F.expr("rank div blocks"), "block": F.expr("rank % blocks")})
    words = F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block, F.col("quota") - F.col("epoch") * F.col("source_size") - F.col("block") * block)
    return ranked.select("slot", "place", "block", "epoch", words.alias("words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 0) -> Mix:
    """Sources, schedule, and documents with their places in their source's stream."""
    rows = settle(sized(docs), "sized")
    sources = sources_of(rows, weights, most, block)
    known = sources.select(F.col("source").alias("known"), "place", "first_word", "source_size", "target")
    tagged = rows.join(known, F.col("source").eqNullSafe(F.col("known"))).drop("known")
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 15), 16, 10).cast("long")
    tagged = tagged.withColumns({"key": key, "words": F.col("size") * F.col("copies")})
    laid = running(tagged, [F.col("place"), F.col("key"), F.col("doc_id"), F.col("size")], {"before": "words", "rows": "copies"}, "laid")
    each = laid.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    start = F.col("before") - F.col("first_word") + F.col("copy") * F.col("size")
    documents = each.select((F.col("rows") + F.col("copy")).alias("row"), "doc_id", "source", "size", "place", "source_size", "target", start.alias("start"))
    return Mix(documents, sources, slots_of(sources, block), block)


def pieces(made: Mix) -> DataFrame:
    """What each slot takes of each document: the documents' columns, slot, epoch, first (word in the document) and taken; documents of which nothing is taken have one row with null slot."""
    b = made.block
    parts = made.documents.withColumn("block", F.explode_outer(F.expr(f"CASE WHEN size > 0 THEN sequence(start div {b}, (start + size - 1) div {b}) END")))
    met = parts.join(made.slots, ["place", "block"], "left")
    begin = F.greatest(F.col("start"), F.col("block") * b)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * b + F.col("words"))
    return met.select(*made.documents.columns, "slot", "epoch", (begin - F.col("start")).alias("first"), F.when(F.col("slot").isNotNull() & (end > begin), end - begin).otherwise(F.lit(0)).alias("taken"))


def schedule(docs: DataFrame, **settings) -> DataFrame:
    """The mix: (slot, source, doc_id, first_word, n_words), to be read in the order of slot."""
    return pieces(mix(docs, **settings)).where("taken > 0").select("slot", "source", "doc_id", F.col("first").alias("first_word"), F.col("taken").alias("n_words"))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of docs."""
    own = ("row", "doc_id", "source", "size", "source_size", "target")
    return pieces(mix(docs, **settings)).groupBy(*own).agg(F.sum("taken").alias("taken")).drop("row")
