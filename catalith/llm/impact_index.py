"""Ranked lexical search on a bit-sliced impact index.

Documents are indexed in blocks of at most BLOCK_DOCS, where they lie in the order
of doc_id. For each term of a block the index has the places of the documents that
hold it, and IMPACT_BITS bitmaps over these documents: bit i of their impact
(SCALE tf) div (1000 tf + 8 m). A block is written by the task that reads its
texts, so a term that all documents hold is a row for each block and no more.

A search meets the index by term. In a block, a term's bitmaps are spread over the
block's documents and multiplied by the term's weight, and the items' terms are
summed, all by bitwise carry arithmetic on whole bitmaps. The best documents are
found from the most significant slice down: documents with the bit set stay while
they are k or more, else they are in and the rest compete on. The best k of each
block compete for an item's best k. That is exact: no list is cut and no document is
passed over.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z
lower-cased. Defined results: a null text has no terms; a document without terms counts
for nothing and is never found; an item without terms, or none that a document holds,
gives no rows. A null doc_id is the greatest. Items that repeat an item_id are ranked
on their own, each from 1. Documents that repeat a doc_id are documents of their own.
Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from catalith.llm.common import settle, slices

TOP = 10
#: Documents of a block, and occurrences of terms after which a block is closed, so that few long texts fill one.
BLOCK_DOCS = 2_048
BLOCK_TERMS = 1_000_000
#: Items that are scored together in a task.
ITEMS = 256
SCALE = 1_000_000_000
IMPACT_BITS = 20
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_TERM_SQL = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "block long, term string, df long, places binary, slices binary, doc_ids array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """In UTF-8 all characters beyond ASCII are bytes of 128 or more, and lower() changes A-Z alone."""
    return _TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())


def totals(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms with repeats)."""
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(_TERM_SQL)).cast("long")
    found = docs.select(n.alias("n")).where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    return found.docs, found.terms or 0


# --- the index


class _Block:
    """Documents of one block: codes of their terms, end to end."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.size = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        words = self.words
        self.codes.append(np.fromiter((words.setdefault(t, len(words)) for t in terms), np.int64, len(terms)))
        self.ids.append(doc_id)
        self.size += len(terms)

    def rows(self, block: int, docs: int, total: int) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        lengths = np.array([len(c) for c in self.codes], np.int64)
        keys, tf = np.unique(np.concatenate(self.codes) * BLOCK_DOCS + np.repeat(place, lengths), return_counts=True)
        codes, places = np.divmod(keys, BLOCK_DOCS)
        n = np.empty(len(order), np.int64)
        n[place] = lengths
        m = 25 + (75 * n[places] * docs) // total
        impact = (SCALE * tf) // (1000 * tf + 8 * m)
        starts = np.searchsorted(codes, np.arange(len(self.words) + 1))
        df = np.diff(starts)
        ids = pa.array([self.ids[i] for i in order], pa.int64())
        one = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids)
        none = pa.nulls(len(df), one.type)
        head = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.string()), pa.array([0]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), one], _names())
        terms = pa.array([t.decode("utf-8", "surrogatepass") for t in self.words], pa.string())
        body = pa.RecordBatch.from_arrays([pa.array(np.full(len(df), block)), terms, pa.array(df.astype(np.int64)), _binary(places.astype("<u2").tobytes(), 2 * starts), _slices(impact, codes, starts), none], _names())
        return pa.Table.from_batches([head, body]).combine_chunks().to_batches()[0]


def _names() -> list[str]:
    return [x.split()[0] for x in _INDEX.split(", ")]


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _slices(impact: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> pa.Array:
    """For each term its IMPACT_BITS bitmaps, each of whole bytes, lowest bit first."""
    size = (np.diff(starts) + 7) // 8
    ends = np.concatenate([[0], np.cumsum(size)])
    bit = (np.arange(len(codes)) - starts[codes]) + 8 * ends[codes]
    owner = np.repeat(np.arange(len(size)), size)
    to = IMPACT_BITS * ends[owner] + np.arange(ends[-1]) - ends[owner]
    out = np.zeros(IMPACT_BITS * ends[-1], np.uint8)
    for i in range(IMPACT_BITS):
        plane = np.zeros(8 * ends[-1], np.uint8)
        plane[bit] = (impact >> i) & 1
        out[to + i * size[owner]] = np.packbits(plane, bitorder="little")
    return _binary(out.tobytes(), IMPACT_BITS * ends)


def build_index(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """(index, documents with a term, all their terms). For each block a row with null term has the doc_ids in the order of their places."""
    count, total = totals(docs)

    def blocks(batches):
        at, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if terms := terms_of(text):
                    block.add(doc_id, terms)
                if len(block.ids) == BLOCK_DOCS or block.size >= BLOCK_TERMS:
                    yield block.rows(at, count, total)
                    at, block = at + 1, _Block()
        if block.ids:
            yield block.rows(at, count, total)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(blocks, _INDEX), "index"), count, total


# --- bit-sliced numbers: lists of bitmaps, lowest bit first; bit d of a bitmap belongs to document d


def add_into(total: list[int], other: list[int], shift: int = 0) -> None:
    """total += other << shift, for all documents at once."""
    total.extend([0] * (len(other) + shift - len(total)))
    carry = 0
    for i, b in enumerate(other, shift):
        a = total[i]
        either = a ^ b
        total[i] = either ^ carry
        carry = (a & b) | (either & carry)
    i = len(other) + shift
    while carry:
        if i == len(total):
            total.append(0)
        total[i], carry = total[i] ^ carry, total[i] & carry
        i += 1


def times(number: list[int], factor: int) -> list[int]:
    """number * factor, a shifted sum for each bit of the factor."""
    out: list[int] = []
    shift = 0
    while factor:
        if factor & 1:
            add_into(out, number, shift)
        factor >>= 1
        shift += 1
    return out


def top_documents(total: list[int], k: int) -> int:
    """Bitmap of the k documents with the highest sums above 0 (all, if fewer); of equal ones those in front."""
    tied = 0
    for plane in total:
        tied |= plane
    chosen = 0
    for plane in reversed(total):
        more = chosen | (tied & plane)
        n = more.bit_count()
        if n > k:
            tied &= plane
        else:
            chosen = more
            tied &= ~plane
            if n == k:
                return chosen
    while tied and chosen.bit_count() < k:
        low = tied & -tied
        chosen |= low
        tied ^= low
    return chosen


def values_at(total: list[int], chosen: int) -> list[tuple[int, int]]:
    """(document, value) of the chosen ones."""
    out = []
    while chosen:
        low = chosen & -chosen
        d = low.bit_length() - 1
        out.append((d, sum(((plane >> d) & 1) << i for i, plane in enumerate(total))))
        chosen ^= low
    return out


def spread(places: bytes, packed: bytes) -> list[int]:
    """A term's bitmaps over its own documents as bitmaps over the block."""
    at = np.frombuffer(places, "<u2")
    bits = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(IMPACT_BITS, -1), axis=1, count=len(at), bitorder="little")
    wide = np.zeros((IMPACT_BITS, int(at[-1]) + 1), np.uint8)
    wide[:, at] = bits
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(wide, axis=1, bitorder="little")]


# --- searching


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): item tells the rows of items apart. Settled."""

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 256):
            rows = []
            for item_id, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows += [(at, item_id, t.decode("utf-8", "surrogatepass"), n) for t, n in Counter(terms_of(text)).items()]
                at += 1
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["item", "item_id", "term", "times"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return settle(rows.mapInArrow(run, "item long, item_id long, term string, times long"), "items")


def _best(k: int):
    """The best k documents of a block for each item of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[int, list[int]] = {}
        for places, packed, weight, items in zip(pdf.places, pdf.slices, pdf.weight, pdf["items"], strict=True):
            impact = times(spread(places, packed), int(weight))
            for item in items:
                add = impact if item["times"] == 1 else times(impact, int(item["times"]))
                add_into(sums.setdefault(int(item["item"]), []), add)
        rows = [(item, d, value) for item, total in sums.items() for d, value in values_at(total, top_documents(total, k))]
        return pd.DataFrame({"block": pdf.block.iloc[0] if len(pdf) else 0, "item": [r[0] for r in rows], "place": [r[1] for r in rows], "score": [r[2] for r in rows]}).astype("int64")

    return run


def search(index: DataFrame, count: int, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    asked = item_terms(items)
    named = asked.select("item", "item_id").distinct()
    # Which items share a task: their terms meet a block's rows once for each group.
    group = F.expr(f"item % {max(1, -(-named.count() // ITEMS))}")
    wanted = asked.select("term").distinct()
    met = index.where("term IS NOT NULL")
    df = met.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2 * count + 2).cast("double")) / (2 * F.col("df") + 1)))
    grouped = asked.groupBy("term", group.alias("group")).agg(F.collect_list(F.struct("item", "times")).alias("items"))
    weighed = settle(grouped.join(df, "term").select("term", "group", weight.alias("weight"), "items"), "weights").where("weight > 0")
    hits = met.select("block", "term", "places", "slices").join(weighed, "term")
    best = hits.select("block", "group", "weight", "items", "places", "slices").groupBy("block", "group").applyInPandas(_best(k), StructType([StructField(x, LongType()) for x in ("block", "item", "place", "score")]))
    ids = index.where("term IS NULL").select("block", "doc_ids")
    found = best.join(ids, "block").select("item", "score", F.get("doc_ids", F.col("place").cast("int")).alias("doc_id"), "block", "place")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index docs and search them for every item."""
    index, count, _ = build_index(docs)
    return search(index, count, items, k)
