"""Sharding by histogram sort, with DataFrame functions only.

The sort key of a document is (xxhash64 of its text, xxhash64 of its doc_id), so
equal texts lie side by side. Each splitter between two shards starts as the
whole key range; a round counts the exact bytes in 256 sub-ranges of every range
that is still open and keeps the one in which the target lies, until the bytes
below an edge are within tolerance of the target or one row is left. The law is
`bytes`: shards get near equal bytes. A group of equal texts stays in one shard
unless it is larger than the tolerance; then its rows are split by doc_id. Rows
move once, when slots are dealt.

Defined results: a null text has size 1 and CRC 0; a null doc_id hashes like any
value. Rows equal in both text and doc_id share a key and so a shard. An empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalith.llm.common import settle

STEP = 8
MIN_LONG, MAX_LONG = -(1 << 63), (1 << 63) - 1
#: Rows in one bin of a shard, about, within which slots are numbered.
BIN_ROWS = 50_000
LEAST_BINS = 64


@dataclass
class Splitter:
    """An open range of keys: depth bits are fixed; below has the exact bytes of all keys before it."""

    target: int
    depth: int = 0
    prefix: int = 0
    group: int | None = None
    below: int = 0
    done: tuple[int, int] | None = None

    def edge(self, prefix: int) -> tuple[int, int]:
        if self.group is not None:
            return self.group, prefix << (128 - self.depth - STEP)
        low = prefix << (64 - self.depth - STEP)
        return (low, MIN_LONG)


def keyed(docs: DataFrame) -> DataFrame:
    """The slim table that is counted: a row for each document, without its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)).alias("k"),
    )


def _count(keys: DataFrame, depth: int, spans: set) -> dict:
    """Bytes and rows of each sub-range: {span: {sub-prefix: (bytes, rows)}}; a span is (group, prefix)."""
    if depth < 64:
        col, bits, rows = F.col("h"), 64 - depth, keys
        rows = rows if depth == 0 else rows.where(F.shiftright(col, bits).isin([p for _, p in spans]))
        group = F.lit(None).cast("long")
    else:
        col, bits = F.col("k"), 128 - depth
        rows = keys.where(F.col("h").isin([g for g, _ in spans]))
        rows = rows if depth == 64 else rows.where(F.shiftright(col, bits).isin([p for _, p in spans]))
        group = F.col("h")
    sub = F.shiftright(col, bits - STEP) if bits > STEP else col
    found: dict = {}
    for r in rows.groupBy(group.alias("g"), sub.alias("s")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        span = (r.g, (r.s >> STEP) if bits < 64 else 0)
        if span in spans:
            found.setdefault(span, {})[r.s] = (r.b, r.n)
    return found


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys at which shards 1, 2, ... begin. At most shards x 256 counts reach the driver in a round, and there are at most 16 rounds."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = max(1, int(tolerance * total / shards))
    open_ = [Splitter(total * i // shards) for i in range(1, shards)]
    cut = list(open_)
    depth = 0
    while open_ and depth < 128:
        counts = _count(keys, depth, {(s.group, s.prefix) for s in open_})
        for s in open_:
            _refine(s, counts.get((s.group, s.prefix), {}), slack)
        open_ = [s for s in open_ if s.done is None]
        depth += STEP
        for s in open_:
            s.depth = depth
            if depth == 64:
                s.group, s.prefix = s.prefix, 0
    return [s.done for s in cut]


def _refine(s: Splitter, subs: dict, slack: int) -> None:
    below, last = s.below, None
    for prefix in sorted(subs):
        size, rows = subs[prefix]
        last = prefix
        if below + size <= s.target:
            below += size
            continue
        if s.target - below <= slack:
            s.done = s.edge(prefix)
        elif below + size - s.target <= slack or rows == 1 or s.depth + STEP >= 128:
            after = below + size - s.target < s.target - below
            s.done = s.edge(prefix + 1) if after else s.edge(prefix)
            if after and s.done[0] > MAX_LONG:
                s.done = (MAX_LONG, MAX_LONG)
            if s.done[1] > MAX_LONG:
                s.done = (s.done[0] + 1, MIN_LONG) if s.done[0] < MAX_LONG else (MAX_LONG, MAX_LONG)
        else:
            s.prefix, s.below = prefix, below
        return
    s.done = s.edge(last) if last is not None else (MAX_LONG, MAX_LONG)


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """The number of splitters at or before the row's key."""
    h, k = F.col("h"), F.col("k")
    out = F.lit(0)
    for a, b in cuts:
        out = out + ((h > F.lit(a)) | ((h == F.lit(a)) & (k >= F.lit(b)))).cast("int")
    return out


def numbered(rows: DataFrame, n_rows: int, shards: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: bins by text and doc_id, so that neither a common text nor null ids fill one, are numbered apart and follow one another."""
    bins = max(LEAST_BINS, n_rows // (BIN_ROWS * shards))
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("h", "k"), F.lit(bins)))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n")).select("shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("shard", "bin").orderBy("k", "h", "size")
    return rows.withColumn("at", F.row_number().over(own) - 1).join(starts, ["shard", "bin"]).withColumn("slot", (F.col("first") + F.col("at")).cast("long")).drop("first", "at", "bin")


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row of docs."""
    keys = settle(keyed(docs), "keys")
    tagged = keys.withColumn("shard", shard_of(splitters(keys, shards, tolerance)))
    return numbered(tagged, keys.count(), shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, tolerance: float = 0.001, files: int = 4) -> None:
    """Write whole rows of docs as Parquet under path/shard=N, texts exchanged once; files: per shard."""
    keys = settle(keyed(docs), "keys")
    cuts = splitters(keys, shards, tolerance)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"h": F.xxhash64(text), "k": F.xxhash64(F.col("doc_id").cast("long"), F.lit(7))}) if not {"h", "k", "shard"} & set(docs.columns) else None
    if own is None:
        raise ValueError("docs has a column named h, k or shard; rename it first")
    tagged = own.withColumn("shard", shard_of(cuts))
    tagged.repartition(shards * files, "shard", F.pmod("k", F.lit(files))).drop("h", "k").write.partitionBy("shard").parquet(path)
