"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Words are runs without ASCII white space; a text's set has the 64-bit hashes of
its runs of N words (of all its words, if it has fewer). Equal texts are one class
from the start and are represented once. Each representative has one MinHash for
each row of each band; band and row counts are chosen for the target recall at the
threshold. Representatives that share a band hash meet in a bucket.

Large buckets are cut into blocks of about BLOCK representatives by hash, and each
pair of blocks is a task of its own, so no bucket is gathered whole and none is
capped. A pair is looked at in the first band that it shares, and only there: a
slim pass over band hashes finds what has such a pair, and only that is sent with
its n-gram set. Tasks return a row for each representative (its links counted, and
the smallest one linked to it inside the task), never pairs.

Joins of sides that grow with the texts are merge joins by a hint: Spark's estimate of a
side leaves out what explode adds, counts an array as one entry and a file as it is
compressed, and adaptive execution doesn't take back a broadcast that was planned by it.

Defined results: a null text counts as empty; a text without a word has no link.
rep_id, class_id are the smallest doc_id that isn't null, else null. Rows that repeat
are copies. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import begins, remembers, settle, slices, trim
from catalith.llm.components import components

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
HASHES = 64
BLOCK = 256
#: Candidate texts whose hash is broadcast at most (about 100 bytes each in a join's table); beyond it both sides of the join are shuffled.
BROADCAST_TEXTS = 1_000_000
#: Grams of either side of a comparison that are held sorted at once.
GRAMS = 500_000
#: Keys that a task remembers to send a copy once; beyond it a few more copies are sent, which do no harm.
REMEMBERED = 1_000_000
_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 64, (1024, 1), dtype=np.uint64) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def bands_and_rows(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most rows in a band, with as many bands as hashes allow, that keep the recall at the threshold."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            need = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
            return need, rows
    raise ValueError(f"{hashes} hashes can't reach a recall of {recall} at {threshold}")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()
remembers("ngram_join", _WORDS.clear)


def ngram_set(data: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word runs of a text in UTF-8."""
    words = data.split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * _FACTOR
        out ^= out >> np.uint64(29)
    return np.unique(out)


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low = np.full(bands * rows, np.uint64(2**64 - 1))
    for at in range(0, len(grams), 4096):
        np.minimum(low, (_MULTIPLY[: bands * rows] * grams[at : at + 4096]).min(1), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        out = (out ^ column) * _FACTOR
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def _data(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _signed(bands: int, rows: int, n: int):
    def signed(batches):
        begins("ngram_join")
        for batch in slices(batches):
            texts = list(map(_data, batch.column("text").to_pylist()))
            keys = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            sets = (ngram_set(t, n) for t in texts)
            hashes = pa.array([band_hashes(s, bands, rows) if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, hashes], ["doc_id", "key", "bands"])

    return signed


GROUP = ["hash", "low", "high"]


def _by_group(handle):
    """Arrow batches of rows sorted by GROUP to what handle makes of whole groups: (table, first rows of groups, their ends)."""

    def cut(table: pa.Table) -> np.ndarray:
        keys = [table.column(c).to_numpy() for c in GROUP]
        new = np.ones(table.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        return np.flatnonzero(new)

    def run(batches):
        begins("ngram_join")
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            starts = cut(table)
            if len(starts) > 1:
                yield from handle(table.slice(0, starts[-1]).combine_chunks(), starts[:-1], starts[1:]).to_batches()
            held = table.slice(starts[-1]) if len(starts) else None
        if held is not None and held.num_rows:
            yield from handle(held.combine_chunks(), np.array([0]), np.array([held.num_rows])).to_batches()
        trim()

    return run


def _matrix(table: pa.Table) -> np.ndarray:
    """The band hashes as rows."""
    return pc.list_flatten(table.column("bands")).to_numpy().reshape(table.num_rows, -1)


def _first_shared(bands: np.ndarray, at: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For rows left x right: whether band `at` is the first that the pair shares (it does share it)."""
    earlier = np.zeros((len(left), len(right)), bool)
    for b in range(at):
        earlier |= bands[left, b][:, None] == bands[right, b][None]
    return ~earlier


def _sides(block: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == low), np.flatnonzero(block == high)


def _pairs_due(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """Of pairs of blocks: the rows with a pair that is due in this band. Groups of two are looked at all at once."""
    bands, keep = _matrix(table), np.zeros(table.num_rows, bool)
    at, low, high, block = (table.column(c).to_numpy() for c in ("band", "low", "high", "block"))
    i = starts[ends - starts == 2]
    earlier = ((bands[i] == bands[i + 1]) & (np.arange(bands.shape[1]) < at[i][:, None])).any(1)
    due = i[~earlier & ((low[i] == high[i]) | (block[i] != block[i + 1]))]
    keep[due] = keep[due + 1] = True
    for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
        left, right = _sides(block[a:b], low[a], high[a])
        due = _first_shared(bands[a:b], at[a], left, right)
        if low[a] == high[a]:
            np.fill_diagonal(due, False)
        keep[a + left[due.any(1)]] = True
        keep[a + right[due.any(0)]] = True
    return table.filter(pa.array(keep))


def _parts(sizes: np.ndarray) -> list[np.ndarray]:
    """Places in runs of at most GRAMS grams (or of one place)."""
    ends = np.cumsum(sizes)
    out, at = [], 0
    while at < len(sizes):
        before = ends[at] - sizes[at]
        to = max(at + 1, int(np.searchsorted(ends, before + GRAMS, side="right")))
        out.append(np.arange(at, to))
        at = to
    return out


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets left x right, a bounded number of grams at once."""
    sizes = np.array(list(map(len, sets)))
    if sizes.sum() <= 2 * GRAMS:
        return _overlaps_at_once(sets, left, right)
    out = np.zeros((len(left), len(right)), np.float32)
    for a in _parts(sizes[left]):
        for b in _parts(sizes[right]):
            used, place = np.unique(np.concatenate([left[a], right[b]]), return_inverse=True)
            out[np.ix_(a, b)] = _overlaps_at_once([sets[i] for i in used], place[: len(a)], place[len(a) :])
    return out


def _overlaps_at_once(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(left) * len(right) <= 16:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if i != j else len(sets[i]) for j in right] for i in left], np.float32)
    row = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, gram, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[gram] > 1
    row, gram = row[shared], gram[shared]
    number = np.cumsum(often > 1) - 1
    gram = number[gram]
    order = np.argsort(gram, kind="stable")
    row, gram = row[order], gram[order]
    out = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    cuts = np.searchsorted(gram, np.arange(0, int(gram[-1]) + 1 + width, width)) if len(gram) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], gram[a:b] % width] = 1
        out += m[left] @ m[right].T
    return out


def _verify(threshold: float):
    def verify(table: pa.Table, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
        bands, nodes = _matrix(table), table.column("node").to_numpy()
        at, lows, highs, block = (table.column(c).to_numpy() for c in ("band", "low", "high", "block"))
        grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        out = []
        for a, b in zip(starts, ends, strict=True):
            sets, node = grams[a:b], nodes[a:b]
            left, right = _sides(block[a:b], lows[a], highs[a])
            size = np.array(list(map(len, sets)), np.float32)
            both = _overlaps(sets, left, right)
            linked = both >= threshold * (size[left][:, None] + size[right][None] - both) - 1e-6
            linked &= _first_shared(bands[a:b], at[a], left, right)
            if lows[a] == highs[a]:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            links = np.zeros(b - a, np.int64)
            links[left] += linked.sum(1)
            if lows[a] != highs[a]:
                links[right] += linked.sum(0)
            root = _roots(b - a, left, right, linked)
            smallest = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(smallest, root, node)
            some = links > 0
            out.append((node[some], links[some], smallest[root][some]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table(dict(zip(("node", "links", "root"), cols, strict=True)))

    return verify


def _roots(n: int, left: np.ndarray, right: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """A representative row for each connected row."""
    label = np.arange(n)
    while True:
        new = label.copy()
        lows = np.where(linked, label[right][None], n).min(1, initial=n)
        new[left] = np.minimum(new[left], lows)
        lows = np.where(linked, label[left][:, None], n).min(0, initial=n)
        new[right] = np.minimum(new[right], lows)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _firsts(column: str):
    """Rows of Arrow batches whose value in column comes up for the first time in the partition: a hot text leaves it once."""

    def firsts(batches):
        seen = set()
        for batch in batches:
            new = []
            for i, x in enumerate(batch.column(column).to_pylist()):
                if x not in seen:
                    new.append(i)
                    if len(seen) < REMEMBERED:
                        seen.add(x)
            yield batch.take(pa.array(new, pa.int64()))

    return firsts


def _grams(n: int):
    first = _firsts("node")

    def grams(batches):
        begins("ngram_join")
        for batch in slices(first(batches)):
            sets = [ngram_set(_data(t), n).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "grams"])

    return grams


def _sets_for(docs: DataFrame, due: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(node, grams) of the nodes that are due."""
    nodes = settle(due.select("node").distinct().hint("merge").join(reps.select("node", "key"), "node"), "due_nodes")
    texts = docs.select("text", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key"))
    if nodes.count() <= BROADCAST_TEXTS:
        nodes = F.broadcast(nodes)
    else:
        texts, nodes = texts.mapInArrow(_firsts("key"), "text string, key binary"), nodes.hint("merge")
    sets = texts.join(nodes, "key").select("node", "text").mapInArrow(_grams(n), "node long, grams binary")
    return sets.groupBy("node").agg(F.any_value("grams").alias("grams"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, rep_id, class_id, n_links, n_copies), a row for each row of docs.

    rep_id stands for the equal texts; n_links counts the other texts at or above
    the threshold; class_id is one for all that links and copies connect.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bands, rows = bands_and_rows(threshold, recall, HASHES)
    signed = settle(docs.mapInArrow(_signed(bands, rows, n), "doc_id long, key binary, bands array<long>"), "signed")
    reps = signed.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("n_copies"), F.any_value("bands").alias("bands"))
    reps = settle(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    found = settle(_links(docs, reps, threshold, n), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("n_links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    label = F.coalesce("label", "node")
    named = reps.select("key", "rep_id", "n_copies", "node").join(links.hint("merge"), "node", "left").join(labels.hint("merge"), "node", "left").withColumn("label", label)
    classes = named.groupBy("label").agg(F.min("rep_id").alias("class_id"))
    named = named.join(classes.hint("merge"), "label").select("key", "rep_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.select("doc_id", "key").join(named.hint("merge"), "key").select("doc_id", "rep_id", "class_id", "n_links", "n_copies")


def _links(docs: DataFrame, reps: DataFrame, threshold: float, n: int) -> DataFrame:
    """(node, links, root) of every task that found links."""
    entries = reps.where("bands IS NOT NULL").select("node", "bands", F.posexplode("bands").alias("band", "hash"))
    sizes = entries.groupBy("hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    met = entries.join(sizes.hint("merge"), "hash").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "hash", "band", "bands", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    grouped = lambda df: df.repartition(*GROUP).sortWithinPartitions(*GROUP)
    due = settle(grouped(met).mapInArrow(_by_group(_pairs_due), met.schema), "due")
    sent = due.join(_sets_for(docs, due, reps, n).hint("merge"), "node")
    return grouped(sent).mapInArrow(_by_group(_verify(threshold)), "node long, links long, root long")
