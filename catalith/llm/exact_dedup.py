"""Exact deduplication through a Golomb-coded fingerprint exchange.

Partitions send each owner (a range of fingerprint space) their sorted distinct
64-bit fingerprints as Golomb-Rice coded gaps. An owner answers every list with
a bitmap of the fingerprints that other lists hold too. Only documents whose
fingerprint is so marked (suspects) are shuffled with their text, where whole
normalised texts are compared byte by byte.

Defined results: a null text counts as the empty text. A null doc_id loses to
every other; if all ids of a group are null, keep_id is null and its rows stay.
Rows that repeat the largest doc_id of their group all stay (they are one
document given twice). An empty table gives an empty result. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import settle, slices

#: Distinct fingerprints in one list; a partition with more sends several lists.
LIST_ROWS = 1_000_000
#: Fingerprints that one owner gets, about.
OWNER_ROWS = 500_000
#: Suspect fingerprints that are broadcast at most (about 25 bytes each in a join's table); beyond it both sides of the join are shuffled.
BROADCAST_SUSPECTS = 2_000_000


def rice_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Gaps of sorted distinct uint64 values: (remainder bits k, unary stream + remainder stream)."""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1, int(values[-1] if len(values) else 0) // max(1, len(values)))
    k = max(0, mean.bit_length() - 1)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(np.concatenate([unary, rest.ravel()])).tobytes()


def rice_decode(n: int, k: int, blob: bytes) -> np.ndarray:
    """The values that rice_encode was given."""
    bits = np.unpackbits(np.frombuffer(blob, np.uint8))
    ends = np.flatnonzero(bits == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    begin = int(ends[-1]) + 1 if n else 0
    rest = bits[begin : begin + n * k].reshape(n, k).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(k)) | (rest << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _normal(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; bytes.lower() touches ASCII letters alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _digests(batches):
    for batch in slices(batches):
        digests = [hashlib.sha256(_normal(x)).digest() for x in batch.column("text").to_pylist()]
        fp = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d.hex() for d in digests], pa.string()), pa.array(fp)], ["doc_id", "text_sha256", "fp"])


def _sender(bits: int):
    """Sorted distinct fingerprints of a partition, by owner; repeats inside the list are told apart at once."""

    def lists(fps: np.ndarray, at: int):
        values, counts = np.unique(fps, return_counts=True)
        owners = (values >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.searchsorted(owners, np.arange((1 << bits) + 1))
        for owner in range(1 << bits):
            own = values[cuts[owner] : cuts[owner + 1]]
            if len(own):
                k, blob = rice_encode(own & np.uint64((1 << (64 - bits)) - 1))
                yield at, owner, len(own), k, blob, np.packbits(counts[cuts[owner] : cuts[owner + 1]] > 1).tobytes()

    def send(batches):
        at, held, n = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy().view(np.uint64))
            n += batch.num_rows
            if n >= LIST_ROWS:
                yield _rows(lists(np.concatenate(held), at))
                at, held, n = at + 1, [], 0
        if n:
            yield _rows(lists(np.concatenate(held), at))

    def _rows(rows):
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["list", "owner", "n", "k", "blob", "own"])

    return send


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each list: a bitmap of its fingerprints that are in another list, or twice in itself."""
    lists = [rice_decode(n, k, blob) for n, k, blob in zip(pdf.n, pdf.k, pdf.blob, strict=True)]
    _, where, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    shared = np.split(counts[where] > 1, np.cumsum(pdf.n)[:-1])
    maps = [np.packbits(s | np.unpackbits(np.frombuffer(own, np.uint8), count=len(s)).astype(bool)).tobytes() for s, own in zip(shared, pdf.own, strict=True)]
    return pd.DataFrame({"list": pdf.list, "owner": pdf.owner, "bitmap": maps})


def _marked(bits: int):
    def marked(frames):
        for pdf in frames:
            out = [np.empty(0, np.uint64)]
            for owner, n, k, blob, bitmap in zip(pdf.owner, pdf.n, pdf.k, pdf.blob, pdf.bitmap, strict=True):
                flags = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=n).astype(bool)
                out.append(rice_decode(n, k, blob)[flags] | np.uint64(owner << (64 - bits)))
            yield pd.DataFrame({"fp": np.concatenate(out).view(np.int64)})

    return marked


def suspect_fingerprints(digests: DataFrame, rows: int) -> DataFrame:
    """Fingerprints that at least two rows share: (fp), each once."""
    bits = max(3, (rows // OWNER_ROWS).bit_length())
    sends = settle(digests.select("fp").mapInArrow(_sender(bits), "list long, owner long, n long, k int, blob binary, own binary"), "sends")
    replies = sends.groupBy("owner").applyInPandas(_answer, "list long, owner long, bitmap binary")
    return sends.select("list", "owner", "n", "k", "blob").join(replies, ["list", "owner"]).mapInPandas(_marked(bits), "fp long").distinct()


def _norms(batches):
    """Documents with the fingerprint and the bytes of their normalised text."""
    for batch in slices(batches):
        texts = [_normal(x) for x in batch.column("text").to_pylist()]
        fp = np.frombuffer(b"".join(hashlib.sha256(t).digest()[:8] for t in texts), ">u8").astype(np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp), pa.array(texts, pa.binary())], ["doc_id", "fp", "norm"])


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digests = settle(docs.mapInArrow(_digests, "doc_id long, text_sha256 string, fp long"), "digests")
    suspects = settle(suspect_fingerprints(digests, digests.count()), "suspects")
    if suspects.count() <= BROADCAST_SUSPECTS:
        suspects = F.broadcast(suspects)
    texts = docs.mapInArrow(_norms, "doc_id long, fp long, norm binary").join(suspects, "fp", "left_semi")
    # Whole texts are the grouping key; partial sums come first, so a hot text leaves each task once.
    groups = texts.groupBy("norm").agg(F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("size"))
    groups = groups.where("size > 1").select(F.sha2("norm", 256).alias("text_sha256"), F.lit(True).alias("found"), "keep", "size")
    keep = F.when(F.col("found"), F.col("keep")).otherwise(F.col("doc_id"))
    return digests.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
