"""Language identification by nearest clustered centroid of TF-IDF n-gram vectors.

A text is folded to lower case, every ASCII character but letters becomes a
space, and its three-byte grams are counted in 2**BITS buckets. The vector is
log-damped counts times inverse document frequency, scaled to length 1. Each
language has up to CLUSTERS centroids (spherical k-means); the nearest by cosine
gives the language and the score. A text further from every centroid than
texts of its length are in training is rejected.

The classifier, with its document frequencies, is fitted on a hash-chosen sample
of at most SAMPLE labelled rows, spread over the languages. Defined results:
`und` with score 0 (and rejected) for a null text or one without a letter; with
nothing to learn from, every text is `und`. A null doc_id counts as the empty
text in the held-out rule. Repeated rows are judged apart, alike.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import begins, slices
from catalith.llm.hashing import char_counts

BITS = 13
CLUSTERS = 3
#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 2_000
#: A text is rejected below this share of the similarity that nearly all training texts of its length reach.
REJECT_SHARE = 0.5
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def is_held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def folded(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Centroids:
    """The fitted classifier: languages, idf, centroids and the similarity floor by text length."""

    def __init__(self, langs: list[str], idf: np.ndarray, centres: np.ndarray, owner: np.ndarray):
        self.langs, self.idf, self.centres, self.owner = langs, idf, centres, owner
        self.floor = np.zeros(64)

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt(v @ v)
        return (v / norm if norm else v).astype(np.float32)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or text is None or not has_letter(text):
            return "und", 0.0, True
        data = folded(text)
        sims = self.centres @ self.vector(char_counts(data, 3, BITS))
        best = int(sims.argmax())
        score = float(min(1.0, max(0.0, sims[best])))
        return self.langs[self.owner[best]], score, score < self.floor[len(data).bit_length()]


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart starting rows."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
    for _ in range(10):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centres


def fit(langs: list[str], texts: list[str]) -> Centroids:
    """Fit on texts with a letter, labelled with langs."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    counts = np.stack([char_counts(folded(t), 3, BITS) for t in texts]) if texts else np.zeros((0, 1 << BITS))
    model = Centroids(names, np.log1p(len(texts) / (1 + (counts > 0).sum(0))), np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int))
    if not texts:
        return model
    x = np.stack([model.vector(c) for c in counts])
    found = [_cluster(x[label == j], CLUSTERS) for j in range(len(names))]
    model.centres = np.vstack(found).astype(np.float32)
    model.owner = np.repeat(np.arange(len(names)), [len(c) for c in found])
    by_length: dict[int, list[float]] = {}
    for j, t in zip(label, texts, strict=True):
        data = folded(t)
        own = model.centres[model.owner == j]
        for power in range(3, len(data).bit_length() + 1):  # what the first 8, 16, ... bytes would score
            sims = own @ model.vector(char_counts(data[: 1 << power], 3, BITS))
            by_length.setdefault(power, []).append(float(sims.max()))
    for power in range(64):
        sims = by_length.get(power) or by_length.get(max(by_length))
        model.floor[power] = REJECT_SHARE * np.quantile(sims, 0.01) if power > 3 else 0.0
    return model


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> Centroids:
    """Fit on at most `sample` rows of docs that aren't held out, the same number for each language at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit([], [])
    each = max(1, sample // len(sizes))
    chance = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_003)) / 1_000_003.0
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(each / n)).otherwise(rate)
    rows = known.where(chance < rate).select("lang", "text").limit(2 * sample).toArrow().to_pylist()
    rows = sorted(((r["lang"], r["text"]) for r in rows if has_letter(r["text"])), key=lambda r: (r[0], zlib.crc32(r[1].encode("utf-8", "surrogatepass")), r[1]))
    return fit([r[0] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs with lang_pred, score and rejected; any column of docs by one of those names is replaced."""
    plain = docs.drop("lang_pred", "score", "rejected")
    schema = plain.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        begins("language_id")
        judged = held.value.judge
        for batch in slices(batches):
            rows = [judged(t) for t in batch.column("text").to_pylist()]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*batch.schema.names, "lang_pred", "score", "rejected"])

    return plain.mapInArrow(judge, schema)


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), a row for each row of docs."""
    docs = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"))
    return identify(docs.select("doc_id", "text"), fit_on(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score", "rejected")
