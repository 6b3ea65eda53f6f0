"""Quality rules: base counts and a calibrated logistic regression over hashed n-grams.

Words are runs without ASCII white space. The model sees log-damped counts of
three-byte grams and of words and word pairs, each in 2**BITS buckets; it is
fitted on labelled rows, calibrated (Platt) on a quarter of them that the fit
doesn't see, and scored in Arrow batches. A text is kept if it passes the base
rules and its probability of being good is KEEP_AT or more.

The fit takes a hash-chosen sample of at most SAMPLE labelled rows. Defined
results: a null text has no words (so it fails the base rules); labels of null
quality or doc_id, or of a doc_id that docs lacks, are not used; a doc_id with
several labels counts with each; with labels of one kind alone, or none, only the
base rules decide.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import slices
from catalith.llm.hashing import char_counts, sparse_unit, word_counts, word_hashes
from catalith.llm.logistic import Rows, fit, platt, sigmoid

BITS = 13
#: Labelled rows for fitting and calibration, at most.
SAMPLE = 3_000
KEEP_AT = 0.5
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    repeat = 0
    triples = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(triples)) < len(triples):
        often = {t for t, n in Counter(triples).items() if n > 1}
        end = 0
        for i, t in enumerate(triples):
            if t in often:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeat


def features(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ci, cv = sparse_unit(char_counts(data, 3, BITS))
    wi, wv = sparse_unit(word_counts(word_hashes(words), BITS))
    return np.concatenate([ci, wi + np.int32(1 << BITS)]), np.concatenate([cv, wv])


class QualityModel:
    def __init__(self, w: np.ndarray | None, b: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.w, self.b, self.slope, self.shift = w, b, slope, shift

    def probability(self, data: bytes, words: list[bytes]) -> float | None:
        if self.w is None:
            return None
        idx, val = features(data, words)
        return float(sigmoid(self.slope * (val @ self.w[idx] + self.b) + self.shift))


def fit_quality(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> QualityModel:
    """Every fourth row calibrates, the others fit; both kinds weigh the same in the fit."""
    if not y.any() or y.all():
        return QualityModel(None)
    part = np.arange(len(y)) % 4 == 0
    if len(set(y[part])) < 2 or len(set(y[~part])) < 2:
        part = np.zeros(len(y), bool)
    own = y[~part]
    w, b = fit(Rows([r for r, p in zip(rows, part, strict=True) if not p], 2 << BITS), own, np.where(own, 0.5 / own.mean(), 0.5 / (1 - own.mean())))
    held = [r for r, p in zip(rows, part, strict=True) if p]
    slope, shift = platt(Rows(held, 2 << BITS).dot(w) + b, y[part]) if held else (1.0, 0.0)
    return QualityModel(w.astype(np.float32), b, slope, shift)


def _featured(batches):
    for batch in slices(batches):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        rows = [features(t, t.split()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "quality", "idx", "val"])


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """The model fitted on at most `sample` labelled rows (about: rows are chosen by the hash of their doc_id)."""
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality"))
    n = known.count()
    if not n:
        return QualityModel(None)
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003.0
    chosen = known.where(chance < sample / n).limit(2 * sample)  # of a bounded number of rows, so its size is too
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = texts.mapInArrow(_featured, "doc_id long, quality int, idx array<int>, val array<float>").toArrow()
    order = np.lexsort([rows["quality"].to_numpy(), rows["doc_id"].to_numpy()])
    ends = np.cumsum(pc.list_value_length(rows["idx"]).to_numpy())
    idx, val = (pc.list_flatten(rows[c]).to_numpy() for c in ("idx", "val"))
    begins = np.concatenate([[0], ends[:-1]]).astype(int)
    return fit_quality([(idx[begins[i] : ends[i]], val[begins[i] : ends[i]]) for i in order], rows["quality"].to_numpy()[order] > 0)


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept)."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept"]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def judge(text: str | None):
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        counts = base_counts(text, words)
        failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED_PERCENT * counts[0]
        p = held.value.probability(data, words)
        return *counts, failed, p, not failed and (p is None or p >= KEEP_AT)

    def judged(batches):
        for batch in slices(batches):
            cols = zip(*map(judge, batch.column("text").to_pylist()), strict=True) if batch.num_rows else [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return docs.select("doc_id", "text").mapInArrow(judged, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean")


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on labels, then judge every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_quality(docs, fit_on(docs, labels))
