"""Hashed n-gram counts of a text, in numpy. Small helpers for Arrow batches."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes handled at once, so that a very long text needs no very long arrays.
SLICE = 1 << 20


def char_counts(data: bytes, n: int, bits: int) -> np.ndarray:
    """Counts of the n-byte grams of data in 2**bits buckets."""
    out = np.zeros(1 << bits, np.int64)
    for at in range(0, max(1, len(data) - n + 1), SLICE):
        part = np.frombuffer(data, np.uint8, offset=at, count=min(SLICE + n - 1, len(data) - at)) if len(data) > at else np.empty(0, np.uint8)
        if len(part) < n:
            continue
        end = len(part) - n + 1
        wide = part.astype(np.uint32)
        h = wide[:end].copy()
        for i in range(1, n):
            h *= np.uint32(0x9E3779B1)
            h ^= wide[i : i + end]
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - bits)
        out += np.bincount(h, minlength=1 << bits)
    return out


class WordHashes(dict):
    """CRC-32 of words, remembered for up to MOST of them."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = zlib.crc32(word)
        return h


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint32, len(words))


def word_counts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Counts of single words and word pairs in 2**bits buckets."""
    shift = np.uint32(32 - bits)
    out = np.bincount(hashes >> shift, minlength=1 << bits)
    if len(hashes) > 1:
        pairs = (hashes[:-1] * np.uint32(0x9E3779B1) ^ hashes[1:]) * np.uint32(0xC2B2AE35)
        out = out + np.bincount(pairs >> shift, minlength=1 << bits)
    return out


def sparse_unit(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and log-damped values of length 1 of the buckets that aren't empty."""
    idx = np.flatnonzero(counts)
    val = np.log1p(counts[idx])
    norm = np.sqrt(val @ val)
    return idx.astype(np.int32), (val / norm if norm else val).astype(np.float32)
