"""Packing documents into training sequences, online and in bounded space.

Each partition keeps OPEN windows. A document's ids end with one end id; whole
windows are cut from its head and leave at once, the rest goes where it leaves the
least room (best fit). If it fits nowhere, it opens a window, or, with OPEN windows
open, the fullest is filled up with its head and leaves, and its tail opens the next.
At the end of a partition its open windows are laid end to end and cut; what is
left, under one window for each partition, is laid end to end for GROUP partitions at
a time. So only the last sequence of each group is padded.

Defined results: a null or empty text is its end id alone; a null doc_id and
repeated rows are packed like any other; an empty table gives no piece.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import begins, parts, remembers, settle

WINDOW = 2048
END_ID = 1
OPEN = 32
#: Partitions whose last windows are merged in one task; each brings less than one window.
GROUP = 64
#: Words whose ids a worker remembers, and the longest such word in bytes.
REMEMBERED, LONG_WORD = 800_000, 64
#: Bytes of text tokenized in one go, about.
CHUNK = 1 << 23
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Whether a byte, or a byte after 0xC3, ends a letter or digit that stays one, of one code point, when normalized and lower-cased (0-9, A-Z, a-z, À-ÿ but × and ÷).
_SAFE, _SAFE_AFTER_C3 = np.zeros(256, bool), np.zeros(256, bool)
_SAFE[[c for c in range(128) if chr(c).isalnum()]] = True
_SAFE_AFTER_C3[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


def _ids_array(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<u4"), pa.uint32()))


def _ends_apart(words: pa.Array, punctuation: str) -> pa.Array:
    """Each word as two: what is before the punctuation at its end, and that; the second is empty where they can't be told apart."""
    if not len(words):
        return pa.array([], pa.binary())
    words = pa.concat_arrays([words])  # from the start of its buffers on
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1]
    cores = pc.binary_length(pc.ascii_rtrim(words, characters=punctuation)).to_numpy()
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    cuts = np.empty(2 * len(words) + 1, np.int32)
    cuts[::2], mid = offsets, offsets[:-1] + cores
    if len(data):
        last, before = data[np.maximum(mid - 1, 0)], data[np.maximum(mid - 2, 0)]
        apart = ((cores > 0) & _SAFE[last]) | ((cores > 1) & (before == 0xC3) & _SAFE_AFTER_C3[last])
        mid = np.where(apart, mid, offsets[1:])
    cuts[1::2] = mid
    return pa.Array.from_buffers(pa.binary(), 2 * len(words), [None, pa.py_buffer(cuts), words.buffers()[2]])


class WordTokenizer:
    """Ids of whole texts, word by word.

    The tokenizer drops white space and no token, merge, normal form or special
    string spans it, so the ids of a text are those of its words in order. Nor does one
    span a letter or digit (of those in _SAFE) and the punctuation that ends its word, so
    these are two words here. Words are looked up in an Arrow array, as many at once as a
    chunk has distinct ones; only words not seen lately are encoded.
    """

    #: Punctuation that may be taken off a word's end; ">" may end a special string.
    punctuation = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != ">")

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder, self.most = Tokenizer.from_file(path), remembered or REMEMBERED
        vocab = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True
        self.words, self.ids = pa.array([b""], pa.binary()), _ids_array([b""])

    @property
    def known(self) -> list[bytes]:
        """The words remembered."""
        return self.words.to_pylist()

    def _pack(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word. Words of letters alone are one symbol run each, so they are encoded as one text and cut where a run ends."""
        texts = [w.decode("utf-8", "replace") for w in words]
        out: list = [None] * len(words)
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            ids = np.array(self.encoder.encode_batch_fast([" ".join([texts[i] for i in part])], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(part):
                data, start = ids.tobytes(), 0
                for i, end in zip(part, ends.tolist(), strict=True):
                    out[i] = data[start:end]
                    start = end
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.encoder.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.string())
        # A-Z are lower-cased as the tokenizer would, unless a special string may be in the text.
        plain = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.ascii_split_whitespace(plain)
        found = split.flatten().dictionary_encode()
        halves = _ends_apart(found.dictionary, self.punctuation).dictionary_encode()
        pairs = self._ids(halves.dictionary).take(halves.indices)
        # Two halves are a word again.
        words = pa.ListArray.from_arrays(pairs.offsets[::2], pairs.values)
        ids = words.take(found.indices)
        data, ends = ids.values.to_numpy().tobytes(), (4 * ids.offsets.to_numpy().astype(np.int64)[split.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in itertools.pairwise(ends)]

    def _ids(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct words (an empty one has none)."""
        at = pc.index_in(words, self.words)
        new = words.filter(at.is_null())
        packed = _ids_array(self._pack(new.to_pylist()))
        place = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        out = pa.concat_arrays([self.ids, packed]).take(pa.array(place))
        self._remember(new, packed, words, out)
        return out

    def _remember(self, new: pa.Array, packed: pa.ListArray, words: pa.Array, ids: pa.ListArray) -> None:
        """The new words too or, if these are too many, this chunk's alone."""
        held = [self.words], [self.ids]  # the first word is the empty one
        if len(self.words) + len(new) > self.most:
            held, new, packed = ([self.words[:1]], [self.ids[:1]]), words, ids
        sizes, room = pc.binary_length(new).to_numpy(), self.most - len(held[0][0])
        short = pa.array(np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))[:room])
        self.words = pa.concat_arrays([*held[0], new.take(short)])
        self.ids = pa.concat_arrays([*held[1], packed.take(short)])


@functools.lru_cache(maxsize=1)
def word_tokenizer(path: str, remembered: int | None = None) -> WordTokenizer:
    """One for each Python worker, which serves many tasks and so keeps what it remembers."""
    return WordTokenizer(path, remembered)


remembers("packing", word_tokenizer.cache_clear)


class Packer:
    """Windows of one partition; pieces leave as tuples of _PIECE, with their ids while the window isn't final."""

    def __init__(self, first_id: int, window: int = WINDOW, most: int = OPEN):
        self.next_id, self.window, self.most, self.open, self.out = first_id, window, most, [], []

    def _leave(self, pieces: list) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, size = len(ids) // 4, self.window
        whole = total // size * size
        for at in range(0, whole, size):
            self._leave([(doc_id, at, ids[4 * at : 4 * (at + size)], total)])
        n = total - whole
        if not n:
            return
        piece = (doc_id, whole, ids[4 * whole :], total)
        best = max((i for i, (fill, _) in enumerate(self.open) if fill + n <= size), key=lambda i: self.open[i][0], default=None)
        if best is not None:
            self._put(best, piece, n)
        elif len(self.open) < self.most:
            self.open.append((n, [piece]))
        else:
            full = max(range(len(self.open)), key=lambda i: self.open[i][0])
            cut = size - self.open[full][0]
            self._put(full, (doc_id, whole, piece[2][: 4 * cut], total), cut)
            self.open.append((n - cut, [(doc_id, whole + cut, piece[2][4 * cut :], total)]))

    def _put(self, i: int, piece: tuple, n: int) -> None:
        fill, pieces = self.open.pop(i)
        pieces.append(piece)
        if fill + n == self.window:
            self._leave(pieces)
        else:
            self.open.append((fill + n, pieces))

    def end(self) -> list:
        """Lay the open windows end to end; the pieces that don't fill a window are returned."""
        rest, fill = [], 0
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            rest, fill = self.lay(rest, fill, pieces)
        self.open = []
        return rest

    def lay(self, held: list, fill: int, pieces: list) -> tuple[list, int]:
        for doc_id, start, ids, total in pieces:
            while ids:
                part = ids[: 4 * (self.window - fill)]
                held.append((doc_id, start, part, total))
                fill += len(part) // 4
                start, ids = start + len(part) // 4, ids[len(part) :]
                if fill == self.window:
                    self._leave(held)
                    held, fill = [], 0
        return held, fill


def _table(rows: list, left: list, part: int) -> pa.RecordBatch:
    """Final pieces, then pieces that are left over, with their ids."""
    rows = [(*r, None, part) for r in rows] + [(d, s, len(i) // 4, None, t, None, k, i, part) for k, (d, s, i, t) in enumerate(left)]
    cols = zip(*rows, strict=True) if rows else [()] * 9
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "part"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _packed(path: str, window: int, chunk: int, remembered: int | None):
    def packed(batches):
        begins("packing")
        part, tokens = TaskContext.get().partitionId(), word_tokenizer(path, remembered)
        packer = Packer(part << 32, window)
        end = struct.pack("<I", END_ID)
        for batch in parts(batches, chunk):
            for d, ids in zip(batch.column("doc_id").to_pylist(), tokens.encode(pc.fill_null(batch.column("text"), "")), strict=True):
                packer.add(d, ids + end)
            yield _table(packer.out, [], part)
            packer.out = []
        left = packer.end()
        yield _table(packer.out, left, part)

    return packed


def _merged(window: int):
    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "offset"])
        ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None)
        packer = Packer((1 << 62) + (int(pdf["part"].iloc[0]) // GROUP << 20), window)
        pieces = [(None if d is None else int(d), int(s), bytes(i), int(t)) for d, s, i, t in zip(ids, pdf["start"], pdf["ids"], pdf["doc_tokens"], strict=True)]
        rest, _ = packer.lay([], 0, pieces)
        if rest:
            packer._leave(rest)
        out = pd.DataFrame(packer.out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return merged


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, chunk: int = CHUNK, remembered: int | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. chunk: bytes of text tokenized in one go; remembered: words that a worker remembers; less of either takes less memory and more time."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = settle(docs.mapInArrow(_packed(path or tokenizer_file(), window, chunk, remembered), f"{_PIECE}, ids binary, part long"), "pieces")
    left = pieces.where("sequence_id IS NULL").withColumn("group", (F.col("part") / GROUP).cast("long"))
    final = pieces.where("sequence_id IS NOT NULL").drop("ids", "part")
    return final.unionByName(left.groupBy("group").applyInPandas(_merged(window), _PIECE))
