"""SentencePiece encoding and decoding over a relational lattice.

A text, its spaces as marks, is cut into segments wherever no piece holds the two
neighbouring characters, so no piece and no merge crosses a cut. Every substring of a segment, up to the longest
piece, is exploded and equi-joined to the piece table; the edges are grouped by
segment and folded with aggregate(), a Spark higher-order function:

* a unigram model's fold is Viterbi: the best path score to each position in turn;
* a BPE model's fold replays merges: of the edges that join two neighbouring symbols,
  the one with the best score (leftmost of equals) is taken until none is left. The
  best-scoring path of such a model isn't what its encoder returns, so Viterbi would
  give wrong ids there. The lattice is the same for both, but for pieces that no merge
  can make and for single characters, which need no merge.

A piece is always made of the same two parts, those of its own merges: what is merged
inside its span doesn't depend on what is around. If both parts rank before the piece,
it can't be due before its turn and isn't late after it; so where all edges are such,
one pass over the edges by rank replays all merges. Segments with a late edge take a pass
for each merge.

A character in no piece is a segment of its own and becomes byte pieces. Passes for each
merge take time in the square of a segment's length; segments of more than LONG_SEGMENT
characters are encoded by the library, in Arrow batches.

The most frequent segments, HOT_SEGMENTS at most, are folded first and their ids sent
to all tasks (a table of bounded size). The others are folded once for each chunk, a
bounded part of one partition's texts. A chunk's texts (as numbers of segments) and
its other segments lie in one bucket of a bucketed table, so texts meet the ids of their
segments without an exchange, and no vocabulary or corpus is gathered anywhere.

Defined results: a null text gives null ids, an empty one no ids; a null doc_id and
repeated rows are encoded like any other; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm.common import parts, settle, settle_buckets

MARK = "▁"
#: Characters of a segment that one 64-bit mask holds (and its end), and that the fold takes at all.
MASK_BITS, LONG_SEGMENT = 61, 255
#: Segments whose ids are sent to all tasks at most; a word counts if a part of COUNTED_CHARS has it so often.
HOT_SEGMENTS, HOT_TIMES = 400_000, 2
#: Bytes of text that are cut into words at once, about, to count them and to code them.
COUNTED_CHARS, CODED_CHARS = 12_000_000, 4_000_000
#: Distinct segments outside the hot ones and characters of text in a chunk, about.
CHUNK_WORDS, CHUNK_CHARS = 100_000, 16_000_000
#: Segments whose edges a task holds before it sorts instead.
SEGMENTS_IN_MEMORY = 250_000
#: Codes put together at once.
ASSEMBLED_CODES = 200_000
#: A single character in the result of a BPE fold: this and its code point.
CHARACTER = 1 << 24
#: Codes: 256 bytes, then the hot segments, then those of the chunk; long segments of the chunk from here on.
LONG_CODE = 1 << 31


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The piece table of a model file: normal pieces, the ids of byte pieces, and the kind of model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.kind = {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
        self.rows = [(p.piece, i, float(p.score)) for i, p in enumerate(model.pieces) if p.type == 1]
        self.bytes = [i for i, p in enumerate(model.pieces) if p.type == 6]
        self.longest = max(len(p) for p, *_ in self.rows)
        self.text = [p.piece.encode() if p.type == 1 else b"" for p in model.pieces]
        for b, i in enumerate(self.bytes):
            self.text[i] = bytes([b])
        self.single = frozenset(p for p, *_ in self.rows if len(p) == 1)
        if any(c not in self.single or c == "\n" for p, *_ in self.rows for c in p):
            raise ValueError("a character of a piece is no piece itself, or a line end")
        if self.longest >= 64 or len(model.pieces) >= 1 << 20:
            raise ValueError("pieces of 64 characters or more, or over a million of them")
        # Classes of characters by what may follow them in a piece, and by what they may follow; 0: none.
        pairs = {x for p, *_ in self.rows for x in itertools.pairwise(p)}
        lefts, rights = (sorted({x[i] for x in pairs}) for i in (0, 1))
        self.left, self.right = (np.zeros(0x110000, np.int32) for _ in range(2))
        self.left[list(map(ord, lefts))] = np.arange(1, len(lefts) + 1) * (len(rights) + 1)
        self.right[list(map(ord, rights))] = np.arange(1, len(rights) + 1)
        self.apart = np.ones((len(lefts) + 1) * (len(rights) + 1), bool)
        self.apart[[self.left[ord(a)] + self.right[ord(b)] for a, b in pairs]] = False

    def frame(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score, rank, first, late): first is the length of the first part; rank 0 is the best score, equal scores have one rank; of BPE, pieces that merges make."""
        rows = pd.DataFrame(self.rows, columns=["piece", "id", "score"])
        rows["rank"] = rows["score"].rank(method="dense", ascending=False).astype("int64") - 1
        rows["first"], rows["late"] = 0, False
        if self.kind == "bpe":
            rank = dict(zip(rows["piece"], rows["rank"], strict=True))
            parts = [self._parts(p, rank) for p in rows["piece"]]
            rows["late"] = [x is not None and any(len(a) > 1 and rank[a] >= rank[p] for a in x) for p, x in zip(rows["piece"], parts, strict=True)]
            rows["first"] = [len(x[0]) if x else 0 for x in parts]
            rows = rows[[x is not None for x in parts]]
        return spark.createDataFrame(rows, "piece string, id long, score double, rank long, first int, late boolean")

    @staticmethod
    def _parts(piece: str, rank: dict[str, int]) -> tuple[str, ...] | None:
        """The two parts of the merge that makes a piece (itself, for a character); None if its merges end elsewhere."""
        symbols, parts = list(piece), (piece,)
        while len(symbols) > 1:
            due = [(rank[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(symbols)) if a + b in rank]
            if not due:
                return None
            i = min(due)[1]
            parts = tuple(symbols[i : i + 2])
            symbols[i : i + 2] = ["".join(parts)]
        return parts

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts, and how many there are before each text and in all."""
        marked = pc.binary_join_element_wise(pc.if_else(pc.equal(texts, ""), "", MARK), pc.replace_substring(texts, " ", MARK), "")
        at = np.frombuffer(marked.buffers()[1] or bytes(4), np.int32)[marked.offset : marked.offset + len(marked) + 1]
        data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        firsts = np.flatnonzero((data & 0xC0) != 0x80)
        starts = np.zeros(len(data) + 1, bool)
        starts[firsts[1:][self.apart[self.left[chars[:-1]] + self.right[chars[1:]]]]] = True
        starts[at] = True
        starts = np.flatnonzero(starts).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)]), np.searchsorted(starts, at)


@functools.lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


# --- lattice and fold -------------------------------------------------------------
# An edge of a BPE lattice is one long, so that edges sort as merges are taken: rank, first character, length, length of its first part, id.
def _edge(rank: Column, p: Column, length: Column, first: Column, piece: Column) -> Column:
    left = lambda c, k: F.call_function("shiftleft", c.cast("long"), F.lit(k))
    return left(rank, 40) + left(p, 32) + left(length, 26) + left(first, 20) + piece


def _start(e: Column) -> Column:
    return F.shiftright(e, 32).bitwiseAND(F.lit(255)).cast("int")


def _length(e: Column) -> Column:
    return F.shiftright(e, 26).bitwiseAND(F.lit(63)).cast("int")


def _first(e: Column) -> Column:
    return F.shiftright(e, 20).bitwiseAND(F.lit(63)).cast("int")


def _bit(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p)


def _symbols(edges: Column, n: Column, whole, single) -> Column:
    """Ids of the edges that are whole symbols, and characters that are, in order."""
    at = lambda p, x: F.call_function("shiftleft", p.cast("long"), F.lit(32)) + x
    wide = F.transform(F.filter(edges, lambda e: (_length(e) > 1) & whole(e)), lambda e: at(_start(e), e.bitwiseAND(F.lit((1 << 20) - 1))))
    ones = F.transform(F.filter(F.sequence(F.lit(0), n - 1), single), lambda p: at(p, F.ascii(F.substring("segment", p + 1, F.lit(1))) + CHARACTER))
    return F.transform(F.sort_array(F.concat(wide, ones)), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))


def _span(mask: Column, e: Column) -> Column:
    """The mask from the edge's first character to its end."""
    return F.call_function("shiftright", mask, _start(e)).bitwiseAND(F.call_function("shiftleft", F.lit(2).cast("long"), _length(e)) - 1)


def _masked(mask: Column, edges: Column, n: Column) -> Column:
    """The symbols of a mask."""
    whole = lambda e: _span(mask, e) == _bit(_length(e)) + 1
    single = lambda p: F.call_function("shiftright", mask, p).bitwiseAND(F.lit(3)) == 3
    return _symbols(edges, n, whole, single)


def _due(mask: Column, e: Column) -> Column:
    """Whether the edge's two parts are symbols."""
    return _span(mask, e) == _bit(_first(e)) + _bit(_length(e)) + 1


def _merged(mask: Column, e: Column) -> Column:
    return mask - _bit(_start(e) + _first(e))


def _pass_fold(edges: Column, n: Column) -> Column:
    """Symbols after all merges, where no edge is late and the symbol starts, and the end, fit one mask."""
    return F.aggregate(edges, _bit(n + 1) - 1, lambda mask, e: F.when(_due(mask, e), _merged(mask, e)).otherwise(mask), lambda mask: _masked(mask, edges, n))


def _merge_fold(edges: Column, n: Column) -> Column:
    """The same with a pass for each merge, for any edges."""
    # The accumulator carries the edges: an expression outside would be evaluated again at each step.
    state = lambda mask, edges: F.struct(mask.alias("mask"), edges.alias("edges"))

    def merge(acc: Column, _: Column) -> Column:
        due = F.slice(F.filter(acc["edges"], lambda e: _due(acc["mask"], e)), 1, 1)
        return state(F.coalesce(F.get(F.transform(due, lambda e: _merged(acc["mask"], e)), F.lit(0)), acc["mask"]), acc["edges"])

    return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), state(_bit(n + 1) - 1, edges), merge, lambda acc: _masked(acc["mask"], edges, n))


def _long_merge_fold(edges: Column, n: Column) -> Column:
    """The same with an array of ones and zeros for the mask, for segments of any length."""
    ready = F.transform(F.filter(edges, lambda e: _length(e) > 1), lambda e: F.struct(_start(e).alias("p"), _first(e).alias("first"), _length(e).alias("length")))
    state = lambda starts, ready: F.struct(starts.alias("starts"), ready.alias("ready"))
    ones = lambda starts, p, length: F.aggregate(F.slice(starts, p + 2, length - 1), F.lit(0), lambda a, x: a + x)
    whole = lambda starts, p, length: (F.get(starts, p) == 1) & (F.get(starts, p + length) == 1)

    def merge(acc: Column, _: Column) -> Column:
        starts = acc["starts"]
        due = F.filter(acc["ready"], lambda r: whole(starts, r["p"], r["length"]) & (F.get(starts, r["p"] + r["first"]) == 1) & (ones(starts, r["p"], r["length"]) == 1))
        gone = lambda r: F.transform(starts, lambda x, i: F.when(i == r["p"] + r["first"], F.lit(0)).otherwise(x))
        return state(F.coalesce(F.get(F.transform(F.slice(due, 1, 1), gone), F.lit(0)), starts), acc["ready"])

    def finish(acc: Column) -> Column:
        starts = acc["starts"]
        return _symbols(edges, n, lambda e: whole(starts, _start(e), _length(e)) & (ones(starts, _start(e), _length(e)) == 0), lambda p: whole(starts, p, F.lit(1)))

    return F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), state(F.array_repeat(F.lit(1), n + 1), ready), merge, finish)


def _viterbi_fold(edges: Column, n: Column) -> Column:
    """Ids of the path of the best total score; of equal ones, that with the longer last piece. Every character is a piece."""
    step = lambda score, p, i: F.struct(score.alias("score"), p.alias("p"), i.alias("id"))
    none = step(F.lit(0.0), F.lit(0), F.lit(0))

    def reach(paths: Column, q: Column) -> Column:
        into = F.filter(edges, lambda e: e["q"] == q)
        options = F.transform(into, lambda e: F.struct((F.get(paths, e["p"])["score"] + e["score"]).alias("score"), (-e["p"]).alias("back"), e["id"].cast("int").alias("id")))
        best = F.array_max(options)
        return F.concat(paths, F.transform(F.array(best), lambda b: step(b["score"], -b["back"], b["id"])))

    def back(paths: Column) -> Column:
        # From the end: the ids so far, and where the next piece to the left ends.
        at = lambda acc: F.get(paths, acc["q"])
        walk = lambda acc, _: F.when(acc["q"] == 0, acc).otherwise(F.struct(F.concat(F.array(at(acc)["id"]), acc["ids"]).alias("ids"), at(acc)["p"].alias("q")))
        return F.aggregate(paths, F.struct(F.array().cast("array<int>").alias("ids"), n.alias("q")), walk)["ids"]

    return F.aggregate(F.sequence(F.lit(1), n), F.array(none), reach, back)


def encode_segments(segments: DataFrame, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, segment, ids: of segments of 1 to LONG_SEGMENT characters, all of them pieces; (keys, segment) is distinct.

    Of a BPE model, ids has characters as CHARACTER and code point; see final_ids. The rows
    are best dealt by a key, or by segment: then grouping their edges moves nothing.
    """
    pieces = _pieces(path)
    keys, n, p, q = (*keys, "segment"), F.length("segment"), F.col("p"), F.col("q")
    if pieces.kind == "bpe":  # of single characters, the first will do: no segment is without an edge
        starts, first = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), p + F.when(p == 0, 1).otherwise(2)
    else:
        starts, first = F.sequence(F.lit(0), n - 1), p + 1
    lattice = segments.select(*keys, F.explode(starts).alias("p"))
    lattice = lattice.select(*keys, "p", F.explode(F.sequence(first, F.least(p + pieces.longest, n))).alias("q"))
    piece = F.coalesce(F.substring("segment", p + 1, q - p), F.lit(""))  # never null, which saves a filter that takes it twice
    lattice = lattice.select(*keys, "p", "q", piece.alias("piece"))
    edges = lattice.join(F.broadcast(pieces.frame(segments.sparkSession)), "piece")
    edge = _edge(F.col("rank"), p, q - p, F.col("first"), F.col("id")) if pieces.kind == "bpe" else F.struct("p", "q", "id", "score")
    edges = edges.select(*keys, edge.alias("edge"), "late").groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.max("late").alias("late"))
    own = F.col("edges")
    if pieces.kind == "bpe":
        ids = F.when(n > MASK_BITS, _long_merge_fold(own, n)).when(F.col("late"), _merge_fold(own, n)).otherwise(_pass_fold(own, n))
    else:
        ids = _viterbi_fold(own, n)
    return edges.select(*keys, ids.alias("ids"))


@functools.lru_cache(maxsize=2)
def _character_ids(path: str) -> np.ndarray:
    out = np.zeros(0x110000, np.int32)
    for p, i, _ in _pieces(path).rows:
        if len(p) == 1:
            out[ord(p)] = i
    return out


def final_ids(path: str, ids: np.ndarray) -> np.ndarray:
    """ids with those of characters in the place of their code points."""
    ids = ids.astype(np.int32)
    at = ids >= CHARACTER
    ids[at] = _character_ids(path)[ids[at] - CHARACTER]
    return ids


# --- segments ---------------------------------------------------------------------
def _counted(path: str):
    """(segment, times) of words that a part has HOT_TIMES or more, and the characters read, under a null segment."""

    def counted(batches):
        pieces = _pieces(path)
        for part in parts(batches, COUNTED_CHARS):
            text = part.column("text")
            found = pc.value_counts(pc.split_pattern(text, " ").flatten())
            found = found.filter(pc.greater_equal(found.field("counts"), HOT_TIMES))
            segments, ends = pieces.segments(found.field("values"))
            segments = segments.dictionary_encode()
            times = np.zeros(len(segments.dictionary), np.int64)
            np.add.at(times, segments.indices.to_numpy(), np.repeat(found.field("counts").to_numpy(), np.diff(ends)))
            short = pc.less_equal(pc.utf8_length(segments.dictionary), LONG_SEGMENT)
            chars = pc.sum(pc.utf8_length(text)).as_py() or 0
            segments, times = segments.dictionary.filter(short), pa.array(times).filter(short)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([segments, pa.nulls(1, pa.string())]), pa.concat_arrays([times, pa.array([chars], pa.int64())])], ["segment", "times"])

    return counted


def _hot(docs: DataFrame, path: str) -> tuple[pa.Array, _Runs, int]:
    """The hot segments, most frequent first, their ids, and the characters of all texts."""
    pieces = _pieces(path)
    counts = settle(docs.select("text").mapInArrow(_counted(path), "segment string, times long").groupBy("segment").agg(F.sum("times").alias("times")), "counts")
    named = counts.where("segment IS NOT NULL")
    # Times by steps of about a tenth: few rows at any size; the lowest step at which all from there on are few enough.
    steps = named.groupBy(F.floor(F.log2("times") * 8).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("times").alias("times")).orderBy(F.desc("step")).collect()
    least, n = None, 0
    for row in steps:
        n += row.n
        if n > HOT_SEGMENTS:
            break
        least = row.times
    chars = counts.where("segment IS NULL").agg(F.sum("times")).first()[0] or 0
    if least is None:
        return pa.array([], pa.string()), _Runs(np.empty(0, np.int32), np.empty(0, np.int64)), chars
    hot = named.where(F.col("times") >= least)
    # Characters in no piece have their codes already; they are segments of one character.
    known = hot.where((F.length("segment") > 1) | F.col("segment").isin(sorted(pieces.single)))
    ids = encode_segments(known.select("segment").repartition("segment"), path)
    rows = ids.join(hot, "segment").toArrow().sort_by([("times", "descending"), ("segment", "ascending")])
    return pa.concat_arrays([pa.array([], pa.string()), *rows.column("segment").chunks]), _runs_of(path, rows.column("ids")), chars


class _Codes:
    """The codes of segments; those of a chunk that aren't hot are numbered as they come."""

    def __init__(self, hot: pa.Array, pieces: Pieces):
        self.pieces, self.hot, self.first = pieces, hot, 256 + len(hot)
        self.single = pa.array(sorted(pieces.single), pa.string())
        self.next_chunk()

    def next_chunk(self) -> None:
        self.rare, self.long = (pa.array([], pa.string()) for _ in range(2))

    @staticmethod
    def _numbers(segments: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The places of distinct segments in known, to which those that aren't there are added."""
        at = pc.index_in(segments, known)
        new = segments.filter(at.is_null())
        at = pc.fill_null(at, -1).to_numpy().astype(np.int64)
        at[at < 0] = len(known) + np.arange(len(new))
        return at, pa.concat_arrays([known, new])

    def _of_segments(self, segments: pa.Array) -> _Runs:
        """Of distinct segments: one code each, and the bytes of a character that is in no piece."""
        codes = pc.fill_null(pc.index_in(segments, self.hot), -1).to_numpy() + np.int64(256)
        lengths = np.ones(len(codes), np.int64)
        size = pc.utf8_length(segments).to_numpy()
        rest = np.flatnonzero(codes == 255)
        alone = rest[size[rest] == 1]
        alone = alone[~pc.is_in(segments.take(pa.array(alone)), self.single).to_numpy(zero_copy_only=False)]
        long = rest[size[rest] > LONG_SEGMENT]
        rare = np.setdiff1d(rest, np.concatenate([alone, long]), assume_unique=True)
        at, self.rare = self._numbers(segments.take(pa.array(rare)), self.rare)
        codes[rare] = self.first + at
        at, self.long = self._numbers(segments.take(pa.array(long)), self.long)
        codes[long] = LONG_CODE + at
        more = [s.encode() for s in segments.take(pa.array(alone)).to_pylist()]
        starts = np.arange(len(codes))
        lengths[alone] = list(map(len, more))
        starts[alone] = len(codes) + np.cumsum(lengths[alone]) - lengths[alone]
        return _Runs(np.concatenate([codes, np.frombuffer(b"".join(more), np.uint8)]).astype(np.uint32), lengths, starts)

    def of(self, texts: pa.Array) -> list[np.ndarray]:
        """Codes of each text (none of a null one)."""
        segments, ends = self.pieces.segments(pc.fill_null(texts, ""))
        found = segments.dictionary_encode()
        runs, at = self._of_segments(found.dictionary), found.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(runs.lengths[at])])[ends]
        return np.split(runs.of(at), ends[1:-1])


_CODES: dict = {}


def _codes(hot, path: str) -> _Codes:
    """One for each Python worker and run, which serves many tasks."""
    if hot.value is not _CODES.get("names"):
        _CODES.clear()
        _CODES.update(names=hot.value, codes=_Codes(hot.value, _pieces(path)))
    codes = _CODES["codes"]
    codes.next_chunk()
    return codes


_ROWS = "chunk long, doc_id long, codes binary, crc long, first int, segments string, long string"


def _chunks(path: str, hot):
    """Rows of texts (their codes as byte planes) and of segments (lists, and long ones one by one), chunk by chunk."""
    names = [c.split()[0] for c in _ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def rows(cols: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([(cols[c] if isinstance(cols[c], pa.Array) else pa.array(cols[c], k)) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def segments(chunk: int, codes: _Codes):
        rare, long = codes.rare.to_pylist(), codes.long.to_pylist()
        at = list(range(0, len(rare), 2000))
        if at:
            yield rows({"chunk": [chunk] * len(at), "first": at, "segments": ["\n".join(rare[i : i + 2000]) for i in at]}, len(at))
        for i, s in enumerate(long):
            yield rows({"chunk": [chunk], "first": [i], "long": [s]}, 1)

    def chunks(batches):
        chunk, size, codes = TaskContext.get().partitionId() << 24, 0, _codes(hot, path)
        for part in parts(batches, CODED_CHARS):
            if size >= CHUNK_CHARS or len(codes.rare) >= CHUNK_WORDS:
                yield from segments(chunk, codes)
                codes.next_chunk()
                chunk, size = chunk + 1, 0
            own = codes.of(part.column("text"))
            texts = part.column("text").to_pylist()
            size += sum(len(t or "") for t in texts)
            yield rows(
                {
                    "chunk": [chunk] * len(texts),
                    "doc_id": part.column("doc_id"),
                    "codes": [None if t is None else c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for t, c in zip(texts, own, strict=True)],
                    "crc": [zlib.crc32((t or "").replace(MARK, " ").encode()) for t in texts],
                },
                len(texts),
            )
        yield from segments(chunk, codes)

    return chunks


def _long_ids(path: str):
    @F.pandas_udf("array<int>")
    def long_ids(segments: pd.Series) -> pd.Series:
        import sentencepiece

        encoder = sentencepiece.SentencePieceProcessor(model_file=path)
        return pd.Series([encoder.encode("\n" + s)[2:] for s in segments])  # without the mark and the line end before it

    return long_ids


# --- texts ---------------------------------------------------------------------------
def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start to start + length - 1 of each, one after another."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


class _Runs:
    """Runs of values, by number."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, starts: np.ndarray | None = None):
        self.values, self.lengths, self.starts = values, lengths, np.cumsum(lengths) - lengths if starts is None else starts

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return self.values[_spread(self.starts[numbers], self.lengths[numbers])]

    def then(self, other: _Runs) -> _Runs:
        starts = np.concatenate([self.starts, other.starts + len(self.values)])
        return _Runs(np.concatenate([self.values, other.values]), np.concatenate([self.lengths, other.lengths]), starts)


def _runs(parts: list, dtype) -> _Runs:
    return _Runs(np.concatenate([np.empty(0, dtype), *parts]).astype(dtype), np.array(list(map(len, parts)), np.int64))


def _runs_of(path: str, ids: pa.ChunkedArray, order: np.ndarray | None = None) -> _Runs:
    """Of a list column, in the order given."""
    ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], ids.type)
    ends = ids.offsets.to_numpy().astype(np.int64)
    runs = _Runs(final_ids(path, ids.values.to_numpy()), np.diff(ends), ends[:-1])
    return runs if order is None else _Runs(runs.values, runs.lengths[order], runs.starts[order])


@functools.lru_cache(maxsize=2)
def _piece_bytes(path: str) -> _Runs:
    return _runs([np.frombuffer(t, np.uint8) for t in _pieces(path).text], np.uint8)


def _decoded(path: str, ids: np.ndarray) -> bytes:
    return _piece_bytes(path).of(ids).tobytes().replace(MARK.encode(), b" ")[1:]


def _assembled(path: str, hot):
    """Texts of a chunk from the ids of its segments; ids are decoded again to compare with the text's CRC."""

    def own(segments: pa.Table, long: bool) -> _Runs:
        part = segments.filter(pa.array(segments.column("long").to_numpy(zero_copy_only=False) == long))
        return _runs_of(path, part.column("ids"), np.argsort(part.column("idx").to_numpy()))

    def codes_of(planes: bytes | None, first_long: int) -> np.ndarray:
        codes = np.ascontiguousarray(np.frombuffer(planes or b"", np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        return np.where(codes >= LONG_CODE, codes - LONG_CODE + first_long, codes)

    def part(docs: pa.Table, codes: list[np.ndarray], runs: _Runs) -> pa.Table:
        ends = np.cumsum([0, *map(len, codes)])
        codes = np.concatenate(codes)
        ids, sums = runs.of(codes), np.concatenate([[0], np.cumsum(runs.lengths[codes])])[ends]
        pieces = _piece_bytes(path)
        data, cuts = pieces.of(ids).tobytes(), np.concatenate([[0], np.cumsum(pieces.lengths[ids])])[sums].tolist()
        plain = [zlib.crc32(data[a:b].replace(MARK.encode(), b" ")[1:]) for a, b in itertools.pairwise(cuts)]
        null = docs.column("codes").is_null().to_numpy(zero_copy_only=False)
        same = pa.array(np.array(plain) == docs.column("crc").to_numpy(), mask=null)
        return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(sums, pa.int32()), pa.array(ids), mask=pa.array(null)), "round_trip": same})

    def assembled(docs: pa.Table, segments: pa.Table) -> pa.Table:
        short = hot.value.then(own(segments, False))
        runs, out = short.then(own(segments, True)), []
        at, size, held = 0, 0, []
        for i, planes in enumerate(docs.column("codes")):
            held.append(codes_of(planes.as_py(), len(short.lengths)))
            size += len(held[-1])
            if size >= ASSEMBLED_CODES or i + 1 == docs.num_rows:
                out.append(part(docs.slice(at, len(held)), held, runs))
                at, size, held = i + 1, 0, []
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int32())), "round_trip": pa.array([], pa.bool_())})

    return assembled


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, round_trip), a row for each row of docs; round_trip: whether the ids decode to the text."""
    path = path or model_file()
    pieces, spark = _pieces(path), docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Edges of a segment come together, so hash tables of this many segments stay small; sorting them instead would spill.
    conf, name = spark.conf, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = conf.get(name)
    conf.set(name, SEGMENTS_IN_MEMORY)
    try:
        names, hot_ids, chars = _hot(docs, path)
        send = spark.sparkContext.broadcast
        buckets = min(max(2 * chars // CHUNK_CHARS, int(conf.get("spark.sql.shuffle.partitions"))), 100_000)
        rows = settle_buckets(docs.mapInArrow(_chunks(path, send(names)), _ROWS), "chunks", "chunk", buckets)
        short = rows.where("segments IS NOT NULL").select("chunk", "first", F.posexplode(F.split("segments", "\n")).alias("at", "segment"))
        short = encode_segments(short.select("chunk", (F.col("first") + F.col("at")).alias("idx"), "segment"), path, ("chunk", "idx"))
        long = rows.where("long IS NOT NULL").select("chunk", F.col("first").alias("idx"), _long_ids(path)("long").alias("ids"), F.lit(True).alias("long"))
        known = settle_buckets(short.select("chunk", "idx", "ids", F.lit(False).alias("long")).unionByName(long), "segments", "chunk", buckets)
    finally:
        conf.set(name, before)
    hot = _runs([np.array([i]) for i in pieces.bytes], np.int32).then(hot_ids)
    texts = rows.where("crc IS NOT NULL").select("chunk", "doc_id", "codes", "crc")
    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_assembled(path, send(hot)), "doc_id long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with a column decoded: the text of its ids (null for null); bytes that aren't UTF-8 become U+FFFD."""
    path = path or model_file()

    @F.pandas_udf("string")
    def plain(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: None if x is None else _decoded(path, np.array(x, np.int64)).decode("utf-8", "replace"))

    return encoded.withColumn("decoded", plain("ids"))
