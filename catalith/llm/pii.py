"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds spans they miss.

The model reads overlapping windows around digits, `@` and pairs of colons that no
pattern span covers, as far on either side as the longest sound span. Neighbouring
windows share as much as that span and a margin on either side, so each such span lies
inside the margins of a window, which has it whole; spans that reach into a margin are
left to the next window (the ends of a stretch have none). Of the spans of all windows,
and the unions of those of one kind that overlap, the longest sound ones that are apart
are taken. A span counts only if it is sound: an email has an `@` and a dotted host, an
ip is an IPv6 address, a card passes Luhn over 12 to 19 digits, a phone has 9 to 15
digits in groups; none is longer than 96 characters. Each needs nine digits, an `@` or
two colons with at most four hexadecimal digits between them, so stretches with none of
them are not read; that loses nothing. A span that touches a pattern span is left out.

Training: windows with labelled spans that labelled_windows() makes by rule; once
for each process. Defined results: a null text is empty; an empty or very long one
is handled like any other; repeated rows are judged apart, alike.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.bilstm_crf import KINDS, PAD, WINDOW, Tagger, char_ids, spans_of
from catalith.llm.common import begins, slices

Span = tuple[int, int, int]  # kind index, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is entered at its first digit alone, which is where the leftmost match starts.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
#: Every sound span holds one: an IPv6 address without a digit has `::`, or eight groups and so one between two colons.
_ANCHOR = re.compile(r"[0-9@]|:(?=[0-9A-Fa-f]{0,4}:)")
#: Anchors this near to each other are read in one stretch, with as many characters on either side: a sound span is no longer.
REACH = WINDOW
#: The model reads READ characters at once and counts what lies MARGIN from either edge; the longest sound span has WINDOW.
MARGIN, STEP = 24, WINDOW
READ = STEP + WINDOW + 2 * MARGIN
BATCH = 256


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Pattern spans by start, then kind."""
    out = []
    if not _ANCHOR.search(text):
        return out
    out += [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def sound(kind: int, value: str) -> bool:
    digits = "".join(_DIGITS.findall(value))
    if len(value) > WINDOW:
        return False
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@.]+(\.[^\s@.]+)+", value))
    if kind == 1:
        try:
            return ipaddress.ip_address(value).version == 6
        except ValueError:
            return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^\W\d_]", value)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9]+(?:[ ().\-/ ]{1,2}[0-9]+)+", value))


# --- labelled spans ---------------------------------------------------------
_SYLLABLES = "an be cor dan el fi gor hin is jo ka lu mer no or pa qui re st th ti un ver wo ya é ö ñ ß ing tion".split()


def labelled_windows(n: int = 1600, seed: int = 9) -> list[tuple[str, list[Span]]]:
    """Snippets of made-up prose with personal data and with things that only look so."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(int(rng.integers(1, 4))))
    ascii_word = lambda: "".join(pick(_SYLLABLES[:25]) for _ in range(int(rng.integers(1, 4))))
    num = lambda k: "".join(str(int(rng.integers(10))) for _ in range(k))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def card():
        body = "4" + num(14)
        digits = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        return pick(("", " ", "-", ".", "/", "  ")).join(digits[i : i + 4] for i in range(0, 16, 4))

    def phone():
        sep = pick((" ", "-", ".", "/"))
        return pick((f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", sep.join((num(3), num(3), num(4))), f"00{num(2)}{sep}{num(2)}{sep}{num(7)}", f"0{num(3)}{sep}{num(3)}{sep}{num(4)}", f"+{num(2)} {num(2)} {num(7)}"))

    make = (
        lambda: f"{pick((word, ascii_word))()}{pick(('', '.', '_'))}{ascii_word()}{pick(('', num(2)))}@{pick((word, ascii_word))()}.{pick(('com', 'org', 'example.com', 'de'))}",
        lambda: ".".join(str(int(rng.integers(256))) for _ in range(4)) if rng.random() < 0.5 else ":".join(hexa(4) for _ in range(8)) if rng.random() < 0.6 else f"{hexa(4)}:{hexa(3)}::{hexa(2)}",
        card,
        phone,
    )
    false = (
        lambda: f"version {num(1)}.{num(1)}",
        lambda: f"password={hexa(18)}",
        lambda: f'token = "{hexa(40)}"',
        lambda: "AKIA" + "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)),
        lambda: f"20{num(2)}-0{num(1)}-1{num(1)}",
        lambda: f"1{num(1)}:{num(2)}:{num(2)}",
        lambda: f"{num(2)}.{num(3)}.{num(3)}",
        lambda: f"ISBN 978-{num(1)}-{num(3)}-{num(5)}-{num(1)}",
        lambda: f"@{ascii_word()}",
        lambda: num(int(rng.integers(1, 12))),
        lambda: f"{num(4)}-{num(4)}",
        lambda: f"{ascii_word()}:{num(2)} ({num(1)})",
    )
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(int(rng.integers(0, 6)))), []
        text += pick((" ", "\n", ": ")) if text else ""
        while len(text) < WINDOW - 30:
            if rng.random() < 0.45:
                kind = int(rng.integers(4))
                item = make[kind]()
                spans.append((kind, len(text), len(text) + len(item)))
            else:
                item = pick(false)() if rng.random() < 0.4 else word()
            text += item + pick((" ", " ", " ", ", ", ". ", ".\n"))
        out.append((text, spans))
    return out


def to_arrays(rows: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    ids, tags = np.full((len(rows), WINDOW), PAD, np.int16), np.zeros((len(rows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(rows):
        own = char_ids(text[:WINDOW])
        ids[i, : len(own)] = own
        for kind, s, e in spans:
            if s < WINDOW:
                tags[i, s:e] = 2 + 2 * kind
                tags[i, s] = 1 + 2 * kind
    return ids, tags


@functools.lru_cache(maxsize=1)
def trained(epochs: int = 8) -> Tagger:
    tagger = Tagger()
    tagger.train(*to_arrays(labelled_windows()), epochs=epochs)
    return tagger


# --- search -------------------------------------------------------------------
def stretches(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Parts of the text that can hold a sound span outside the base spans."""
    out: list[list[int]] = []
    covered = sorted((s, e) for _, s, e in base)
    k = 0
    for m in _ANCHOR.finditer(text):
        at = m.start()
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        if k < len(covered) and covered[k][0] <= at:
            continue
        if out and at - out[-1][1] <= REACH:
            out[-1][1] = at + 1
        else:
            out.append([at, at + 1])
    kept = []
    for s, e in out:
        s, e = max(0, s - REACH), min(len(text), e + REACH)
        part = text[s:e]
        if "@" in part or part.count(":") > 1 or len(_DIGITS.findall(part)) >= 9:
            kept.append((s, e))
    return kept


def _windows(s: int, e: int) -> list[tuple[int, int, int, int]]:
    """(start, end, first, last): the window, and between which places its spans count."""
    starts = list(range(s, max(s + 1, e - READ + STEP), STEP))
    return [(a, min(a + READ, e), s if i == 0 else a + MARGIN, e if i == len(starts) - 1 else a + READ - MARGIN) for i, a in enumerate(starts)]


def added_spans(tagger: Tagger, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
    """What the model adds to the base spans of each text."""
    jobs: dict[int, list[tuple[int, int, int, int, int]]] = {}  # by padded width, which is a window's own: results don't hang on the batch
    for i, text in enumerate(texts):
        for s, e in stretches(text, bases[i]):
            for w in _windows(s, e):
                jobs.setdefault(max(WINDOW, -(-(w[1] - w[0]) // MARGIN) * MARGIN), []).append((i, *w))
    found: list[list[Span]] = [[] for _ in texts]
    for width, own in jobs.items():
        for at in range(0, len(own), BATCH):
            part = own[at : at + BATCH]
            ids = np.full((len(part), width), PAD, np.int16)
            for row, (i, a, b, *_) in zip(ids, part, strict=True):
                row[: b - a] = char_ids(texts[i][a:b])
            for (i, a, b, first, last), tags in zip(part, tagger.decode(ids), strict=True):
                found[i] += [(int(k), a + s, min(a + e, b)) for k, s, e in spans_of(tags) if first <= a + s < b and min(a + e, b) <= last]
    return [_reconciled(text, base, spans) if spans else [] for text, base, spans in zip(texts, bases, found, strict=True)]


def _reconciled(text: str, base: list[Span], spans: list[Span]) -> list[Span]:
    """The longest sound spans that touch neither each other nor a base span."""
    joined: list[list[int]] = []
    last: dict[int, list[int]] = {}
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
        if k in last and s < last[k][2]:
            last[k][2] = max(e, last[k][2])
        else:
            last[k] = [k, s, e]
            joined.append(last[k])
    taken = sorted((s, e) for _, s, e in base)
    sane, b = set(), 0
    for k, s, e in sorted({*spans, *map(tuple, joined)}, key=lambda x: x[1]):
        while s < e and text[s] in " \n,;:.":
            s += 1
        while e > s and text[e - 1] in " \n,;:.-":
            e -= 1
        sane.add((k, s, e))
    clear = []
    for k, s, e in sorted(sane, key=lambda x: x[1]):
        while b < len(taken) and taken[b][1] <= s:
            b += 1
        if (b == len(taken) or taken[b][0] >= e) and s < e and sound(k, text[s:e]):
            clear.append((k, s, e))
    out: list[Span] = []
    for k, s, e in sorted(clear, key=lambda x: (x[1] - x[2], x[1], x[0])):
        at = bisect.bisect_left(out, s, key=lambda x: x[1])
        if (at == len(out) or out[at][1] >= e) and (at == 0 or out[at - 1][2] <= s):
            out.insert(at, (k, s, e))
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])))


def _scan(held):
    """Arrow batches to (texts, base spans, added spans)."""

    def scan(batch):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        bases = [base_spans(t) for t in texts]
        return texts, bases, added_spans(held.value, texts, bases)

    return scan


def find_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added): counts and hash are of the base spans."""
    scan = _scan(docs.sparkSession.sparkContext.broadcast(tagger or trained()))
    names = ["n_email", "n_ip", "n_card", "n_phone"]

    def found(batches):
        begins("pii")
        for batch in slices(batches):
            _, bases, added = scan(batch)
            counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(spelled(b).encode()).hexdigest() for b in bases], pa.string())
            spans = pa.array([spelled(b + a) for b, a in zip(bases, added, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, sha, spans, pa.array(list(map(len, added)), pa.int64())], ["doc_id", *names, "base_sha256", "spans", "n_added"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """Each span becomes its kind in angle brackets; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0], x[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with personal data masked in the column text (null stays null); other columns are as they were."""
    scan = _scan(docs.sparkSession.sparkContext.broadcast(tagger or trained()))

    def masked(batches):
        begins("pii")
        for batch in slices(batches):
            texts, bases, added = scan(batch)
            null = batch.column("text").is_null().to_pylist()
            new = [None if n else redacted(t, b + a) if b or a else t for n, t, b, a in zip(null, texts, bases, added, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(masked, docs.withColumn("text", F.col("text").cast("string")).schema)
