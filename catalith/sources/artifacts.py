"""Web pages as stored artifacts: parsed within stated limits, with addresses for every piece of text and every JSON node.

A page over a limit is refused with a status and has no content; nothing is cut.
Addresses are those of a parse: a text fragment has the number of its element and
its place in the visible text, a JSON node the number of its block and a JSON pointer.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from catalith.operators.webidentity import primary_pointers
from catalith.sources.html import VOID

# Media types that are read, elements whose text isn't, and the limits of a page.
MEDIA_TYPES = ("text/html", "application/xhtml+xml")
UNSEEN = frozenset("head style noscript template nav iframe script".split())
MAX_BYTES = 5 * 1024 * 1024
MAX_ELEMENTS = 100_000
MAX_TEXT = 2_000_000
MAX_BLOCKS = 100

CONTENT = (
    "title string, canonical string, meta map<string,string>, visible string, elements int, "
    "fragments array<struct<text:string,element:int,begin:int,end:int>>, blocks array<struct<raw:string,json:string,error:string>>"
)


#: Pages, and bytes of them, that a task holds as Python objects at once.
AT_ONCE, BYTES_AT_ONCE = 256, 4 << 20


def pieces(batches, column: str, rows: int = AT_ONCE, size: int = BYTES_AT_ONCE):
    """Arrow batches cut into pieces of so many rows, and of so many bytes of a column, at most; a row is never cut. Arrow's batches of 10,000 pages would all be Python objects at once."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(lengths):
            if i > start and (i - start >= rows or held + n > size):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


class Refused(Exception):
    """A limit is exceeded while the page is read."""


class _Snapshot(HTMLParser):
    def __init__(self, elements: int, text: int, blocks: int):
        super().__init__(convert_charrefs=True)
        self.most = elements, text, blocks
        self.open: list[tuple[str, int, bool]] = []
        self.elements = self.unseen = self.chars = 0
        self.title, self.canonical, self.meta = [], None, {}
        self.shown: list[tuple[str, int]] = []
        self.raw: list[str] = []
        self.block: list[str] | None = None

    def _enter(self, tag, attrs, closed):
        self.elements += 1
        if self.elements > self.most[0]:
            raise Refused("TOO_MANY_ELEMENTS")
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and self.canonical is None and "canonical" in a.get("rel", "").casefold().split() and a.get("href", "").strip():
            self.canonical = a["href"].strip()
        name, content = (a.get("name") or a.get("property") or "").casefold(), " ".join(a.get("content", "").split())
        if tag == "meta" and name and content:
            self.meta.setdefault(name, content)
        if tag == "script" and a.get("type", "").split(";", 1)[0].strip().casefold() == "application/ld+json":
            if len(self.raw) >= self.most[2]:
                raise Refused("TOO_MANY_JSONLD_BLOCKS")
            self.block = []
        if not closed and tag not in VOID:
            unseen = tag in UNSEEN or "hidden" in a or a.get("aria-hidden", "").casefold() == "true" or a.get("role", "").casefold() == "navigation"
            self.open.append((tag, self.elements - 1, unseen))
            self.unseen += unseen

    def handle_starttag(self, tag, attrs):
        self._enter(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._enter(tag, attrs, True)

    def handle_endtag(self, tag):
        if tag == "script":
            self._end_block()
        names = [t for t, _, _ in self.open]
        if tag in names:
            at = len(names) - 1 - names[::-1].index(tag)
            self.unseen -= sum(u for _, _, u in self.open[at:])
            del self.open[at:]

    def handle_data(self, data):
        if self.block is not None:
            self.block.append(data)
        text = " ".join(data.split())
        if text and self.open and self.open[-1][0] == "title":
            self.title.append(text)
        if self.unseen or not text:
            return
        self.chars += len(text) + bool(self.shown)
        if self.chars > self.most[1]:
            raise Refused("TOO_MUCH_TEXT")
        self.shown.append((text, self.open[-1][1] if self.open else 0))

    def _end_block(self):
        if self.block is not None:
            self.raw.append("".join(self.block).strip())
            self.block = None

    def close(self):
        super().close()
        self._end_block()  # one that never ends is kept, and is malformed as a rule


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _block(raw: str) -> dict:
    def refuse(constant):
        raise ValueError(f"constant {constant}")

    try:
        return {"raw": raw, "json": canonical_json(json.loads(raw, parse_constant=refuse)), "error": None}
    except (ValueError, RecursionError) as e:
        return {"raw": raw, "json": None, "error": type(e).__name__}


def read_snapshot(html: str, elements: int = MAX_ELEMENTS, text: int = MAX_TEXT, blocks: int = MAX_BLOCKS) -> tuple[str, dict | None]:
    """(status, content): PARSED, or what was exceeded with no content."""
    page = _Snapshot(elements, text, blocks)
    try:
        page.feed(html)
        page.close()
    except Refused as e:
        return str(e), None
    except (AssertionError, ValueError, RecursionError):
        return "MALFORMED", None
    fragments, at = [], 0
    for t, element in page.shown:
        fragments.append({"text": t, "element": element, "begin": at, "end": at + len(t)})
        at += len(t) + 1
    return "PARSED", {
        "title": " ".join(page.title) or None, "canonical": page.canonical, "meta": list(page.meta.items()), "visible": "\n".join(t for t, _ in page.shown),
        "elements": page.elements, "fragments": fragments, "blocks": [_block(r) for r in page.raw],
    }


def read_artifacts(pages: DataFrame, id_col: str, html: str = "html", media_type: str | None = None, max_bytes: int = MAX_BYTES, **limits: int) -> DataFrame:
    """(id_col, sha256, n_bytes, status, content), a row for each page.

    status: NOT_HTML (of another media type), EMPTY (null or no bytes), TOO_MANY_BYTES, PDF_SIGNATURE,
    NOT_UTF8, TOO_MANY_ELEMENTS, TOO_MUCH_TEXT, TOO_MANY_JSONLD_BLOCKS, MALFORMED or PARSED; the first that
    holds counts. content is a struct of CONTENT, null unless PARSED. html may be text or binary.
    """
    data = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    kind = F.lower(F.trim(F.split_part(F.coalesce(F.col(media_type), F.lit("")), F.lit(";"), F.lit(1)))) if media_type else F.lit(MEDIA_TYPES[0])
    refusal = (
        F.when(~kind.isin(*MEDIA_TYPES), "NOT_HTML")
        .when(F.length(data) == 0, "EMPTY")
        .when(F.length(data) > max_bytes, "TOO_MANY_BYTES")
        .when(F.hex(F.substring(data, 1, 5)) == F.lit(b"%PDF-".hex().upper()), "PDF_SIGNATURE")
    )
    slim = pages.select(F.col(id_col), F.when(refusal.isNull(), data).alias("data"), F.length(data).alias("n_bytes"), F.sha2(data, 256).alias("sha256"), refusal.alias("status"))
    id_type = dict(slim.dtypes)[id_col]
    content = to_arrow_type(StructType.fromDDL(f"content struct<{CONTENT}>")["content"].dataType)

    def parsed(batches):
        for batch in pieces(batches, "data"):
            statuses, contents = [], []
            for status, raw in zip(batch.column("status").to_pylist(), batch.column("data").to_pylist(), strict=True):
                found = None
                if status is None:
                    try:
                        status, found = read_snapshot(raw.decode("utf-8-sig"), **limits)
                    except UnicodeDecodeError:
                        status = "NOT_UTF8"
                statuses.append(status)
                contents.append(found)
            cols = [batch.column(id_col), batch.column("sha256"), batch.column("n_bytes"), pa.array(statuses, pa.string()), pa.array(contents, content)]
            yield pa.RecordBatch.from_arrays(cols, [id_col, "sha256", "n_bytes", "status", "content"])

    return slim.mapInArrow(parsed, f"{id_col} {id_type}, sha256 string, n_bytes int, status string, content struct<{CONTENT}>")


def text_fragments(artifacts: DataFrame, id_col: str) -> DataFrame:
    """(id_col, text, element, begin, end): every fragment of visible text."""
    return artifacts.select(id_col, F.inline("content.fragments"))


def json_blocks(artifacts: DataFrame, id_col: str) -> DataFrame:
    """(id_col, block, raw, json, error): every JSON-LD block, malformed ones too."""
    return artifacts.select(id_col, F.posexplode("content.blocks").alias("block", "b")).select(id_col, "block", "b.*")


_NODE = "block int, pointer string, parent string, member string, kind string, holders array<string>, text string, is_primary boolean"


def _kind(value) -> str:
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    return {dict: "object", list: "array", str: "string"}.get(type(value), "number")


def _nodes(document):
    """(pointer, parent, member, kinds of it and what holds it, value) of a JSON value and all that lies in it."""
    todo = [("", None, None, ("", ""), document)]
    while todo:
        at, above, name, holders, v = todo.pop()
        kinds = (_kind(v), *holders[:2])
        yield at, above, name, kinds, v
        inner = v.items() if kinds[0] == "object" else enumerate(v) if kinds[0] == "array" else ()
        todo += [(f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}", at, str(k), kinds, x) for k, x in inner]


def json_nodes(artifacts: DataFrame, id_col: str) -> DataFrame:
    """Every JSON node as a row: (id_col, block, pointer, parent, member, kind, holders, text, is_primary).

    holders are the kinds of its parent and of the parent's parent, empty above the document. text is that of scalars, and of whole values of members named value; strings are
    plain, the rest canonical JSON. is_primary marks the products that their block is about.
    """
    blocks = json_blocks(artifacts, id_col).where("json IS NOT NULL").select(id_col, "block", "json")
    types = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_())

    def nodes(batches):
        for batch in pieces(batches, "json"):
            at, rows = [], []
            for i, (block, text) in enumerate(zip(batch.column("block").to_pylist(), batch.column("json").to_pylist(), strict=True)):
                value = json.loads(text)
                primary = primary_pointers(value)
                for pointer, parent, member, (kind, *holders), v in _nodes(value):
                    shown = v if kind == "string" else canonical_json(v) if kind not in ("object", "array") or member == "value" else None
                    at.append(i)
                    rows.append((block, pointer, parent, member, kind, holders, shown, kind == "object" and pointer in primary))
            cols = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [id_col, *(x.split()[0] for x in _NODE.split(", "))])

    return blocks.mapInArrow(nodes, f"{id_col} {dict(blocks.dtypes)[id_col]}, {_NODE}")

