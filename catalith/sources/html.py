"""Reading web pages: visible text, title, canonical link, meta and JSON-LD, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content isn't shown, and those that have no end tag.
HIDDEN = frozenset("head style noscript template nav iframe script".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Pages that a task holds as Python objects at once.
AT_ONCE = 256
SCHEMA = "title string, canonical string, visible string, fragments int, jsonld array<string>, jsonld_errors int, meta map<string,string>"


class Page(HTMLParser):
    """Collects what a reader of the page sees, and its structured blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.title, self.canonical, self.meta = [], None, {}
        self.fragments: list[str] = []
        self.block: list[str] | None = None
        self.jsonld, self.errors = [], 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split() and self.canonical is None:
            self.canonical = a.get("href")
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag == "script" and a.get("type", "").lower() == "application/ld+json":
            self.block = []
        if tag not in VOID:
            hidden = tag in HIDDEN or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() == "navigation"
            self.stack.append((tag, hidden or bool(self.stack and self.stack[-1][1])))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "script" and self.block is not None:
            self._block("".join(self.block))
            self.block = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def _block(self, text):
        def refuse(x):
            raise ValueError(x)

        try:
            self.jsonld.append(json.dumps(json.loads(text, parse_constant=refuse), sort_keys=True, separators=(",", ":"), ensure_ascii=False))
        except ValueError:
            self.errors += 1

    def handle_data(self, data):
        if self.block is not None:
            self.block.append(data)
        elif self.stack and self.stack[-1][0] == "title":
            self.title.append(data)
        elif not (self.stack and self.stack[-1][1]) and (text := " ".join(data.split())):
            self.fragments.append(text)


def read_page(html: str | None) -> tuple:
    page = Page()
    page.feed(html or "")
    page.close()
    return " ".join("".join(page.title).split()) or None, page.canonical, "\n".join(page.fragments), len(page.fragments), page.jsonld, page.errors, page.meta


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with a struct column `page` of SCHEMA; a null page has no text."""

    @F.pandas_udf(SCHEMA)
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:  # a batch has up to 10,000 pages
            for at in range(0, len(texts), AT_ONCE):
                yield pd.DataFrame(list(map(read_page, texts[at : at + AT_ONCE])), columns=["title", "canonical", "visible", "fragments", "jsonld", "jsonld_errors", "meta"])

    return pages.withColumn("page", parsed(F.col(html)))


def products(pages: DataFrame, id_col: str) -> DataFrame:
    """(id_col, pointer, node): every JSON-LD node of type Product in column page, at any depth, with its JSON pointer."""

    def walk(node, pointer):
        if isinstance(node, dict):
            kinds = node.get("@type", [])
            if "Product" in (kinds if isinstance(kinds, list) else [kinds]):
                yield pointer, node
            for k, v in node.items():
                yield from walk(v, f"{pointer}/{k.replace('~', '~0').replace('/', '~1')}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                yield from walk(v, f"{pointer}/{i}")

    def found(frames):
        for pdf in frames:
            rows = [(i, f"/{b}{p}", json.dumps(n, sort_keys=True, ensure_ascii=False)) for i, blocks in zip(pdf[id_col], pdf["jsonld"], strict=True) for b, text in enumerate(blocks if blocks is not None else []) for p, n in walk(json.loads(text), "")]
            yield pd.DataFrame(rows, columns=[id_col, "pointer", "node"])

    slim = pages.select(id_col, F.col("page.jsonld").alias("jsonld"))
    return slim.mapInPandas(found, f"{id_col} {dict(slim.dtypes)[id_col]}, pointer string, node string")
