"""Catalogue files: delimited input with a checked header, delivery contracts, and delivery output."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from catalith.operators.catalogue import FIELDS


#: Lines that a header record may take.
HEADER_LINES = 50


class HeaderError(ValueError):
    """A header that lacks a required column or has one twice."""


def first_record(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",") -> list[str]:
    """The header record of a delimited file, read by Spark so that any store works; it may hold quoted line ends."""
    head, quotes = "", 0
    for row in spark.read.option("encoding", encoding).text(path).limit(HEADER_LINES).toLocalIterator():
        head += ("\n" if head else "") + row.value
        quotes = head.count('"')
        if quotes % 2 == 0:
            break
    if quotes % 2:
        raise HeaderError(f"a quote in the header isn't closed within {HEADER_LINES} lines")
    return next(csv.reader(io.StringIO(head.removeprefix("﻿")), delimiter=sep), [])


def check_header(header: list[str], required: tuple[str, ...] = FIELDS) -> list[str]:
    """The columns beyond the required ones, in order; columns go by name, never by place."""
    twice = sorted({c for c in header if header.count(c) > 1})
    if twice:
        raise HeaderError(f"column given twice: {', '.join(twice)}")
    missing = [c for c in required if c not in header]
    if missing:
        raise HeaderError(f"column missing: {', '.join(missing)}")
    return [c for c in header if c not in required]


def read_catalogue(spark: SparkSession, path: str, required: tuple[str, ...] = FIELDS) -> DataFrame:
    """The required fields as text (empty, not null), extra fields as a map, and malformed for records of a wrong width.

    Quoted line ends are legal, so each file is read whole by one task; give many files
    for many tasks. Blank records are skipped.
    """
    header = first_record(spark, path)
    extras = check_header(header, required)
    schema = StructType([StructField(c, StringType()) for c in header] + [StructField("_bad", StringType())])
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    text = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    extra = F.create_map(*[x for c in extras for x in (F.lit(c), text(c))]) if extras else F.create_map().cast("map<string,string>")
    return rows.select(*[text(c).alias(c) for c in required], extra.alias("extra"), F.col("_bad").isNotNull().alias("malformed"))


# --- delivery contracts -----------------------------------------------------------
_SLOT = re.compile(r"ATTRIBUTE_(LABEL|VALUE|UOM) ?(\d+)")


class DeliveryContract:
    """Ordered headers, with numbered attribute triplets found by name."""

    def __init__(self, headers: list[str]):
        check_header(headers, ())
        self.headers = headers
        found: dict[int, dict[str, str]] = {}
        for h in headers:
            if m := _SLOT.fullmatch(h):
                found.setdefault(int(m[2]), {})[m[1]] = h
        for i, parts in found.items():
            if len(parts) < 3:
                raise HeaderError(f"attribute slot {i} lacks {', '.join(sorted({'LABEL', 'VALUE', 'UOM'} - set(parts)))}")
        if sorted(found) != list(range(1, len(found) + 1)):
            raise HeaderError("attribute slots are not 1, 2, 3, ...")
        self.slots = [found[i] for i in sorted(found)]

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> DeliveryContract:
        return cls(first_record(spark, path))

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.headers, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def assemble(self, base: DataFrame, facts: DataFrame, key: str) -> DataFrame:
        """Delivery rows: base columns by name, facts (key, slot, label, value, uom) in their slots, empty text elsewhere.

        A slot beyond the contract stops the job; nothing is cut off.
        """
        fits = F.assert_true(F.col("slot") <= len(self.slots), F.lit("more attributes than the contract has slots"))
        cells = facts.select(key, "slot", F.struct("label", "value", "uom").alias("cell"), fits.alias("ok")).where("ok IS NULL")
        packed = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "cell"))).alias("cells"))
        rows = base.join(packed, key, "left")
        out, part = [], {}
        for i, names in enumerate(self.slots, 1):
            for kind, h in names.items():
                part[h] = F.try_element_at("cells", F.lit(i))[kind.lower()]
        for h in self.headers:
            c = part.get(h, F.col(f"`{h}`") if h in base.columns else F.lit(None))
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(h))
        return rows.select(key, *out) if key not in self.headers else rows.select(*out)


def conformance(actual: list[str], expected: list[str]) -> dict:
    """How two header lists differ."""
    order = next((i for i, (a, b) in enumerate(zip(actual, expected, strict=False)) if a != b), None)
    return {"count": len(actual) == len(expected), "missing": [h for h in expected if h not in actual], "extra": [h for h in actual if h not in expected], "first_divergence": order}


def write_delivery(rows: DataFrame, path: str) -> None:
    """Delimited output with a header; text is quoted where it must be, empty text stays empty."""
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")
