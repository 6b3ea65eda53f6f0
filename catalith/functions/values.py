"""Numbers, units, ranges, booleans and quantities in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.text import col, strip

# Unit symbol, dimension, factor to the dimension's base unit.
UNITS = (
    ("A", "current", "1"), ("mA", "current", "0.001"), ("kA", "current", "1000"),
    ("V", "voltage", "1"), ("mV", "voltage", "0.001"), ("kV", "voltage", "1000"),
    ("W", "power", "1"), ("mW", "power", "0.001"), ("kW", "power", "1000"), ("MW", "power", "1000000"),
    ("VA", "apparent_power", "1"), ("kVA", "apparent_power", "1000"),
    ("var", "reactive_power", "1"), ("kvar", "reactive_power", "1000"),
    ("mm", "length", "1"), ("cm", "length", "10"), ("m", "length", "1000"), ("in", "length", "25.4"),
    ("g", "mass", "1"), ("mg", "mass", "0.001"), ("kg", "mass", "1000"),
    ("Hz", "frequency", "1"), ("kHz", "frequency", "1000"), ("MHz", "frequency", "1000000"),
    ("s", "time", "1"), ("ms", "time", "0.001"), ("min", "time", "60"), ("h", "time", "3600"),
    ("Ω", "resistance", "1"), ("kΩ", "resistance", "1000"), ("MΩ", "resistance", "1000000"),
    ("°C", "temperature", "1"), ("K", "temperature", "1"),
)
AFFINE = ("°C", "K")


def units(spark: SparkSession) -> DataFrame:
    """(symbol, dimension, factor, affine, position); 33 rows, so it is broadcast."""
    rows = [(s, d, f, s in AFFINE, i) for i, (s, d, f) in enumerate(UNITS)]
    return spark.createDataFrame(rows, "symbol string, dimension string, factor string, affine boolean, position int").withColumn("factor", F.col("factor").cast("decimal(14,4)"))


def convert(df: DataFrame, value: str, source: str, target: str) -> DataFrame:
    """Adds converted and convert_status: CONVERTED, IDENTITY, UNKNOWN_UNIT, INCOMPATIBLE or AFFINE_REFUSED."""
    table = units(df.sparkSession)
    side = lambda p: F.broadcast(table.select(*[F.col(c).alias(f"{p}_{c}") for c in ("symbol", "dimension", "factor", "affine")]))
    out = df.join(side("_s"), strip(source) == F.col("_s_symbol"), "left").join(side("_t"), strip(target) == F.col("_t_symbol"), "left")
    status = (
        F.when(F.col("_s_symbol").isNull() | F.col("_t_symbol").isNull(), "UNKNOWN_UNIT")
        .when(F.col("_s_dimension") != F.col("_t_dimension"), "INCOMPATIBLE")
        .when(F.col("_s_symbol") == F.col("_t_symbol"), "IDENTITY")
        .when(F.col("_s_affine") | F.col("_t_affine"), "AFFINE_REFUSED")
        .otherwise("CONVERTED")
    )
    x = F.col(value).cast("decimal(20,9)")
    scaled = (x * F.col("_s_factor").cast("decimal(12,4)") / F.col("_t_factor").cast("decimal(12,4)")).cast("double")
    out = out.withColumn("convert_status", status)
    converted = F.when(F.col("convert_status") == "IDENTITY", F.col(value).cast("double")).when(F.col("convert_status") == "CONVERTED", scaled)
    return out.withColumn("converted", converted).drop(*[f"_{p}_{c}" for p in "st" for c in ("symbol", "dimension", "factor", "affine")])


def parse_number(c) -> Column:
    """A finite decimal, else null."""
    return F.try_cast(strip(c), "decimal(38,18)") if hasattr(F, "try_cast") else strip(c).try_cast("decimal(38,18)")


def parse_integer(c) -> Column:
    return F.when(F.rlike(strip(c), F.lit(r"^[+-]?\d+$")), strip(c).try_cast("decimal(38,0)"))


def parse_boolean(c) -> Column:
    low = F.lower(strip(c))
    return F.when(low.isin("true", "yes", "1"), True).when(low.isin("false", "no", "0"), False)


def parse_number_with_unit(c) -> Column:
    """struct(number, unit) of `number unit`; null where there is no space between or no number."""
    pattern = r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s+(\S.*)$"
    n = F.regexp_extract(strip(c), pattern, 1)
    return F.when(n != "", F.struct(n.try_cast("decimal(38,18)").alias("number"), F.regexp_extract(strip(c), pattern, 2).alias("unit")))


def parse_range(c) -> Column:
    """struct(lo, hi, unit) of `a to b unit` or `a - b unit`; null where lo > hi."""
    pattern = r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s*(?:to|–|—|-)\s*([+-]?[0-9]+(?:\.[0-9]+)?)(?:\s+(\S.*))?$"
    g = lambda i: F.regexp_extract(strip(c), pattern, i)
    lo, hi = g(1).try_cast("double"), g(2).try_cast("double")
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"), F.nullif(g(3), F.lit("")).alias("unit")))


_OP, _AMOUNT, _UNIT = "<=|>=|≤|≥|<|>|=", r"[+-]?[0-9]+(?:[.,][0-9]+)?", "°[CF]|[A-Za-zµΩ%][A-Za-z0-9µΩ°/%-]*"
#: op, number, unit of one stated quantity. A digit that an identifier's dash leads to isn't one. White space is looked at behind an operator and before a unit alone.
QUANTITY = rf"(?:({_OP})\s*)?(?<![A-Za-z0-9.,])(?<![A-Za-z0-9]-)({_AMOUNT})(?:\s*({_UNIT}))?"


def quantities(df: DataFrame, c: str) -> DataFrame:
    """A row for each quantity: op, number, unit beside the columns of df. Texts are read once; only what was found is taken apart."""
    out = df.withColumn("_q", F.explode(F.regexp_extract_all(F.col(c), F.lit(QUANTITY), F.lit(0))))
    part = lambda i: F.regexp_extract("_q", rf"^({_OP})?\s*({_AMOUNT})\s*({_UNIT})?$", i)
    number = F.replace(part(2), F.lit(","), F.lit("."))
    return out.withColumns({"op": F.nullif(part(1), F.lit("")), "number": number.cast("double"), "unit": F.nullif(part(3), F.lit(""))}).drop("_q")


def magnitudes_agree(a, b) -> Column:
    return F.abs(col(a) - col(b)) <= 1e-9 * F.greatest(F.abs(col(a)), F.abs(col(b)), F.lit(1.0))


# Known spellings of units in delivered attributes.
UOM_ALIASES = {"V": "V", "volt": "V", "volts": "V", "A": "A", "amp": "A", "amps": "A", "in": "in", "inch": "in", "inches": "in", "dB": "dB", "dBA": "dBA"}


def normalize_uom(c) -> Column:
    """struct(uom, resolution): NONE, EXACT, ALIAS or UNRESOLVED; only exact known spellings count."""
    table = F.create_map(*[F.lit(x) for kv in UOM_ALIASES.items() for x in kv])
    raw = F.coalesce(col(c), F.lit(""))
    found = F.try_element_at(table, raw)
    resolution = F.when(raw == "", "NONE").when(found.isNull(), "UNRESOLVED").when(found == raw, "EXACT").otherwise("ALIAS")
    return F.struct(found.alias("uom"), resolution.alias("resolution"))


def compatible_units(spark: SparkSession) -> DataFrame:
    """(dimension, symbols) in the order of the table."""
    symbols = F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol"))), lambda x: x["symbol"])
    return units(spark).groupBy("dimension").agg(symbols.alias("symbols"))


def resolve_source_unit(c) -> Column:
    """The known symbol a source spelling stands for: itself, else the only one equal but for case; else null."""
    low: dict[str, list[str]] = {}
    for s, _, _ in UNITS:
        low.setdefault(s.lower(), []).append(s)
    exact = F.array(*[F.lit(s) for s, _, _ in UNITS])
    alone = F.create_map(*[F.lit(x) for k, v in low.items() if len(v) == 1 for x in (k, v[0])])
    return F.when(F.array_contains(exact, strip(c)), strip(c)).otherwise(F.try_element_at(alone, F.lower(strip(c))))


def semantic_key(kind, value, lo, hi, text, flag, unit) -> Column:
    """What two values are compared by: numbers to nine places (half to even), text without case."""
    nine = lambda x: F.bround(col(x).cast("decimal(30,12)"), 9).cast("string")
    return (
        F.when(col(kind) == "numeric", F.concat_ws("|", F.lit("numeric"), nine(value), F.coalesce(col(unit), F.lit(""))))
        .when(col(kind) == "range", F.concat_ws("|", F.lit("range"), nine(lo), nine(hi), F.coalesce(col(unit), F.lit(""))))
        .when(col(kind) == "logical", F.concat_ws("|", F.lit("logical"), col(flag).cast("string")))
        .otherwise(F.concat_ws("|", F.lit("alphanumeric"), F.lower(col(text))))
    )


def delivery_value(kind, number_text, lo_text, hi_text, text, flag) -> Column:
    """As delivered: Yes or No, `min to max`, numbers with the digits they were given, else the text."""
    return (
        F.when(col(kind) == "logical", F.when(col(flag), "Yes").otherwise("No"))
        .when(col(kind) == "range", F.concat(col(lo_text), F.lit(" to "), col(hi_text)))
        .when(col(kind) == "numeric", col(number_text))
        .otherwise(col(text))
    )
