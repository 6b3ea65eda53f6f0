"""Tables of a page from its words and ruled lines.

Vertical rules that meet or lie within BAND_GAP of each other are one frame; the places of its
rules are the bounds of its columns. Words inside a frame are its header, those below it its
body, until the first row that fills a single column. A page without rules has no table: white
space is no evidence of a column. A page's words are gathered once, in order from above, and meet
its frames as one row; rows and cells are then parts of that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Distances in points, and the least columns and filled cells.
X_TOLERANCE = 2.0
BAND_GAP = 3.0
ROW_TOLERANCE = 3.0
LEAST_COLUMNS = 3
LEAST_FILLED = 2
LEAST_HEIGHT = 4.0
REACH = 400.0


def frames(rules: DataFrame) -> DataFrame:
    """(page, frame, top, bottom, xs): bands of vertical rules with enough columns, numbered from above; xs are the columns' bounds.

    rules: page, x, top, bottom. Places within X_TOLERANCE of their neighbour are one bound, at their mean.
    """
    alike = rules.groupBy("page", "top", "bottom").agg(F.collect_list("x").alias("held"))
    order = Window.partitionBy("page").orderBy("top", "bottom")
    before = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("top") - before > BAND_GAP).cast("int"), F.lit(1))
    banded = alike.withColumn("new", new).withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = banded.groupBy("page", "band").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sort_array(F.flatten(F.collect_list("held"))).alias("held"))
    first = lambda i: (i == 0) | (F.get("held", i) - F.get("held", i - 1) > X_TOLERANCE)
    found = found.withColumn("firsts", F.filter(F.transform("held", lambda _, i: i), first))
    place = lambda at, i: F.slice("held", at + 1, F.coalesce(F.get("firsts", i + 1), F.size("held")) - at)
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda sum, x: sum + x) / F.size(xs)
    found = found.withColumn("xs", F.transform(F.transform("firsts", place), mean))
    found = found.where((F.size("xs") > LEAST_COLUMNS) & (F.col("bottom") - F.col("top") > LEAST_HEIGHT))
    return found.select("page", (F.row_number().over(Window.partitionBy("page").orderBy("top")) - 1).alias("frame"), "top", "bottom", "xs")


def _parts(words: DataFrame, found: DataFrame) -> DataFrame:
    """(page, frame, columns, is_header, words): for each frame the words in its header and those below it, from above, each with its column (one that is not there outside all)."""
    held = words.where("page IS NOT NULL").groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.col("top").cast("double").alias("y"), "x0", "x1", "text"))).alias("held"))
    met = held.join(found.hint("merge"), "page")  # by Spark's estimate all frames would be broadcast: it leaves out what explode adds
    place = lambda w: F.size(F.filter("xs", lambda x: x <= (w["x0"] + w["x1"]) / 2)) - 1
    part = lambda name, low, high: F.struct(F.lit(name).alias("is_header"), F.transform(F.filter("held", lambda w: (w["y"] >= low) & (w["y"] < high)), lambda w: F.struct(w["x0"].alias("x0"), w["y"].alias("y"), w["text"].alias("text"), place(w).alias("column_index"))).alias("words"))
    both = F.array(part(True, F.col("top") - 1, F.col("bottom")), part(False, F.col("bottom"), F.col("bottom") + REACH))
    return met.select("page", "frame", (F.size("xs") - 1).alias("columns"), F.inline(both)).where(F.size("words") > 0)


def _starts(words: Column) -> Column:
    """Of words from above the places of each row's first one: it lies more than ROW_TOLERANCE below the last row's first one."""
    last = lambda rows: F.try_element_at(rows, F.lit(-1))
    y = lambda i: F.get(words, i)["y"]
    return F.aggregate(F.transform(words, lambda _, i: i), F.array().cast("array<int>"), lambda rows, i: F.when(last(rows).isNull() | (y(i) - y(last(rows)) > ROW_TOLERANCE), F.concat(rows, F.array(i))).otherwise(rows))


def _rows(words: DataFrame, found: DataFrame) -> DataFrame:
    """(page, frame, is_header, line, cells, filled): rows that hold words, cells as an array with a text for each column."""
    part = ["page", "frame", "is_header"]
    held = _parts(words, found).withColumn("starts", _starts(F.col("words")))
    line = lambda at, i: F.slice("words", at + 1, F.coalesce(F.get("starts", i + 1), F.size("words")) - at)
    own = lambda at, i: F.sort_array(F.filter(line(at, i), lambda w: (w["column_index"] >= 0) & (w["column_index"] < F.col("columns"))))
    lined = held.select(*part, "columns", F.posexplode(F.transform("starts", own)).alias("line", "own"))
    text = lambda i: F.trim(F.array_join(F.transform(F.filter("own", lambda w: w["column_index"] == i), lambda w: w["text"]), " "))
    cells = lined.select(*part, "line", F.transform(F.sequence(F.lit(0), F.col("columns") - 1), text).alias("cells"))
    return cells.withColumn("filled", F.size(F.filter("cells", lambda c: c != "")))


def ruled_rows(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, table_index, row_index, is_header, row): every row of every table, with a text for each column.

    words: page, text, x0, x1, top. rules: page, x, top, bottom. Header rows have a filled cell; body rows fill
    LEAST_FILLED columns, and the first that fills fewer (but one at least) ends the table.
    """
    rows = _rows(words, frames(rules))
    down = Window.partitionBy("page", "frame", "is_header").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ended = F.max((~F.col("is_header") & (F.col("filled") > 0) & (F.col("filled") < LEAST_FILLED)).cast("int")).over(down)
    kept = rows.withColumn("ended", ended).where("filled > 0 AND ended = 0")
    table = F.dense_rank().over(Window.partitionBy("page").orderBy("frame")) - 1
    row = F.row_number().over(Window.partitionBy("page", "frame").orderBy(F.desc("is_header"), "line")) - 1
    return kept.select("page", table.alias("table_index"), row.alias("row_index"), "is_header", F.col("cells").alias("row"))


def ruled_tables(words: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, table_index, row_index, column_index, is_header, text): every cell of every table of ruled_rows, empty ones too."""
    cells = ruled_rows(words, rules).select("page", "table_index", "row_index", F.posexplode("row").alias("column_index", "text"), "is_header")
    return cells.select("page", "table_index", "row_index", "column_index", "is_header", "text")


def page_tables(pages: DataFrame, words: DataFrame, rules: DataFrame) -> DataFrame:
    """(page, status, tables): NO_TABLE_STRUCTURE without a frame, TABLE_STRUCTURE_UNRESOLVED where frames held no row, else TABLES_EXTRACTED."""
    framed = frames(rules).groupBy("page").agg(F.count(F.lit(1)).alias("frames"))
    made = ruled_rows(words, rules).groupBy("page").agg((F.max("table_index") + 1).cast("long").alias("tables"))
    df = pages.select("page").join(framed.hint("merge"), "page", "left").join(made.hint("merge"), "page", "left")
    status = F.when(F.col("frames").isNull(), "NO_TABLE_STRUCTURE").when(F.col("tables").isNull(), "TABLE_STRUCTURE_UNRESOLVED").otherwise("TABLES_EXTRACTED")
    return df.select("page", status.alias("status"), F.coalesce("tables", F.lit(0)).cast("long").alias("tables"))
