"""Sums over all earlier rows of a table in a total order, without a window over the whole table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from catalith.llm.common import settle


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds for each entry new: long column of sums the sum of that column over all rows before, settled.

    Rows are dealt to ranges of the order and sorted there; a task adds up its own
    rows, and gets what lies in the ranges before from a table of one row for each
    partition, which is broadcast. Rows that are equal in the order may change
    places, so the order should tell rows apart unless they are alike.
    """
    schema = StructType([*rows.schema.fields, *(StructField(new, LongType()) for new in sums), StructField("_part", IntegerType())])

    def add(batches):
        part, totals = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for batch in batches:
            cols = list(batch.columns)
            for new, old in sums.items():
                values = batch.column(batch.schema.get_field_index(old)).to_numpy(zero_copy_only=False)
                upto = np.cumsum(values, dtype=np.int64) + totals[new]
                cols.append(pa.array(upto - values))
                totals[new] = int(upto[-1]) if len(upto) else totals[new]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(batch.num_rows, part, np.int32))], [*batch.schema.names, *sums, "_part"])

    own = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = own.groupBy("_part").agg(*(F.sum(old).alias(f"_{new}") for new, old in sums.items()))
    parts = parts.select("_part", *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in sums))
    joined = own.join(F.broadcast(parts), "_part")
    return joined.select(*rows.columns, *((F.col(new) + F.col(f"_{new}")).alias(new) for new in sums))
