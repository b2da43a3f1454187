"""Running sums over a whole table without a window over one partition.

Rows are dealt by ranges of their order and written, so that a range's number does not change; the sums of each range are
one small row; sums of the ranges before are added to running sums inside each range. Every step but the adding up of one
row a range runs in as many tasks as there are ranges.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import materialized

PART = "_range"


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], most: dict[str, int] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with running sums: sums names a new column and the column of whole numbers, not negative, that it adds up to
    and with each row. order: expressions that tell all rows apart. With `most` (new column: limit) only rows within every
    limit are given back, and ranges that begin beyond one are not read."""
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialized(rows.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()))
    totals = sorted(dealt.groupBy(PART).agg(*(F.sum(c).cast("long").alias(name) for name, c in sums.items())).collect())  # one row a range
    before = {name: [0, *accumulate(r[name] for r in totals)] for name in sums}
    offsets = [(r[PART], *(before[name][k] for name in sums)) for k, r in enumerate(totals)]
    offsets = [o for o in offsets if all(o[1 + list(sums).index(name)] <= limit for name, limit in (most or {}).items())]
    table = spark.createDataFrame(offsets, f"{PART} int, " + ", ".join(f"`_{name}` long" for name in sums))
    upto = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(table), PART)  # one row a range
    out = out.select(*rows.columns, *((F.sum(c).over(upto) + F.col(f"_{name}")).cast("long").alias(name) for name, c in sums.items()))
    for name, limit in (most or {}).items():
        out = out.where(F.col(name) <= limit)
    return out
