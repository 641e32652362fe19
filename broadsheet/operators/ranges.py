"""Running totals and row numbers over whole tables, by ranges: totals of each range, offsets, totals inside.

A window without a partition, or with one that holds a third of the table, sorts those rows in one task. Here rows are
cut into ranges of their order, so that even one key is spread over as many ranges as its rows need; each range's total per
key is made once, ranges take the sum of the earlier ones as their offset, and windows only run inside a range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from broadsheet.session import materialize

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


def running(df: DataFrame, order: list, sums: dict[str, Column], by: list[str] | tuple[str, ...] = (), ranges: int | None = None,
            range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with, for each name in ``sums``, the total of its column over this row and those before it in ``order``, within
    rows of equal ``by`` (null is a key like any other). ``order`` should decide all ties that matter.

    The ranged rows are stored first: reads after a lost executor see the same ranges. At least as many ranges as
    shuffle partitions are made, and one for each ``range_rows`` rows.
    """
    spark = df.sparkSession
    by = list(by)
    if ranges is None:
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / range_rows))
    values = {f"_v{i}": c.cast("bigint") for i, c in enumerate(sums.values())}
    keyed = df.withColumns(values)
    ranged = keyed.repartitionByRange(ranges, *[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    stored = materialize(ranged, "ranges")
    totals = stored.groupBy("_range", *by).agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.partitionBy(*by or [F.lit(0)]).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    # a key goes on from an earlier range in at most one place of each range, so at most ``ranges`` rows are left
    offsets = totals.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)],
                            *[F.sum(v).over(earlier).alias(f"_o{v}") for v in values], F.row_number().over(
                                W.partitionBy(*by or [F.lit(0)]).orderBy("_range")).alias("_n")).where("_n > 1").drop("_n")
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = stored.join(F.broadcast(offsets), same, "left")
    return out.select(*df.columns, *[(F.coalesce(F.col(f"_o{v}"), F.lit(0)) + F.sum(v).over(inside)).cast("bigint").alias(name)
                                     for name, v in zip(sums, values, strict=True)])


def number_rows(df: DataFrame, order: list, out: str = "rank", by: list[str] | tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with each row's number from 1 in ``order`` (within equal ``by``), without a window over all rows."""
    return running(df, order, {out: F.lit(1)}, by, ranges)
