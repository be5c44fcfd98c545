"""Global order without a single-partition window.

``Window.orderBy(...)`` with no partition key moves every row into one task.  The
helpers here rank or accumulate in a global order the distributed way:

1. range-partition the rows on the order key (a sampled shuffle, AQE may coalesce
   neighbouring ranges, which keeps the order),
2. tag each row with its partition id and checkpoint, so the ids are fixed,
3. per-partition totals (one row per partition) -> exclusive running offsets,
4. a window *partitioned by the partition id* for the local running value,
5. global value = offset of the partition + local value.

Used for vocabulary and category ranks (E1, A1, A5), bin codes (N6) and the exact
AUC prefix sums (M10).  Cost follows the number of distinct keys, never a single
task.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint, spread_width

_PID = "__pid"


def _range_tagged(df: DataFrame, order: Sequence[Column], num_partitions: int | None) -> DataFrame:
    n = num_partitions or spread_width(df.sparkSession)
    tagged = df.repartitionByRange(n, *order).withColumn(_PID, F.spark_partition_id())
    return reliable_checkpoint(tagged)


def global_prefix(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
                  inclusive: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Add running sums of the ``sums`` expressions in the global ``order``.

    ``sums`` maps an output name to an expression summed over the rows that come
    before (``inclusive=False``) or up to and including (``True``) each row.  The
    order must be total (ties broken by the caller) for a deterministic result.
    """
    tagged = _range_tagged(df, order, num_partitions)
    names = list(sums)
    vals = tagged.select("*", *[sums[k].alias(f"__v_{k}") for k in names])
    totals = vals.groupBy(_PID).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in names])
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a handful of rows, so the global window here is bounded
    offsets = totals.select(_PID, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0))
                                    .alias(f"__o_{k}") for k in names])
    hi = 0 if inclusive else -1
    local = Window.partitionBy(_PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, hi)
    out = vals.select("*", *[F.coalesce(F.sum(f"__v_{k}").over(local), F.lit(0)).alias(f"__l_{k}")
                             for k in names])
    out = out.join(F.broadcast(offsets), _PID)
    return out.select(*df.columns, *[(F.col(f"__o_{k}") + F.col(f"__l_{k}")).alias(k) for k in names])


def global_index(df: DataFrame, order: Sequence[Column], name: str = "idx",
                 start: int = 0, num_partitions: int | None = None) -> DataFrame:
    """0-based (or ``start``-based) position of each row in the global ``order``."""
    out = global_prefix(df, order, {name: F.lit(1).cast("bigint")}, inclusive=False,
                        num_partitions=num_partitions)
    return out.withColumn(name, (F.col(name) + F.lit(start)).cast("bigint"))
