"""Exact ranks over all rows, without a task that holds them all.

Rows are dealt by range (Spark samples the splitters), sorted within their range and numbered there;
the ranges' counts, one row a range, give each range's first rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.cut import cut

#: Bits of a row's number within its range in ``monotonically_increasing_id``.
ROW_BITS = 33


def ranked(df: DataFrame, order: list[Column], out: str, ranges: int | None = None) -> DataFrame:
    """Adds ``out``, the 0-based place of each row in ``order``; equal rows get places in no stated order.

    ``ranges``: how many ranges; by default, Spark's shuffle partitions.  An empty table stays empty.
    """
    names = df.columns
    if clash := {"_at", "_first"} & {c.lower() for c in names}:
        raise ValueError(f"rename the columns {sorted(clash)}")
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    numbered = cut(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", ROW_BITS).cast("int")
    counts = dict(sorted((r[0], r[1]) for r in numbered.groupBy(part.alias("p")).count().collect()))  # one row a range
    first, seen = {}, 0
    for p, n in counts.items():
        first[p], seen = seen, seen + n
    firsts = df.sparkSession.createDataFrame(list(first.items()) or [(0, 0)], "p int, _first long")
    placed = numbered.join(F.broadcast(firsts), part == F.col("p"))
    return placed.withColumn(out, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).select(*[f"`{c}`" for c in names if c != out], out)
