"""Running aggregates of groups of any size.

A window over a group sorts all of it in one task.  Here rows are dealt by range of (group,
order), so a large group spans many pieces; each piece is aggregated by itself, and pieces of a
group that are continued get what the pieces before them add up to.  At most one group goes on
from each piece to the next, so this table has no more rows than there are pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesmill.functions.lineage import release, stable

PIECE = "_piece"
#: how values of two stretches of rows are put together
MERGE = {
    "count": ("sum", lambda a, b: a + b),
    "sum": ("sum", lambda a, b: a + b),
    "bit_xor": ("bit_xor", lambda a, b: a.bitwiseXOR(b)),
    "max": ("max", F.greatest),
    "min": ("min", F.least),
}


def dealt(df: DataFrame, group: Sequence[str], order: Sequence[str], write=stable) -> DataFrame:
    """The rows with the number of their range piece, written once: ranges are cut at sampled rows."""
    pieces = write(df.repartitionByRange(*group, *order).withColumn(PIECE, F.spark_partition_id()))
    release(df.sparkSession)
    return pieces


def continued(pieces: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups that have rows in more than one piece, at most one for each end of a piece."""
    key = F.struct(*group)
    ends = pieces.groupBy(PIECE).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(F.explode(F.array("low", "high")).alias("g"), PIECE).distinct()
    return ends.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g.*")


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], totals: dict[str, tuple[str, str]], write=stable) -> DataFrame:
    """Add each {name: (function, column)} over the rows of the group up to this one.

    `order` must tell the rows of a group apart, and neither it nor the aggregated columns may
    come from sums whose last bits vary.  Group columns must not be null.  Functions are those of
    `MERGE`; a null counts as absent.
    """
    group, order = list(group), list(order)
    pieces = dealt(df, group, order, write)
    upto = Window.partitionBy(PIECE, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a broadcast of at most two rows a piece
    shared = pieces.join(F.broadcast(continued(pieces, group)), group, "left_semi")
    whole = shared.groupBy(*group, PIECE).agg(*(getattr(F, f)(c).alias(n) for n, (f, c) in totals.items()))
    earlier = Window.partitionBy(*group).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*group, PIECE, *(getattr(F, MERGE[f][0])(n).over(earlier).alias(f"_{n}") for n, (f, _) in totals.items()))
    local = pieces.withColumns({n: getattr(F, f)(c).over(upto) for n, (f, c) in totals.items()})
    joined = local.join(F.broadcast(before), [*group, PIECE], "left")

    def merged(n: str, f: str):
        a, b = F.col(f"_{n}"), F.col(n)
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(MERGE[f][1](a, b)).alias(n)

    return joined.select(*df.columns, *(merged(n, f) for n, (f, _) in totals.items()))
