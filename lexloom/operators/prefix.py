"""Running sums and positions over a total order without moving everything into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialize


def prefix_sum(df: DataFrame, value: str | Column, order_by: Sequence[str], within: Sequence[str] = (), name: str = "prefix", partitions: int | None = None) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one in ``order_by``, separately for each ``within`` key.

    The rows are range-partitioned on key and order, so a key with a third of all rows spreads over many tasks. Each range's total
    per key is a small table whose running sums give the offsets; the rest is a window inside a range. ``order_by`` must be a total
    order (append an id) for a repeatable result. Null values count 0, null keys form one group, an empty table gives no rows. Pass only the narrow
    columns (ids and sizes) and join wide ones afterwards."""
    cols = df.columns
    spread = df.select("*", F.coalesce(value if isinstance(value, Column) else F.col(value), F.lit(0)).alias("_v"))
    by = [*within, *order_by]
    ranged = spread.repartitionByRange(partitions, *by) if partitions else spread.repartitionByRange(*by)
    # The ranges come from a sample, so they are fixed by writing them once: both readers below see the same ones.
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("_p")), "ranges")
    keys = list(within)
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_p").agg(F.sum("_v").alias("_s"))
    offsets = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_op"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    on = ranged["_p"] == offsets["_op"]
    for i, k in enumerate(keys):
        on = on & ranged[k].eqNullSafe(offsets[f"_k{i}"])
    local = Window.partitionBy("_p", *keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, on).select(*cols, (F.col("_o") + F.coalesce(F.sum("_v").over(local), F.lit(0))).alias(name))
