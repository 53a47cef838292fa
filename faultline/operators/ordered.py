"""Running totals and ordinals in groups of any size.

A window over a whole group sorts it in one task.  Here rows are cut into
ordered slices, each slice is handled by a task of its own, and the totals of
the slices before it are added; only one row per slice meets in the small
window over slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut


def running_totals(df: DataFrame, key: str, order: str, values: dict[str, Column],
                   slice_width: int = 100_000) -> DataFrame:
    """Add running sums of ``values`` per ``key`` in the order of an integer column.

    ``slice_width`` is the range of ``order`` one task takes, so a slice holds
    that many rows at most when ``order`` is a position.
    """
    sliced = df.select("*", F.floor(F.col(order) / slice_width).alias("slice_no"),
                       *[v.cast("long").alias(f"value_{n}") for n, v in values.items()])
    before = Window.partitionBy(key).orderBy("slice_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(key, "slice_no")
        .agg(*[F.sum(f"value_{n}").alias(f"sum_{n}") for n in values])
        .select(key, "slice_no",
                *[F.coalesce(F.sum(f"sum_{n}").over(before), F.lit(0)).alias(f"before_{n}")
                  for n in values]))
    within = Window.partitionBy(key, "slice_no").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return sliced.join(offsets, [key, "slice_no"]).select(
        *df.columns,
        *[(F.col(f"before_{n}") + F.sum(f"value_{n}").over(within)).alias(n) for n in values])


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def positions(df: DataFrame, order: Sequence[Column], name: str, weight: Column | None = None) -> DataFrame:
    """``df``, stored, with the 0-based position of each row in the order of the whole table.

    Rows are dealt out by ranges of ``order`` and sorted there; a row's place in its range and the
    sizes of the ranges before it, one number per range, add up to its position.  With ``weight`` each row
    stands for so many.  Rows equal in ``order`` stand in some order, fixed once stored.
    """
    at, part, size, before = (_unused(df, n) for n in ("row_at", "range_no", "range_size", "range_before"))
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order)
                 .select("*", F.monotonically_increasing_id().alias(at)))
    # Fixed layout of these ids: the range above, the place in it in the lower 33 bits.
    placed = placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
    ranges = placed.groupBy(part).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias(size))
    # One row per range of the shuffle: small whatever the table holds.
    offsets = ranges.select(part, (F.sum(size).over(Window.orderBy(part)) - F.col(size)).alias(before))
    if weight is not None:
        earlier = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn(at, F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    return placed.join(F.broadcast(offsets), part).select(*df.columns, (F.col(before) + F.col(at)).cast("long").alias(name))


def ordinals(df: DataFrame, keys: list[str], order: str, name: str, collation: str | None = None) -> DataFrame:
    """Add the 0-based position of each row in its group, by a text column unique in the group.

    A group of any size spreads over the ranges of one order of the whole table; a row's ordinal is its
    position less the first of its group.  ``collation`` names another order of the texts than that of
    their bytes, such as ``UNICODE``.
    """
    text = F.col(order) if collation is None else F.collate(F.col(order), collation)
    at, first = _unused(df, "position"), _unused(df, "first_position")
    placed = positions(df, [*map(F.col, keys), text, F.col(order)], at)
    firsts = placed.groupBy(*keys).agg(F.min(at).alias(first))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in keys]
    return placed.alias("r").join(firsts.alias("g"), same).select(
        *[F.col(f"r.{c}").alias(c) for c in df.columns], (F.col(f"r.{at}") - F.col(first)).alias(name))
