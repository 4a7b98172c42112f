"""Running sums, maxima and counts of changes over long keys, by a two-level prefix scan.

A window over a key puts all rows of that key in one task. Here rows are sorted by ranges of (key, order), so a
long key is cut into segments of several tasks. Each segment's totals, a small row each, are summed in order and
carried into the segments behind, in which windows then run. Ties in the order are broken by all other columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keep = Callable[[DataFrame, str], DataFrame]


def same(left: DataFrame, right: DataFrame, names: dict[str, str]) -> Column:
    """Columns of left equal those of right, nulls included."""
    out = F.lit(True)
    for a, b in names.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def running(rows: DataFrame, keys: list[str], order: list[str], keep: Keep, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None) -> DataFrame:
    """rows with a column for each of sums and maxima: the sum or maximum of its value over the key's rows up to this one.

    keep writes a table and reads it back, as segments must stay as they were cut. Nulls add nothing; keys may be null.
    """
    sums, maxima = sums or {}, maxima or {}
    values = {f"_v_{k}": c for k, c in {**sums, **maxima}.items()}
    by = [*keys, *order, *[c for c in rows.columns if c not in (*keys, *order)]]
    sortable = [c for c in by if "map<" not in dict(rows.dtypes)[c]]
    cut = rows.repartitionByRange(*sortable).sortWithinPartitions(*sortable)
    placed = keep(cut.withColumns(values).withColumn("_at", F.monotonically_increasing_id()).withColumn("_segment", F.shiftright("_at", 33)), "running-rows")
    fold = {k: (F.sum if k in sums else F.max) for k in (*sums, *maxima)}
    # a row a key and segment
    totals = placed.groupBy(*keys, "_segment").agg(*[f(f"_v_{k}").alias(f"_t_{k}") for k, f in fold.items()])
    ahead = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = keep(totals.select(*keys, "_segment", *[f(f"_t_{k}").over(ahead).alias(f"_c_{k}") for k, f in fold.items()]), "running-carried")
    right = carried.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_segment")], *[f"_c_{k}" for k in fold])
    here = Window.partitionBy(*keys, "_segment").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0)
    out = {k: F.coalesce(F.col(f"_c_{k}"), zero) + F.coalesce(F.sum(f"_v_{k}").over(here), zero) for k in sums}
    out |= {k: F.greatest(F.col(f"_c_{k}"), F.max(f"_v_{k}").over(here)) for k in maxima}
    return placed.join(right, same(placed, right, {c: f"_k_{c}" for c in (*keys, "_segment")})).withColumns(out).select(*rows.columns, *fold)


def changes(rows: DataFrame, keys: list[str], order: str, value: str, keep: Keep, name: str = "version") -> DataFrame:
    """rows with `name`: how often value differed from the row before, over the key's rows up to this one. A null is a value.

    Of a segment its first and last value and its changes are enough: whether its first row is a change shows in the
    last value of the segment ahead. Rows of one place in the order are ordered by value.
    """
    cut = rows.repartitionByRange(*keys, order, value).sortWithinPartitions(*keys, order, value)
    placed = keep(cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_segment", F.shiftright("_at", 33)), "running-rows")
    boxed = F.struct(F.col(value).alias("v"))  # so that no row before and a null before differ
    near = Window.partitionBy(*keys, "_segment").orderBy("_at")
    marked = placed.withColumn("_before", F.lag(boxed).over(near))
    marked = marked.withColumn("_changed", (F.col("_before").isNotNull() & ~F.col("_before.v").eqNullSafe(F.col(value))).cast("long")).drop("_before")
    totals = marked.groupBy(*keys, "_segment").agg(F.min_by(boxed, "_at").alias("_first"), F.max_by(boxed, "_at").alias("_last"), F.sum("_changed").alias("_inside"))
    ahead = Window.partitionBy(*keys).orderBy("_segment")
    totals = totals.withColumn("_before", F.lag("_last").over(ahead))
    at_start = (F.col("_before").isNotNull() & ~F.col("_before.v").eqNullSafe(F.col("_first.v"))).cast("long")
    up_to = F.sum(F.col("_inside") + at_start).over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    carried = keep(totals.select(*[F.col(c).alias(f"_k_{c}") for c in (*keys, "_segment")], (up_to - F.col("_inside")).alias("_carried")), "running-carried")
    joined = marked.join(carried, same(marked, carried, {c: f"_k_{c}" for c in (*keys, "_segment")}))
    here = near.rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col("_carried") + F.sum("_changed").over(here)).select(*rows.columns, name)
