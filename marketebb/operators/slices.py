"""Ordered computations per key that stay balanced when one key is hot.

A window over ``key`` alone puts all rows of a key into one task. Here the key's time line is cut
into slices (a day by default): the window runs over (key, slice), and what earlier or later slices
contribute comes from a one-row-per-slice summary. The summary is a map-side combined aggregate, so
only it, never the rows, meets in a per-key window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.session import stage


def carry(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    summary: dict[str, Column],
    carried: Callable[[Window], dict[str, Column]],
) -> DataFrame:
    """Join to each row what the other slices of its key contribute.

    ``summary`` names the aggregates of one slice; ``carried`` receives the window over the slices
    of a key in order and returns the columns to attach. Rows with a NULL key belong to no slice.
    """
    # The join would add this filter to one side only; stated first, both sides stay alike and can
    # share a shuffle.
    for name in (*keys, slice_col):
        df = df.filter(F.col(name).isNotNull())
    per_slice = df.groupBy(*keys, slice_col).agg(*[c.alias(n) for n, c in summary.items()])
    over_slices = Window.partitionBy(*keys).orderBy(slice_col)
    columns = carried(over_slices)
    attach = per_slice.select(*keys, slice_col, *[c.alias(n) for n, c in columns.items()])
    return df.join(attach, [*keys, slice_col], "inner")


def running(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running sum / max / min per key over all slices.

    ``values`` maps an output name to (function, expression); the function is "sum", "max" or
    "min". With ``inclusive=False`` the row itself does not count.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    carried = carry(
        df,
        keys,
        slice_col,
        {f"__s_{n}": fold[f](e) for n, (f, e) in values.items()},
        lambda w: {
            f"__c_{n}": fold[f](F.col(f"__s_{n}")).over(w.rowsBetween(Window.unboundedPreceding, -1))
            for n, (f, _) in values.items()
        },
    )
    end = 0 if inclusive else -1
    inside = (
        Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    )
    for name, (f, expr) in values.items():
        here = fold[f](expr).over(inside)
        before = F.col(f"__c_{name}")
        if f == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        elif f == "max":
            value = F.greatest(here, before)
        else:
            value = F.least(here, before)
        carried = carried.withColumn(name, value)
    return carried.drop(*[f"__c_{n}" for n in values])


def previous(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """``lag`` of columns per key across slices: ``values`` maps output name to source column."""
    picked = F.struct(*order, *[F.col(c).alias(f"__v_{n}") for n, c in values.items()])
    carried = carry(
        df,
        keys,
        slice_col,
        {"__last": F.max(picked)},
        lambda w: {"__before": F.lag("__last").over(w)},
    )
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    here = carried.withColumn("__here", F.lag(picked).over(inside))
    row = F.coalesce(F.col("__here"), F.col("__before"))
    return here.select(
        "*", *[row[f"__v_{n}"].alias(n) for n in values]
    ).drop("__here", "__before")


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """1-based position of each row in one total order, without one global sort task.

    The rows are range-partitioned by the order and written once; only the number of rows of each partition meets in a
    single task. Ties of the order share a partition, so end it with a unique column where ties may be many.
    """
    cut = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked")
    counts = cut.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return cut.join(ahead, "__part").withColumn(name, local + F.col("__ahead")).drop("__ahead", "__part")
