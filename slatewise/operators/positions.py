"""Row positions and running totals that never put one whole group in one task.

A plain ``row_number`` over a group sorts that group in a single task.  Here rows are dealt by range over the
full order, with bounds sampled from the data, so concentrated or outlying values spread as well; positions are
taken inside a range and shifted by the rows of the ranges before it.  Only range counts are windowed
per group, and their number is that of the partitions.  The dealt rows are written once, as counts and rows must see
the same bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewise.session import stored


def md5_slice(*columns: str, digits: int = 3) -> Column:
    """An even hash slice of 16**digits values, the same in any SQL engine."""
    return F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns])), 1, digits)


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows with the number of the range that holds them in ``_range``."""
    rows = stored(df, "ranked")
    return stored(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def position(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """1-based position of each row in its key group by ``order``, which must be total."""
    rows, group = _ranged(df, keys, order), [*keys, "_range"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.select(*group, F.coalesce(F.sum("_rows").over(_earlier(keys)), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_inside", inside).join(offsets, group).withColumn(out, F.col("_inside") + F.col("_offset")).drop("_range", "_inside", "_offset")


def running_before(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, str]) -> DataFrame:
    """Sum of each column over the strictly earlier rows of the key group.

    ``totals`` maps an input column to its output name.  Rows must have distinct ``order``
    values within a key; aggregate duplicates first.
    """
    rows, group = _ranged(df, keys, order), [*keys, "_range"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group).agg(*[F.sum(c).alias(f"_sum_{c}") for c in totals])
    offsets = sums.select(*group, *[F.coalesce(F.sum(f"_sum_{c}").over(_earlier(keys)), F.lit(0)).alias(f"_before_{c}") for c in totals])
    ranked = rows.withColumns({f"_inside_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in totals})
    joined = ranked.join(offsets, group)
    return joined.withColumns({out: F.col(f"_inside_{c}") + F.col(f"_before_{c}") for c, out in totals.items()}).drop(
        "_range", *[f"_inside_{c}" for c in totals], *[f"_before_{c}" for c in totals]
    )


def neighbours(df: DataFrame, keys: list[str], order: list[Column], value: Column) -> DataFrame:
    """The nearest non-null ``value`` of an earlier and of a later row of the key group, in ``_last`` and ``_next``.

    ``order`` must be total.  A range looks among its own rows first; what lies beyond comes from the first and last
    value of the other ranges, one row each.
    """
    rows, group = _ranged(df.withColumn("_value", value), keys, order), [*keys, "_range"]
    # what follows is what came before in the reversed order: a frame that only grows, where one that shrinks is run anew for every row
    earlier = lambda by: F.last("_value", ignorenulls=True).over(Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    near = rows.withColumns({"_inner_last": earlier(order), "_inner_next": earlier([c.desc() for c in order])})
    place = F.struct(*order)
    edges = rows.groupBy(*group).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_end"), F.min_by("_value", F.when(F.col("_value").isNotNull(), place)).alias("_start"))
    beyond = lambda value, by: F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.select(*group, beyond("_end", F.asc("_range")).alias("_outer_last"), beyond("_start", F.desc("_range")).alias("_outer_next"))
    joined = near.join(edges, group).withColumns({"_last": F.coalesce("_inner_last", "_outer_last"), "_next": F.coalesce("_inner_next", "_outer_next")})
    return joined.drop("_range", "_value", "_inner_last", "_inner_next", "_outer_last", "_outer_next")


def last_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key group with their place from the end in ``from_end``.

    Spark limits each group before the shuffle, so a hot group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("from_end", F.row_number().over(w)).filter(F.col("from_end") <= n)
