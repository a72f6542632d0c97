"""Top rows per group, ranks and positions. Every ordering ends in a unique key, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimlens.session import materialize


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark keeps only k rows of each group per task before it shuffles."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def best_row(df: DataFrame, keys: list[str], order: Column, *, largest: bool = False) -> DataFrame:
    """One row per group by an aggregate instead of a window: combines before the shuffle, so large groups are no
    hot spot. order must be unique within a group."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), order)
    return df.groupBy(*keys).agg(pick.alias("__row")).select(*keys, "__row.*")


def percent_rank(value: str, keys: list[str], *, descending: bool = False) -> Column:
    """Nulls last, whatever the direction."""
    c = F.col(value)
    return F.percent_rank().over(Window.partitionBy(*keys).orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last()))


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank as a share of the group, ties at their mean rank; null values have none."""
    w = Window.partitionBy(*keys, F.col(value).isNull())
    ties = Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), (F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(w))


def framed_median(value: str, keys: list[str], order: list[str], before: int, upto: int = -1) -> Column:
    """Median of the rows from `before` rows back to `upto` rows back; null over an empty frame."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, upto)
    xs = F.sort_array(F.collect_list(value).over(w))
    n = F.size(xs)
    lo, hi = F.floor((n + 1) / 2).cast("int"), F.floor(n / 2).cast("int") + 1
    return F.when(n > 0, (F.element_at(xs, F.greatest(lo, F.lit(1))) + F.element_at(xs, F.least(hi, F.greatest(n, F.lit(1))))) / 2)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1, 2, ... over all rows. Rows are sorted by range over all tasks; each range's rows are counted and numbered on
    from the ranges before it, so no task sees them all."""
    spark = df.sparkSession
    df = materialize(df.orderBy(*order).withColumn("__part", F.spark_partition_id()), "rank")
    counts = df.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # one row per range
    within = Window.partitionBy("__part").orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(within)).join(F.broadcast(offsets), "__part")
    return out.withColumn(name, (F.col("__before") + F.col("__i")).cast("long")).drop("__part", "__i", "__before")


def burst(df: DataFrame, keys: list[str], day: str, width: int) -> DataFrame:
    """keys, most (items within any `width` days, both ends included), first_day of the earliest such span and last_day
    the window could reach. day is a date or a day number."""
    d = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) if dict(df.dtypes)[day] in ("date", "timestamp") else F.col(day)
    w = Window.partitionBy(*keys).orderBy("__d").rangeBetween(0, width)
    x = df.where(F.col(day).isNotNull()).withColumn("__d", d).withColumn("__n", F.count("*").over(w))
    return x.groupBy(*keys).agg(F.max("__n").alias("most"), F.max_by("__d", F.struct("__n", -F.col("__d"))).alias("first_day"))


def ntile_by_rank(value: str, unique: str, n: int) -> Column:
    return F.ntile(n).over(Window.orderBy(F.col(value).asc_nulls_last(), unique))
