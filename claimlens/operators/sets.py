"""Set operations, deduplication, paging, splits and slice replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.operators.ranking import best_row


def keep_best(df: DataFrame, keys: list[str], order: Column, *, largest: bool = False) -> DataFrame:
    """One row per key. order must be unique within a key."""
    return best_row(df, keys, order, largest=largest)


def replace_slice(old: DataFrame, new: DataFrame, column: str, value) -> DataFrame:
    """old without the rows of one slice, and new in their place."""
    return old.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new win over rows of old with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update_from(df: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """df with the values that patch has for its keys; a null in patch leaves the old value. patch has unique keys."""
    cols = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *(F.col(c).alias(f"__{c}") for c in cols))
    x = df.join(p, keys, "left")
    return x.select(*(F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in df.columns))


def hash_split(key: str, share: float, seed: int = 0) -> Column:
    """True for about this share of the keys, always the same ones."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)


def stratified_split(key: str, label: str, share: float, seed: int = 0) -> Column:
    """True for about this share of the keys of each label, always the same ones: the label is part of the hash, so that the
    shares of two labels don't depend on each other."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(1_000_000)) < int(share * 1_000_000)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows (all, if there are fewer), the same ones for the same seed: those with the smallest hash of their key, which
    Spark picks per task before it merges them. key must be unique."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def flag_top(df: DataFrame, order: list[Column], n: int, unique: str, name: str = "is_top") -> DataFrame:
    """df with whether a row is among the first n of the order, which ends in unique. Only n keys are compared with."""
    top = F.broadcast(df.orderBy(*order, unique).limit(n).select(F.col(unique).alias("__top")))
    return df.join(top, df[unique] == top["__top"], "left").withColumn(name, F.col("__top").isNotNull()).drop("__top")


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)
