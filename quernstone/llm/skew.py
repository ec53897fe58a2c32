"""Joins whose hot keys don't land in one task."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of the joined rows is hot. So at most that many keys are, whatever the tables' size.
HOT_SHARE = 4096
#: Parts over which the rows of hot keys are dealt.
SALTS = 64


def split_join(rows: DataFrame, few: DataFrame, keys: list[str], count: str, salt: list[str], keep_null: bool = False, keep_missing: bool = False) -> DataFrame:
    """rows joined with few, which has one row a key and in `count` how many rows have that key.

    Hot keys, at most HOT_SHARE of them by count, come by broadcast. The others, each at most a HOT_SHARE-th of the rows, come
    by an ordinary join, in which rows of hot keys are dealt by a hash of the `salt` columns and meet nothing. rows is read once,
    few twice: store it. Keys that few lacks give no row unless keep_missing, nor do null keys unless keep_null or keep_missing.
    Columns: those of rows, then those of few without its keys.
    """
    total = few.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_SHARE, total) // HOT_SHARE
    values = [c for c in few.columns if c not in keys]
    hot = few.where(F.col(count) > least).select(*keys, F.struct(*values).alias("__hot"))
    cold = few.where(F.col(count) <= least).select(*(F.col(k).alias(f"__{k}") for k in keys), F.struct(*values).alias("__cold"), F.lit(0).alias("__part"))
    null = functools.reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__own", F.when(F.col("__hot").isNull() & ~null, 0).otherwise(1 + F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")))
    on = F.col("__own") == F.col("__part")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    found = dealt.join(cold, on, "left").withColumn("__found", F.coalesce("__hot", "__cold"))
    if not keep_missing:
        found = found.where(F.col("__found").isNotNull() | (null if keep_null else F.lit(False)))
    return found.select(*rows.columns, *(F.col(f"__found.{v}").alias(v) for v in values))
