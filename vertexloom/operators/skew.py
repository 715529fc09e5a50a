"""Joins of many rows to one row per key when a few keys hold most of the many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is split over several tasks.
ROWS_PER_TASK = 1_000_000
#: A table of at most so many bytes, its known rows times its known width, may be broadcast.
BROADCAST_BYTES = 64_000_000


def hot_keys(df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``key, n_salts`` of the keys with more than ``rows_per_task`` rows.

    At most count(df) / rows_per_task keys can be hot, which bounds the result. Null keys join nothing
    and are left out.
    """
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > rows_per_task)
    return n.select(key, F.ceil(F.col("_n") / rows_per_task).cast("int").alias("n_salts"))


def salted(big: DataFrame, key: str, spread_by: str, hot: DataFrame) -> DataFrame:
    """``big`` with ``_salt``: 0, or for a hot key one of its n_salts by the hash of ``spread_by``."""
    h = F.broadcast(hot.select(F.col(key).alias("_hot"), "n_salts"))
    j = big.join(h, big[key] == F.col("_hot"), "left")
    return j.withColumn("_salt", F.when(F.col("n_salts").isNull(), 0).otherwise(F.pmod(F.hash(spread_by), F.col("n_salts")))).drop("_hot", "n_salts")


def replicated(small: DataFrame, key: str, hot: DataFrame, hot_key: str) -> DataFrame:
    """``small`` (one row per key) with ``_salt``: each row once, a hot key's row once per salt."""
    h = F.broadcast(hot.select(F.col(hot_key).alias("_hot"), "n_salts"))
    j = small.join(h, small[key] == F.col("_hot"), "left")
    return j.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n_salts"), F.lit(1)) - 1))).drop("_hot", "n_salts")
