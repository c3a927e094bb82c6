"""Joins with counted tables: small ones are sent to all executors, and in a shuffle the rows of a hot key are dealt to several tasks."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairoscope.session import materialise

#: Rows, and bytes, up to which a counted table is sent to all executors.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20
#: Rows of one key beyond which they are dealt to several tasks, and the most of these.
HOT_KEY_ROWS, MOST_BLOCKS = 100_000, 1024
SALT, PARTS = "__salt", "__parts"


def release_shuffles(spark: SparkSession) -> None:
    """Lets the driver collect plans that nothing refers to any more; the files of their shuffles go with them, not when its memory is short."""
    spark.range(1).count()  # the last plan that ran is still referred to
    gc.collect()
    spark._jvm.System.gc()


def row_bytes(rows: DataFrame) -> int:
    """About the bytes of a row: fixed sizes, and 64 for each string, list or struct."""
    return sum({"bigint": 8, "int": 4, "double": 8, "boolean": 1}.get(f.dataType.simpleString(), 64) for f in rows.schema.fields)


def small(rows: DataFrame) -> DataFrame:
    """``rows``, marked to be sent to all executors if they are no more than BROADCAST_ROWS and BROADCAST_BYTES."""
    return F.broadcast(rows) if rows.count() <= min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes(rows)) else rows


def blocks_of(rows: DataFrame, key: str, most: int) -> DataFrame:
    """key, __parts: in how many blocks the rows of a key with more than ``most`` are dealt."""
    counted = rows.groupBy(key).agg(F.count("*").alias("__rows")).where(F.col("__rows") > most)
    return small(materialise(counted.select(key, F.least(F.ceil(F.col("__rows") / most), F.lit(MOST_BLOCKS)).cast("int").alias(PARTS)), "hot"))


def dealt(rows: DataFrame, blocks: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows`` with the block (SALT) of each, by ``spread``."""
    return rows.join(blocks, key, "left").withColumn(SALT, F.pmod(F.xxhash64(spread), F.coalesce(PARTS, F.lit(1))).cast("int")).drop(PARTS)


def copied(rows: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """``rows`` once for each block of their key."""
    return rows.join(blocks, key, "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(PARTS, F.lit(1)) - 1))).drop(PARTS)


def salted_join(rows: DataFrame, found: DataFrame, key: str, spread: Column, how: str = "left", most: int | None = None) -> DataFrame:
    """``rows`` with what ``found`` has for their key (``rows`` may have any other columns but SALT and PARTS).

    A small ``found`` is sent to all executors. Others are joined by a shuffle, in which the rows of a hot key are
    dealt to several tasks by ``spread``, so that none gets many more than ``most``; only hot keys of ``found`` are copied.
    """
    sent = small(found)
    if sent is not found:
        return rows.join(sent, key, how)
    blocks = blocks_of(rows.select(key), key, most or HOT_KEY_ROWS)
    return dealt(rows, blocks, key, spread).join(copied(found, blocks, key), [key, SALT], how).drop(SALT)


def without(rows: DataFrame, gone: DataFrame, key: str, spread: Column) -> DataFrame:
    """``rows``, of any columns, whose key is not in ``gone`` (a column of that name); rows without a key stay."""
    names = rows.columns
    packed = rows.select(F.col(key), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.xxhash64(spread).alias("__spread"))
    return salted_join(packed, gone.select(key), key, F.col("__spread"), how="left_anti").select(*[F.col("__row").getField(c).alias(c) for c in names])
