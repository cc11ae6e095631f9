"""Helpers shared by the training-data operators.

Words, unless an operator says otherwise, are maximal runs of characters other
than the six ASCII white-space characters (space and U+0009 to U+000D).
"""

from __future__ import annotations

import ctypes
import functools
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``, read with Spark's own reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's ``spark.checkpoint.dir`` if it
    is set, else (tests, laptops) one below the warehouse, which is then set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read
    again: like ``cut``, but later steps read only the columns they name."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free_memory() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(run):
    """``run``, a generator function for mapInArrow, that frees memory when it's done:
    Spark keeps workers for later tasks, and what they hold adds to what those need."""

    @functools.wraps(run)
    def stream(batches):
        try:
            yield from run(batches)
        finally:
            free_memory()

    return stream


def crc_mod(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: of '')."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def deal_of(rows: DataFrame, salts: int):
    """A salt by a hash of the row: a task that runs again deals its rows alike (equal
    rows go together; there is no order among them to deal them by)."""
    plain = [f"`{f.name}`" for f in rows.schema if not isinstance(f.dataType, MapType)]
    return F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")


def attach_by_key(rows: DataFrame, key: str, table: DataFrame, size: int, broadcast_bytes: int, salts: int = 64) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique, not null ``key``). A table of up to
    ``broadcast_bytes`` (``size`` is its measured size) is broadcast; a larger one is
    repeated per salt so that a hot key's rows are dealt over ``salts`` tasks."""
    named = table.withColumnRenamed(key, "_key")
    if size <= broadcast_bytes:
        return rows.join(F.broadcast(named), rows[key] == F.col("_key"), "left").drop("_key")
    spread = named.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = rows.withColumn("_deal", deal_of(rows, salts))
    same = (F.col(key) == F.col("_key")) & (F.col("_deal") == F.col("_salt"))
    return dealt.join(spread, same, "left").drop("_key", "_salt", "_deal")
