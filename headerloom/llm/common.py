"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and the master is local (tests), a temporary folder is taken instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = tempfile.mkdtemp(prefix="headerloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one evaluation, no lineage."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks over which the rows of one join key are dealt.
WAYS = 16


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], by: Column, how: str = "inner", ways: int = WAYS) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``; the rows of one key are dealt over ``ways`` tasks by a hash of ``by``, to each of which ``few`` is copied.

    A key that holds a third of all rows of ``many`` is so no task of its own. ``few`` has to be the smaller side,
    with few rows for a key.
    """
    dealt = many.withColumn("__way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    copied = few.withColumn("__way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return dealt.join(copied, [*keys, "__way"], how).drop("__way")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hex_digits(value: Column) -> Column:
    """A signed 64-bit integer as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def in_order(df: DataFrame, order: list[Column], name: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, staged, with (part, nth): files in order and rows from 0 in each.

    The staged table fixes the partition bounds, so totals taken from it and rows read from it agree.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.monotonically_increasing_id())
    nth = F.col("part").bitwiseAND(F.lit((1 << 33) - 1))
    return staged(ordered.withColumns({"nth": nth, "part": F.shiftright("part", 33).cast("int"), **(extra or {})}), name)
