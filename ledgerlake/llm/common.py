"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# White space and words as the contracts define them: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROW_GROUP = 1 << 24  # bytes that a writing task buffers


def store(df: DataFrame) -> DataFrame:
    """Write the rows as Parquet below the shared checkpoint folder and go on from there.

    Unlike ``checkpoint()`` the files are compressed and columns can be pruned when read again. A lost
    executor costs nothing, since the files are in the shared folder.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/step-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside one expression."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def partitions(df: DataFrame) -> int:
    """How many tasks to deal rows to: what the session says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


FILTER_BITS = 1 << 26


def _bit(keys: list[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def among(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are in ``wanted``, and a few others, with a boolean ``_hit`` for all rows.

    A filter of fixed size (8 MB) is broadcast, so rows can be told apart without a shuffle. It has false
    hits, more of them the more keys there are, so an exact join has to follow.
    """
    bits = (
        wanted.select(_bit([F.col(k) for k in keys]).alias("b"))
        .groupBy(F.floor(F.col("b") / 32768).alias("_block"))
        .agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("_bits"))
    )
    bit = _bit([df[k] for k in keys])
    byte = F.substring("_bits", (F.floor((bit % 32768) / 8) + 1).cast("int"), F.lit(1))
    filled = F.conv(F.hex(byte), 16, 10).cast("int")
    mask = F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))
    hit = F.coalesce(filled.bitwiseAND(mask) > 0, F.lit(False))
    marked = df.withColumn("_at", F.floor(bit / 32768)).join(
        F.broadcast(store(bits)), F.col("_at") == F.col("_block"), "left"
    )
    return marked.withColumn("_hit", hit).drop("_at", "_block", "_bits")


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column, ``row``, beside computed keys: no name can clash with the rows' own."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Packed rows whose keys are not in ``gone``, unpacked. Only rows that may be gone are shuffled."""
    marked = among(rows, gone, keys)
    rest = marked.where("_hit").join(gone.select(*keys).distinct(), keys, "left_anti")
    return marked.where("NOT _hit").select("row.*").unionByName(rest.select("row.*"))
