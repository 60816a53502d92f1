"""A pre-filter of fixed size for joins on a hash: a bitmap of the hashes that can match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap of Spark's bitmap functions, and how many of them a filter has, 256 x 4 KB = 1 MB, or at most.
BITS, BITMAPS, MOST_BITMAPS = 32_768, 256, 4_096


def bitmaps_for(rows: int) -> int:
    """Bitmaps for so many wanted rows: 16 bits a row, from 1 MB to 16 MB; beyond 8 million rows it lets more pass."""
    return max(BITMAPS, min(MOST_BITMAPS, -(-rows * 16 // BITS)))


def _bits(wanted: DataFrame, column: str, bitmaps: int) -> DataFrame:
    """At most ``bitmaps`` rows (_map, _bits): the bitmap built where the wanted rows lie and merged by OR."""
    slot = F.pmod(F.col(column), F.lit(bitmaps * BITS))
    bits = wanted.select(F.floor(slot / BITS).cast("int").alias("_map"), F.pmod(slot, F.lit(BITS)).alias("_bit")).where("_bit is not null")
    return bits.groupBy("_map").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def bitmap_flag(df: DataFrame, column: str, wanted: DataFrame, name: str, bitmaps: int = BITMAPS) -> DataFrame:
    """Adds ``name``: whether the bigint ``column`` may occur in ``wanted`` (one bigint column of the same name).

    The bitmap is broadcast: at most ``bitmaps`` rows of 4 KB however large either side is. A row that only shares a bit
    is flagged too; no wanted row is missed. A null is never flagged. With a filled bitmap all rows are flagged, and it
    costs only its megabytes.
    """
    slot = F.pmod(F.col(column), F.lit(bitmaps * BITS))
    rows = df.withColumn("_map", F.floor(slot / BITS).cast("int")).withColumn("_bit", F.pmod(slot, F.lit(BITS)).cast("int"))
    joined = rows.join(F.broadcast(_bits(wanted, column, bitmaps)), "_map", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.withColumn(name, hit).drop("_map", "_bit", "_bits")


def bitmap_filter(df: DataFrame, column: str, wanted: DataFrame, bitmaps: int = BITMAPS) -> DataFrame:
    """Rows of ``df`` that ``bitmap_flag`` flags; an exact join has to follow where that matters."""
    return bitmap_flag(df, column, wanted, "_likely", bitmaps).where("_likely").drop("_likely")
