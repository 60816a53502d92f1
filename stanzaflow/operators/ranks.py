"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.operators.skew import materialize


def grouped_rank(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the 1-based position of each row in its group, ordered by ``order``, whose values are unique in a group.

    Rows are range-partitioned by keys and order, so a hot group spans several tasks. Each task numbers its own stretch;
    the rows that earlier tasks hold of the group are added from a table of one row per task and group, which only the
    groups at task borders need.
    """
    placed = materialize(df.repartitionByRange(*[F.col(k) for k in keys], F.col(order)).withColumn("_part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order))
    numbered = placed.withColumn("_local", local)
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).where("_before > 0").select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    match = F.col("s._part") == F.col("n._part")
    for i, k in enumerate(keys):
        match = match & F.col(f"n.{k}").eqNullSafe(F.col(f"s._k{i}"))
    joined = numbered.alias("n").join(starts.alias("s"), match, "left")
    return joined.select(*[F.col(f"n.{c}") for c in df.columns], (F.col("n._local") + F.coalesce("s._before", F.lit(0))).cast("bigint").alias(name))
