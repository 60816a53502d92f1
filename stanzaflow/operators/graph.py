"""Groups of linked songs and their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.operators.skew import HOT_ROWS, materialize, skew_join


def linked_labels(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of undirected edges (a, b): the smallest vertex it reaches.

    Alternates large-star and small-star steps: every vertex links its larger, then its smaller neighbours to the
    smallest of them, until the edges are stars. Each step is one aggregation and one join that splits hot keys. Fewer
    edges than HOT_ROWS / 2 can have no hub, so none is looked for.
    """
    now = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select("v", F.col("u").alias("label")).unionByName(now.select(F.col("u").alias("v"), F.col("u").alias("label"))).groupBy("v").agg(F.min("label").alias("label"))
        before = state
        hot = [] if 2 * state[0] < HOT_ROWS else None  # no vertex of so few edges can be hot
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = skew_join(both.where("u > v"), least, "v", hot=hot).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = large if hot == [] else materialize(large)  # with hubs to look for it is read once more
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = skew_join(large, least, "v", hot=hot)
        now = materialize(small.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct())


def groups(songs: DataFrame, edges: DataFrame) -> DataFrame:
    """(song_index, group_min) of every song; a song without links is a group of its own. Links to unknown songs still join."""
    labels = linked_labels(edges).select(F.col("v").alias("song_index"), "label")
    ids = songs.where("song_index is not null").select("song_index").distinct()
    own = skew_join(ids, labels, "song_index", "left", hot=[]).select("song_index", F.coalesce("label", "song_index").alias("root"))
    own = materialize(own)
    least = own.groupBy("root").agg(F.min("song_index").alias("group_min"))
    return skew_join(own, least, "root").select("song_index", "group_min")


def global_rank(df: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the 1-based position of ``key``, a column of unique values, in its order.

    Ranges of the key are numbered in parallel; only the row count of each range goes to the driver.
    """
    placed = materialize(df.repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _start bigint"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return placed.withColumn("_place", place).join(starts, "_part").select(*df.columns, (F.col("_place") + F.col("_start")).cast("bigint").alias(name))


def group_ids(members: DataFrame) -> DataFrame:
    """(song_index, group_id): groups numbered by their smallest member, as G and five digits."""
    members = materialize(members)
    numbered = global_rank(members.select("group_min").distinct(), "group_min", "n").select("group_min", F.format_string("G%05d", "n").alias("group_id"))
    return skew_join(members, numbered, "group_min").select("song_index", "group_id", "group_min")
