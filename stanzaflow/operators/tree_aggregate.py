"""Per-key results where a few keys hold most records: multi-level tree aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.bitmap import bitmap_flag
from stanzaflow.operators.skew import materialize

CHUNK_ROWS = 8_192
FAN_IN = 16

#: How two partial states become one.
MERGES = {"sum": F.sum, "max": F.max, "min": F.min}


def n_chunks(rows: int, chunk_rows: int = CHUNK_ROWS) -> int:
    """Chunks of about ``chunk_rows`` rows each; at least one."""
    return max(1, -(-rows // chunk_rows))


def tree_aggregate(rows: DataFrame, keys: list[str], states: dict[str, tuple[str, Column]], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Aggregate ``rows`` by ``keys``; ``states`` maps a result name to (sum|max|min, expression per record).

    A chunk is an input partition, numbered modulo ``chunks``; it is combined where it lies, before anything is shuffled.
    Each round merges the states of ``fan_in`` neighbouring chunks, ceil(log_fan_in(chunks)) rounds in all and one at least,
    so one reducer reads about ``fan_in`` partial states of a key however many records the key has. Which chunk a record
    is in does not matter for the result. Null keys form a group of their own; an empty input gives an empty result.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    state = rows.select(F.pmod(F.spark_partition_id(), F.lit(chunks)).alias("_bucket"), *keys, *[e.alias(name) for name, (_, e) in states.items()])
    left = chunks
    while True:
        left = -(-left // fan_in)
        state = state.groupBy(F.floor(F.col("_bucket") / fan_in).cast("int").alias("_bucket"), *keys).agg(
            *[MERGES[kind](F.col(name)).alias(name) for name, (kind, _) in states.items()]
        )
        if left == 1:
            return state.drop("_bucket")


def song_keys(songs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per song, field and key: the title and each distinct line of every song.

    ``ids`` (song_index, n) counts the deliveries of every song. Most were delivered once, and those are taken apart where they lie; a bitmap
    tells them. The rest, with any that share a bit, are brought to one row per song and key, combined before the shuffle.
    A title that is null or empty gives no row, nor does a null or empty line.
    """
    rows = songs.select("song_index", "normalized_title", "lyric_lines", F.coalesce(F.col("has_chords").cast("int"), F.lit(0)).alias("chorded"), F.coalesce("line_count", F.lit(0)).alias("line_count"))
    again = ids.where("n > 1").select("song_index")
    flagged = bitmap_flag(rows, "song_index", again, "_again").withColumn("_again", F.col("_again") | F.col("song_index").isNull())
    title = F.array(F.struct(F.lit("normalized_title").alias("field_name"), F.col("normalized_title").alias("key_value")))
    lines = F.array_distinct(F.coalesce("lyric_lines", F.array().cast("array<string>")))
    line = F.transform(lines, lambda x: F.struct(F.lit("lyric_lines").alias("field_name"), x.alias("key_value")))
    each = lambda df: df.select("song_index", F.explode(F.concat(title, line)).alias("k"), "chorded", "line_count").select("song_index", "k.*", "chorded", "line_count").where("key_value <> ''")
    several = each(flagged.where("_again")).groupBy("song_index", "field_name", "key_value").agg(F.max("chorded").alias("chorded"), F.max("line_count").alias("line_count"))
    return each(flagged.where("not _again")).unionByName(several).drop("song_index")


def _counted(songs: DataFrame) -> tuple[DataFrame, int, int]:
    """Deliveries of every song, and how many rows and how many songs there are."""
    ids = materialize(songs.groupBy("song_index").agg(F.count(F.lit(1)).alias("n")))
    rows, known = ids.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("song_index")).first()
    return ids, rows, known


def song_key_stats(songs: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Songs, chorded songs, summed and largest line count of every title and of every line."""
    ids, rows, _ = _counted(songs)
    states = {
        "songs": ("sum", F.lit(1).cast("bigint")),
        "chorded": ("sum", F.col("chorded").cast("bigint")),
        "line_total": ("sum", F.col("line_count").cast("bigint")),
        "line_max": ("max", F.col("line_count").cast("bigint")),
    }
    return tree_aggregate(song_keys(songs, ids), ["field_name", "key_value"], states, n_chunks(rows, chunk_rows), fan_in)


def frequent_song_keys(songs: DataFrame, percent: int = 3, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """Titles and lines that at least ``percent`` of all songs have. A song counts once, however often it was delivered."""
    ids, rows, total = _counted(songs)
    counted = tree_aggregate(song_keys(songs, ids), ["field_name", "key_value"], {"songs": ("sum", F.lit(1).cast("bigint"))}, n_chunks(rows, chunk_rows), fan_in)
    return counted.where(F.col("songs") * 100 >= F.lit(percent * total)).select("field_name", "key_value")
