"""Best representative of each duplicate group: survivorship in single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.skew import skew_join

#: Sources from the least to the most trusted; any other source comes before all of them.
TRUST = ["repo_a", "repo_b", "repo_c"]


def trust(source: Column) -> Column:
    """Rank of a source, 0 for unknown or null."""
    return F.coalesce(*[F.when(source == s, F.lit(i + 1)) for i, s in enumerate(TRUST)], F.lit(0))


def group_songs(groups: DataFrame, songs: DataFrame, best: dict[str, Column]) -> DataFrame:
    """Distinct members of groups with the maximum of each of ``best`` over the rows of their song; members that are no
    songs drop out. A song that is in very many groups is spread over tasks, and so are one with very many rows and a hot group."""
    members = groups.where("group_id is not null and member_index is not null").select("group_id", F.col("member_index").alias("song_index")).distinct()
    one = songs.groupBy("song_index").agg(*[F.max(c).alias(n) for n, c in best.items()])
    return skew_join(members, one, "song_index")


def survivors(groups: DataFrame, songs: DataFrame) -> DataFrame:
    """(group_id, song_index): the member to keep of each group that has at least two different existing members.

    Order: chords, number of chords, number of lines, trusted source, smallest index; null counts as false or 0. One
    aggregation per group, combined before the shuffle, so the size of a group does not matter; repeated rows change
    nothing.
    """
    rank = F.struct(
        F.coalesce("has_chords", F.lit(False)).alias("a"),
        F.coalesce("chord_count", F.lit(0)).alias("b"),
        F.coalesce("line_count", F.lit(0)).alias("c"),
        trust(F.col("source_repo")).alias("d"),
        (-F.col("song_index")).alias("e"),
    )
    rows = group_songs(groups, songs, {"r": rank})
    best = rows.groupBy("group_id").agg(F.max("r").alias("r"), F.min("song_index").alias("lo"), F.max("song_index").alias("hi"))
    return best.where("lo < hi").select("group_id", (-F.col("r.e")).alias("song_index"))


def golden_records(groups: DataFrame, songs: DataFrame, attributes: list[str], priority: Column, timestamp: Column) -> DataFrame:
    """One row per group, each attribute chosen for itself: non-null first, then priority, timestamp, smallest index.

    Every attribute is the maximum of one composite struct and all are found in the same aggregation. Empty text counts
    as missing. An attribute that no member has is null.
    """
    types = dict(songs.select(*attributes).dtypes)

    def composite(c: str) -> Column:
        value = F.when(F.col(c) != "", F.col(c)) if types[c] == "string" else F.col(c)
        return F.struct(value.isNotNull().alias("k"), priority.alias("p"), timestamp.alias("t"), (-F.col("song_index")).alias("i"), value.alias("v"))

    rows = group_songs(groups, songs, {c: composite(c) for c in attributes})
    best = rows.groupBy("group_id").agg(*[F.max(c).alias(c) for c in attributes], F.count(F.lit(1)).alias("members"))
    return best.select("group_id", *[F.col(f"{c}.v").alias(c) for c in attributes], "members")


def song_golden_records(groups: DataFrame, songs: DataFrame) -> DataFrame:
    """The built record of every group: title, artist, key, chord and line columns."""
    return golden_records(groups, songs, ["title", "artist", "musical_key", "has_chords", "chord_count", "line_count", "source_repo"], trust(F.col("source_repo")), F.col("mtime_ns"))
