"""Duplicates hidden by formatting differences: progressive partition refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.bitmap import bitmap_filter, bitmaps_for
from stanzaflow.operators.skew import HOT_ROWS, hottest, materialize, once, skew_join

#: Letters whose counts make up the histogram: frequent ones of the scripts that occur.
HISTOGRAM = ["e", "a", "t", "o", "i", "s", "l", "о", "а", "и", "י", "ה"]


def folded(text: Column) -> Column:
    """Letter case folded; the long form of sharp s, which upper case spells SS. Null is empty."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def bare(text: Column) -> Column:
    """Folded, without punctuation marks and white space."""
    return F.regexp_replace(folded(text), r"(?U)[\p{P}\s]+", "")


def title_words(title: Column) -> Column:
    """Words of a title, single spaces between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(title), r"\p{P}+", ""), r"(?U)\s+", " "))


def section_keys(lyrics: Column) -> Column:
    """Bare sections in sorted order; sections are separated by blank lines, and one without letters is none."""
    parts = F.split(folded(lyrics), r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
    return F.array_sort(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)[\p{P}\s]+", "")), lambda x: x != ""))


def with_cheap_class(songs: DataFrame) -> DataFrame:
    """Adds ``class``, a hash of invariants that are equal for any two copies: bare lengths of title and lyrics, and a letter histogram.

    They do not depend on the order of sections. Null for lyrics without letters.
    """
    text = once(songs.withColumn("_title", bare(F.col("title"))), "_bare", bare(F.col("plain_lyrics")))
    counts = [F.length("_bare") - F.length(F.replace(F.col("_bare"), F.lit(c), F.lit(""))) for c in HISTOGRAM]
    return once(text, "class", F.when(F.length("_bare") > 0, F.xxhash64(F.length("_title"), F.length("_bare"), *counts))).drop("_bare", "_title")


def copy_keys(songs: DataFrame) -> DataFrame:
    """(song_index, copy_key) of the songs that share their cheap class with another song.

    First every song gets its cheap class, and only (song_index, class) is kept. The songs of classes with several members
    become a bitmap of song ids, which the texts are filtered by where they lie; the costlier key, a SHA-256 over title
    words and sorted sections, is made for those alone. A song that passes by a shared bit has a key of its own, since equal
    keys mean equal classes. Hot classes are spread over tasks.
    """
    rows = songs.select("song_index", "title", "plain_lyrics").where("song_index is not null")
    classes = materialize(with_cheap_class(rows).where("class is not null").select("song_index", "class").distinct())
    counted = classes.groupBy("class").agg(F.min("song_index").alias("lo"), F.max("song_index").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = materialize(counted.where("lo < hi").select("class", "n"))
    hot = hottest(several.select(F.col("class").alias("k"), "n"), HOT_ROWS)
    members = materialize(skew_join(classes, several.select("class"), "class", hot=hot).select("song_index"))
    likely = bitmap_filter(rows, "song_index", members, bitmaps_for(members.count()))
    text = F.concat_ws("\u0001", title_words(F.col("title")), F.concat_ws("\u0002", section_keys(F.col("plain_lyrics"))))
    keyed = likely.select("song_index", F.sha2(F.encode(text, "utf-8"), 256).alias("copy_key"), (F.size(section_keys(F.col("plain_lyrics"))) > 0).alias("full"))
    return materialize(keyed.where("full").select("song_index", "copy_key").distinct())


def collapse(songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed songs, and per copy key of at least two songs the one to keep and the number of songs."""
    keyed = copy_keys(songs)
    sets = keyed.groupBy("copy_key").agg(F.min("song_index").alias("keep_index"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return keyed, sets


def formatted_copies(songs: DataFrame) -> DataFrame:
    """(keep_index, song_index): every song that repeats another, with the smallest index of its set.

    Songs with empty or null lyrics are no copies; a null title equals an empty one. Repeated deliveries of a song are
    no copies of it. The members of a large set are spread over tasks, never gathered.
    """
    keyed, sets = collapse(songs)
    return skew_join(keyed, sets, "copy_key").where("keep_index < song_index").select("keep_index", "song_index")


def collapsed_songs(songs: DataFrame) -> DataFrame:
    """(keep_index, copies): one record for each set of copies with the number of songs in it."""
    return collapse(songs)[1].select("keep_index", "copies")
