"""From groups to the catalogue: features, best pair, canonical song, class, reports and export text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators.skew import once, pair_join

# Thresholds, source roles, and the folder of each class.
CLEAN, REVIEW = 0.96, 0.65
PRIMARY, PREFERRED = "repo_a", "repo_c"
FOLDERS = {
    "clean_match": "01_clean_match_chordpro", "single_source": "02_single_source_chordpro", "lyrics_only": "03_lyrics_only_chordpro", "lyric_match_title_different": "04_lyric_match_title_different_chordpro",
    "title_match_lyrics_different": "05_title_match_lyrics_different_chordpro", "multiple_chorded_sources": "06_multiple_chorded_sources_chordpro",
    "unmatched_non_openlyrics": "07_unmatched_non_openlyrics_chordpro", "needs_review": "08_needs_review_chordpro",
}


def conflict_pairs(scores: DataFrame, songs: DataFrame, review: float = REVIEW) -> DataFrame:
    """Scored pairs of songs with the same non-empty normalised title and an identity below ``review``."""
    t = songs.select("song_index", "normalized_title").where("normalized_title <> ''").dropDuplicates(["song_index"])
    side = lambda p: t.select(F.col("song_index").alias(p), F.col("normalized_title").alias(f"t{p}"))
    rows = scores.where(F.col("lyric_identity_score") < review)
    return pair_join(rows, side("a"), side("b")).where("ta = tb").select(*scores.columns)


def conflict_songs(conflicts: DataFrame) -> DataFrame:
    """Songs that are in a conflict pair, each once."""
    return conflicts.select(F.explode(F.array("a", "b")).alias("song_index")).distinct()


def best_pairs(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Of every group with a scored pair inside it, the pair of highest identity; ties go to the first pair in member order."""
    m = members.select("song_index", "group_min")
    a = m.select(F.col("song_index").alias("a"), "group_min")
    b = m.select(F.col("song_index").alias("b"), F.col("group_min").alias("gb"))
    rows = scores.where("lyric_identity_score is not null").select("a", "b", "lyric_identity_score", "lyric_score", "line_coverage_max")
    inside = pair_join(rows, a, b).where("group_min = gb")
    best = F.max(F.struct("lyric_identity_score", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"), "lyric_score", "line_coverage_max")).alias("p")
    return inside.groupBy("group_min").agg(best).select(
        "group_min", (-F.col("p.na")).alias("best_a"), (-F.col("p.nb")).alias("best_b"), F.col("p.lyric_identity_score").alias("best_identity"), F.col("p.lyric_score").alias("best_lyric"), F.col("p.line_coverage_max").alias("best_coverage")
    )


def group_features(members: DataFrame, songs: DataFrame, flagged: DataFrame) -> DataFrame:
    """Size, chorded songs, whether a primary source is in it, whether titles differ and whether a member is flagged, by group."""
    s = songs.select("song_index", "has_chords", "source_repo", "normalized_title")
    rows = members.join(s, "song_index").join(flagged.select("song_index", F.lit(True).alias("flag")), "song_index", "left")
    title = F.when(F.col("normalized_title") != "", F.col("normalized_title"))
    return rows.groupBy("group_min").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.coalesce("has_chords", F.lit(False))).alias("chorded"), F.max(F.col("source_repo") == PRIMARY).alias("has_primary"),
        F.coalesce(F.min(title) != F.max(title), F.lit(False)).alias("titles_differ"), F.max(F.coalesce("flag", F.lit(False))).alias("conflict"),
    )


def canonical_songs(members: DataFrame, songs: DataFrame) -> DataFrame:
    """(group_min, song_index, reason): of every group the song that stands for it.

    Chorded songs come first, by chords, lines, lyric length and preferred source; then songs of the primary source and
    then all others, by lines and lyric length. Ties go to the smallest index. One aggregation, so group size does not matter.
    """
    s = songs.select("song_index", "has_chords", "chord_count", "line_count", "source_repo", F.length(T.text(F.col("normalized_lyrics"))).alias("size"))
    chorded = F.coalesce("has_chords", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    tier = F.when(chorded, 2).when(F.col("source_repo") == PRIMARY, 1).otherwise(0)
    rank = F.struct(
        tier.alias("tier"), F.when(chorded, zero("chord_count")).otherwise(0).alias("c"), zero("line_count").alias("l"), F.col("size").alias("n"),
        F.when(chorded & (F.col("source_repo") == PREFERRED), 1).otherwise(0).alias("p"), (-F.col("song_index")).alias("i"),
    )
    best = members.join(s, "song_index").groupBy("group_min").agg(F.max(rank).alias("r"))
    reason = F.when(F.col("r.tier") == 2, "Best available chorded source").when(F.col("r.tier") == 1, "Primary lyrics source; no chords found").otherwise("Best available lyrics-only source")
    return best.select("group_min", (-F.col("r.i")).alias("song_index"), reason.alias("reason"))


def classify(features: DataFrame, best: DataFrame, songs: DataFrame, clean: float = CLEAN, review: float = REVIEW) -> DataFrame:
    """(group_min, class, folder, best_identity): the first rule that holds decides."""
    rows = features.join(best.select("group_min", "best_identity"), "group_min", "left")
    one = songs.select(F.col("song_index").alias("group_min"), F.coalesce("has_chords", F.lit(False)).alias("own_chords"), (F.col("source_repo") == PRIMARY).alias("own_primary"))
    rows = rows.join(one, "group_min", "left")
    score, single = F.col("best_identity"), F.col("members") == 1
    kind = (
        F.when(F.col("conflict") & (score.isNull() | (score < clean)), "title_match_lyrics_different")
        .when(single & F.col("own_chords") & ~F.col("own_primary"), "unmatched_non_openlyrics").when(single & F.col("own_chords"), "single_source").when(single, "lyrics_only")
        .when(F.col("chorded") > 1, "multiple_chorded_sources").when(score.isNull(), "needs_review")
        .when((score >= clean) & F.col("titles_differ"), "lyric_match_title_different").when(score >= clean, "clean_match").when(score >= review, "needs_review")
        .when(F.col("has_primary") & (F.col("chorded") == 0), "lyrics_only").otherwise("needs_review")
    )
    folder = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    return rows.withColumn("class", kind).select("group_min", "class", folder[F.col("class")].alias("folder"), "best_identity", "members")


def class_counts(classified: DataFrame) -> DataFrame:
    """(class, groups) with all classes, 0 for those without groups."""
    spark = classified.sparkSession
    names = spark.createDataFrame([(k,) for k in FOLDERS], "class string")
    return names.join(classified.groupBy("class").agg(F.count(F.lit(1)).alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("groups"))


def member_text(members: DataFrame, songs: DataFrame) -> DataFrame:
    """(group_min, members): the members of a group as one text, ordered by index.

    The text itself holds every member, so a group is as long as its text; members are shortened to their line before
    they are gathered.
    """
    line = F.concat(T.text(F.col("source_repo")), F.lit(": "), T.text(F.col("title")), F.lit(" ["), T.text(F.col("source_path")), F.lit("]"))
    rows = members.join(songs.select("song_index", line.alias("line")), "song_index")
    return rows.groupBy("group_min").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("song_index", "line"))), lambda x: x["line"]), " || ").alias("members"))


def inventory(songs: DataFrame) -> DataFrame:
    """One row per song for the inventory; metadata as JSON, flags as 0 or 1."""
    texts = ["title", "artist", "author", "source_repo", "source_format", "source_path", "file_hash"]
    tail = ["chord_count", "line_count", "parse_status", "parse_error"]
    meta = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("source_meta"))))
    return songs.select("song_index", *texts, F.coalesce(meta, F.lit("{}")).alias("source_meta"), F.col("has_chords").cast("int").alias("has_chords"), *tail)


def with_export_stem(df: DataFrame, kind: Column) -> DataFrame:
    """Adds ``stem``, the file stem of an export: the title, and for two classes also who made the song."""
    filled = lambda c: F.when(T.text(F.col(c)) != "", F.col(c))
    path = T.file_stem(F.col("source_path"))
    creator = F.coalesce(filled("artist"), filled("author"), F.when(path != "", path), F.col("source_repo"))
    made = once(once(df, "_base", T.sanitize_filename(F.col("title"))), "_creator", T.sanitize_filename(creator))
    differ = T.normalize_title(F.col("_base")) != T.normalize_title(F.col("_creator"))
    named = once(made, "_named", kind.isin("title_match_lyrics_different", "multiple_chorded_sources") & differ)
    both = T.sanitize_filename(F.concat("_base", F.lit(" - "), "_creator"))
    return named.withColumn("stem", F.when(F.col("_named"), both).otherwise(F.col("_base"))).drop("_base", "_creator", "_named")


_META = r"^\s*\{([^:{}]+)\s*:\s*(.*?)\s*\}\s*$"
HEADER_NAMES = ["title", "t", "artist", "subtitle", "st", "author", "key", "tempo", "time", "time_signature", "copyright"]


def export_body(body: Column, lyrics: Column) -> Column:
    """Body lines of an export without the metadata that its header repeats; the plain lyrics where there is no body."""
    kept = F.filter(T.lines(T.trim(T.text(body))), lambda x: ~F.lower(T.trim(F.regexp_extract(T.trim(x), _META, 1))).isin(HEADER_NAMES) & T.bare_metadata(T.trim(x)).isNull())
    return F.when(T.trim(T.text(body)) != "", F.array_join(kept, "\n")).otherwise(F.array_join(T.lines(lyrics), "\n"))


def export_header(fields: dict[str, Column]) -> Column:
    """Directives of the fields that are not empty, one per line."""
    made = F.array(*[F.when(T.text(v) != "", F.concat(F.lit("{" + k + ": "), T.escape_directive(v), F.lit("}"))) for k, v in fields.items()])
    return F.array_join(made, "\n")


def export_text(songs: DataFrame) -> DataFrame:
    """(song_index, export_text): a song as a ChordPro text."""
    c = F.col
    head = export_header({"title": c("title"), "artist": c("artist"), "author": c("author"), "key": c("musical_key"), "tempo": c("tempo"), "time": c("time_signature"), "copyright": c("copyright")})
    whole = F.concat(head, F.lit("\n\n"), export_body(c("chordpro_body"), c("plain_lyrics")))
    return songs.select("song_index", F.concat(F.regexp_replace(whole, rf"{T.SPACE}+$", ""), F.lit("\n")).alias("export_text"))


def collision_names(df: DataFrame, folder: Column, stem: Column, order: str, fold: bool = True) -> DataFrame:
    """Adds ``name``: the stem, with _2, _3 ... from the second use in a folder on, in the order of ``order``.

    A folder may hold a great many equal stems: the count is made in ranges of the order, not in one task per stem.
    """
    from stanzaflow.operators.ranks import grouped_rank

    keyed = df.withColumn("_folder", folder).withColumn("_stem", stem).withColumn("_key", F.lower("_stem") if fold else F.col("_stem"))
    ranked = grouped_rank(keyed, ["_folder", "_key"], order, "_n")
    return ranked.withColumn("name", F.when(F.col("_n") > 1, F.concat_ws("_", "_stem", F.col("_n").cast("string"))).otherwise(F.col("_stem"))).drop("_folder", "_stem", "_key", "_n")
