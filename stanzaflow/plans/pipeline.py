"""The whole run: files in, a classified catalogue with reports and exports out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.config import RunConfig
from stanzaflow.functions import text as T
from stanzaflow.operators import blocking, catalog, graph, similarity
from stanzaflow.operators.skew import materialize, once
from stanzaflow.sources import chordpro, files, openlyrics, sinks

_META = ["song_index", "source_repo", "source_format", "path", "file_hash", "size", "modified"]
_TEXTS = ["title", "artist", "author", "key", "tempo", "time_signature", "copyright", "plain_lyrics", "chordpro_body", "parse_status", "parse_error"]
PAIR_REPORT = (
    "a_index b_index a_title b_title a_source b_source a_path b_path title_score lyric_score line_coverage_a_in_b line_coverage_b_in_a line_coverage_max line_coverage_min lyric_identity_score final_score shared_line_count decision_hint"
).split()


def read_sources(spark: SparkSession, roots: dict[str, str], config: RunConfig) -> DataFrame:
    """Decoded files of the roots, a mapping of source format to folder, with their hashes."""
    found = files.discover(spark, [(roots[k], config.repos[k], k) for k in files.SUFFIXES if k in roots])
    return files.decoded(found.withColumn("file_hash", files.content_hash()))


def parse_files(sources: DataFrame) -> DataFrame:
    """Songs of decoded files. What claims to be XML and is none is read as a sheet, with status warning."""
    xml = materialize(openlyrics.parsed_songs(sources.where("source_format = 'openlyrics'"), "song_index", "text"))
    sheets = sources.where("source_format <> 'openlyrics'").select("song_index", "path", "text", F.lit("").alias("parse_error"))
    broken = sources.join(xml.where("parse_status <> 'ok'").select("song_index", "parse_error"), "song_index").select("song_index", "path", "text", "parse_error")
    read = chordpro.with_parsed_sheet(sheets.unionByName(broken)).withColumn("parse_status", F.when(F.col("parse_error") == "", "ok").otherwise("warning"))
    empty = F.lit("")
    good = xml.where("parse_status = 'ok'").withColumn("tempo", empty).withColumn("time_signature", empty).withColumn("source_meta", F.create_map().cast("map<string,string>"))
    cols = ["song_index", *_TEXTS, "chord_count", "source_meta"]
    rows = good.select(*cols).unionByName(read.select(*cols)).join(sources.select(*_META), "song_index")
    title = F.when(F.col("title") == "", T.title_from_filename(F.col("path"))).otherwise(F.col("title"))
    rows = once(rows.withColumn("title", title).withColumnsRenamed({"key": "musical_key", "path": "source_path"}), "normalized_lyrics", T.normalize_lyric_text(F.col("plain_lyrics")))
    rows = once(rows, "lyric_lines", T.meaningful_lines(F.col("plain_lyrics")))
    return rows.select(
        "*", (F.col("chord_count") > 0).alias("has_chords"), F.size("lyric_lines").alias("line_count"), T.normalize_title(F.col("title")).alias("normalized_title"),
        T.compact_title(F.col("title")).alias("compact_title"), T.title_tokens(F.col("title")).alias("title_tokens"), T.shingles(F.col("normalized_lyrics")).alias("lyric_shingles"),
    )


def build(spark: SparkSession, roots: dict[str, str], out: str, config: RunConfig | None = None) -> dict:
    """Run everything and write below ``out``, shared storage: reports as CSV folders, one export per group, a summary.

    Returns the summary. A dry run writes reports but no exports. No files give empty reports.
    """
    config = config or RunConfig()
    if config.clear:
        sinks.clear_folders(spark, out, [*catalog.FOLDERS.values(), "reports"])
    songs = materialize(parse_files(read_sources(spark, roots, config)))
    scores = materialize(similarity.score_pairs(blocking.covered_pairs(songs, config.caps), songs))
    members = materialize(graph.groups(songs, scores.where(F.col("lyric_identity_score") >= config.auto_identity).select("a", "b")))
    conflicts = catalog.conflict_pairs(scores, songs, config.review)
    best = catalog.best_pairs(members, scores)
    classified = materialize(catalog.classify(catalog.group_features(members, songs, catalog.conflict_songs(conflicts)), best, songs, config.clean, config.review))
    ids = graph.group_ids(members).select("group_min", "group_id").distinct()
    chosen = catalog.canonical_songs(members, songs).join(songs, "song_index").join(classified.drop("members", "best_identity"), "group_min").join(ids, "group_min")
    stems = catalog.collision_names(catalog.with_export_stem(chosen.select("group_min", "title", "artist", "author", "source_path", "source_repo", "class", "folder"), F.col("class")).select("group_min", "folder", "stem"), F.col("folder"), F.col("stem"), "group_min")
    named = materialize(chosen.join(stems.select("group_min", F.concat_ws("/", "folder", F.concat("name", F.lit(".chopro"))).alias("export_path")), "group_min"))

    report = lambda df, name, columns: sinks.write_report(df, f"{out}/reports/{name}.csv", columns)
    report(catalog.inventory(songs).withColumnRenamed("song_index", "index"), "01_inventory_all", ["index", "title", "artist", "author", "source_repo", "source_format", "source_path", "file_hash", "source_meta", "has_chords", "chord_count", "line_count", "parse_status", "parse_error"])
    groups = named.join(best.select("group_min", "best_identity", "best_lyric", "best_coverage"), "group_min", "left").join(classified.select("group_min", F.col("members").alias("member_count")), "group_min").join(catalog.member_text(members, songs), "group_min")
    groups = groups.select("group_id", F.col("class").alias("classification"), F.col("folder").alias("classification_folder"), "member_count", F.col("title").alias("canonical_title"), F.col("source_repo").alias("canonical_source_repo"), F.col("source_path").alias("canonical_source_file"),
                           *[T.round_even(F.col(c)).alias(n) for c, n in (("best_identity", "best_lyric_identity_score"), ("best_lyric", "best_lyric_score"), ("best_coverage", "best_line_coverage_max"))], "members")
    report(groups, "02_match_groups", groups.columns)
    picked = named.select("group_id", F.col("class").alias("classification"), "export_path", F.col("reason").alias("canonical_reason"), "title", "artist", "author", "source_repo", "source_format", "source_path", "file_hash", "has_chords", "chord_count", "line_count")
    report(picked, "03_canonical_selection", picked.columns)

    def pair_rows(pairs: DataFrame) -> DataFrame:
        both = similarity.pair_sides(pairs, songs, ["title", "source_repo", "source_path"])
        rows = both.withColumnsRenamed({"a": "a_index", "b": "b_index"} | {f"{p}_{c}": f"{p}_{n}" for p in "ab" for c, n in (("source_repo", "source"), ("source_path", "path"))})
        kinds = dict(rows.dtypes)
        return rows.select(*[T.round_even(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in PAIR_REPORT])

    report(pair_rows(scores), "07_group_pair_scores", PAIR_REPORT)
    report(pair_rows(conflicts), "08_same_title_different_lyrics", PAIR_REPORT)
    exported = 0
    if not config.dry_run:
        texts = catalog.export_text(songs)
        lines = named.select("song_index", "export_path").join(texts, "song_index")
        exported = sinks.write_files(lines, out, "export_path", "export_text")
    counts = {r["class"]: r["groups"] for r in catalog.class_counts(classified).collect()}
    summary = {"source_count": songs.count(), "group_count": sum(counts.values()), "exported_count": exported, "classification_counts": counts, "title_lyric_conflicts": conflicts.count(), "dry_run": config.dry_run}
    sinks.write_text(spark, f"{out}/reports/run_summary.json", json.dumps(summary, indent=2))
    return summary
