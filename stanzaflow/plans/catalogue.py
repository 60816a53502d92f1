"""Queries of the catalogue: features, canonical songs, classes, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import catalog as C
from stanzaflow.operators import graph as G
from stanzaflow.operators import similarity as M
from stanzaflow.operators.skew import materialize
from stanzaflow.plans import sql as S
from stanzaflow.plans.pairs import GROUPS_SQL, SCORES_SQL, SONGS_SQL, edges_of, scores_of, songs_of
from stanzaflow.sources.tables import table


def _members(spark, d):
    return G.groups(table(spark, d, "songs"), edges_of(spark, d))


def _classified(spark, d, members=None):
    songs, scores = songs_of(spark, d), scores_of(spark, d)
    members = materialize(_members(spark, d)) if members is None else members
    features = C.group_features(members, songs, C.conflict_songs(C.conflict_pairs(scores, songs)))
    return C.classify(features, C.best_pairs(members, scores), songs)


def fil6_strong_pairs(spark, d):
    return edges_of(spark, d)


def fil7_conflicts(spark, d):
    return C.conflict_pairs(scores_of(spark, d), songs_of(spark, d)).select("a", "b", "lyric_identity_score")


def agg6_conflict_songs(spark, d):
    return C.conflict_songs(C.conflict_pairs(scores_of(spark, d), songs_of(spark, d)))


def agg2_class_counts(spark, d):
    return C.class_counts(_classified(spark, d))


def agg3_group_features(spark, d):
    songs, scores = songs_of(spark, d), scores_of(spark, d)
    return C.group_features(_members(spark, d), songs, C.conflict_songs(C.conflict_pairs(scores, songs)))


def agg4_best_pairs(spark, d):
    return C.best_pairs(_members(spark, d), scores_of(spark, d))


def agg5_score_statistics(spark, d):
    s = scores_of(spark, d)
    return s.agg(F.count(F.lit(1)).alias("pairs"), F.count_if("cache_hit").alias("cached"), F.count_if(~F.col("cache_hit")).alias("computed"), F.count_if(F.col("lyric_identity_score") >= 1.0).alias("fast_path"))


def agg8_member_text(spark, d):
    return C.member_text(_members(spark, d), songs_of(spark, d))


def win1_canonical(spark, d):
    return C.canonical_songs(_members(spark, d), songs_of(spark, d))


def cls1_classes(spark, d):
    return _classified(spark, d).select("group_min", "class", "best_identity")


def cls2_folders(spark, d):
    return _classified(spark, d).groupBy("folder").agg(F.sum("members").alias("songs"))


def prj1_inventory(spark, d):
    return C.inventory(songs_of(spark, d)).drop("source_meta")


def prj1_inventory_meta(spark, d):
    return C.inventory(songs_of(spark, d)).select("song_index", "source_meta")


def prj1_groups(spark, d):
    members, songs = materialize(_members(spark, d)), songs_of(spark, d)
    named = C.canonical_songs(members, songs).join(songs.select("song_index", "title", "source_repo", "source_path"), "song_index")
    best = C.best_pairs(members, scores_of(spark, d)).select("group_min", "best_lyric", "best_coverage")
    rows = _classified(spark, d, members).join(named, "group_min").join(G.group_ids(members).select("group_min", "group_id").distinct(), "group_min").join(best, "group_min", "left")
    return rows.select("group_id", F.col("class").alias("classification"), F.col("folder").alias("classification_folder"), F.col("members").alias("member_count"), F.col("title").alias("canonical_title"),
                       F.col("source_repo").alias("canonical_source_repo"), F.col("source_path").alias("canonical_source_file"), "best_identity", "best_lyric", "best_coverage")


def prj1_pairs(spark, d):
    both = M.pair_sides(scores_of(spark, d), songs_of(spark, d), ["title", "source_repo", "source_path"])
    return both.withColumnsRenamed({f"{p}_{c}": f"{p}_{n}" for p in "ab" for c, n in (("source_repo", "source"), ("source_path", "path"))}).select(
        F.col("a").alias("a_index"), F.col("b").alias("b_index"), "a_title", "b_title", "a_source", "b_source", "a_path", "b_path", "title_score", "lyric_score", "line_coverage_a_in_b", "line_coverage_b_in_a",
        "line_coverage_max", "line_coverage_min", "lyric_identity_score", "final_score", "shared_line_count", "decision_hint", F.col("cache_hit").cast("int").alias("cache_hit"),
    )


def prj4_export_stem(spark, d):
    members, songs = materialize(_members(spark, d)), songs_of(spark, d)
    rows = _classified(spark, d, members).join(C.canonical_songs(members, songs), "group_min").join(songs.select("song_index", "title", "artist", "author", "source_path", "source_repo"), "song_index")
    return C.with_export_stem(rows, F.col("class")).select("group_min", "stem")


def snk2_export_text(spark, d):
    return C.export_text(songs_of(spark, d))


def fil3_export_body(spark, d):
    return songs_of(spark, d).select("song_index", C.export_body(F.col("chordpro_body"), F.col("plain_lyrics")).alias("body"))


def win6_collision_names(spark, d):
    named = C.collision_names(songs_of(spark, d).select("song_index", "source_repo", "title"), F.col("source_repo"), T.safe_filename(F.col("title")), "song_index")
    return named.select("song_index", "name")


_CLASS_SQL = (
    GROUPS_SQL
    + f""",
cf AS (SELECT a, b, lyric_identity_score FROM sc JOIN sg x ON x.song_index = a JOIN sg y ON y.song_index = b WHERE x.normalized_title <> '' AND x.normalized_title = y.normalized_title AND lyric_identity_score < 0.65),
cs AS (SELECT a AS song_index FROM cf UNION SELECT b FROM cf),
ft AS (SELECT group_min, count(*) AS members, count(*) FILTER (coalesce(has_chords, false)) AS chorded, bool_or(source_repo = 'repo_a') AS has_primary,
    count(DISTINCT nullif(normalized_title, '')) > 1 AS titles_differ, bool_or(song_index IN (SELECT song_index FROM cs)) AS conflict FROM gr JOIN sg USING (song_index) GROUP BY group_min),
bp AS (SELECT x.group_min, a, b, lyric_identity_score AS i, lyric_score AS l, line_coverage_max AS c, row_number() OVER (PARTITION BY x.group_min ORDER BY lyric_identity_score DESC, a, b) AS k
    FROM sc JOIN gr x ON a = x.song_index JOIN gr y ON b = y.song_index AND x.group_min = y.group_min WHERE lyric_identity_score IS NOT NULL),
be AS (SELECT group_min, a AS best_a, b AS best_b, i AS best_identity, l AS best_lyric, c AS best_coverage FROM bp WHERE k = 1),
kl AS (SELECT group_min, members, best_identity AS s, CASE WHEN conflict AND (s IS NULL OR s < 0.96) THEN 'title_match_lyrics_different'
    WHEN members = 1 AND coalesce(has_chords, false) AND source_repo <> 'repo_a' THEN 'unmatched_non_openlyrics' WHEN members = 1 AND coalesce(has_chords, false) THEN 'single_source' WHEN members = 1 THEN 'lyrics_only'
    WHEN chorded > 1 THEN 'multiple_chorded_sources' WHEN s IS NULL THEN 'needs_review' WHEN s >= 0.96 AND titles_differ THEN 'lyric_match_title_different' WHEN s >= 0.96 THEN 'clean_match'
    WHEN s >= 0.65 THEN 'needs_review' WHEN has_primary AND chorded = 0 THEN 'lyrics_only' ELSE 'needs_review' END AS class
    FROM ft LEFT JOIN be USING (group_min) LEFT JOIN sg ON song_index = group_min),
rk AS (SELECT group_min, song_index, CASE WHEN coalesce(has_chords, false) THEN 2 WHEN source_repo = 'repo_a' THEN 1 ELSE 0 END AS tier, row_number() OVER (PARTITION BY group_min ORDER BY
    CASE WHEN coalesce(has_chords, false) THEN 2 WHEN source_repo = 'repo_a' THEN 1 ELSE 0 END DESC, CASE WHEN coalesce(has_chords, false) THEN coalesce(chord_count, 0) ELSE 0 END DESC,
    coalesce(line_count, 0) DESC, length(coalesce(normalized_lyrics, '')) DESC, (coalesce(has_chords, false) AND source_repo = 'repo_c') DESC, song_index) AS k FROM gr JOIN sg USING (song_index)),
ca AS (SELECT group_min, song_index, CASE tier WHEN 2 THEN 'Best available chorded source' WHEN 1 THEN 'Primary lyrics source; no chords found' ELSE 'Best available lyrics-only source' END AS reason FROM rk WHERE k = 1),
fo AS (SELECT unnest([{S.names(list(C.FOLDERS))}]) AS class, unnest([{S.names(list(C.FOLDERS.values()))}]) AS folder)"""
)


def _heads_sql() -> str:
    made = ", ".join(
        f"CASE WHEN {S.text(col)} <> '' THEN '{{{name}: ' || {S.trim(f'replace({S.text(col)}, chr(10), {chr(39)} {chr(39)})')} || '}}' END"
        for name, col in [("title", "title"), ("artist", "artist"), ("author", "author"), ("key", "musical_key"), ("tempo", "tempo"), ("time", "time_signature"), ("copyright", "copyright")]
    )
    return f"array_to_string(list_filter([{made}], lambda z: z IS NOT NULL), chr(10))"


def _body_sql() -> str:
    names = S.names(C.HEADER_NAMES)
    key = f"lower({S.trim('regexp_extract(' + S.trim('z') + ', ' + S.q(C._META) + ', 1)')})"
    pattern = rf"^[{S.WS}]*([A-Za-z][A-Za-z0-9 ()/_-]{{0,40}})[{S.WS}]*:[{S.WS}]*(.*?)[{S.WS}]*$"
    bare = f"lower({S.norm_space('regexp_extract(' + S.trim('z') + ', ' + S.q(pattern) + ', 1)')})"
    known = S.names([*T.DIRECT_FIELDS, *T.SOURCE_FIELDS])
    kept = f"list_filter({S.lines(S.trim(S.text('chordpro_body')))}, lambda z: {key} NOT IN ({names}) AND {bare} NOT IN ({known}))"
    return f"CASE WHEN {S.trim(S.text('chordpro_body'))} <> '' THEN array_to_string({kept}, chr(10)) ELSE array_to_string({S.lines('plain_lyrics')}, chr(10)) END"


def _stem_sql() -> str:
    base = S.sanitize("title")
    creator = S.sanitize(f"coalesce(nullif(artist, ''), nullif(author, ''), nullif({S.stem('source_path')}, ''), source_repo)")
    return f"""WITH_BASE, st AS (SELECT group_min, class, {base} AS base, {creator} AS creator FROM kl JOIN ca USING (group_min) JOIN sg USING (song_index))
SELECT group_min, CASE WHEN class IN ('title_match_lyrics_different', 'multiple_chorded_sources') AND {S.title('base')} <> {S.title('creator')} THEN {S.sanitize("base || ' - ' || creator")} ELSE base END AS stem FROM st""".replace("WITH_BASE", _CLASS_SQL)


_SIDE = "x.title AS a_title, y.title AS b_title, x.source_repo AS a_source, y.source_repo AS b_source, x.source_path AS a_path, y.source_path AS b_path"
_ONE = f"WITH {SONGS_SQL}"
ORACLE = {
    "fil6_strong_pairs": f"WITH {SCORES_SQL} SELECT a, b FROM sc WHERE lyric_identity_score >= 0.86",
    "fil7_conflicts": _CLASS_SQL + " SELECT a, b, lyric_identity_score FROM cf",
    "agg6_conflict_songs": _CLASS_SQL + " SELECT song_index FROM cs",
    "agg2_class_counts": _CLASS_SQL + " SELECT fo.class, count(group_min) AS groups FROM fo LEFT JOIN kl ON fo.class = kl.class GROUP BY 1",
    "agg3_group_features": _CLASS_SQL + " SELECT * FROM ft",
    "agg4_best_pairs": _CLASS_SQL + " SELECT * FROM be",
    "agg5_score_statistics": f"WITH {SCORES_SQL} SELECT count(*) AS pairs, count(*) FILTER (cache_hit) AS cached, count(*) FILTER (NOT cache_hit) AS computed, count(*) FILTER (lyric_identity_score >= 1) AS fast_path FROM sc",
    "agg8_member_text": _CLASS_SQL + " SELECT group_min, string_agg(coalesce(source_repo, '') || ': ' || coalesce(title, '') || ' [' || coalesce(source_path, '') || ']', ' || ' ORDER BY song_index) AS members FROM gr JOIN sg USING (song_index) GROUP BY 1",
    "win1_canonical": _CLASS_SQL + " SELECT * FROM ca",
    "cls1_classes": _CLASS_SQL + " SELECT group_min, class, s AS best_identity FROM kl",
    "cls2_folders": _CLASS_SQL + " SELECT folder, sum(members)::bigint AS songs FROM kl JOIN fo USING (class) GROUP BY 1",
    "prj1_inventory": _ONE + " SELECT song_index, title, artist, author, source_repo, source_format, source_path, file_hash, has_chords::int AS has_chords, chord_count, line_count, parse_status, parse_error FROM sg",
    "prj1_groups": _CLASS_SQL + """ SELECT group_id, class AS classification, folder AS classification_folder, members AS member_count, title AS canonical_title, source_repo AS canonical_source_repo, source_path AS canonical_source_file,
        best_identity, best_lyric, best_coverage FROM kl JOIN ca USING (group_min) JOIN sg USING (song_index) JOIN fo USING (class) JOIN (SELECT DISTINCT group_min, group_id FROM gi) USING (group_min) LEFT JOIN be USING (group_min)""",
    "prj1_pairs": f"""WITH {SONGS_SQL}, {SCORES_SQL} SELECT a AS a_index, b AS b_index, {_SIDE}, title_score, lyric_score, line_coverage_a_in_b, line_coverage_b_in_a, line_coverage_max, line_coverage_min, lyric_identity_score,
        final_score, shared_line_count, decision_hint, cache_hit::int AS cache_hit FROM sc JOIN sg x ON x.song_index = a JOIN sg y ON y.song_index = b""",
    "prj4_export_stem": _stem_sql(),
    "snk2_export_text": f"{_ONE} SELECT song_index, {S.re('(' + _heads_sql() + ' || chr(10) || chr(10) || ' + _body_sql() + ')', f'[{S.WS}]+$')} || chr(10) AS export_text FROM sg",
    "fil3_export_body": f"{_ONE} SELECT song_index, {_body_sql()} AS body FROM sg",
    "win6_collision_names": f"""{_ONE}, n AS (SELECT song_index, source_repo, {S.safe_name('title')} AS stem FROM sg), r AS (SELECT *, row_number() OVER (PARTITION BY source_repo, lower(stem) ORDER BY song_index) AS k FROM n)
        SELECT song_index, CASE WHEN k > 1 THEN stem || '_' || k ELSE stem END AS name FROM r""",
    "prj1_inventory_meta": _ONE + " SELECT song_index, CASE WHEN source_meta IS NULL OR len(map_keys(source_meta)) = 0 THEN '{}' ELSE '{' || array_to_string(list_transform(list_sort(map_keys(source_meta)), lambda k: to_json(k) || ':' || to_json(source_meta[k])), ',') || '}' END AS source_meta FROM sg",
}
QUERIES = {k: globals()[k] for k in ORACLE}
