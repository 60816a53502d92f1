"""Queries of the smaller operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import catalog as C
from stanzaflow.operators import diff as D
from stanzaflow.operators import similarity as M
from stanzaflow.plans import sql as S
from stanzaflow.plans.catalogue import _heads_sql, _members, fil7_conflicts
from stanzaflow.plans.catalogue import ORACLE as CATALOGUE_SQL
from stanzaflow.plans.pairs import GROUPS_SQL, SCORES_SQL, SONGS_SQL, scores_of, songs_of
from stanzaflow.sources import openlyrics as X
from stanzaflow.sources.tables import table

_c = F.col


def _mapped(df, key: str, function, columns: list[str], kind: str):
    """(key, result) of a Python function over text columns, in Arrow batches; null counts as empty."""
    types = {"string": pa.string(), "double": pa.float64()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[x or "" for x in b.column(i + 1).to_pylist()] for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([function(*x) for x in zip(*cols, strict=True)], types[kind])], names=[key, "result"])

    return df.select(key, *columns).mapInArrow(scan, f"{key} {dict(df.dtypes)[key]}, result {kind}")


def str23_clean_text(spark, d):
    texts = F.array(*[F.struct(F.lit(c).alias("field"), _c(c).alias("text")) for c in ("title", "plain_lyrics", "chordpro_body")])
    rows = songs_of(spark, d).select("song_index", F.explode(texts).alias("t")).select(F.concat_ws("-", "song_index", "t.field").alias("field"), "t.text")
    return _mapped(rows, "field", X.clean_text, ["text"], "string")


def str32_local_name(spark, d):
    """Namespace-free lower-case names of tags made of the source format."""
    df = songs_of(spark, d).select("song_index", F.concat(F.lit("{urn:Song}"), F.initcap("source_format")).alias("tag"))
    return _mapped(df, "song_index", X.local_name, ["tag"], "string")


def sim1_ratios(spark, d):
    """Likeness of titles and of whole lyrics of every scored pair."""
    return M.text_ratios(scores_of(spark, d).select("a", "b"), table(spark, d, "songs"), ["normalized_title", "compact_title", "normalized_lyrics"])


def sim3_line_scores(spark, d):
    """For every line of the first song of a scored pair the likeness of the most like line of the second."""
    return M.best_line_scores(scores_of(spark, d).select("a", "b"), table(spark, d, "songs"))


def par7_titles(spark, d):
    from stanzaflow.plans.sheets import xml_of

    return X.parsed_songs(xml_of(spark, d), "song_index", "xml").select("song_index", "title", "author", "copyright")


def par15_json_round_trip(spark, d):
    kind = "struct<title:string,lines:array<string>,meta:map<string,string>>"
    made = F.to_json(F.struct(_c("title"), _c("lyric_lines").alias("lines"), _c("source_meta").alias("meta")))
    rows = songs_of(spark, d).select("song_index", F.from_json(made, kind).alias("s"))
    return rows.select("song_index", "s.title", F.array_join("s.lines", "\n").alias("lines"), F.coalesce(F.size("s.meta"), F.lit(0)).cast("bigint").alias("meta"))


def prj5_snapshot_text(spark, d):
    c = F.col
    head = C.export_header({"title": c("title"), "artist": c("artist"), "author": c("author"), "key": c("musical_key"), "tempo": c("tempo"), "time": c("time_signature"), "copyright": c("copyright")})
    body = F.when(T.text(c("chordpro_body")) != "", c("chordpro_body")).otherwise(T.text(c("plain_lyrics")))
    return songs_of(spark, d).select("song_index", F.concat(head, F.lit("\n\n"), body).alias("snapshot"))


def rem3_member_texts(spark, d):
    """Length of the text of every exported member; 0 for a member that is no song."""
    s = songs_of(spark, d).select(_c("song_index").alias("member_index"), "plain_lyrics")
    return table(spark, d, "match_groups").select("group_id", "member_index").join(s, "member_index", "left").select("group_id", "member_index", F.length(T.text(_c("plain_lyrics"))).alias("size"))


def rem5_member_counts(spark, d):
    return _members(spark, d).groupBy("group_min").agg(F.count(F.lit(1)).alias("n"))


def rem7_snapshot_lookup(spark, d):
    """The parsed song of every sighted file, found by path and then by the recorded hash."""
    rec = table(spark, d, "source_files").where("file_hash is not null").groupBy("path").agg(F.max(F.struct("updated_at", "file_hash")).alias("e")).select("path", _c("e.file_hash").alias("file_hash"))
    parsed = songs_of(spark, d).where("file_hash is not null").groupBy("file_hash").agg(F.min("song_index").alias("song_index"))
    return table(spark, d, "file_scans").select("scan_id", "path").join(rec, "path", "left").join(parsed, "file_hash", "left").select("scan_id", "song_index")


def rem8_song_features(spark, d):
    return D.features(songs_of(spark, d).select("song_index", "chordpro_body"), "chordpro_body").select("song_index", "chord_count", "lyric_line_count", "completeness")


def agg10_conflict_count(spark, d):
    return fil7_conflicts(spark, d).agg(F.count(F.lit(1)).alias("conflicts"))


def lim2_first_lines(spark, d):
    """The first 200 lines of a song, as many as a quick look at a large text takes."""
    return songs_of(spark, d).select("song_index", F.array_join(F.slice("lyric_lines", 1, 200), "\n").alias("lines"))


def srt1_ordered_pairs(spark, d):
    return scores_of(spark, d).select("a", "b").orderBy("a", "b")


def set1_union_of_roots(spark, d):
    """Files of both listings, repeated ones as often as they are listed."""
    a, b = table(spark, d, "source_files").select("path", "source_repo"), table(spark, d, "file_scans").select("path", "source_repo")
    return a.unionByName(b).groupBy("source_repo").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("path").alias("paths"))


_FEATURES = f"""WITH {SONGS_SQL}, l AS (SELECT song_index, {S.lines('chordpro_body')} AS l FROM sg), n AS (SELECT song_index, list_sum(list_transform(l, lambda x: len(regexp_extract_all(x, {S.q(T.REVIEW_CHORD)})))) AS c,
    len(list_filter(l, lambda x: {S.trim('x')} <> '' AND {S.review_line('x')} <> '')) AS y FROM l) SELECT song_index, coalesce(c, 0)::bigint AS chord_count, y::bigint AS lyric_line_count, CASE WHEN y BETWEEN 1 AND 4 THEN 'likely partial' ELSE 'complete-looking' END AS completeness FROM n"""
ORACLE = {
    "par15_json_round_trip": f"WITH {SONGS_SQL} SELECT song_index, title, array_to_string(lyric_lines, chr(10)) AS lines, coalesce(len(map_keys(source_meta)), 0)::bigint AS meta FROM sg",
    "prj5_snapshot_text": f"WITH {SONGS_SQL} SELECT song_index, {_heads_sql()} || chr(10) || chr(10) || CASE WHEN {S.text('chordpro_body')} <> '' THEN chordpro_body ELSE {S.text('plain_lyrics')} END AS snapshot FROM sg",
    "rem3_member_texts": f"WITH {SONGS_SQL} SELECT group_id, member_index, length({S.text('plain_lyrics')})::int AS size FROM match_groups LEFT JOIN sg ON song_index = member_index",
    "rem5_member_counts": GROUPS_SQL + " SELECT group_min, count(*) AS n FROM gr GROUP BY 1",
    "rem7_snapshot_lookup": f"WITH {SONGS_SQL}, r AS (SELECT path, (max({{'u': updated_at, 'h': file_hash}})).h AS h FROM source_files WHERE file_hash IS NOT NULL GROUP BY 1), p AS (SELECT file_hash, min(song_index) AS song_index FROM sg WHERE file_hash IS NOT NULL GROUP BY 1) SELECT scan_id, song_index FROM file_scans LEFT JOIN r USING (path) LEFT JOIN p ON r.h = p.file_hash",
    "rem8_song_features": _FEATURES,
    "agg10_conflict_count": CATALOGUE_SQL["fil7_conflicts"].rsplit(" SELECT a, b, lyric_identity_score FROM cf", 1)[0] + " SELECT count(*) AS conflicts FROM cf",
    "lim2_first_lines": f"WITH {SONGS_SQL} SELECT song_index, array_to_string(lyric_lines[1:200], chr(10)) AS lines FROM sg",
    "srt1_ordered_pairs": f"WITH {SCORES_SQL} SELECT a, b FROM sc",
    "set1_union_of_roots": "SELECT source_repo, count(*) AS files, count(DISTINCT path) AS paths FROM (SELECT path, source_repo FROM source_files UNION ALL SELECT path, source_repo FROM file_scans) GROUP BY 1",
}
QUERIES = {k: globals()[k] for k in [*ORACLE, "str23_clean_text", "str32_local_name", "sim1_ratios", "sim3_line_scores", "par7_titles"]}
