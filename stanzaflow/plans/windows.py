"""Queries of order-dependent operators, sets, and what the sinks write."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import blocking as B
from stanzaflow.operators import catalog as C
from stanzaflow.operators import diff as D
from stanzaflow.operators.changes import VersionedTable
from stanzaflow.operators.skew import materialize, once, pair_join, scratch, skew_join
from stanzaflow.plans import sql as S
from stanzaflow.plans.catalogue import _CLASS_SQL, _classified, _members, prj1_pairs
from stanzaflow.plans.catalogue import ORACLE as CATALOGUE_SQL
from stanzaflow.plans.pairs import _KEYS_SQL, SCORES_SQL, SONGS_SQL, scores_of, songs_of
from stanzaflow.plans.reviewing import _TX, dif2_positional, pair_class
from stanzaflow.plans.sheets import _sheets_sql, chords_sql, sheets_of, xml_of
from stanzaflow.plans.smaller import _mapped
from stanzaflow.sources import chordpro as P
from stanzaflow.sources import openlyrics as X
from stanzaflow.sources.tables import table

_c = F.col


def fil5_kept_buckets(spark, d):
    return B.bucket_sizes(B.blocking_keys(songs_of(spark, d))).where("kept").select("kind", "key", "n")


def set2_pairs_by_index(spark, d):
    """Different pairs that each index gives by itself."""
    pairs = B.kept_pairs(songs_of(spark, d))
    return pairs.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"))


def win3_header_lines(spark, d):
    """Lines of a sheet with whether they are still in its header: no line of content came before. Nothing is shuffled."""

    def content(x):
        return T.bind(T.trim(x), lambda s: (s != "") & (F.regexp_extract(s, P.DIRECTIVE, 1) == "") & T.bare_metadata(s).isNull())

    rows = once(sheets_of(spark, d), "c", F.array_position(F.transform(T.lines(_c("text")), content), F.lit(True)))
    return rows.select("song_index", "c", F.posexplode(T.lines(_c("text"))).alias("pos", "line")).select("song_index", "pos", ((_c("c") == 0) | (_c("pos") < _c("c"))).alias("header"))


_COMMENT = r"^\s*\{(?:comment|c|section)\s*:\s*(.*?)\}\s*$"


def win4_section_runs(spark, d):
    """Lines of a document with the number of the section that they are in; a section mark starts the next. Nothing is shuffled."""
    rows = table(spark, d, "documents").select("doc_id", T.lines(_c("text")).alias("l"))
    marks = F.filter(F.transform("l", lambda x, i: F.when(F.regexp_extract(x, _COMMENT, 1) != "", i)), lambda x: x.isNotNull())
    rows = once(rows, "m", marks).select("doc_id", "m", F.posexplode("l").alias("pos", "line"))
    return rows.select("doc_id", "pos", F.size(F.filter("m", lambda x: x <= _c("pos"))).cast("bigint").alias("section"))


def win5_first_seen(spark, d):
    return songs_of(spark, d).select("song_index", F.array_join(F.array_distinct(F.concat("lyric_lines", "lyric_lines")), "\n").alias("lines"))


def srt3_sorted_chords(spark, d):
    rows = P.with_chord_offsets(table(spark, d, "documents"), "doc_id", "text").where(F.size("chords") > 0)
    return rows.select("doc_id", "section", "line", F.array_join(F.transform(F.array_sort(F.transform("chords", lambda c: F.struct(c["offset"].alias("o"), c["text"].alias("t")))), lambda x: x["t"]), " ").alias("chords"))


def snk6_chord_rows(spark, d):
    """The row of chords over every line that has some."""
    rows = P.with_chord_offsets(table(spark, d, "documents"), "doc_id", "text").where(F.size("chords") > 0)
    keyed = rows.select(F.concat_ws("-", "doc_id", "section", "line").alias("k"), F.to_json(F.struct("words", "chords")).alias("line"))

    def over(line: str) -> str:
        import json

        parts = json.loads(line)
        return P.chord_row(parts["words"], [(c["text"], c["offset"]) for c in parts["chords"]])

    return _mapped(keyed, "k", over, ["line"], "string")


def par3_mixed_lines(spark, d):
    def first_verse(xml: str) -> str:
        import xml.etree.ElementTree as ET

        blocks = [e for e in ET.fromstring(xml).iter() if X.local_name(e.tag) == "lines"]
        return "\n".join(X.plain_and_chorded(x)[1] for b in blocks for x in X.mixed_lines(b))

    return _mapped(xml_of(spark, d), "song_index", first_verse, ["xml"], "string")


def str25_trim_offsets(spark, d):
    """Trimmed body lines with the place of their first bracket moved along, inside the line."""
    rows = songs_of(spark, d).select("song_index", F.posexplode(T.lines(_c("chordpro_body"))).alias("pos", "line"))
    lead = F.length("line") - F.length(F.regexp_replace("line", rf"^{T.SPACE}+", ""))
    text = T.trim(_c("line"))
    return rows.select("song_index", "pos", text.alias("text"), F.greatest(F.lit(0), F.least(F.length(text), F.instr("line", "[") - 1 - lead)).cast("bigint").alias("at"))


def dif3_line_status(spark, d):
    return dif2_positional(spark, d).groupBy("a", "b").agg(*[F.count_if(_c("status") == s).alias(s) for s in ("equal", "metadata", "chord_change", "changed", "a_only", "b_only")])


def _keyed_pairs(spark, d):
    """Scored pairs with their texts, their class and the key under which their diff is kept: file hashes, else of the text."""
    text = F.concat_ws("\n", F.concat(F.lit("Title: "), T.text(_c("title"))), T.text(_c("chordpro_body")))
    h = songs_of(spark, d).select("song_index", T.text(_c("title")).alias("title"), text.alias("text"), F.when(T.text(_c("file_hash")) != "", _c("file_hash")).otherwise(F.sha2(F.encode(text, "utf-8"), 256)).alias("h"))
    side = lambda p: h.select(_c("song_index").alias(p), *[_c(c).alias(f"{p}_{c}") for c in ("title", "text", "h")])
    p = pair_join(scores_of(spark, d).select("a", "b", "lyric_identity_score"), side("a"), side("b"))
    p = p.withColumn("classification", pair_class(_c("a_title"), _c("b_title"), _c("lyric_identity_score")))
    return p.withColumn("diff_key", D.diff_key(_c("a_h"), _c("b_h"), _c("classification")))


def dif4_cache_keys(spark, d):
    return _keyed_pairs(spark, d).select("a", "b", "classification", _c("diff_key").alias("cache_key"))


def dif4_read_through(spark, d):
    """Diffs of all scored pairs, where those of pairs whose songs differ little were kept by a run before."""
    pairs = _keyed_pairs(spark, d)
    store = VersionedTable(spark, scratch(spark, "diffs"), "diff_key")
    D.read_through(pairs.where("lyric_identity_score >= 0.65"), store)
    return D.read_through(pairs, store).select("diff_key", "row_count", F.round("similarity", 6).alias("similarity"), "chord_changes", "metadata_changes", "summary", "cached")


def snk1_score_report(spark, d):
    """The pair report as it is written: all its columns, scores rounded to six digits."""
    rows = prj1_pairs(spark, d)
    return rows.select(*[T.round_even(_c(c)).alias(c) if t == "double" else _c(c) for c, t in rows.dtypes])


def snk3_run_summary(spark, d):
    """Counts of the run summary as (name, value)."""
    members = materialize(_members(spark, d))
    songs = members.agg(F.count(F.lit(1)).alias("value")).select(F.lit("source_count").alias("name"), "value")
    groups = members.agg(F.countDistinct("group_min").alias("value")).select(F.lit("group_count").alias("name"), "value")
    return songs.unionByName(groups).unionByName(C.class_counts(_classified(spark, d, members)).select(_c("class").alias("name"), _c("groups").alias("value")))


def rem4_sides(spark, d):
    """Both sides of every scored pair as rows with a marker."""
    one = songs_of(spark, d).select("song_index", "source_repo", "title", "source_path")
    rows = scores_of(spark, d).select("a", "b", F.explode(F.array(F.struct(F.lit("A").alias("marker"), _c("a").alias("song_index")), F.struct(F.lit("B").alias("marker"), _c("b").alias("song_index")))).alias("s")).select("a", "b", "s.*")
    return skew_join(rows, one, "song_index").select("a", "b", "marker", "source_repo", "title", "source_path")


def rem9_title_lookups(spark, d):
    """Report rows that an exact title finds beside those that its normalised form finds, by exact title."""
    t = songs_of(spark, d).where("title <> ''").select("title", T.normalize_title(_c("title")).alias("n")).where("n <> ''")
    exact = t.groupBy("title", "n").agg(F.count(F.lit(1)).alias("exact"))
    return exact.join(t.groupBy("n").agg(F.count(F.lit(1)).alias("normalised")), "n").select("title", "exact", "normalised")


def _header_sql() -> str:
    bare = rf"^[{S.WS}]*([A-Za-z][A-Za-z0-9 ()/_-]{{0,40}})[{S.WS}]*:[{S.WS}]*(.*?)[{S.WS}]*$"
    s = S.trim("line")
    name = f"lower({S.norm_space(f'regexp_extract({s}, {S.q(bare)}, 1)')})"
    known = S.names([*T.DIRECT_FIELDS, *T.SOURCE_FIELDS])
    return f"""WITH {_sheets_sql()}, ar AS (SELECT song_index, {S.lines('text')} AS l FROM sh), li AS (SELECT song_index, unnest(range(len(l)))::int AS pos, unnest(l) AS line FROM ar),
k AS (SELECT song_index, pos, {s} <> '' AND regexp_extract({s}, {S.q(P.DIRECTIVE)}, 1) = '' AND {name} NOT IN ({known}) AS content FROM li)
SELECT song_index, pos, NOT coalesce(bool_or(content) OVER (PARTITION BY song_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS header FROM k"""


_STATUS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("equal", "metadata", "chord_change", "changed", "a_only", "b_only"))
_H = f"WITH {SONGS_SQL}, {SCORES_SQL}"
ORACLE = {
    "srt3_sorted_chords": chords_sql("doc_id", "sh AS (SELECT doc_id, text FROM documents)") + " SELECT doc_id, section, line, array_to_string(list_transform(list_sort(list_transform(chords, lambda c: {'o': c.offset, 't': c.text})), lambda c: c.t), ' ') AS chords FROM ch WHERE len(chords) > 0",
    "fil5_kept_buckets": _KEYS_SQL + " SELECT kind, key, n FROM bk WHERE n BETWEEN 2 AND cap",
    "set2_pairs_by_index": _KEYS_SQL + " SELECT kind, count(*) AS pairs FROM (SELECT DISTINCT kind, x.a, y.b FROM (SELECT kind, key, id AS a FROM ky JOIN kp USING (kind, key)) x JOIN (SELECT kind, key, id AS b FROM ky JOIN kp USING (kind, key)) y USING (kind, key) WHERE x.a < y.b) GROUP BY kind",
    "win3_header_lines": _header_sql(),
    "win4_section_runs": f"WITH a AS (SELECT doc_id, {S.lines('text')} AS l FROM documents), li AS (SELECT doc_id, unnest(range(len(l)))::int AS pos, unnest(l) AS line FROM a) SELECT doc_id, pos, sum((regexp_extract(line, {S.q(_COMMENT)}, 1) <> '')::int) OVER (PARTITION BY doc_id ORDER BY pos)::bigint AS section FROM li",
    "win5_first_seen": f"WITH {SONGS_SQL} SELECT song_index, array_to_string(list_filter(lyric_lines, lambda x, i: list_position(lyric_lines, x) = i), chr(10)) AS lines FROM sg",
    "str25_trim_offsets": f"WITH {SONGS_SQL}, a AS (SELECT song_index, {S.lines('chordpro_body')} AS l FROM sg), li AS (SELECT song_index, unnest(range(len(l)))::int AS pos, unnest(l) AS line FROM a) SELECT song_index, pos, {S.trim('line')} AS text, greatest(0, least(length({S.trim('line')}), instr(line, '[') - 1 - (length(line) - length({S.re('line', f'^[{S.WS}]+')}))))::bigint AS at FROM li",
    "dif3_line_status": _TX + f" SELECT a, b, {_STATUS} FROM sl GROUP BY 1, 2",
    "dif4_cache_keys": _H + f""", k AS (SELECT song_index, {S.title('title')} AS t, coalesce(nullif(file_hash, ''), sha256('Title: ' || {S.text('title')} || chr(10) || {S.text('chordpro_body')})) AS h FROM sg),
        c AS (SELECT a, b, x.h AS xh, y.h AS yh, CASE WHEN x.t = y.t AND lyric_identity_score < 0.65 THEN 'title_match_lyrics_different' WHEN x.t <> y.t AND lyric_identity_score >= 0.96 THEN 'lyric_match_title_different' ELSE '' END AS classification
        FROM sc JOIN k x ON x.song_index = a JOIN k y ON y.song_index = b) SELECT a, b, classification, sha256(xh || '|' || yh || '|' || classification || '|diff.1') AS cache_key FROM c""",
    "snk1_score_report": "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in ("title_score", "lyric_score", "line_coverage_a_in_b", "line_coverage_b_in_a", "line_coverage_max", "line_coverage_min", "lyric_identity_score", "final_score")) + ") FROM (" + CATALOGUE_SQL["prj1_pairs"] + ")",
    "snk3_run_summary": _CLASS_SQL + " SELECT 'source_count' AS name, count(*) AS value FROM gr UNION ALL SELECT 'group_count', count(DISTINCT group_min) FROM gr UNION ALL SELECT fo.class, count(group_min) FROM fo LEFT JOIN kl ON fo.class = kl.class GROUP BY 1",
    "rem4_sides": _H + " SELECT a, b, 'A' AS marker, source_repo, title, source_path FROM sc JOIN sg ON a = song_index UNION ALL SELECT a, b, 'B', source_repo, title, source_path FROM sc JOIN sg ON b = song_index",
    "rem9_title_lookups": f"WITH {SONGS_SQL}, t AS (SELECT title, {S.title('title')} AS n FROM sg WHERE title <> ''), u AS (SELECT * FROM t WHERE n <> '') SELECT title, count(*) AS exact, any_value(m) AS normalised FROM u JOIN (SELECT n, count(*) AS m FROM u GROUP BY 1) USING (n) GROUP BY title",
}
QUERIES = {k: globals()[k] for k in [*ORACLE, "dif4_read_through", "snk6_chord_rows", "par3_mixed_lines"]}
