"""Queries of the review layer, the diffs, and tables that are replaced by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import catalog as C
from stanzaflow.operators import diff as D
from stanzaflow.operators import graph as G
from stanzaflow.operators import review as R
from stanzaflow.operators.similarity import pair_sides
from stanzaflow.plans import sql as S
from stanzaflow.plans.catalogue import _CLASS_SQL, _classified, _members, agg8_member_text, prj1_pairs
from stanzaflow.plans.pairs import GROUPS_SQL, SCORES_SQL, SONGS_SQL, scores_of, songs_of
from stanzaflow.sources import files as FS
from stanzaflow.sources import sinks
from stanzaflow.operators.skew import materialize, pair_join
from stanzaflow.sources.tables import table

_c = F.col


REVIEWED = ["lyric_match_title_different", "needs_review", "title_match_lyrics_different", "multiple_chorded_sources"]


def fil1_review_groups(spark, d):
    return _classified(spark, d).where(_c("class").isin(REVIEWED)).select("group_min", "class")


#: The fields of a review candidate that a search looks at.
SEARCHED = ["group_id", "classification", "title", "artist", "author", "source_repo", "source_format", "source_path", "canonical_reason", "members"]


def candidates_of(spark, d):
    """Review candidates: every group with its class, the song that stands for it, its members and whether it was exported."""
    members, songs = materialize(_members(spark, d)), songs_of(spark, d)
    classified = _classified(spark, d, members).select("group_min", _c("class").alias("classification"), "best_identity", _c("members").alias("sources"))
    chosen = C.canonical_songs(members, songs).join(songs.select("song_index", "title", "artist", "author", "source_repo", "source_format", "source_path"), "song_index").withColumnRenamed("reason", "canonical_reason")
    ids = G.group_ids(members).select("group_min", "group_id").distinct()
    rows = classified.join(chosen, "group_min").join(ids, "group_min").join(C.member_text(members, songs), "group_min")
    return rows.join(_exports(spark, d, members).select("group_min", "status"), "group_min")


def fil2_search(spark, d):
    """Review candidates by class and terms that may stand in any of their fields."""
    return R.matching(candidates_of(spark, d), SEARCHED, " best  REPO_ the ", classification="All", status="Unresolved").select("group_id", "classification", "title")


def fil8_features(spark, d):
    return D.features(table(spark, d, "documents"), "text").select("doc_id", "chord_count", "line_count", "lyric_line_count", "completeness")


def par11_members(spark, d):
    text = agg8_member_text(spark, d)
    return text.select("group_min", F.posexplode(R.parse_members(_c("members"))).alias("place", "m")).select("group_min", "place", "m.source_repo", "m.title", "m.source_path")


def joi7_title_index(spark, d):
    rows = prj1_pairs(spark, d).select(_c("a_index").alias("a"), _c("b_index").alias("b"), "a_title", "b_title")
    return R.title_index(rows)


def joi8_group_pairs(spark, d):
    m = materialize(_members(spark, d))
    a, b = m.select(_c("song_index").alias("a"), "group_min"), m.select(_c("song_index").alias("b"), _c("group_min").alias("gb"))
    p = scores_of(spark, d).select("a", "b", "final_score")
    return pair_join(p, a, b).where("group_min = gb").select("group_min", "a", "b", "final_score")


def joi6_groups_with_exports(spark, d):
    """Groups with the latest export that names one of their songs; groups without keep null."""
    return _exports(spark, d, materialize(_members(spark, d)))


def _exports(spark, d, m):
    e = table(spark, d, "match_groups").select(_c("member_index").alias("song_index"), "group_id", "exported_at")
    last = m.join(e, "song_index", "left").groupBy("group_min").agg(F.max(F.struct("exported_at", "group_id")).alias("x"))
    return last.select("group_min", F.when(_c("x.group_id").isNull(), "unresolved").otherwise("resolved").alias("status"), _c("x.group_id").alias("exported_as"))


def joi9_path_merge(spark, d):
    """Recorded and sighted files by path without regard to case, each side where it has the path."""
    a = table(spark, d, "source_files").groupBy(F.lower("path").alias("p")).agg(F.count(F.lit(1)).alias("recorded"))
    b = table(spark, d, "file_scans").groupBy(F.lower("path").alias("p")).agg(F.count(F.lit(1)).alias("sighted"))
    return a.join(b, "p", "full").select("p", F.coalesce("recorded", F.lit(0)).alias("recorded"), F.coalesce("sighted", F.lit(0)).alias("sighted"))


def win2_default_pairs(spark, d):
    """Of every title that several scored pairs share, the pair to compare first, as for each kind of issue in turn."""
    rows = prj1_pairs(spark, d).withColumnsRenamed({"a_index": "a", "b_index": "b"}).withColumn("key", T.normalize_title(_c("a_title")))
    kinds = F.array(*[F.lit(k) for k in ("title_match_lyrics_different", "lyric_match_title_different", "multiple_chorded_sources", "needs_review")])
    rows = rows.where("key <> ''").select("*", F.explode(kinds).alias("kind")).withColumn("g", F.concat_ws("|", "kind", "key"))
    return R.default_pairs(rows, "g", _c("kind"))


def _texts(spark, d):
    one = songs_of(spark, d).select("song_index", F.concat_ws("\n", F.concat(F.lit("Title: "), T.text(_c("title"))), T.text(_c("chordpro_body"))).alias("t"), T.text(_c("title")).alias("title"))
    p = scores_of(spark, d).select("a", "b", _c("lyric_identity_score").alias("identity"))
    side = lambda x: one.select(_c("song_index").alias(x), _c("t").alias(f"t{x}"), _c("title").alias(f"title_{x}"))
    return pair_join(p, side("a"), side("b"))


def pair_class(a_title, b_title, identity):
    """What a scored pair is an issue of: equal titles of little identity, or the other way round."""
    same = T.normalize_title(a_title) == T.normalize_title(b_title)
    return F.when(same & (identity < 0.65), "title_match_lyrics_different").when(~same & (identity >= 0.96), "lyric_match_title_different").otherwise("")


def dif1_song_diffs(spark, d):
    rows = _texts(spark, d).withColumn("class", pair_class(_c("title_a"), _c("title_b"), _c("identity")))
    shown = ["chord_changes", "metadata_changes", "partial", "separate", "summary", "simplified", "truncated"]
    return D.song_diffs(rows, "ta", "tb", ["a", "b"], _c("class")).select("a", "b", F.col("row_count").cast("int").alias("rows"), F.size("lines").alias("shown"), F.round("similarity", 6).alias("similarity"), *shown)


def dif2_positional(spark, d):
    return D.positional(_texts(spark, d), "ta", "tb", ["a", "b"])


def agg7_status_counts(spark, d):
    return dif2_positional(spark, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def lim1_first_lines(spark, d):
    """The lines of a text that a display shows, with a mark where more follow."""
    cut = F.when(F.size("l") > D.RENDERED, F.concat(F.slice("l", 1, D.RENDERED), F.array(F.lit(D.CUT)))).otherwise(_c("l"))
    return table(spark, d, "documents").select("doc_id", T.lines(_c("text")).alias("l")).select("doc_id", F.array_join(cut, "\n").alias("shown"))


def lim3_first_two_members(spark, d):
    m = materialize(_members(spark, d))
    first = m.groupBy("group_min").agg(F.min("song_index").alias("first"))
    second = m.where("song_index <> group_min").groupBy("group_min").agg(F.min("song_index").alias("second"))
    return first.join(second, "group_min", "left").select("group_min", "first", "second")


def dif5_side_tags(spark, d):
    both = pair_sides(scores_of(spark, d).select("a", "b"), table(spark, d, "songs"), ["lyric_lines"])
    rows = both.select("a", "b", _c("b_lyric_lines").alias("lb"), F.explode("a_lyric_lines").alias("line"))
    return rows.select("a", "b", "line", F.when(F.array_contains("lb", _c("line")), "both").otherwise("a_only").alias("tag"))


def ups1_replace_files(spark, d):
    old = table(spark, d, "source_files").groupBy("path").agg(F.max(F.struct("updated_at", "file_hash", "size")).alias("e")).select("path", "e.file_hash", "e.size")
    new = table(spark, d, "file_scans").select("path", "file_hash", "size", "scanned_at", "scan_id")
    return sinks.replace_by_key(old, new, ["path"], F.struct("scanned_at", "scan_id")).select("path", "file_hash", "size")


def ups2_wider_table(spark, d):
    return sinks.replace_by_key(table(spark, d, "run_log"), table(spark, d, "run_log").where("status = 'running'").withColumn("note", F.lit("open")), ["run_id"]).select("run_id", "status", "note")


def set4_without_old(spark, d):
    return table(spark, d, "source_files").join(table(spark, d, "file_scans").select("path").distinct(), "path", "left_anti").select("path", "last_seen_run")


def joi5_cache_hits(spark, d):
    """Scored pairs that an older scoring already had, by the hashes of their files, and those that were new."""
    h = songs_of(spark, d).select("song_index", "file_hash")
    p = table(spark, d, "pair_scores").join(h.select(_c("song_index").alias("a"), _c("file_hash").alias("ha")), "a").join(h.select(_c("song_index").alias("b"), _c("file_hash").alias("hb")), "b")
    keyed = p.select(F.least("ha", "hb").alias("k1"), F.greatest("ha", "hb").alias("k2"), "scored_at")
    cut = F.lit("2024-03-02 00:00:00").cast("timestamp")
    hits, misses = sinks.cached_or_missing(keyed.where(_c("scored_at") >= cut).select("k1", "k2").distinct(), keyed.where(_c("scored_at") < cut).select("k1", "k2").distinct(), ["k1", "k2"])
    return hits.select("k1", "k2", F.lit(True).alias("cached")).unionByName(misses.select("k1", "k2", F.lit(False).alias("cached")))


def src8_detail_rows(spark, d):
    return FS.detail_rows(prj1_pairs(spark, d), "Lantern on the Hill").select("a_index", "b_index", "a_title", "b_title")


def src9_orphans(spark, d):
    named = table(spark, d, "source_files").select(_c("path").alias("export_path"))
    return FS.orphan_exports(table(spark, d, "file_scans").select(_c("path").alias("export_path"), "scan_id"), named)


def srt2_sorted_scores(spark, d):
    """Scored pairs with the number that a review list sorts by; text that is no number counts as 0."""
    return scores_of(spark, d).select("a", "b", T.float_value(_c("final_score").cast("string")).alias("sort_key")).orderBy(F.desc("sort_key"), "a", "b")


def str34_set_title(spark, d):
    """Documents with their first title directive replaced, or one put in front."""
    found = T.text(_c("text")).rlike(r"(?:\A|\n)[ \t]*\{(?:title|t)[ \t]*:[^}\n]*\}[ \t]*(?:\r?\n|\r?\z)")
    parts = F.regexp_replace(T.text(_c("text")), r"(?s)\A(|.*?\n)[ \t]*\{(?:title|t)[ \t]*:[^}\n]*\}[ \t]*(\r?\n|\r?\z)", "$1{title: New Name}$2")
    return table(spark, d, "documents").select("doc_id", F.when(found, parts).otherwise(F.concat(F.lit("{title: New Name}\n"), T.text(_c("text")))).alias("text"))


def str30_anchors(spark, d):
    """Anchors of titles: unsafe characters become underscores, later uses of a slug get a number."""
    from stanzaflow.operators.catalog import collision_names

    slug = F.regexp_replace(T.trim(T.text(_c("title"))), "[^A-Za-z0-9_.-]+", "_")
    named = collision_names(songs_of(spark, d).select("song_index", "title"), F.lit("songbook"), F.when(slug == "", "Song").otherwise(slug), "song_index", fold=False)
    return named.select("song_index", _c("name").alias("anchor"))


def rem1_pair_rows(spark, d):
    return scores_of(spark, d).select("a", "b", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("title_score", "lyric_score", "lyric_identity_score", "final_score")], F.lit(True).alias("cache_hit"))


def rem6_file_hash(spark, d):
    """Hash of every sighted file: its own, else the recorded one, else one of the path."""
    rec = table(spark, d, "source_files").where("file_hash is not null").groupBy("path").agg(F.max(F.struct("updated_at", "file_hash")).alias("e")).select("path", _c("e.file_hash").alias("known"))
    missing = F.sha2(F.encode(F.concat(F.lit("missing|"), _c("path")), "utf-8"), 256)
    return table(spark, d, "file_scans").join(rec, "path", "left").select("scan_id", F.coalesce("file_hash", "known", missing).alias("hash"))


def rem12_issue_table(spark, d):
    """The rows of the issue table: class, title, best identity, sources, status and reason of every review candidate."""
    rows = candidates_of(spark, d).where(_c("classification").isin(REVIEWED))
    return rows.select("group_id", "classification", "title", T.round_even(_c("best_identity")).alias("best_identity"), "sources", "status", _c("canonical_reason").alias("reason"))


_PT = f"WITH {SONGS_SQL}, {SCORES_SQL}, pt AS (SELECT sc.a, sc.b, x.title AS a_title, y.title AS b_title, x.source_repo AS a_source, y.source_repo AS b_source, sc.title_score, sc.lyric_identity_score, sc.final_score FROM sc JOIN sg x ON x.song_index = a JOIN sg y ON y.song_index = b)"
_TX = f"""WITH {SONGS_SQL}, {SCORES_SQL}, tx AS (SELECT sc.a, sc.b, 'Title: ' || {S.text('x.title')} || chr(10) || {S.text('x.chordpro_body')} AS ta, 'Title: ' || {S.text('y.title')} || chr(10) || {S.text('y.chordpro_body')} AS tb FROM sc JOIN sg x ON x.song_index = a JOIN sg y ON y.song_index = b),
al AS (SELECT a, b, {S.lines('ta')} AS la, {S.lines('tb')} AS lb FROM tx), zl AS (SELECT a, b, unnest(range(greatest(len(la), len(lb))))::int AS place, la, lb FROM al),
pl AS (SELECT a, b, place, coalesce(la[place + 1], '') AS l, coalesce(lb[place + 1], '') AS r FROM zl),
sl AS (SELECT a, b, place, l AS "left", r AS "right", CASE WHEN l <> '' AND r <> '' THEN CASE WHEN l = r THEN 'equal' WHEN {S.line_kind('l')} = 'metadata' OR {S.line_kind('r')} = 'metadata' THEN 'metadata'
    WHEN regexp_extract_all(l, {S.q(T.REVIEW_CHORD)}) <> regexp_extract_all(r, {S.q(T.REVIEW_CHORD)}) AND {S.review_line('l')} = {S.review_line('r')} THEN 'chord_change' WHEN {S.review_line('l')} = {S.review_line('r')} THEN 'equal' ELSE 'changed' END
    WHEN l <> '' THEN 'a_only' ELSE 'b_only' END AS status FROM pl WHERE l <> '' OR r <> '')"""
_HAY = "lower(concat_ws(' ', " + ", ".join(S.text(f) for f in SEARCHED) + "))"
_EXPORT_SQL = "e AS (SELECT group_min, max({'t': exported_at, 'g': group_id}) FILTER (group_id IS NOT NULL) AS x FROM gr LEFT JOIN match_groups ON member_index = song_index GROUP BY 1)"
_CAND_SQL = _CLASS_SQL + f""", {_EXPORT_SQL}, mt AS (SELECT group_min, string_agg(coalesce(source_repo, '') || ': ' || coalesce(title, '') || ' [' || coalesce(source_path, '') || ']', ' || ' ORDER BY song_index) AS members FROM gr JOIN sg USING (song_index) GROUP BY 1),
cd AS (SELECT group_id, kl.class AS classification, s AS best_identity, kl.members AS sources, title, artist, author, source_repo, source_format, source_path, reason AS canonical_reason, mt.members AS members, CASE WHEN x IS NULL THEN 'unresolved' ELSE 'resolved' END AS status
    FROM kl JOIN ca USING (group_min) JOIN sg USING (song_index) JOIN (SELECT DISTINCT group_min, group_id FROM gi) USING (group_min) JOIN mt USING (group_min) JOIN e USING (group_min))"""
_DIFFER = f"({S.collapsed('a_title')} <> '' AND {S.collapsed('b_title')} <> '' AND {S.collapsed('a_title')} <> {S.collapsed('b_title')})"
ORACLE = {
    "fil1_review_groups": _CLASS_SQL + " SELECT group_min, class FROM kl WHERE class IN ('lyric_match_title_different', 'needs_review', 'title_match_lyrics_different', 'multiple_chorded_sources')",
    "fil2_search": _CAND_SQL + f" SELECT group_id, classification, title FROM cd WHERE status = 'unresolved' AND contains({_HAY}, 'best') AND contains({_HAY}, 'repo_') AND contains({_HAY}, 'the')",
    "fil8_features": f"""WITH l AS (SELECT doc_id, {S.lines('text')} AS l FROM documents), n AS (SELECT doc_id, list_sum(list_transform(l, lambda x: len(regexp_extract_all(x, {S.q(T.REVIEW_CHORD)})))) AS c, len(l) AS n,
        len(list_filter(l, lambda x: {S.trim('x')} <> '' AND {S.review_line('x')} <> '')) AS y FROM l) SELECT doc_id, coalesce(c, 0)::bigint AS chord_count, n::bigint AS line_count, y::bigint AS lyric_line_count, CASE WHEN y BETWEEN 1 AND 4 THEN 'likely partial' ELSE 'complete-looking' END AS completeness FROM n""",
    "par11_members": GROUPS_SQL + ", o AS (SELECT group_min, row_number() OVER (PARTITION BY group_min ORDER BY song_index) - 1 AS place, source_repo, title, source_path FROM gr JOIN sg USING (song_index)) SELECT group_min, place::int AS place, " + ", ".join(f"{S.trim(S.text(c))} AS {c}" for c in ("source_repo", "title", "source_path")) + " FROM o",
    "joi7_title_index": _PT + f", u AS (SELECT a, b, unnest([{S.title('a_title')}, {S.title('b_title')}]) AS norm_title FROM pt) SELECT DISTINCT norm_title, a, b FROM u WHERE norm_title <> ''",
    "joi8_group_pairs": GROUPS_SQL + " SELECT x.group_min, a, b, final_score FROM sc JOIN gr x ON a = x.song_index JOIN gr y ON b = y.song_index AND x.group_min = y.group_min",
    "joi6_groups_with_exports": GROUPS_SQL + ", e AS (SELECT group_min, max({'t': exported_at, 'g': group_id}) FILTER (group_id IS NOT NULL) AS x FROM gr LEFT JOIN match_groups ON member_index = song_index GROUP BY 1) SELECT group_min, CASE WHEN x IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, x.g AS exported_as FROM e",
    "joi9_path_merge": "SELECT coalesce(a.p, b.p) AS p, coalesce(recorded, 0) AS recorded, coalesce(sighted, 0) AS sighted FROM (SELECT lower(path) AS p, count(*) AS recorded FROM source_files GROUP BY 1) a FULL JOIN (SELECT lower(path) AS p, count(*) AS sighted FROM file_scans GROUP BY 1) b ON a.p = b.p",
    "win2_default_pairs": _PT + f""", k AS (SELECT *, {S.title('a_title')} AS key FROM pt), u AS (SELECT *, unnest(['title_match_lyrics_different', 'lyric_match_title_different', 'multiple_chorded_sources', 'needs_review']) AS kind FROM k WHERE key <> ''),
        o AS (SELECT kind || '|' || key AS g, a, b, CASE kind WHEN 'title_match_lyrics_different' THEN (coalesce(title_score, 0) >= 0.85)::int WHEN 'lyric_match_title_different' THEN {_DIFFER}::int WHEN 'multiple_chorded_sources' THEN (a_source <> 'repo_a')::int + (b_source <> 'repo_a')::int ELSE 0 END AS x,
        CASE WHEN kind = 'title_match_lyrics_different' THEN -coalesce(lyric_identity_score, 0) WHEN kind = 'lyric_match_title_different' AND {_DIFFER} OR kind = 'multiple_chorded_sources' THEN coalesce(lyric_identity_score, 0) ELSE coalesce(final_score, lyric_identity_score, 0) END AS y FROM u),
        r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x DESC, y DESC, a, b) AS k FROM o) SELECT g, a, b FROM r WHERE k = 1""",
    "dif2_positional": _TX + " SELECT * FROM sl",
    "agg7_status_counts": _TX + " SELECT status, count(*) AS n FROM sl GROUP BY 1",
    "lim1_first_lines": f"WITH l AS (SELECT doc_id, {S.lines('text')} AS l FROM documents) SELECT doc_id, array_to_string(CASE WHEN len(l) > {D.RENDERED} THEN list_concat(l[1:{D.RENDERED}], ['{D.CUT}']) ELSE l END, chr(10)) AS shown FROM l",
    "lim3_first_two_members": GROUPS_SQL + " SELECT group_min, min(song_index) AS first, min(song_index) FILTER (song_index <> group_min) AS second FROM gr GROUP BY 1",
    "dif5_side_tags": f"WITH {SONGS_SQL}, {SCORES_SQL}, u AS (SELECT a, b, unnest(x.lyric_lines) AS line, y.lyric_lines AS lb FROM sc JOIN sg x ON x.song_index = a JOIN sg y ON y.song_index = b) SELECT a, b, line, CASE WHEN list_contains(lb, line) THEN 'both' ELSE 'a_only' END AS tag FROM u",
    "ups1_replace_files": """WITH n AS (SELECT DISTINCT ON (path) path, file_hash, size FROM file_scans ORDER BY path, scanned_at DESC, scan_id DESC), o AS (SELECT path, max({'u': updated_at, 'h': file_hash, 's': size}) AS e FROM source_files GROUP BY 1)
        SELECT * FROM n UNION ALL SELECT path, e.h, e.s FROM o WHERE path NOT IN (SELECT path FROM n)""",
    "ups2_wider_table": "SELECT run_id, status, CASE WHEN status = 'running' THEN 'open' END AS note FROM run_log",
    "set4_without_old": "SELECT path, last_seen_run FROM source_files WHERE path NOT IN (SELECT path FROM file_scans)",
    "joi5_cache_hits": f"WITH {SONGS_SQL}, k AS (SELECT least(x.file_hash, y.file_hash) AS k1, greatest(x.file_hash, y.file_hash) AS k2, scored_at >= TIMESTAMPTZ '2024-03-02 00:00:00+00' AS late FROM pair_scores JOIN sg x ON x.song_index = a JOIN sg y ON y.song_index = b) SELECT k1, k2, bool_or(NOT late) AS cached FROM k WHERE k1 IS NOT NULL AND k2 IS NOT NULL GROUP BY 1, 2 HAVING bool_or(late)",
    "src8_detail_rows": _PT + " SELECT a AS a_index, b AS b_index, a_title, b_title FROM pt WHERE 'Lantern on the Hill' IN (a_title, b_title)",
    "src9_orphans": "SELECT path AS export_path, scan_id FROM file_scans WHERE path NOT IN (SELECT path FROM source_files)",
    "srt2_sorted_scores": f"WITH {SCORES_SQL} SELECT a, b, coalesce(final_score, 0) AS sort_key FROM sc",
    "str34_set_title": r"""WITH f AS (SELECT doc_id, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '(?:\A|\n)[ \t]*\{(?:title|t)[ \t]*:[^}\n]*\}[ \t]*(?:\r?\n|\r?\z)') AS found FROM documents)
        SELECT doc_id, CASE WHEN found THEN regexp_replace(text, '(?s)\A(|.*?\n)[ \t]*\{(?:title|t)[ \t]*:[^}\n]*\}[ \t]*(\r?\n|\r?\z)', '\1{title: New Name}\2') ELSE '{title: New Name}' || chr(10) || text END AS text FROM f""",
    "str30_anchors": f"""WITH {SONGS_SQL}, s AS (SELECT song_index, coalesce(nullif({S.re(S.trim(S.text('title')), '[^A-Za-z0-9_.-]+', '_')}, ''), 'Song') AS s FROM sg), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY song_index) AS k FROM s)
        SELECT song_index, CASE WHEN k > 1 THEN s || '_' || k ELSE s END AS anchor FROM r""",
    "rem1_pair_rows": f"WITH {SCORES_SQL} SELECT a, b, coalesce(title_score, 0) AS title_score, coalesce(lyric_score, 0) AS lyric_score, coalesce(lyric_identity_score, 0) AS lyric_identity_score, coalesce(final_score, 0) AS final_score, true AS cache_hit FROM sc",
    "rem6_file_hash": "WITH r AS (SELECT path, (max({'u': updated_at, 'h': file_hash})).h AS known FROM source_files WHERE file_hash IS NOT NULL GROUP BY 1) SELECT scan_id, coalesce(file_hash, known, sha256('missing|' || f.path)) AS hash FROM file_scans f LEFT JOIN r USING (path)",
    "rem12_issue_table": _CAND_SQL + f" SELECT group_id, classification, title, round(best_identity, 6) AS best_identity, sources, status, canonical_reason AS reason FROM cd WHERE classification IN ({S.names(REVIEWED)})",
}
QUERIES = {k: globals()[k] for k in ORACLE} | {"dif1_song_diffs": dif1_song_diffs}
