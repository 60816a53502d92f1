"""Queries of blocking, pair measures and grouping."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import blocking as B
from stanzaflow.operators import graph as G
from stanzaflow.operators import similarity as M
from stanzaflow.plans import sql as S
from stanzaflow.sources.tables import table


def songs_of(spark, d):
    """One row per song."""
    return table(spark, d, "songs").dropDuplicates(["song_index"])


def scores_of(spark, d):
    """One row per unordered pair (a < b): the latest."""
    p = table(spark, d, "pair_scores").where("a is not null and b is not null and a <> b")
    rest = [c for c in p.columns if c not in ("a", "b", "scored_at")]
    rows = p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("scored_at", *rest).alias("s"))
    return rows.groupBy("a", "b").agg(F.max("s").alias("s")).select("a", "b", *[f"s.{c}" for c in rest])


def edges_of(spark, d, least: float = 0.86):
    """Pairs whose lyric identity reaches the threshold."""
    return scores_of(spark, d).where(F.col("lyric_identity_score") >= least).select("a", "b")


SONGS_SQL = "sg AS (SELECT DISTINCT ON (song_index) * FROM songs)"
_REST = "decision_hint, final_score, lyric_identity_score, lyric_score, line_coverage_max, title_score"
SCORES_SQL = """sc AS (SELECT a, b, s.* FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, max({'scored_at': scored_at, 'title_score': title_score, 'lyric_score': lyric_score, 'line_coverage_a_in_b': line_coverage_a_in_b,
    'line_coverage_b_in_a': line_coverage_b_in_a, 'line_coverage_max': line_coverage_max, 'line_coverage_min': line_coverage_min, 'lyric_identity_score': lyric_identity_score, 'final_score': final_score,
    'shared_line_count': shared_line_count, 'decision_hint': decision_hint, 'cache_hit': cache_hit, 'matcher_version': matcher_version}) AS s FROM pair_scores WHERE a <> b GROUP BY 1, 2))"""
GROUPS_SQL = f"""
WITH RECURSIVE {SONGS_SQL}, {SCORES_SQL},
ed AS (SELECT a, b FROM sc WHERE lyric_identity_score >= 0.86), nb AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
rc AS (SELECT a AS v, a AS w FROM nb UNION SELECT rc.v, nb.b FROM rc JOIN nb ON rc.w = nb.a),
lb AS (SELECT v, min(w) AS label FROM rc GROUP BY v),
rt AS (SELECT song_index, coalesce(label, song_index) AS root FROM sg LEFT JOIN lb ON v = song_index),
gr AS (SELECT song_index, min(song_index) OVER (PARTITION BY root) AS group_min FROM rt),
gi AS (SELECT song_index, group_min, 'G' || lpad(dense_rank() OVER (ORDER BY group_min)::varchar, 5, '0') AS group_id FROM gr)"""
_KEYS_SQL = f"""
WITH {SONGS_SQL}, ks AS (SELECT 'title' AS kind, normalized_title AS key, song_index AS id, 500 AS cap FROM sg UNION ALL SELECT 'compact', compact_title, song_index, 500 FROM sg
    UNION ALL SELECT 'token', unnest(title_tokens), song_index, 500 FROM sg UNION ALL SELECT 'line', unnest(lyric_lines), song_index, 250 FROM sg UNION ALL SELECT 'shingle', unnest(lyric_shingles), song_index, 250 FROM sg),
ky AS (SELECT * FROM ks WHERE key <> '' AND (kind <> 'line' OR length(key) >= 10 AND key NOT IN ({S.names(T.WEAK_LINES)}))),
bk AS (SELECT kind, key, count(*) AS n, any_value(cap) AS cap FROM ky GROUP BY 1, 2), kp AS (SELECT kind, key FROM bk WHERE n BETWEEN 2 AND cap)"""
_PAIRS_SQL = _KEYS_SQL + ", pr AS (SELECT DISTINCT x.a, y.b FROM (SELECT kind, key, id AS a FROM ky JOIN kp USING (kind, key)) x JOIN (SELECT kind, key, id AS b FROM ky JOIN kp USING (kind, key)) y USING (kind, key) WHERE x.a < y.b)"


def _pair_columns(*columns):
    return lambda spark, d: M.pair_sides(scores_of(spark, d).select("a", "b"), table(spark, d, "songs"), list(columns))


_SIDES = f"WITH {SONGS_SQL}, {SCORES_SQL}, pt AS (SELECT sc.a, sc.b, x.* EXCLUDE (song_index), y.* EXCLUDE (song_index) FROM sc JOIN (SELECT song_index, COLUMNS(c -> c <> 'song_index') FROM sg) x ON x.song_index = sc.a JOIN sg y ON y.song_index = sc.b)"


def _sides_sql(*columns: str) -> str:
    pick = ", ".join(f"x.{c} AS a_{c}, y.{c} AS b_{c}" for c in columns)
    return f"WITH {SONGS_SQL}, {SCORES_SQL}, pt AS (SELECT sc.a, sc.b, {pick} FROM sc JOIN sg x ON x.song_index = sc.a JOIN sg y ON y.song_index = sc.b)"


def _contain_sql(x: str, y: str) -> str:
    a, b = f"list_distinct({S.tokens(S.text(x))})", f"list_distinct({S.tokens(S.text(y))})"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len({a}) ELSE 0 END"


def _cover_sql(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) > 0 AND len({y}) > 0 THEN len(list_filter({x}, lambda z: list_contains({y}, z))) / len({x}) ELSE 0 END"


def joi1_candidate_classes(spark, d):
    return B.candidate_classes(songs_of(spark, d))


def joi1_candidate_links(spark, d):
    return B.candidate_links(B.candidate_pairs(songs_of(spark, d)))


def joi1_covered_links(spark, d):
    """As joi1_candidate_links, with the buckets over the caps too."""
    return B.covered_links(songs_of(spark, d))


def agg1_bucket_sizes(spark, d):
    sizes = B.bucket_sizes(B.blocking_keys(songs_of(spark, d)))
    return sizes.groupBy("kind").agg(F.count(F.lit(1)).alias("buckets"), F.sum("n").alias("rows"), F.max("n").alias("largest"), F.count_if("kept").alias("kept"))


def joi2_over_cap(spark, d):
    return B.bucket_sizes(B.blocking_keys(songs_of(spark, d))).where("n > 1 and not kept").select("kind", "key", "n")


def joi3_token_buckets(spark, d):
    keys = B.blocking_keys(songs_of(spark, d)).where("kind = 'token'")
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("songs"))


def fil4_blocking_lines(spark, d):
    return B.blocking_keys(songs_of(spark, d)).where("kind = 'line'").groupBy(F.col("id").alias("song_index")).agg(F.count(F.lit(1)).alias("lines"))


def sim2_containment(spark, d):
    p = _pair_columns("normalized_title")(spark, d)
    return p.select("a", "b", M.containment(F.col("a_normalized_title"), F.col("b_normalized_title")).alias("a_in_b"), M.containment(F.col("b_normalized_title"), F.col("a_normalized_title")).alias("b_in_a"))


def sim4_exact_coverage(spark, d):
    p = _pair_columns("lyric_lines")(spark, d)
    return p.select("a", "b", M.exact_coverage(F.col("a_lyric_lines"), F.col("b_lyric_lines")).alias("a_in_b"), M.exact_coverage(F.col("b_lyric_lines"), F.col("a_lyric_lines")).alias("b_in_a"))


def sim5_shared_lines(spark, d):
    return _pair_columns("lyric_lines")(spark, d).select("a", "b", M.shared_lines(F.col("a_lyric_lines"), F.col("b_lyric_lines")).alias("shared"))


def sim4_line_coverage(spark, d):
    """Share of the lines of each song of a scored pair that the other has exactly or nearly."""
    return M.line_coverages(scores_of(spark, d).select("a", "b"), table(spark, d, "songs"))


def sim6_exact_pairs(spark, d):
    """Songs with the lyrics of another song, beside the first of them: what the fast path scores 1.0."""
    return M.equal_lyrics(songs_of(spark, d))


def sim7_combined(spark, d):
    s = M.pair_sides(scores_of(spark, d), songs_of(spark, d), ["lyric_lines", "normalized_title"])
    lines = F.least(*[F.coalesce(F.size(f"{p}_lyric_lines"), F.lit(0)) for p in "ab"])
    named = F.coalesce((F.col("a_normalized_title") != "") & (F.col("a_normalized_title") == F.col("b_normalized_title")), F.lit(False))
    parts = s.select(
        "a", "b", F.coalesce("title_score", F.lit(0.0)).alias("title_score"), F.coalesce("lyric_score", F.lit(0.0)).alias("lyric_score"), F.coalesce("line_coverage_a_in_b", F.lit(0.0)).alias("ab"),
        F.coalesce("line_coverage_b_in_a", F.lit(0.0)).alias("ba"), lines.alias("lines"), named.alias("same_title"), F.coalesce("shared_line_count", F.lit(0)).alias("shared_line_count"),
    )
    return M.combine(parts).select("a", "b", F.round("lyric_identity_score", 6).alias("lyric_identity_score"), F.round("final_score", 6).alias("final_score"), "decision_hint")


def sim7_pair_scores(spark, d):
    return M.score_pairs(scores_of(spark, d).select("a", "b"), table(spark, d, "songs"))


def str28_titles_differ(spark, d):
    return _pair_columns("title")(spark, d).select("a", "b", T.titles_differ(F.col("a_title"), F.col("b_title")).alias("differ"))


def str36_paths_differ(spark, d):
    return _pair_columns("source_path")(spark, d).select("a", "b", (F.lower(T.text(F.col("a_source_path"))) != F.lower(T.text(F.col("b_source_path")))).alias("differ"))


def set3_line_difference(spark, d):
    p = _pair_columns("lyric_lines")(spark, d)
    only = lambda x, y: F.size(F.array_except(x, y)).cast("bigint")
    a, b = F.col("a_lyric_lines"), F.col("b_lyric_lines")
    return p.select("a", "b", only(a, b).alias("a_only"), only(b, a).alias("b_only"), F.size(F.array_union(a, b)).cast("bigint").alias("either"))


def sim12_partial_side(spark, d):
    p = _pair_columns("lyric_lines")(spark, d).select("a", "b", F.size("a_lyric_lines").alias("x"), F.size("b_lyric_lines").alias("y"))
    short = lambda x, y: F.col(x) <= F.greatest(F.lit(2), F.floor(F.col(y) * 0.55))
    side = F.when((F.col("x") > 0) & (F.col("y") > 0), F.when(short("x", "y"), "A").when(short("y", "x"), "B").otherwise("")).otherwise("")
    return p.select("a", "b", side.alias("partial"))


def grf1_groups(spark, d):
    return G.groups(table(spark, d, "songs"), edges_of(spark, d))


def grf2_group_ids(spark, d):
    return G.group_ids(grf1_groups(spark, d)).select("song_index", "group_id")


def joi4_pair_titles(spark, d):
    return _pair_columns("title", "source_repo")(spark, d)


_TITLES = _sides_sql("title", "source_repo")
_Z = "coalesce({}, 0)"
_hi, _lo, _t, _y = "greatest(ab, ba)", "least(ab, ba)", "t", "y"
ORACLE = {
    "joi1_candidate_classes": _KEYS_SQL + ", kd AS (SELECT DISTINCT kind, key, id, cap FROM ky), bs AS (SELECT kind, key, id, count(*) OVER w AS n, min(id) OVER w AS rep, cap FROM kd WINDOW w AS (PARTITION BY kind, key)) SELECT kind, md5(kind || '|' || key) AS bucket, rep, id AS song_index, n - 1 AS links, n > cap AS over_cap FROM bs WHERE n > 1",
    "joi1_candidate_links": _PAIRS_SQL + " SELECT id, count(*) AS links FROM (SELECT a AS id FROM pr UNION ALL SELECT b FROM pr) GROUP BY id",
    "joi1_covered_links": _KEYS_SQL + ", pr AS (SELECT DISTINCT x.id AS a, y.id AS b FROM ky x JOIN ky y USING (kind, key) WHERE x.id < y.id) SELECT id, count(*) AS links FROM (SELECT a AS id FROM pr UNION ALL SELECT b FROM pr) GROUP BY id",
    "agg1_bucket_sizes": _KEYS_SQL + " SELECT kind, count(*) AS buckets, sum(n)::bigint AS rows, max(n) AS largest, count(*) FILTER (n BETWEEN 2 AND cap) AS kept FROM bk GROUP BY kind",
    "joi2_over_cap": _KEYS_SQL + " SELECT kind, key, n FROM bk WHERE n > cap",
    "joi3_token_buckets": _KEYS_SQL + " SELECT key, count(*) AS rows, count(DISTINCT id) AS songs FROM ky WHERE kind = 'token' GROUP BY key",
    "fil4_blocking_lines": _KEYS_SQL + " SELECT id AS song_index, count(*) AS lines FROM ky WHERE kind = 'line' GROUP BY id",
    "sim2_containment": _sides_sql("normalized_title") + f" SELECT a, b, {_contain_sql('a_normalized_title', 'b_normalized_title')} AS a_in_b, {_contain_sql('b_normalized_title', 'a_normalized_title')} AS b_in_a FROM pt",
    "sim4_exact_coverage": _sides_sql("lyric_lines") + f" SELECT a, b, {_cover_sql('a_lyric_lines', 'b_lyric_lines')} AS a_in_b, {_cover_sql('b_lyric_lines', 'a_lyric_lines')} AS b_in_a FROM pt",
    "sim5_shared_lines": _sides_sql("lyric_lines") + " SELECT a, b, len(list_distinct(list_intersect(a_lyric_lines, b_lyric_lines))) AS shared FROM pt",
    "sim6_exact_pairs": f"WITH {SONGS_SQL}, e AS (SELECT song_index, coalesce(normalized_title, '') AS t, min(song_index) OVER w AS rep, first_value(coalesce(normalized_title, '')) OVER w AS rt FROM sg WHERE normalized_lyrics <> '' WINDOW w AS (PARTITION BY normalized_lyrics ORDER BY song_index)) SELECT rep, song_index, t = rt AS same_title FROM e WHERE song_index <> rep",
    "sim7_combined": f"""WITH {SONGS_SQL}, {SCORES_SQL}, p AS (SELECT a, b, coalesce(title_score, 0) AS t, coalesce(lyric_score, 0) AS y, coalesce(line_coverage_a_in_b, 0) AS ab, coalesce(line_coverage_b_in_a, 0) AS ba,
        least(coalesce(len(x.lyric_lines), 0), coalesce(len(z.lyric_lines), 0)) AS n, coalesce(x.normalized_title <> '' AND x.normalized_title = z.normalized_title, false) AS named FROM sc JOIN sg x ON a = x.song_index JOIN sg z ON b = z.song_index),
        i AS (SELECT *, CASE WHEN n < 3 THEN y * 0.65::double + {_hi} * 0.2::double + t * 0.15::double ELSE {_hi} * 0.6::double + {_lo} * 0.2::double + y * 0.15::double + t * 0.05::double END AS base FROM p),
        j AS (SELECT *, CASE WHEN named AND n >= 4 AND {_hi} >= 0.88 AND y >= 0.72 THEN greatest(base, {_hi} * 0.7::double + y * 0.2::double + t * 0.1::double) ELSE base END AS s FROM i)
        SELECT a, b, round(s, 6) AS lyric_identity_score, round(greatest(s, y * 0.85::double + t * 0.15::double), 6) AS final_score,
        CASE WHEN s >= 0.86 THEN 'strong' WHEN named AND s < 0.65 THEN 'same_title_different' WHEN s >= 0.65 THEN 'possible' ELSE 'weak' END AS decision_hint FROM j""",
    "str28_titles_differ": _TITLES + f" SELECT a, b, ({S.collapsed('a_title')} <> '' AND {S.collapsed('b_title')} <> '' AND {S.collapsed('a_title')} <> {S.collapsed('b_title')}) AS differ FROM pt",
    "str36_paths_differ": _sides_sql("source_path") + f" SELECT a, b, lower({S.text('a_source_path')}) <> lower({S.text('b_source_path')}) AS differ FROM pt",
    "set3_line_difference": _sides_sql("lyric_lines") + """ SELECT a, b, len(list_filter(list_distinct(a_lyric_lines), lambda z: NOT list_contains(b_lyric_lines, z))) AS a_only,
        len(list_filter(list_distinct(b_lyric_lines), lambda z: NOT list_contains(a_lyric_lines, z))) AS b_only, len(list_distinct(list_concat(a_lyric_lines, b_lyric_lines))) AS either FROM pt""",
    "sim12_partial_side": _sides_sql("lyric_lines") + """, n AS (SELECT a, b, len(a_lyric_lines) AS x, len(b_lyric_lines) AS y FROM pt) SELECT a, b, CASE WHEN NOT (x > 0 AND y > 0) THEN ''
        WHEN x <= greatest(2, floor(y * 0.55::double)) THEN 'A' WHEN y <= greatest(2, floor(x * 0.55::double)) THEN 'B' ELSE '' END AS partial FROM n""",
    "grf1_groups": GROUPS_SQL + " SELECT song_index, group_min FROM gr",
    "grf2_group_ids": GROUPS_SQL + " SELECT song_index, group_id FROM gi",
    "joi4_pair_titles": _TITLES + " SELECT * FROM pt",
}
QUERIES = {k: globals()[k] for k in ORACLE} | {"sim4_line_coverage": sim4_line_coverage, "sim7_pair_scores": sim7_pair_scores}
