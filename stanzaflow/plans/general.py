"""Queries of the general data-processing operators, with their SQL."""

from __future__ import annotations

from stanzaflow.operators.changes import file_changes
from stanzaflow.operators.tree_aggregate import frequent_song_keys, song_key_stats
from stanzaflow.sources.tables import table


def p1_found(spark, d):
    return frequent_song_keys(table(spark, d, "songs"))


def p1_key_stats(spark, d):
    return song_key_stats(table(spark, d, "songs"))


def _changes(spark, d):
    return file_changes(table(spark, d, "file_scans"), table(spark, d, "source_files"), table(spark, d, "run_log"))


def p6_found(spark, d):
    return _changes(spark, d).where("change <> 'removed'").select("path")


def p6_changes(spark, d):
    return _changes(spark, d)


QUERIES = {"p1_found": p1_found, "p1_key_stats": p1_key_stats, "p6_found": p6_found, "p6_changes": p6_changes}

_KEYS = """
WITH s AS (SELECT DISTINCT song_index, normalized_title, lyric_lines, coalesce(has_chords, false) AS chords, coalesce(line_count, 0) AS lc FROM songs),
k AS (SELECT song_index, 'normalized_title' AS field_name, normalized_title AS key_value, chords, lc FROM s
      UNION ALL SELECT song_index, 'lyric_lines', unnest(lyric_lines), chords, lc FROM s),
d AS (SELECT song_index, field_name, key_value, max(chords::int) AS chorded, max(lc) AS lc FROM k WHERE key_value <> '' GROUP BY 1, 2, 3)
"""

_CHANGES = """
WITH last_seen AS (SELECT path, arg_max({'h': file_hash, 's': size, 'm': mtime_ns}, {'t': scanned_at, 'i': scan_id}) AS n FROM file_scans WHERE path IS NOT NULL GROUP BY path),
recorded AS (SELECT path, arg_max({'h': file_hash, 's': size, 'm': mtime_ns}, updated_at::timestamp) AS o FROM source_files
             WHERE path IS NOT NULL AND last_seen_run IN (SELECT run_id FROM run_log WHERE status = 'ok') GROUP BY path),
c AS (SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed'
        WHEN n.h IS NOT NULL AND o.h IS DISTINCT FROM n.h THEN 'changed'
        WHEN n.h IS NULL AND (o.s IS DISTINCT FROM n.s OR o.m IS DISTINCT FROM n.m) THEN 'changed' END AS change
      FROM last_seen l FULL JOIN recorded r ON l.path = r.path)
"""

ORACLE = {
    "p1_found": _KEYS + "SELECT field_name, key_value FROM d GROUP BY 1, 2 HAVING count(*) * 100 >= 3 * (SELECT count(DISTINCT song_index) FROM songs)",
    "p1_key_stats": _KEYS
    + "SELECT field_name, key_value, count(*)::bigint AS songs, sum(chorded)::bigint AS chorded, sum(lc)::bigint AS line_total, max(lc)::bigint AS line_max FROM d GROUP BY 1, 2",
    "p6_found": _CHANGES + "SELECT path FROM c WHERE change <> 'removed'",
    "p6_changes": _CHANGES + "SELECT path, change FROM c WHERE change IS NOT NULL",
}
