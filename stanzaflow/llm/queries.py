"""Queries of the training-data operators, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stanzaflow.sources.tables import table


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.components import song_components

    return song_components(table(spark, d, "pair_scores"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.encoding import garbled_fields

    return garbled_fields(table(spark, d, "songs"), table(spark, d, "lang_samples"))


def _p3_restored(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.encoding import repaired_fields

    return repaired_fields(table(spark, d, "songs"), table(spark, d, "lang_samples")).distinct()


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.lookalikes import disguised_fields

    return disguised_fields(table(spark, d, "songs"), table(spark, d, "lang_samples"))


def _p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.lookalikes import canonical_fields

    return canonical_fields(table(spark, d, "songs"))


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.survivor import survivors

    return survivors(table(spark, d, "match_groups"), table(spark, d, "songs"))


def _p4_golden(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.survivor import song_golden_records

    return song_golden_records(table(spark, d, "match_groups"), table(spark, d, "songs"))


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.formatting import formatted_copies

    return formatted_copies(table(spark, d, "songs"))


def _p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.formatting import collapsed_songs

    return collapsed_songs(table(spark, d, "songs"))


def _p8_packed(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.packing import packed

    return packed(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def _p8_fill(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.packing import fill

    return fill(table(spark, d, "documents"), table(spark, d, "pack_targets"))


def _p9_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.leaks import leaked_items

    return leaked_items(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.languages import label_cases

    return label_cases(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def _p10_documents(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.languages import document_languages

    return document_languages(table(spark, d, "documents"), table(spark, d, "lang_samples"))


def _p10_segments(spark: SparkSession, d: str) -> DataFrame:
    from stanzaflow.llm.languages import document_segments

    return document_segments(table(spark, d, "documents"), table(spark, d, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": _p2_found,
    "p3_found": _p3_found,
    "p3_restored": _p3_restored,
    "p4_found": _p4_found,
    "p4_golden": _p4_golden,
    "p5_found": _p5_found,
    "p5_canonical": _p5_canonical,
    "p7_found": _p7_found,
    "p7_collapsed": _p7_collapsed,
    "p8_packed": _p8_packed,
    "p8_fill": _p8_fill,
    "p9_found": _p9_found,
    "p10_found": _p10_found,
    "p10_documents": _p10_documents,
    "p10_segments": _p10_segments,
}

ORACLE: dict[str, str] = {
    "p2_found": """
WITH RECURSIVE p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max({'t': scored_at, 'h': decision_hint, 's': final_score}) AS s
    FROM pair_scores WHERE a <> b GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE s.h = 'strong' AND s.s >= 0.86),
n AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS v, a AS w FROM n UNION SELECT r.v, n.b FROM r JOIN n ON r.w = n.a)
SELECT v AS song_index, min(w) AS component_id FROM r GROUP BY v""",
    "p4_found": """
WITH m AS (SELECT DISTINCT group_id, song_index, coalesce(has_chords, false) AS a, coalesce(chord_count, 0) AS b, coalesce(line_count, 0) AS c,
    CASE source_repo WHEN 'repo_c' THEN 3 WHEN 'repo_b' THEN 2 WHEN 'repo_a' THEN 1 ELSE 0 END AS d
    FROM match_groups JOIN songs ON member_index = song_index WHERE group_id IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY a DESC, b DESC, c DESC, d DESC, song_index) AS k,
    min(song_index) OVER (PARTITION BY group_id) AS lo, max(song_index) OVER (PARTITION BY group_id) AS hi FROM m)
SELECT group_id, song_index FROM g WHERE k = 1 AND lo < hi""",
    "p4_golden": "WITH m AS (SELECT DISTINCT group_id, song_index, mtime_ns, title, artist, musical_key, has_chords, chord_count, line_count, source_repo,"
    " CASE source_repo WHEN 'repo_c' THEN 3 WHEN 'repo_b' THEN 2 WHEN 'repo_a' THEN 1 ELSE 0 END AS p FROM match_groups JOIN songs ON member_index = song_index WHERE group_id IS NOT NULL) SELECT group_id, "
    + ", ".join(
        f"first({v} ORDER BY ({v}) IS NOT NULL DESC, p DESC, mtime_ns DESC, song_index) AS {c}"
        for c, v in [("title", "nullif(title, '')"), ("artist", "nullif(artist, '')"), ("musical_key", "nullif(musical_key, '')"), ("has_chords", "has_chords"), ("chord_count", "chord_count"), ("line_count", "line_count"), ("source_repo", "nullif(source_repo, '')")]
    )
    + ", count(DISTINCT song_index) AS members FROM m GROUP BY group_id",
}

_COPIES = r"""
WITH s AS (SELECT DISTINCT song_index, replace(lower(coalesce(title, '')), 'ß', 'ss') AS t, replace(lower(coalesce(plain_lyrics, '')), 'ß', 'ss') AS l FROM songs),
k AS (SELECT song_index, trim(regexp_replace(regexp_replace(t, '\p{P}+', '', 'g'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+', ' ', 'g')) AS t,
    list_sort(list_filter(list_transform(regexp_split_to_array(l, '\r?\n[ \t]*(?:\r?\n[ \t]*)+'),
        lambda x: regexp_replace(x, '[\p{P}\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{b}]+', '', 'g')), lambda x: x <> '')) AS l FROM s),
g AS (SELECT song_index, min(song_index) OVER (PARTITION BY t, l) AS keep_index FROM k WHERE len(l) > 0)
"""
ORACLE["p7_found"] = _COPIES + "SELECT keep_index, song_index FROM g WHERE keep_index < song_index"
ORACLE["p7_collapsed"] = _COPIES + "SELECT keep_index, count(*) AS copies FROM g GROUP BY 1 HAVING count(*) > 1"
