"""Queries of the text functions: each over a whole table, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.plans import sql as S
from stanzaflow.sources.files import content_hash
from stanzaflow.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name: str, source: str, keys: list[str], made: dict, sql: dict | None, before: str = "", frame=None) -> None:
    """Register a query that adds columns ``made`` to ``keys`` of a table, or of ``frame`` whose SQL is ``before``."""

    def run(spark, d):
        df = frame(spark, d) if frame else table(spark, d, source)
        return df.select(*keys, *[e().alias(n) for n, e in made.items()])

    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = f"{before} SELECT {', '.join(keys)}, " + ", ".join(f"{e} AS {n}" for n, e in sql.items()) + f" FROM {'lines' if frame else source}"


def _lines(name: str, key: str, column: str):
    frame = lambda spark, d: table(spark, d, name).select(key, F.posexplode(T.lines(F.col(column))).alias("pos", "line"))
    sql = f"WITH arrays AS (SELECT {key}, {S.lines(column)} AS l FROM {name}), lines AS (SELECT {key}, unnest(range(len(l)))::int AS pos, unnest(l) AS line FROM arrays)"
    return frame, sql


_SONG_LINES, _SONG_SQL = _lines("songs", "song_index", "chordpro_body")
_DOC_LINES, _DOC_SQL = _lines("documents", "doc_id", "text")
_c = F.col


def _song(name: str, column: str, function, sql) -> None:
    _add(name, "songs", ["song_index"], {"result": lambda: function(_c(column))}, {"result": sql(column)})


def _song_line(name: str, **made) -> None:
    _add(name, "", ["song_index", "pos"], {n: (lambda f=f: f(_c("line"))) for n, (f, _) in made.items()}, {n: s("line") for n, (_, s) in made.items()}, _SONG_SQL, _SONG_LINES)


def _doc_line(name: str, **made) -> None:
    _add(name, "", ["doc_id", "pos"], {n: (lambda f=f: f(_c("line"))) for n, (f, _) in made.items()}, {n: s("line") for n, (_, s) in made.items()}, _DOC_SQL, _DOC_LINES)


_joined = lambda f, sep=" ": lambda c: F.array_join(f(c), sep)
_song("str1_norm_space", "plain_lyrics", T.norm_space, S.norm_space)
_song("str2_normalize_title", "title", T.normalize_title, S.title)
_song("str3_compact_title", "title", T.compact_title, S.compact)
_song("str4_normalize_lyrics", "plain_lyrics", T.normalize_lyric_text, S.lyric)
_song_line("str5_normalize_lyric_line", result=(T.normalize_lyric_line, S.lyric_line))
_doc_line("str6_valid_chord", result=(T.is_chord, S.is_chord))
_song_line("str7_strip_chords", stripped=(T.strip_chords, S.strip_chords), chords=(T.count_chords, S.count_chords))
_doc_line("str8_chord_only_line", result=(T.is_chord_line, S.is_chord_line))
_doc_line("str9_bracket_label", result=(T.bracket_label, S.bracket_label))
_doc_line("str10_colon_label", result=(T.colon_label, S.colon_label))
_song_line("str11_meaningful_line", result=(lambda c: T.is_meaningful(T.normalize_lyric_line(c)), lambda x: S.meaningful(S.lyric_line(x))))
_add(
    "str12_meaningful_lines", "songs", ["song_index"], {"result": lambda: F.array_join(T.meaningful_lines(_c("plain_lyrics")), "\n")},
    {"result": f"array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10))"},
    f"WITH a AS (SELECT song_index, list_filter(list_transform({S.lines('plain_lyrics')}, lambda y: {S.lyric_line('y')}), lambda y: {S.meaningful('y')}) AS l FROM songs)",
)
ORACLE["str12_meaningful_lines"] = ORACLE["str12_meaningful_lines"].replace("FROM songs)  SELECT", "FROM songs) SELECT")
ORACLE["str12_meaningful_lines"] = ORACLE["str12_meaningful_lines"][: ORACLE["str12_meaningful_lines"].rindex("FROM songs")] + "FROM a"
_song("str13_title_tokens", "title", _joined(T.title_tokens), lambda x: f"array_to_string({S.title_tokens(x)}, ' ')")
_add(
    "str14_lyric_shingles", "songs", ["song_index"], {"result": lambda: F.array_join(T.shingles(_c("normalized_lyrics")), "|")}, {"result": "''"},
)
ORACLE["str14_lyric_shingles"] = f"""
WITH t AS (SELECT song_index, {S.tokens(S.text('normalized_lyrics'))} AS t FROM songs),
s AS (SELECT song_index, list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' ')) AS s FROM t)
SELECT song_index, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), '|') AS result FROM s"""
_song("str15_title_from_filename", "source_path", T.title_from_filename, lambda x: S.norm_space(S.re(S.stem(x), "[_\\-]+", " ")))
_add(
    "str16_meta_key", "", ["song_index", "name"], {"result": lambda: T.meta_key(_c("name"))}, {"result": S.meta_key("name")},
    "WITH lines AS (SELECT song_index, unnest(map_keys(source_meta)) AS name FROM songs)", lambda spark, d: table(spark, d, "songs").select("song_index", F.explode(F.map_keys("source_meta")).alias("name")),
)
_song("str17_clean_key", "musical_key", T.clean_key, S.clean_key)


#: Header lines made of the columns of a song, as a source file has them.
_HEADS = [("Title: ", "title"), ("  Key :[", "musical_key"), ("Time Signature:", "time_signature"), ("scripture  reference(s): ", "copyright"), ("Mood: ", "artist"), ("TEMPO:\t", "tempo")]


def _bare_sql() -> str:
    pattern = rf"^[{S.WS}]*([A-Za-z][A-Za-z0-9 ()/_-]{{0,40}})[{S.WS}]*:[{S.WS}]*(.*?)[{S.WS}]*$"
    name = f"lower({S.norm_space(f'regexp_extract(line, {S.q(pattern)}, 1)')})"
    value = S.norm_space(f"regexp_extract(line, {S.q(pattern)}, 2)")
    return f"""WITH lines AS (SELECT song_index, unnest([{", ".join(f"'{h}' || {S.text(c)}" for h, c in _HEADS)}]) AS line FROM songs),
n AS (SELECT song_index, {name} AS name, {value} AS value FROM lines),
k AS (SELECT song_index, {S.lookup(T.DIRECT_FIELDS, 'name')} AS d, {S.lookup(T.SOURCE_FIELDS, 'name')} AS s, value FROM n)
SELECT song_index, CASE WHEN d IS NOT NULL THEN 'direct' ELSE 'source' END AS kind, coalesce(d, s) AS field, CASE WHEN d = 'key' THEN {S.clean_key('value')} ELSE value END AS value
FROM k WHERE d IS NOT NULL OR s IS NOT NULL"""


def _bare(spark, d):
    made = F.array(*[F.concat(F.lit(h), T.text(_c(c))) for h, c in _HEADS])
    return table(spark, d, "songs").select("song_index", F.explode(made).alias("line")).select("song_index", T.bare_metadata(_c("line")).alias("m")).where("m is not null").select("song_index", "m.*")


QUERIES["str18_bare_metadata"], ORACLE["str18_bare_metadata"] = _bare, _bare_sql()
_song("str19_sanitize_filename", "title", T.sanitize_filename, S.sanitize)
_song("str20_safe_filename", "title", T.safe_filename, S.safe_name)
_song("str21_escape_directive", "plain_lyrics", T.escape_directive, lambda x: S.trim(f"replace({S.text(x)}, chr(10), ' ')"))
_song("str22_clean_controls", "plain_lyrics", T.clean_controls, S.clean_controls)
_song("str24_is_rtl", "title", T.is_rtl, lambda x: f"regexp_matches({S.text(x)}, {S.q(chr(92) + 'x{0590}' + '-' + chr(92) + 'x{05FF}').replace(chr(39) + chr(92), chr(39) + '[' + chr(92), 1)[:-1]}]')")
_doc_line("str26_review_line", result=(T.review_line, S.review_line))
_doc_line("str27_line_kind", kind=(T.line_kind, S.line_kind), chords=(lambda c: F.array_join(T.review_chords(c), " "), lambda x: f"array_to_string(regexp_extract_all({S.text(x)}, {S.q(T.REVIEW_CHORD)}), ' ')"))
_song("str29_review_title", "title", T.normalize_title, S.title)
_doc_line("str31_section_code", code=(T.section_code, S.section_code), code_long=(lambda c: T.section_code(c, False), lambda x: S.section_code(x, False)))
_doc_line("str33_line_norm", result=(T.collapsed, S.collapsed))
_song("str35_html_escape", "plain_lyrics", T.html_escape, S.html)
_doc_line("par12_verse_label", result=(T.verse_label, S.verse_label))
_song("par13_format_of", "source_path", T.format_of, lambda x: f"CASE lower(regexp_extract({S.text(x)}, {S.q(r'(\.[^./]+)$')}, 1)) WHEN '.xml' THEN 'openlyrics' WHEN '.onsong' THEN 'onsong' ELSE 'txt_chordpro' END")
_song("src6_text_hash", "plain_lyrics", lambda c: F.sha2(F.encode(T.text(c), "utf-8"), 256), lambda x: f"sha256({S.text(x)})")
QUERIES["src5_file_hash"] = lambda spark, d: table(spark, d, "documents").select("doc_id", F.encode(T.text(_c("text")), "utf-8").alias("content")).select("doc_id", content_hash().alias("hash"))
ORACLE["src5_file_hash"] = f"SELECT doc_id, sha256({S.text('text')}) AS hash FROM documents"
_add("sim8_float_value", "songs", ["song_index"], {"value": lambda: T.float_value(_c("tempo"))}, {"value": "coalesce(try_cast(tempo AS double), 0)"})
_secs = "CAST(size AS double)"
_hms = lambda full: f"""CASE WHEN size IS NULL THEN '-' WHEN size >= 3600 THEN (size // 3600) || 'h ' || (size % 3600 // 60) || 'm{" ' || (size % 60) || 's" if full else ''}'
    WHEN size >= 60 THEN (size // 60) || 'm ' || (size % 60) || 's' ELSE size || 's' END"""  # noqa: E731
_add(
    "sim10_durations", "songs", ["song_index"],
    {"full": lambda: T.duration(_c("size")), "short": lambda: T.duration(_c("size"), False), "eta": lambda: T.eta(_c("size").cast("double"), F.greatest(_c("song_index"), F.lit(1)), _c("size"))},
    {"full": _hms(True), "short": _hms(False), "eta": "CASE WHEN size <= 0 THEN '?' ELSE (WITH x AS (SELECT greatest(0, trunc(size::double / greatest(song_index, 1) * (size - greatest(song_index, 1))))::bigint AS s) SELECT CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END FROM x) END"},
)
