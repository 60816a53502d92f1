"""Queries of the parsers: sheets are put together from the catalogue and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.plans import sql as S
from stanzaflow.plans.pairs import SONGS_SQL, songs_of
from stanzaflow.sources import chordpro as P
from stanzaflow.sources import openlyrics as X
from stanzaflow.sources.tables import table

_c = F.col
_HEAD = [("Title: ", "title"), ("Artist : ", "artist"), ("Key: [", "musical_key"), ("Notes: ", "copyright")]


def sheets_of(spark, d):
    """(song_index, path, text): every song as a file with a bare header, a braced tempo and its body."""
    head = [F.concat(F.lit(h), T.text(_c(c)), F.lit("]" if h.endswith("[") else "")) for h, c in _HEAD]
    text = F.concat_ws("\n", *head, F.lit(""), F.concat(F.lit("{tempo: "), T.text(_c("tempo")), F.lit("}")), T.text(_c("chordpro_body")))
    return songs_of(spark, d).select("song_index", _c("source_path").alias("path"), text.alias("text"))


def _sheets_sql() -> str:
    head = " || chr(10) || ".join(f"'{h}' || {S.text(c)}" + (" || ']'" if h.endswith("[") else "") for h, c in _HEAD)
    return f"{SONGS_SQL}, sh AS (SELECT song_index, source_path AS path, {head} || chr(10) || chr(10) || '{{tempo: ' || {S.text('tempo')} || '}}' || chr(10) || {S.text('chordpro_body')} AS text FROM sg)"


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("sheets/"), _c("doc_id").cast("string"), F.lit("_a-sheet.cho")).alias("path"), "text")


_DOC_SQL = "sh AS (SELECT doc_id, 'sheets/' || doc_id || '_a-sheet.cho' AS path, text FROM documents)"


def _parse_sql(source: str, key: str, columns: list[str]) -> str:
    s = S.trim("x")
    bare = rf"^[{S.WS}]*([A-Za-z][A-Za-z0-9 ()/_-]{{0,40}})[{S.WS}]*:[{S.WS}]*(.*?)[{S.WS}]*$"
    get = lambda p, i: f"regexp_extract({s}, {S.q(p)}, {i})"
    name, value = f"lower({S.trim(get(P.DIRECTIVE, 1))})", S.norm_space(get(P.DIRECTIVE, 2))
    bname, bvalue = f"lower({S.norm_space(get(bare, 1))})", S.norm_space(get(bare, 2))
    field = f"CASE WHEN {name} <> '' THEN {S.lookup(T.DIRECT_FIELDS, name)} ELSE {S.lookup(T.DIRECT_FIELDS, bname)} END"
    label = f"coalesce({S.bracket_label(s)}, {S.colon_label(s)})"
    last = lambda f: f"coalesce(arg_max(v, pos) FILTER (meant AND field = '{f}'), '')"
    fields = ", ".join(f"{last(f)} AS {f}_" for f in P.FIELDS)
    title = f"CASE WHEN title_ = '' THEN {S.norm_space(S.re(S.stem('path'), '[_' + chr(92) + '-]+', ' '))} ELSE title_ END"
    made = {"title": title, **{f: f"{f}_" for f in P.FIELDS[1:]}, "chord_count": "chord_count::bigint", "has_chords": "chord_count > 0", "plain_lyrics": "plain_lyrics", "chordpro_body": S.trim("body")}
    return f"""WITH {source}, ar AS (SELECT {key}, path, {S.lines('text')} AS l FROM sh),
li AS (SELECT {key}, unnest(range(len(l))) AS pos, unnest(l) AS x FROM ar),
ki AS (SELECT *, CASE WHEN {name} <> '' THEN 'directive' WHEN {s} = '' THEN 'blank' WHEN {S.lookup(T.DIRECT_FIELDS, bname)} IS NOT NULL OR {S.lookup(T.SOURCE_FIELDS, bname)} IS NOT NULL THEN 'bare' ELSE 'content' END AS kind,
    {field} AS field, CASE WHEN {name} <> '' THEN {value} ELSE {bvalue} END AS raw, {label} AS label FROM li),
en AS (SELECT {key}, min(pos) FILTER (kind = 'content') AS stop FROM ki GROUP BY 1),
me AS (SELECT ki.*, CASE WHEN field = 'key' THEN {S.clean_key('raw')} ELSE raw END AS v, kind = 'directive' OR kind = 'bare' AND (stop IS NULL OR pos < stop) AS meant FROM ki JOIN en USING ({key})),
su AS (SELECT *, NOT meant AND label IS NULL AS sung, CASE WHEN NOT meant AND label IS NULL AND NOT {S.is_chord_line('x')} THEN {S.norm_space(S.strip_chords('x'))} ELSE '' END AS words FROM me),
ag AS (SELECT {key}, {fields}, coalesce(sum({S.count_chords('x')}) FILTER (sung), 0) AS chord_count, coalesce(string_agg(words, chr(10) ORDER BY pos) FILTER (words <> ''), '') AS plain_lyrics,
    coalesce(string_agg(CASE WHEN kind = 'directive' OR label IS NULL THEN x ELSE '{{comment: ' || label || '}}' END, chr(10) ORDER BY pos) FILTER (NOT (kind = 'bare' AND meant)), '') AS body FROM su GROUP BY 1)
SELECT {key}, {', '.join(f'{made[c]} AS {c}' for c in columns)} FROM (SELECT {key}, path, {", ".join(f"coalesce({f}_, '') AS {f}_" for f in P.FIELDS)}, coalesce(chord_count, 0) AS chord_count, coalesce(plain_lyrics, '') AS plain_lyrics, coalesce(body, '') AS body FROM sh LEFT JOIN ag USING ({key}))"""


def chords_sql(key: str, source: str) -> str:
    """Lines of the sheets of ``source`` with section, label, words and chords, as ``ch``."""
    bare, meta = S.trim("raw"), S.q(P.META)
    get = lambda i: S.trim(f"regexp_extract({bare}, {meta}, {i})")
    inner, outside = f"regexp_extract_all(raw, {S.q(P.BRACKET)}, 1)", f"regexp_split_to_array(raw, {S.q(P.BRACKET)})"
    return f"""WITH {source}, cl AS (SELECT {key}, {S.lines('text')} AS l FROM sh), cr AS (SELECT {key}, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM cl),
cm AS (SELECT {key}, pos, CASE WHEN {bare} = '' THEN '' ELSE raw END AS raw, regexp_matches({bare}, {meta}) AS meta, lower({get(1)}) AS name, {get(2)} AS value FROM cr),
co AS (SELECT *, count(*) FILTER (meta AND name IN ({S.names(P.MARKS)})) OVER (PARTITION BY {key} ORDER BY pos) AS part FROM cm),
cv AS (SELECT {key}, part, value AS label FROM co WHERE meta AND name IN ({S.names(P.MARKS)})),
cx AS (SELECT {key}, part, (dense_rank() OVER (PARTITION BY {key} ORDER BY part) - 1)::int AS section, (row_number() OVER (PARTITION BY {key}, part ORDER BY pos) - 1)::int AS line, {inner} AS i, {outside} AS o FROM co WHERE NOT meta),
ch AS (SELECT {key}, section, label, line, {S.re("array_to_string(o, '')", f'[{S.WS}]+$')} AS words,
    list_filter(list_transform(range(1, len(i) + 1), lambda k: {{'text': {S.trim('i[k]')}, 'offset': length(array_to_string(o[1:k], ''))}}), lambda c: c.text <> '') AS chords FROM cx LEFT JOIN cv USING ({key}, part))"""


_SHOWN = ["title", "artist", "key", "tempo", "copyright", "chord_count", "has_chords", "plain_lyrics", "chordpro_body"]


def par2_chordpro_songs(spark, d):
    return P.with_parsed_sheet(sheets_of(spark, d)).select("song_index", *_SHOWN)


def par2_chordpro_documents(spark, d):
    return P.with_parsed_sheet(_documents(spark, d)).select("doc_id", "title", "tempo", "key", "chord_count", "plain_lyrics")


def par14_song_rows(spark, d):
    rows = P.as_songs(P.with_parsed_sheet(_documents(spark, d)))
    return rows.select("path", "title", "normalized_title", "line_count", F.size("lyric_shingles").alias("shingles"))


def par6_dispatch(spark, d):
    """Songs of each format through the parser that their suffix asks for."""
    xml = T.format_of(_c("path")) == "openlyrics"
    files = sheets_of(spark, d)
    sheets = P.with_parsed_sheet(files.where(~xml)).select("song_index", "title", F.lit("ok").alias("parse_status"))
    made = xml_of(spark, d).join(files.where(xml).select("song_index"), "song_index", "left_semi")
    return sheets.unionByName(X.parsed_songs(made, "song_index", "xml").select("song_index", "title", "parse_status"))


def xml_of(spark, d):
    """(song_index, xml): every song as an OpenLyrics document; inline chords are elements, sections are verses."""
    clean = lambda c: F.regexp_replace(T.html_escape(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")
    body = clean(F.regexp_replace(T.text(_c("chordpro_body")), r"(?m)^\{[^}\n]*\}\n?", ""))
    chords = F.regexp_replace(body, r"\[([A-G](?:#|b)?)([^\[\]\n/]{0,8})(?:/([A-G](?:#|b)?))?\]", '<chord root="$1" structure="$2" bass="$3"/>')
    verses = F.filter(F.split(F.replace(chords, F.lit("\r"), F.lit("")), r"\n[ \t]*\n+"), lambda x: T.trim(x) != "")
    names = F.array(*[F.lit(x) for x in ("v1", "c", "v2", "b", "e", "p")])
    each = F.transform(verses, lambda x, i: F.concat(F.lit('<verse name="'), F.element_at(names, F.pmod(i, F.lit(6)) + 1), F.lit('"><lines>'), F.replace(x, F.lit("\n"), F.lit("<br/>")), F.lit("</lines></verse>")))
    xml = F.concat(
        F.lit('<song xmlns="http://openlyrics.info/namespace/2009/song"><properties><titles><title>'), clean(_c("title")), F.lit("</title></titles><authors><author>"), clean(_c("author")), F.lit("</author></authors><copyright>"),
        clean(_c("copyright")), F.lit("</copyright></properties><lyrics>"), F.array_join(each, ""), F.lit("</lyrics></song>"),
    )
    return songs_of(spark, d).select("song_index", xml.alias("xml"))


def par1_openlyrics(spark, d):
    return X.parsed_songs(xml_of(spark, d), "song_index", "xml")


def par5_songbook(spark, d):
    rows = X.songbook(xml_of(spark, d), "song_index", "xml")
    return rows.select("song_index", "title", F.array_join("authors", "; ").alias("authors"), "copyright", "released", F.size("verses").alias("verses"), F.array_join(F.transform("verses", lambda v: F.coalesce(v["name"], F.lit(""))), ",").alias("names"))


def par4_chord_offsets(spark, d):
    rows = X.songbook(xml_of(spark, d), "song_index", "xml").select("song_index", F.posexplode("verses").alias("verse", "v")).select("song_index", "verse", F.posexplode("v.lines").alias("line", "l"))
    return rows.select("song_index", "verse", "line", _c("l.text").alias("words"), F.to_json("l.chords").alias("chords"))


def par9_sections(spark, d):
    return P.with_chord_offsets(sheets_of(spark, d), "song_index", "text").withColumn("chords", F.to_json("chords"))


def par10_chord_positions(spark, d):
    rows = P.with_chord_offsets(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", "section", "line", F.explode("chords").alias("c")).select("doc_id", "section", "line", _c("c.text").alias("chord"), _c("c.offset").alias("at"))


def snk5_opensong(spark, d):
    return P.with_opensong(sheets_of(spark, d), "song_index", "text")


def par8_chord_name(spark, d):
    parts = [F.element_at(F.array(*[F.lit(x) for x in xs]), (F.pmod(_c("song_index"), F.lit(len(xs))) + 1).cast("int")) for xs in (["", "", "", "Csus"], ["C", "", "F#", " Bb "], ["min", "dom7", "", "weird", "maj"], ["", "G"])]
    return songs_of(spark, d).select("song_index", T.chord_name(*parts).alias("chord"))


def _chord_sql() -> str:
    pick = lambda xs: f"[{S.names(xs)}][song_index % {len(xs)} + 1]"
    return f"""WITH {SONGS_SQL}, p AS (SELECT song_index, trim({pick(['', '', '', 'Csus'])}) AS n, trim({pick(['C', '', 'F#', ' Bb '])}) AS r, {pick(['min', 'dom7', '', 'weird', 'maj'])} AS s, {pick(['', 'G'])} AS b FROM sg)
SELECT song_index, CASE WHEN n <> '' THEN n WHEN r = '' THEN '' ELSE r || coalesce({S.lookup(T.CHORD_STRUCTURES, 's')}, s) || CASE WHEN b <> '' THEN '/' || b ELSE '' END END AS chord FROM p"""


def agg9_presentation(spark, d):
    """Order of the section codes of a sheet, a run of equal codes once."""
    marks = F.filter(F.transform(T.lines(_c("text")), lambda x: T.section_code(T.trim(F.regexp_extract(x, r"^\s*\{(?:comment|c|section)\s*:\s*(.*?)\}\s*$", 1)))), lambda x: x.isNotNull())
    runs = lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.element_at(a, F.greatest(i, F.lit(1)))))
    return table(spark, d, "documents").select("doc_id", marks.alias("m")).select("doc_id", F.array_join(runs(_c("m")), " ").alias("presentation"))


_MARK = S.section_code(S.trim("regexp_extract(x, '^\\s*\\{(?:comment|c|section)\\s*:\\s*(.*?)\\}\\s*$', 1)"))
_SUFFIX = "lower(regexp_extract(path, '(\\.[^./]+)$', 1)) = '.xml'"
_NEW_LINES = f"list_filter(list_transform({S.lines('plain_lyrics')}, lambda y: {S.lyric_line('y')}), lambda y: {S.meaningful('y')})"
ORACLE = {
    "par6_dispatch": f"""WITH p AS ({_parse_sql(_sheets_sql(), "song_index", ["title"])}), g AS (SELECT DISTINCT ON (song_index) song_index, source_path AS path, title AS raw FROM songs)
SELECT song_index, CASE WHEN {_SUFFIX} THEN {S.norm_space(S.re(S.text('raw'), '[' + chr(92) + 'x00-' + chr(92) + 'x08' + chr(92) + 'x0B' + chr(92) + 'x0C' + chr(92) + 'x0E-' + chr(92) + 'x1F]'))} ELSE title END AS title, 'ok' AS parse_status FROM p JOIN g USING (song_index)""",
    "par9_sections": chords_sql("song_index", _sheets_sql()) + " SELECT song_index, section, label, line, words, to_json(chords)::varchar AS chords FROM ch",
    "par10_chord_positions": chords_sql("doc_id", "sh AS (SELECT doc_id, text FROM documents)") + " SELECT doc_id, section, line, c.text AS chord, c.offset::int AS at FROM (SELECT doc_id, section, line, unnest(chords) AS c FROM ch)",
    "par14_song_rows": f"""WITH p AS ({_parse_sql(_DOC_SQL, "doc_id", ["title", "plain_lyrics"])}), t AS (SELECT *, {S.tokens(S.lyric('plain_lyrics'))} AS t FROM p)
SELECT 'sheets/' || doc_id || '_a-sheet.cho' AS path, title, {S.title('title')} AS normalized_title, len(list_distinct({_NEW_LINES}))::int AS line_count,
    len(list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i+4], ' '))))::int AS shingles FROM t""",
    "par2_chordpro_songs": _parse_sql(_sheets_sql(), "song_index", _SHOWN),
    "par2_chordpro_documents": _parse_sql(_DOC_SQL, "doc_id", ["title", "tempo", "key", "chord_count", "plain_lyrics"]),
    "par8_chord_name": _chord_sql(),
    "agg9_presentation": f"""WITH a AS (SELECT doc_id, list_filter(list_transform({S.lines('text')}, lambda x: {_MARK}), lambda x: x IS NOT NULL) AS m FROM documents)
SELECT doc_id, array_to_string(list_filter(m, lambda x, i: i = 1 OR x <> m[i - 1]), ' ') AS presentation FROM a""",
}
QUERIES = {
    k: globals()[k]
    for k in ["par1_openlyrics", "par2_chordpro_songs", "par2_chordpro_documents", "par4_chord_offsets", "par5_songbook", "par6_dispatch", "par8_chord_name", "par9_sections", "par10_chord_positions", "par14_song_rows", "snk5_opensong", "agg9_presentation"]
}
