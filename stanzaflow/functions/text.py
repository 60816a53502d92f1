"""Text functions as Catalyst expressions. A null text counts as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and patterns that results depend on.
WS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SPACE = f"[{WS}]"
LINE_END = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
SECTION_WORDS = ["intro", "verse", "v", "chorus", "c", "prechorus", "pre chorus", "pre-chorus", "pc", "bridge", "b", "tag", "ending", "end", "outro", "instrumental", "interlude", "refrain", "repeat"]
WEAK_LINES = ["amen", "hallelujah", "alleluia", "oh", "o", "yeah", "yes", "lord", "jesus"]
TITLE_STOP_WORDS = ["the", "a", "an", "of", "to", "and", "in", "on", "for", "my", "your"]
CHORD = r"[A-G](?:#|b)?(?:m|maj|min|dim|aug|sus|add|mmaj)?(?:\d+)?(?:\([^)]+\))?(?:/[A-G](?:#|b)?)?"
INLINE_CHORD = r"(?i)\[(?=[^\[\]\n]{1,32}\])" + rf"{SPACE}*[A-G](?:#|b)?(?:m|maj|min|dim|aug|sus|add|mmaj)?\d*(?:\([^) \[\]\n]+\))?(?:/[A-G](?:#|b)?)?{SPACE}*\]"
DIRECT_FIELDS = {
    "title": "title", "t": "title", "artist": "artist", "subtitle": "artist", "st": "artist", "author": "author", "key": "key", "tempo": "tempo",
    "time": "time_signature", "time signature": "time_signature", "time_signature": "time_signature", "copyright": "copyright",
}
SOURCE_FIELDS = {
    "original key": "original_key", "book": "book", "notes": "notes", "scripture reference(s)": "scripture_references",
    "scripture references": "scripture_references", "scripture reference": "scripture_references",
}
CHORD_STRUCTURES = {"major": "", "maj": "", "min": "m", "minor": "m", "dom7": "7", "maj7": "maj7", "min7": "m7", "dim": "dim", "aug": "aug", "sus4": "sus4", "sus2": "sus2", "add9": "add9"}
C1_FROM = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9f"
C1_TO = "€‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›œŸ"
REVIEW_META = r"(?i)^\s*(?:\{[^}]+:\s*.*\}|(?:Title|Artist|Author|Key|Original Key|Book|Notes|Scripture):)"
REVIEW_CHORD = r"\[[A-G](?:#|b)?[A-Za-z0-9/#().+-]*\]"


def text(c: Column) -> Column:
    """The text itself, empty for null."""
    return F.coalesce(c, F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def norm_space(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text(c), f"{SPACE}+", " "))


def lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end adds no line, and an empty text has none."""
    body = F.regexp_replace(text(c), rf"(?:{LINE_END})\z", "")
    return F.when(F.length(text(c)) == 0, F.array().cast("array<string>")).otherwise(F.split(body, LINE_END))


def tokens(c: Column) -> Column:
    """Space-separated tokens of a normalised text."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def _folded(c: Column) -> Column:
    t = F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(t, r",(?=\p{Nd})(?<=\p{Nd},)", "")


def normalize_title(c: Column) -> Column:
    """Lower-case letters and digits of a title, with leading zeros dropped."""
    t = F.regexp_replace(_folded(c), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(t, r"\b0+(\d+)\b", "$1"))


def compact_title(c: Column) -> Column:
    """A normalised title without spaces."""
    return F.replace(normalize_title(c), F.lit(" "), F.lit(""))


def normalize_lyric_text(c: Column) -> Column:
    """Lower-case letters and digits of lyrics; syllable hyphens join, filler words go."""
    word = r"[\p{L}\p{N}_]"
    t = F.regexp_replace(_folded(c), rf"10(?<!{word}10){SPACE}+000(?!{word})", "10000")
    t = F.regexp_replace(t, rf"([a-z]){SPACE}*-{SPACE}*([a-z])", "$1$2")
    t = F.regexp_replace(F.regexp_replace(t, rf"oh(?<!{word}oh)(?!{word})", "o"), rf"yeah(?<!{word}yeah)(?!{word})", " ")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def is_chord(c: Column) -> Column:
    """Whether a token is a chord name."""
    return bind(trim(text(c)), lambda t: (t != "") & ~F.contains(t, F.lit(" ")) & t.rlike(f"(?i)^(?:{CHORD})$"))


def strip_chords(c: Column) -> Column:
    """A line without its bracketed chords; other brackets stay."""
    return F.regexp_replace(text(c), INLINE_CHORD, "")


def count_chords(c: Column) -> Column:
    """Bracketed chords of a line."""
    return F.regexp_count(text(c), F.lit(INLINE_CHORD)).cast("bigint")


def normalize_lyric_line(c: Column) -> Column:
    """A lyric line without chords, normalised."""
    return normalize_lyric_text(strip_chords(c))


def is_chord_line(c: Column) -> Column:
    """Whether a line is blank or holds nothing but chords and bar signs."""
    token = lambda x: F.regexp_replace(x, r"^[\[\](){}.,;:|]+|[\[\](){}.,;:|]+$", "")
    parts = lambda t: F.filter(F.transform(F.split(F.replace(t, F.lit("."), F.lit(" ")), f"{SPACE}+"), token), lambda x: x != "")
    bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"\[[^\[\]\n]{1,32}\]", " "), rf"(?:[.\-_/|,:;()]|{SPACE})+", "")
    only = lambda t: bind(parts(t), lambda p: (F.size(p) > 0) & F.forall(p, is_chord))
    return bind(trim(text(c)), lambda t: (t == "") | (t.rlike(r"\[[^\[\]\n]{1,32}\]") & (bare(t) == "")) | only(t))


def _is_section(label: Column) -> Column:
    base = norm_space(F.replace(F.regexp_replace(label, r"\p{Nd}+", ""), F.lit("-"), F.lit(" ")))
    return label.isin(SECTION_WORDS) | base.isin(SECTION_WORDS)


def bracket_label(c: Column) -> Column:
    """The label of a line like ``[Verse 1]``; null for any other line, and for a chord."""
    inner = F.regexp_extract(trim(text(c)), r"^\[([^\[\]]{1,40})\]$", 1)
    known = lambda i: bind(F.lower(norm_space(i)), lambda label: ~is_chord(label) & _is_section(label))
    return bind(inner, lambda i: F.when((i != "") & known(i), trim(i)))


def colon_label(c: Column) -> Column:
    """The label of a line like ``Verse 1:``; null for any other line."""
    label = norm_space(F.regexp_extract(trim(text(c)), rf"^([A-Za-z][A-Za-z ]*(?:{SPACE}+\p{{Nd}}+)?){SPACE}*:$", 1))
    return bind(label, lambda x: F.when((x != "") & _is_section(F.lower(x)), x))


def is_meaningful(c: Column) -> Column:
    """Whether a normalised line says enough to tell songs apart."""
    return bind(norm_space(c), lambda t: (F.length(t) >= 5) & ~t.isin(WEAK_LINES) & (F.contains(t, F.lit(" ")) | (F.length(t) >= 8)))


def meaningful_lines(c: Column) -> Column:
    """Normalised meaningful lines in order, each once."""
    return F.array_distinct(F.filter(F.transform(lines(c), normalize_lyric_line), is_meaningful))


def title_tokens(c: Column) -> Column:
    """Words of at least three letters of a title that are no stop words; repeated ones stay."""
    return F.filter(tokens(normalize_title(c)), lambda x: (F.length(x) >= 3) & ~x.isin(TITLE_STOP_WORDS))


def shingles(normalized: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` tokens of a normalised text, in order; none for a shorter text."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, size), " "))
    return bind(tokens(text(normalized)), lambda t: F.when(F.size(t) >= size, F.array_distinct(runs(t))).otherwise(F.array().cast("array<string>")))


def file_stem(path: Column) -> Column:
    """The file name of a path without its last suffix."""
    name = F.regexp_extract(text(path), r"([^/]*)/*$", 1)
    return F.when(name.rlike(r"^[^.].*\.[^.]+$|^\.+[^.].*\.[^.]+$"), F.regexp_replace(name, r"\.[^.]+$", "")).otherwise(name)


def title_from_filename(path: Column) -> Column:
    """A title made of a file name: dashes and underscores become spaces."""
    return norm_space(F.regexp_replace(file_stem(path), r"[_\-]+", " "))


def meta_key(c: Column) -> Column:
    """Name of a metadata field in snake case."""
    k = F.replace(normalize_title(c), F.lit(" "), F.lit("_"))
    return F.when(k == "scripture_reference_s", "scripture_references").otherwise(k)


def clean_key(c: Column) -> Column:
    """A musical key without the brackets of a chord."""
    t = norm_space(c)
    inner = F.regexp_extract(t, r"^\[([^\[\]]+)\]$", 1)
    return F.when(inner != "", norm_space(inner)).otherwise(t)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def bare_metadata(c: Column) -> Column:
    """struct(kind, field, value) of a line like ``Key: G`` whose name is known; null for any other line."""
    pattern = rf"^{SPACE}*([A-Za-z][A-Za-z0-9 ()/_-]{{0,40}}){SPACE}*:{SPACE}*(.*?){SPACE}*$"
    extract = lambda t, n: norm_space(F.regexp_extract(t, pattern, n))
    fields = lambda name: F.struct(_lookup(DIRECT_FIELDS, name).alias("d"), _lookup(SOURCE_FIELDS, name).alias("s"))

    def meant(t: Column, f: Column) -> Column:
        value = F.when(f["d"] == "key", clean_key(extract(t, 2))).otherwise(extract(t, 2))
        kind = F.when(f["d"].isNotNull(), "direct").otherwise("source")
        return F.when(f["d"].isNotNull() | f["s"].isNotNull(), F.struct(kind.alias("kind"), F.coalesce(f["d"], f["s"]).alias("field"), value.alias("value")))

    return bind(text(c), lambda t: bind(fields(F.lower(extract(t, 1))), lambda f: meant(t, f)))


def _or_untitled(c: Column) -> Column:
    return F.when(c == "", "Untitled").otherwise(c)


def sanitize_filename(c: Column) -> Column:
    """A file name of at most 160 characters; characters that file systems refuse become underscores."""
    t = F.regexp_replace(_or_untitled(norm_space(c)), r'[<>:"/\\|?*\x00-\x1f]+', "_")
    return _or_untitled(F.substring(F.regexp_replace(t, r"^[ ._]+|[ ._]+$", ""), 1, 160))


def safe_filename(c: Column) -> Column:
    """A file name of at most 120 characters without dots."""
    t = F.replace(F.regexp_replace(_or_untitled(text(c)), r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit("."), F.lit(" "))
    return _or_untitled(F.substring(F.regexp_replace(norm_space(t), r"[ .]+$", ""), 1, 120))


def escape_directive(c: Column) -> Column:
    """A value that fits on one line of a directive."""
    return trim(F.replace(text(c), F.lit("\n"), F.lit(" ")))


def clean_controls(c: Column) -> Column:
    """C1 controls become the characters that were meant; other controls go."""
    return F.regexp_replace(F.translate(text(c), C1_FROM, C1_TO), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x80-\x9F]", "")


def is_rtl(c: Column) -> Column:
    """Whether a text has Hebrew characters."""
    return text(c).rlike(r"[\x{0590}-\x{05FF}]")


def review_line(c: Column) -> Column:
    """A line as the review compares it: nothing for metadata, else letters, digits and apostrophes."""
    t = F.regexp_replace(F.lower(F.regexp_replace(text(c), REVIEW_CHORD, "")), f"[^a-z0-9'{WS}]", " ")
    return F.when(text(c).rlike(REVIEW_META), "").otherwise(norm_space(t))


def line_kind(c: Column) -> Column:
    """metadata, chord or lyric."""
    return F.when(text(c).rlike(REVIEW_META), "metadata").when(text(c).rlike(REVIEW_CHORD), "chord").otherwise("lyric")


def review_chords(c: Column) -> Column:
    """Bracketed chords in the wider sense of the review."""
    return F.regexp_extract_all(text(c), F.lit(f"({REVIEW_CHORD})"), 1)


def collapsed(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.regexp_replace(F.lower(trim(text(c))), f"{SPACE}+", " ")


def titles_differ(a: Column, b: Column) -> Column:
    """Whether two titles are both there and differ in more than case and spacing."""
    x, y = collapsed(a), collapsed(b)
    return (x != "") & (y != "") & (x != y)


def section_code(c: Column, short_forms: bool = True) -> Column:
    """OpenSong code of a section name; ``short_forms`` also knows v1, c, b and ``pre chorus``."""
    t = F.lower(trim(text(c)))
    number = F.regexp_extract(t, r"(\d+)", 1)
    cleaned = F.regexp_replace(text(c), r"[^A-Za-z0-9]+", "")
    out = F.when(text(c) == "", F.lit(None)).when(F.startswith(t, F.lit("verse")), F.concat(F.lit("V"), number))
    if short_forms:
        out = out.when(t.isin("v", "v1", "v2", "v3", "v4"), F.upper(t))
    out = out.when(F.startswith(t, F.lit("chorus")) | (F.lit(short_forms) & (t == "c")), "C").when(F.startswith(t, F.lit("bridge")) | (F.lit(short_forms) & (t == "b")), "B")
    out = out.when(t.rlike("^pre-?chorus") | (F.lit(short_forms) & F.startswith(t, F.lit("pre chorus"))), "P").when(t.rlike("^(?:ending|tag)"), "T")
    return out.otherwise(F.when(cleaned != "", cleaned))


def verse_label(c: Column) -> Column:
    """Display name of a verse code: c1, b, e, p, v2; ``ei`` has none."""
    t = F.lower(text(c))
    number = F.regexp_extract(t, r"^v(\d+)", 1)
    first = F.substring(t, 1, 1)
    return (
        F.when(first == "c", "Chorus").when(first == "b", "Bridge").when(t == "ei", F.lit(None)).when(first == "e", "Ending").when(first == "p", "Pre-Chorus")
        .when((first == "v") & (number != ""), F.concat(F.lit("Verse "), number)).when(first == "v", "Verse").otherwise(text(c))
    )


def chord_name(name: Column, root: Column, structure: Column, bass: Column) -> Column:
    """Chord of the attributes of a chord element: its name, or root, structure and bass."""
    n, r, s, b = (trim(text(x)) for x in (name, root, structure, bass))
    chord = F.concat(r, F.coalesce(_lookup(CHORD_STRUCTURES, s), s))
    return F.when(n != "", n).when(r == "", "").when(b != "", F.concat(chord, F.lit("/"), b)).otherwise(chord)


def html_escape(c: Column) -> Column:
    """Text for HTML: & < > and both quotes."""
    t = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def format_of(path: Column) -> Column:
    """Source format that the suffix of a path tells."""
    suffix = F.lower(F.regexp_extract(text(path), r"(\.[^./]+)$", 1))
    return F.when(suffix == ".xml", "openlyrics").when(suffix == ".onsong", "onsong").otherwise("txt_chordpro")


def float_value(c: Column, default: float = 0.0) -> Column:
    """A number in a text, or ``default``."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def round_even(c: Column, digits: int = 6) -> Column:
    """A score rounded as Python rounds it: by the exact value of the double, and a tie to the even digit.

    The product with the power of ten is taken without error, in two parts, so that a value just beside a tie is not
    taken for one. For values below 10^9 and up to 7 digits; null stays null.
    """
    scale, x = float(10**digits), F.abs(c)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    down = F.floor(x * scale)
    over = ((high * scale - (down + F.lit(0.5))) + (x - high) * scale)
    up = (over > 0) | ((over == 0) & (down % 2 == 1))
    return F.signum(c) * (down + up.cast("int")) / scale


def duration(seconds: Column, finest: bool = True) -> Column:
    """Seconds in words, such as 1h 2m 3s; with ``finest`` false hours come without seconds, and no number is a dash."""
    n = seconds.try_cast("double")
    s = F.when(n.isNotNull(), F.greatest(n, F.lit(0.0))).cast("bigint") if finest else n.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    long = F.format_string("%dh %dm %ds", h, m, r) if finest else F.format_string("%dh %dm", h, m)
    return F.when(s.isNull(), "-").when(h > 0, long).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Time that the rest will take at the pace so far; a question mark before anything is done."""
    return F.when((done <= 0) | (total <= 0), "?").otherwise(duration(elapsed / done * (total - done)))
