"""SQL twins of the text functions, for the checks in another engine."""

from __future__ import annotations

from stanzaflow.functions import text as T

WS = T.WS.lower().replace(r"\x{0b}", r"\x{0b}")


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def names(values: list[str]) -> str:
    """A list of string literals."""
    return ", ".join(q(v) for v in values)


def text(x: str) -> str:
    return f"coalesce({x}, '')"


def re(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def trim(x: str) -> str:
    return re(x, f"^[{WS}]+|[{WS}]+$")


def norm_space(x: str) -> str:
    return f"trim({re(text(x), f'[{WS}]+', ' ')})"


def lines(x: str) -> str:
    end = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
    body = f"regexp_replace({text(x)}, {q(f'(?:{end})$')}, '')"
    return f"CASE WHEN {text(x)} = '' THEN []::varchar[] ELSE regexp_split_to_array({body}, {q(end)}) END"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda z: z <> '')"


def folded(x: str) -> str:
    t = f"replace(lower({text(x)}), '&', ' and ')"
    return re(re(t, r"(\p{Nd}),(\p{Nd})", r"\1\2"), r"(\p{Nd}),(\p{Nd})", r"\1\2")


def title(x: str) -> str:
    return norm_space(re(re(folded(x), f"[^a-z0-9{WS}]+", " "), r"\b0+(\d+)\b", r"\1"))


def compact(x: str) -> str:
    return f"replace({title(x)}, ' ', '')"


def _word(x: str, word: str, to: str) -> str:
    one = lambda y: re(y, rf"(^|[^\p{{L}}\p{{N}}_]){word}($|[^\p{{L}}\p{{N}}_])", rf"\1{to}\2")
    return one(one(x))


def lyric(x: str) -> str:
    t = _word(folded(x), f"10[{WS}]+000", "10000")
    t = re(t, f"([a-z])[{WS}]*-[{WS}]*([a-z])", r"\1\2")
    return norm_space(re(_word(_word(t, "oh", "o"), "yeah", " "), f"[^a-z0-9{WS}]+", " "))


_GRAMMAR = r"[A-G](?:#|b)?(?:m|maj|min|dim|aug|sus|add|mmaj)?\d*"
_INLINE = rf"(?i)\[[{WS}]*{_GRAMMAR}(?:\([^) \[\]\n]+\))?(?:/[A-G](?:#|b)?)?[{WS}]*\]"


def is_chord(x: str) -> str:
    t = trim(text(x))
    return f"({t} <> '' AND NOT contains({t}, ' ') AND regexp_matches({t}, {q('(?i)^(?:' + _GRAMMAR + r'(?:\([^)]+\))?(?:/[A-G](?:#|b)?)?)$')}))"


def strip_chords(x: str) -> str:
    return re(text(x), _INLINE)


def count_chords(x: str) -> str:
    return f"len(regexp_extract_all({text(x)}, {q(_INLINE)}))"


def lyric_line(x: str) -> str:
    return lyric(strip_chords(x))


def is_chord_line(x: str) -> str:
    t = trim(text(x))
    bracket = r"\[[^\[\]\n]{1,32}\]"
    bare = re(re(t, bracket, " "), rf"(?:[.\-_/|,:;()]|[{WS}])+")
    part = re("z", r"^[\[\](){}.,;:|]+|[\[\](){}.,;:|]+$")
    dotless = f"replace({t}, '.', ' ')"
    parts = f"list_filter(list_transform(regexp_split_to_array({dotless}, {q(f'[{WS}]+')}), lambda z: {part}), lambda z: z <> '')"
    return f"({t} = '' OR ({bare} = '' AND regexp_matches({t}, {q(bracket)})) OR (len({parts}) > 0 AND len(list_filter({parts}, lambda z: {is_chord('z')})) = len({parts})))"


def _section(x: str) -> str:
    digitless = re(x, r"\p{Nd}+")
    base = norm_space(f"replace({digitless}, '-', ' ')")
    return f"({x} IN ({names(T.SECTION_WORDS)}) OR {base} IN ({names(T.SECTION_WORDS)}))"


def bracket_label(x: str) -> str:
    inner = f"regexp_extract({trim(text(x))}, {q(r'^\[([^\[\]]{1,40})\]$')}, 1)"
    label = f"lower({norm_space(inner)})"
    return f"CASE WHEN {inner} <> '' AND NOT {is_chord(label)} AND {_section(label)} THEN {trim(inner)} END"


def colon_label(x: str) -> str:
    pattern = rf"^([A-Za-z][A-Za-z ]*(?:[{WS}]+\p{{Nd}}+)?)[{WS}]*:$"
    label = norm_space(f"regexp_extract({trim(text(x))}, {q(pattern)}, 1)")
    return f"CASE WHEN {label} <> '' AND {_section(f'lower({label})')} THEN {label} END"


def meaningful(x: str) -> str:
    t = norm_space(x)
    return f"(length({t}) >= 5 AND {t} NOT IN ({names(T.WEAK_LINES)}) AND (contains({t}, ' ') OR length({t}) >= 8))"


def title_tokens(x: str) -> str:
    return f"list_filter({tokens(title(x))}, lambda z: length(z) >= 3 AND z NOT IN ({names(T.TITLE_STOP_WORDS)}))"


def stem(x: str) -> str:
    name = f"regexp_extract({text(x)}, '([^/]*)/*$', 1)"
    return f"CASE WHEN regexp_matches({name}, {q(r'^[^.].*\.[^.]+$|^\.+[^.].*\.[^.]+$')}) THEN {re(name, r'\.[^.]+$')} ELSE {name} END"


def meta_key(x: str) -> str:
    k = f"replace({title(x)}, ' ', '_')"
    return f"CASE WHEN {k} = 'scripture_reference_s' THEN 'scripture_references' ELSE {k} END"


def clean_key(x: str) -> str:
    t = norm_space(x)
    inner = f"regexp_extract({t}, {q(r'^\[([^\[\]]+)\]$')}, 1)"
    return f"CASE WHEN {inner} <> '' THEN {norm_space(inner)} ELSE {t} END"


def lookup(table: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def _or_untitled(x: str) -> str:
    return f"coalesce(nullif({x}, ''), 'Untitled')"


_REFUSED = r'[<>:"/\\|?*\x00-\x1f]+'


def sanitize(x: str) -> str:
    return _or_untitled(f"substr({re(re(_or_untitled(norm_space(x)), _REFUSED, '_'), '^[ ._]+|[ ._]+$')}, 1, 160)")


def safe_name(x: str) -> str:
    t = f"replace({re(_or_untitled(text(x)), _REFUSED, '_')}, '.', ' ')"
    return _or_untitled(f"substr({re(norm_space(t), '[ .]+$')}, 1, 120)")


def clean_controls(x: str) -> str:
    return re(f"translate({text(x)}, {q(T.C1_FROM)}, {q(T.C1_TO)})", r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{80}-\x{9F}]")


_META = T.REVIEW_META


def review_line(x: str) -> str:
    t = re(f"lower({re(text(x), T.REVIEW_CHORD)})", f"[^a-z0-9'{WS}]", " ")
    return f"CASE WHEN regexp_matches({text(x)}, {q(_META)}) THEN '' ELSE {norm_space(t)} END"


def line_kind(x: str) -> str:
    return f"CASE WHEN regexp_matches({text(x)}, {q(_META)}) THEN 'metadata' WHEN regexp_matches({text(x)}, {q(T.REVIEW_CHORD)}) THEN 'chord' ELSE 'lyric' END"


def collapsed(x: str) -> str:
    return re(f"lower({trim(text(x))})", f"[{WS}]+", " ")


def section_code(x: str, short: bool = True) -> str:
    t = f"lower({trim(text(x))})"
    cleaned = re(text(x), "[^A-Za-z0-9]+")
    s = "true" if short else "false"
    return f"""CASE WHEN {text(x)} = '' THEN NULL WHEN starts_with({t}, 'verse') THEN 'V' || regexp_extract({t}, '(\\d+)', 1)
        WHEN {s} AND {t} IN ('v', 'v1', 'v2', 'v3', 'v4') THEN upper({t}) WHEN starts_with({t}, 'chorus') OR ({s} AND {t} = 'c') THEN 'C'
        WHEN starts_with({t}, 'bridge') OR ({s} AND {t} = 'b') THEN 'B' WHEN regexp_matches({t}, '^pre-?chorus') OR ({s} AND starts_with({t}, 'pre chorus')) THEN 'P'
        WHEN regexp_matches({t}, '^(?:ending|tag)') THEN 'T' ELSE nullif({cleaned}, '') END"""


def verse_label(x: str) -> str:
    t = f"lower({text(x)})"
    return f"""CASE WHEN {t} LIKE 'c%' THEN 'Chorus' WHEN {t} LIKE 'b%' THEN 'Bridge' WHEN {t} = 'ei' THEN NULL WHEN {t} LIKE 'e%' THEN 'Ending' WHEN {t} LIKE 'p%' THEN 'Pre-Chorus'
        WHEN regexp_matches({t}, '^v\\d') THEN 'Verse ' || regexp_extract({t}, '^v(\\d+)', 1) WHEN {t} LIKE 'v%' THEN 'Verse' ELSE {text(x)} END"""


def html(x: str) -> str:
    t = text(x)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t
