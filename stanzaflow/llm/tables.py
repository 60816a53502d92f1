"""Chord sheets as words: what the text operators on documents share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of a chord, and the headings of sections.
CHORD = r"[A-G](?:#|b)?(?:mmaj|maj|min|dim|aug|sus|add|m)?\d*(?:(?:sus|add|maj)\d*)?(?:\([^()\[\]\n]{1,12}\))?(?:/[A-G](?:#|b)?)?"
HEADINGS = "verse|chorus|bridge|refrain|tag|ending|outro|intro|interlude|instrumental|pre[- ]?chorus|repeat|coda|vamp|v|c|b|p|t"
#: Names of sections in other languages.
OTHER_HEADINGS = (
    "estrofa|verso|coro|estribillo|puente|strophe|vers|brücke|zwischenspiel|couplet|pont|estrofe|refrão|ponte|refrein|brug|tussenspel|куплет|припев|бридж|проигрыш|strofa|ritornello"
    "|zwrotka|refren|mostek|refräng|brygga|stick|절|후렴|브리지|간주|בית|פזמון|גשר"
)

_INLINE = rf"\[\s*{CHORD}\s*\]"
_DIRECTIVE = r"[ \t]*\{[^{}\n]*\}[ \t]*"
_CHORD_LINE = rf"[ \t|/.\-]*+(?:\[?{CHORD}\]?(?=[ \t|/.\-\]]|$)[ \t|/.\-]*+)++"
_NAMED = rf"(?:{HEADINGS}|{OTHER_HEADINGS})"
_HEADING = rf"(?iu:[ \t]*+(?:\[[ \t]*{_NAMED}[ \t]*\d*[ \t]*\]|{_NAMED}[ \t]*\d*[ \t]*:|(?:verse|chorus|bridge|refrain|tag|ending|outro|intro|v|c|{OTHER_HEADINGS})[ \t]*\d*|\d[ \t]*절:?)[ \t]*)"
#: Lines that are not sung, taken out in one pass.
_UNSUNG = rf"(?m)^(?:{_DIRECTIVE}|{_CHORD_LINE}|{_HEADING})$\n?"
_MARK = r"(?:[x×](?<![\p{L}\p{M}\p{N}].) ?\d++|\d(?<![\p{L}\p{M}\p{N}].)\d*+ ?[x×])(?![\p{L}\p{M}\p{N}'’-])"
_REPEAT = rf"(?i)(?=[(\[|:x×\d])(?:\([ \t]*(?:{_MARK}|bis|repeat[^()\n]*)[ \t]*\)|\[[ \t]*(?:{_MARK}|bis|repeat[^\[\]\n]*)[ \t]*\]|\|:|:\||{_MARK})"


def sung_text(text: Column) -> Column:
    """The words that are sung, line by line: without directives, chord lines, inline chords, headings and repeat marks.

    Null is empty. Blank lines stay, so sections can still be told apart.
    """
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, _UNSUNG, "")
    t = F.regexp_replace(t, _INLINE, "")
    return F.regexp_replace(t, _REPEAT, " ")


def plain_words(text: Column) -> Column:
    """Lower-case words of sung text: apostrophes join, all other characters but letters, marks and digits separate."""
    t = F.lower(sung_text(text))
    t = F.regexp_replace(t, r"['’‘`´]|,(?=\d)(?<=\d,)", "")
    return F.array_remove(F.split(t, r"[^\p{L}\p{M}\p{N}]+"), "")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the plain words, in order."""
    return F.transform(plain_words(text), lambda w: F.xxhash64(w))
