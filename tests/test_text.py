"""Text functions against hand-stated results and an independent Python form."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanzaflow.functions import text as T


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normaliser_edges(spark):
    cases = {
        "Café OH yeah—oh": "caf o o", "10 000 reasons": "10000 reasons", "10,000 & 5-a a - b": "10000 and 5 a ab", "a-b-c d-e": "ab c de", "İstanbul": "i stanbul",
        "a b": "a b", "x\u001cy z": "x y z", "ohé oh": "oh o", "": "", None: "",
    }
    assert apply(spark, T.normalize_lyric_text, list(cases)) == list(cases.values())


def test_titles_and_tokens(spark):
    assert apply(spark, T.normalize_title, ["The 007 & Co.", "1,000 Bells", None, "  "]) == ["the 7 and co", "1000 bells", "", ""]
    assert apply(spark, T.title_tokens, ["The Hill of the Hill", "a", None]) == [["hill", "hill"], [], []]
    assert apply(spark, T.shingles, ["a b c d e a b c d e", "a b", ""]) == [["a b c d e", "b c d e a", "c d e a b", "d e a b c", "e a b c d"], [], []]


def test_chords_and_sections(spark):
    assert apply(spark, T.strip_chords, ["[G]Word [Bridge] [F#m7/A]x [ c ]", None]) == ["Word [Bridge] x ", ""]
    assert apply(spark, T.count_chords, ["[G]Word [Bridge] [F#m7/A]x", None]) == [2, 0]
    assert apply(spark, T.bracket_label, ["[Verse 2]", "[B]", "[C1]", "[Pre-Chorus]", "[x]", "Verse"]) == ["Verse 2", None, None, "Pre-Chorus", None, None]
    assert apply(spark, T.colon_label, ["Verse 1:", "Chorus:", "Note:", "Verse 1"]) == ["Verse 1", "Chorus", None, None]
    assert apply(spark, T.is_chord_line, ["G  C/E | Am", "[G] [C]", "", "A word", None, "(Dm7) Bb."]) == [True, True, True, False, True, True]
    assert apply(spark, T.section_code, ["Verse 12", "v3", "pre chorus", "Tag", "Solo part", "", None]) == ["V12", "V3", "P", "T", "Solopart", None, None]
    assert apply(spark, T.verse_label, ["c1", "ei", "e", "v2", "vx", "other"]) == ["Chorus", None, "Ending", "Verse 2", "Verse", "other"]


def test_names_and_times(spark):
    assert apply(spark, T.title_from_filename, ["a/b/my_song-one.txt", ".hidden", "x.tar.gz", None]) == ["my song one", ".hidden", "x.tar", ""]
    assert apply(spark, T.sanitize_filename, ["a/b:c?", " ._", None, "x" * 300]) == ["a_b_c", "Untitled", "Untitled", "x" * 160]
    assert apply(spark, T.safe_filename, ["a.b", "...", None]) == ["a b", "Untitled", "Untitled"]
    assert apply(spark, T.duration, ["3723", "61", "5", "-3", "x"]) == ["1h 2m 3s", "1m 1s", "5s", "0s", "-"]
    assert apply(spark, T.bare_metadata, ["Key: [G]", "Book: Red", "Mood: sad", None])[:2] == [("direct", "key", "G"), ("source", "book", "Red")]
    assert apply(spark, T.html_escape, ["<a & 'b'>", None]) == ["&lt;a &amp; &#x27;b&#x27;&gt;", ""]


def test_lines_like_python(spark):
    values = ["a\r\nb\n", "a\rb", "\n", "", "a\x0bb c", "a\n\n", "x" * 100_000]
    assert apply(spark, T.lines, values) == [v.splitlines() for v in values]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="abz019 -,&[]{}:.ohyeahG#m/é\n\t’", max_size=40), min_size=1, max_size=30))
def test_norm_space_property(spark, values):
    got = apply(spark, T.norm_space, values)
    assert got == [re.sub(r"\s+", " ", v).strip() for v in values]
