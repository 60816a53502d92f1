"""Parsers, files, sinks, diffs and choices of the review."""

import json
import random
import xml.etree.ElementTree as ET
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators import bitmap, blocking, catalog, diff, review, similarity, skew
from stanzaflow.operators.changes import VersionedTable
from stanzaflow.sources import chordpro, files, openlyrics, sinks

SHEET = "Title: My Song\nKey: [G]\nBook: Red\n\n{artist: Ann}\n[Verse 1]\n[G]Hello [C]world\nG  C\nTitle: not a header\nChorus:\nSing [Bridge] on\n"


def test_sheet(spark):
    df = spark.createDataFrame([(1, "x/a_b.cho", SHEET, "clash"), (2, "x/no-title.txt", None, ""), (3, "c.cho", "", "")], "id int, path string, text string, title string").drop("title")
    rows = {r.id: r for r in chordpro.with_parsed_sheet(df).collect()}
    a = rows[1]
    assert (a.title, a.key, a.artist, a.source_meta, a.chord_count, a.has_chords) == ("My Song", "G", "Ann", {"book": "Red"}, 2, True)
    assert a.plain_lyrics == "Hello world\nTitle: not a header\nSing [Bridge] on"
    assert a.chordpro_body == "{artist: Ann}\n{comment: Verse 1}\n[G]Hello [C]world\nG  C\nTitle: not a header\n{comment: Chorus}\nSing [Bridge] on"
    assert (rows[2].title, rows[2].plain_lyrics, rows[2].chord_count) == ("no title", "", 0)


def test_opensong(spark):
    assert chordpro.chord_row("Hello", [("G", 0), ("Am", 0), ("C", 4)]) == ".GAm C"
    text = "{title: T}\n{c: Verse 1}\n[G]Hi\n\n\n{c: Chorus}\nLa\n{c: Chorus}\nLo"
    rows = [(1, text, "clash"), (2, None, ""), (3, "", ""), (4, "[G]Hel[Am]lo \n{key: [Bb]}\n{key: C}\n{composer: A}\n{author: B}\n{c: empty}\n{section: End}\nx[ ]y[" + "z" * 40 + "]", ""), (5, "[A]é𝄞[B]b", "")]
    df = spark.createDataFrame(rows, "id int, text string, sections string")
    made = {r.id: r for r in chordpro.with_opensong(df, "id", "text").collect()}
    root = ET.fromstring(made[1].xml)
    assert [e.tag for e in root] == chordpro.OPENSONG and root.findtext("title") == "T"
    assert (root.findtext("lyrics"), root.findtext("presentation")) == ("[V1]\n.G\n Hi\n\n[C]\n La\n Lo", "V1 C")
    assert ET.fromstring(made[2].xml).findtext("title") == "Untitled" and made[3].error is None
    assert (ET.fromstring(made[4].xml).findtext("key"), ET.fromstring(made[4].xml).findtext("author")) == ("Bb", "B")
    at = {(r.id, r.section, r.line): (r.label, r.words, [tuple(c) for c in r.chords]) for r in chordpro.with_chord_offsets(df, "id", "text").collect()}
    assert at[4, 0, 0] == (None, "Hello", [("G", 0), ("Am", 3)]) and at[4, 1, 0] == ("End", "xy[" + "z" * 40 + "]", [])
    assert at[5, 0, 0][2] == [("A", 0), ("B", 2)] and [k for k in at if k[0] in (2, 3)] == []


XML = """<song xmlns="urn:x"><properties><titles><title lang="en">A  Song</title></titles><authors><author>Ann</author></authors></properties><lyrics>
<verse name="v1"><lines><chord root="G" structure="min7" bass="D"/>Hel<chord name="C"/>lo<br/>there<line>in line</line></lines></verse><verse name="c"><lines>Sing</lines></verse></lyrics></song>"""


def test_openlyrics(spark):
    song = openlyrics.parse_song(XML)
    assert song["plain_lyrics"] == "Hello\nthere\nin line\nSing".replace("there\nin line", "therein line")
    assert song["chord_count"] == 2 and song["chordpro_body"].startswith("{comment: v1}\n[Gm7/D]Hel[C]lo\n")
    book = openlyrics.parse_songbook(XML)
    assert (book["title"], book["authors"], book["copyright"], [v["name"] for v in book["verses"]]) == ("A  Song", ["Ann"], "Unknown Copyright", ["Verse 1", "Chorus"])
    assert book["verses"][0]["lines"][0] == {"text": "Hello", "chords": [{"text": "Gm7/D", "offset": 0}, {"text": "C", "offset": 3}]}
    rows = openlyrics.parsed_songs(spark.createDataFrame([(1, XML), (2, "<broken"), (3, None)], "id int, x string"), "id", "x").collect()
    assert [r.parse_status for r in rows] == ["ok", "warning", "warning"] and rows[1].parse_error.startswith("XML parse failed")


def test_openlyrics_varieties(spark):
    doc = lambda props, lyrics: f'<o:song xmlns:o="urn:x"><o:properties>{props}</o:properties><o:lyrics>{lyrics}</o:lyrics></o:song>'
    bare = openlyrics.parse_song(doc("<o:titles><o:title> </o:title><o:title>B  t</o:title></o:titles><o:author/><o:composer>Con</o:composer><o:writer>Wri</o:writer>", '<o:verse name="v1">in <i>the</i> verse<o:br/>more</o:verse><o:verse>unnamed</o:verse>'))
    assert (bare["title"], bare["author"], bare["plain_lyrics"], bare["chordpro_body"]) == ("B t", "Con", "in the verse\nmore\nunnamed", "{comment: v1}\nin the verse\nmore\n\n{comment: Verse}\nunnamed")
    lined = openlyrics.parse_song(doc("", '<o:verse label="x"><o:lines><o:line>one</o:line><o:line>t<o:chord root="F#" structure="odd"/>wo</o:line></o:lines><o:lines>three</o:lines></o:verse>'))
    assert (lined["plain_lyrics"], lined["chord_count"]) == ("one\ntwo\nthree", 1) and lined["chordpro_body"] == "{comment: x}\none\nt[F#odd]wo\nthree"
    none = openlyrics.parse_song(doc("", "<o:lines>no verse<o:br/><o:br/>here</o:lines>"))
    assert none["plain_lyrics"] == "no verse\nhere" and none["title"] == ""
    book = openlyrics.parse_songbook(doc('<o:titles><o:title o:x="1">T</o:title></o:titles><o:authors><o:author>A</o:author><o:author> </o:author></o:authors><o:released>1999</o:released>', '<o:verse name="ei">x</o:verse><o:verse name="v2" lang="DE"><o:lines><o:chord name="G"/> lead</o:lines></o:verse><o:verse name="p"/>'))
    assert [(v["name"], v["lang"]) for v in book["verses"]] == [(None, ""), ("Verse 2", "de")] and book["released"] == "1999" and book["authors"] == ["A", ""]
    assert book["verses"][1]["lines"] == [{"text": "lead", "chords": [{"text": "G", "offset": 0}]}]
    assert openlyrics.clean_text("ﬁ\x92s ’\x07x") == "fi's 'x" and openlyrics.local_name("{urn:x}Verse") == "verse" and openlyrics.local_name("{u}A", False) == "A" and openlyrics.local_name(None) == ""
    rows = spark.createDataFrame([(1, "<a><b></a>"), (2, "no xml"), (3, "<song/>"), (4, "<song>" + "<verse>x</verse>" * 5000 + "</song>")], "id int, x string")
    got = {r.id: r for r in openlyrics.parsed_songs(rows, "id", "x").collect()}
    assert [got[i].parse_status for i in (1, 2, 3, 4)] == ["warning", "warning", "ok", "ok"] and got[4].plain_lyrics.count("x") == 5000
    assert {r.id for r in openlyrics.songbook(rows, "id", "x").collect()} == {3, 4}


def test_decoding():
    assert files.decode_bytes("café".encode("utf-8-sig"), files.CATALOGUE_LADDER) == "café"
    assert files.decode_bytes("café".encode("utf-16"), files.CATALOGUE_LADDER) == "café"
    assert files.decode_bytes("café au lait!".encode("cp1252"), files.CATALOGUE_LADDER) == "café au lait!"
    assert files.decode_bytes(None, files.CATALOGUE_LADDER) == ""


def test_discovery_reports_and_decisions(spark, tmp_path):
    (tmp_path / "a" / "sub").mkdir(parents=True)
    for n in ("b.xml", "sub/a.XML", "c.txt"):
        (tmp_path / "a" / n).write_text("x")
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "z.onsong").write_bytes("café".encode("utf-16"))
    roots = [(str(tmp_path / "a"), "repo_a", "openlyrics"), (str(tmp_path / "o"), "repo_b", "onsong"), (str(tmp_path / "none"), "repo_c", "txt_chordpro")]
    found = files.discover(spark, roots)
    got = [(r.song_index, r.source_repo, r.path.rsplit("/", 1)[1]) for r in found.orderBy("song_index").collect()]
    assert got == [(0, "repo_a", "b.xml"), (1, "repo_a", "a.XML"), (2, "repo_b", "z.onsong")]
    assert {r.text for r in files.decoded(found).collect()} == {"x", "café"}
    assert files.discover(spark, roots[2:]).count() == 0
    as_uri = [(f"file://{r}", repo, kind) for r, repo, kind in roots]
    assert [r.path for r in files.discover(spark, as_uri).orderBy("song_index").collect()] == [r.path for r in found.orderBy("song_index").collect()]
    assert [(r.name, r.place) for r in files.xml_listing(spark, str(tmp_path / "a")).collect()] == [("b.xml", 1)]
    df = spark.createDataFrame([("G1", 'a "b", c\nd', True), ("G2", None, False)], "group_id string, title string, flag boolean")
    sinks.write_report(df, str(tmp_path / "r"), ["group_id", "title", "flag"])
    back = files.read_report(spark, str(tmp_path / "r"), ["group_id", "title", "flag", "more"]).orderBy("group_id").collect()
    assert [tuple(r) for r in back] == [("G1", 'a "b", c\nd', "1", ""), ("G2", "", "0", "")]
    assert files.read_report(spark, str(tmp_path / "absent"), ["x"]).count() == 0
    (tmp_path / "d.json").write_text(json.dumps([{"group_id": "G1", "a": "1"}, {"group_id": "G1", "a": "2"}, {"a": "3"}]))
    assert [json.loads(r.decision)["a"] for r in files.read_decisions(spark, str(tmp_path / "d.json")).collect()] == ["2"]
    assert files.read_decisions(spark, str(tmp_path / "nope.json")).count() == 0
    n = sinks.write_files(spark.createDataFrame([("x/1.cho", "é"), ("2.cho", None)], "n string, t string"), str(tmp_path / "out"), "n", "t")
    assert n == 2 and (tmp_path / "out/x/1.cho").read_text() == "é"
    n = sinks.write_files(spark.createDataFrame([("x/1.cho", "new")], "n string, t string"), f"file://{tmp_path}/out", "n", "t")
    assert n == 1 and (tmp_path / "out/x/1.cho").read_text() == "new"
    sinks.write_text(spark, f"file://{tmp_path}/out/reports/s.json", '{"source_count": 3}')
    assert files.read_summary(spark, f"{tmp_path}/out/reports/s.json") == {"source_count": 3}
    assert files.read_summary(spark, f"{tmp_path}/none.json") == {} and files.read_summary(spark, str(tmp_path / "out/x/1.cho")) == {}


def test_paths_of_reports(spark, tmp_path):
    (tmp_path / "out" / "01").mkdir(parents=True)
    out = str(tmp_path / "out")
    assert files.resolve_path(spark, out, "/abs/x") == "/abs/x" and files.resolve_path(spark, out, "hdfs://h/x") == "hdfs://h/x"
    assert files.resolve_path(spark, out, "01/a.cho") == f"{out}/01/a.cho"
    assert files.resolve_path(spark, out + "/", "out/01/a.cho") == f"{tmp_path}/out/01/a.cho"


def test_replace_by_key(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3, "x", 1), ("b", 4, "y", 2), ("c", 5, None, 1)], "k string, v int, w string, t int")
    got = sinks.replace_by_key(old, new, ["k"], F.col("t")).select("k", "v", "w").collect()
    assert sorted(map(tuple, got), key=str) == [("a", 1, None), ("b", 4, "y"), ("c", 5, None)]


def test_similarity_measures(spark):
    assert similarity.ratio("tide", "diet") == 0.25 and similarity.ratio("diet", "tide") == 0.5
    assert similarity.ratio("", "") == 0.0
    assert similarity.coverage(["a b c", "x y z"], ["a b c d", "q"]) == 0.5
    songs = spark.createDataFrame(
        [(1, "t", "t", "one two three", ["one two three"]), (2, "t", "t", "one two three", ["one two three"]), (3, "u", "u", None, None), (1, "t", "t", "one two three", ["one two three"])],
        "song_index bigint, normalized_title string, compact_title string, normalized_lyrics string, lyric_lines array<string>",
    )
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 99)], "a bigint, b bigint")
    rows = {(r.a, r.b): r for r in similarity.score_pairs(pairs, songs).collect()}
    assert set(rows) == {(1, 2), (1, 3)}
    assert rows[1, 2].decision_hint == "strong" and rows[1, 2].title_score == 1.0
    assert rows[1, 3].final_score == 0.0 and rows[1, 3].decision_hint == "weak"


def test_blocking_caps(spark):
    schema = "song_index bigint, normalized_title string, compact_title string, title_tokens array<string>, lyric_lines array<string>, lyric_shingles array<string>"
    songs = spark.createDataFrame([(i, "same", None, ["tok", "tok"] if i < 2 else None, ["a long enough line"] if i < 3 else ["oh"], []) for i in range(6)], schema)
    caps = {"title": 5, "compact": 5, "token": 3, "line": 3, "shingle": 3}
    assert sorted(map(tuple, blocking.candidate_pairs(songs, caps).collect())) == [(0, 1), (0, 2), (1, 2)]  # title and token buckets are too large
    assert blocking.candidate_pairs(songs.limit(0)).count() == 0
    links = {r.id: r.links for r in blocking.candidate_links(blocking.candidate_pairs(songs, caps)).collect()}
    assert links == {0: 2, 1: 2, 2: 2}


def test_blocking_covers_buckets_over_the_caps(spark):
    schema = "song_index bigint, normalized_title string, compact_title string, title_tokens array<string>, lyric_lines array<string>, lyric_shingles array<string>"
    line = "line number {} is long".format
    rows = [(i, f"title {i % 3}" if i % 5 else None, "", [f"tok{i % 7}", f"tok{i % 7}"], [line(i % 11), line(i % 4), "oh"], [f"s{i}"]) for i in range(60)]
    rows += [(100 + i, "same", "same", ["same"], [line("x"), line("x")], ["s"]) for i in range(40)] + [(200, "", None, None, None, None), (201, "alone", "", [], [], []), (202, "same", "other", [], [], [])]
    songs = spark.createDataFrame(rows, schema)
    buckets = defaultdict(set)
    for i, t, c, k, lines, sh in rows:
        for key in [("t", t), ("c", c), *[("k", x) for x in k or []], *[("l", x) for x in lines or [] if len(x) >= 10], *[("s", x) for x in sh or []]]:
            if key[1]:
                buckets[key].add(i)
    want = {(a, b) for v in buckets.values() for a in v for b in v if a < b}
    for caps in ({k: 4 for k in blocking.CAPS}, None):
        got = list(map(tuple, blocking.covered_pairs(songs, caps).collect()))
        assert len(got) == len(want) and set(got) == want
    links = {r.id: r.links for r in blocking.covered_links(songs, {k: 4 for k in blocking.CAPS}).collect()}
    assert links == Counter(x for p in want for x in p)
    assert blocking.covered_pairs(songs.limit(0)).count() == blocking.covered_links(songs.limit(0)).count() == 0
    stars = blocking.candidate_classes(songs, {k: 4 for k in blocking.CAPS}).collect()
    together = defaultdict(set)
    for r in stars:
        together[r.bucket].add(r.song_index)
    assert {(a, b) for v in together.values() for a in v for b in v if a < b} == want
    assert all(r.rep == min(together[r.bucket]) and r.links == len(together[r.bucket]) - 1 and r.over_cap == (r.links >= 4) for r in stars)
    assert blocking.candidate_classes(songs.limit(0)).count() == 0


def test_blocking_with_a_full_bitmap_and_a_hot_bucket(spark, monkeypatch):
    for m in (blocking, skew):
        monkeypatch.setattr(m, "HOT_ROWS", 30)
    monkeypatch.setattr(bitmap, "BITS", 8)
    schema = "song_index bigint, normalized_title string, compact_title string, title_tokens array<string>, lyric_lines array<string>, lyric_shingles array<string>"
    rows = [(i, "hot", "hot", [f"t{i % 50}", "often" if i < 60 else "x"], [], [f"s{i // 3}"]) for i in range(100)]
    songs = spark.createDataFrame(rows, schema)
    caps = {k: 10 for k in blocking.CAPS}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[0] % 50 == b[0] % 50 or a[0] // 3 == b[0] // 3)}
    assert set(map(tuple, blocking.candidate_pairs(songs, caps).collect())) == want
    stars = blocking.candidate_classes(songs, caps)
    assert stars.where("kind = 'title' and rep = 0 and over_cap and links = 99").count() == 100
    assert stars.count() <= 5 * len(rows)


def test_covered_links_form_no_pair(spark, monkeypatch):
    monkeypatch.setattr(blocking, "_block_pairs", lambda *_: pytest.fail("pairs are formed"))
    schema = "song_index bigint, normalized_title string, compact_title string, title_tokens array<string>, lyric_lines array<string>, lyric_shingles array<string>"
    rows = [(i, "hot", "hot", ["hot", None, f"t{i % 13}"], [f"a line of {i % 9}", "oh", f"a line of {i % 9}"], [f"s{i % 70}", f"r{i % 70}", f"own{i}"]) for i in range(300)]
    rows += [(1000 + i, "twins", None, ["twins"], None, ["s3"]) for i in range(20)] + [(2000, "alone", "", ["alone"], ["oh"], []), (2001, None, None, None, None, None), (2002, "title", "", ["twins"], [], []), (2003, "x", "title", [], [], []), (None, "hot", "hot", [], [], [])]
    buckets = defaultdict(set)
    for i, *fields in rows:
        for kind, values in zip("tckls", ([fields[0]], [fields[1]], *fields[2:]), strict=True):
            for x in values or []:
                if i is not None and x and (kind != "l" or len(x) >= 10):
                    buckets[kind, x].add(i)
    near = defaultdict(set)
    for v in buckets.values():
        for i in v if len(v) > 1 else []:
            near[i] |= v
    songs = spark.createDataFrame(rows, schema).repartition(5)
    for args in ({}, {"block_links": 900}):
        got = blocking.covered_links(songs, **args)
        assert sorted(map(tuple, got.collect())) == sorted((i, len(v) - 1) for i, v in near.items())
    assert dict(got.dtypes) == {"id": "bigint", "links": "bigint"}


def test_diff():
    a, b = "Title: A\n[G]one\ntwo\nthree", "Title: B\n[C]one\ntwo\nfour"
    d = diff.align(a, b)
    assert [x["status"] for x in d["lines"]] == ["metadata", "chord_change", "equal", "a_only", "b_only"]
    assert (d["chord_changes"], d["metadata_changes"], d["simplified"]) == (1, 1, False)
    assert [x["status"] for x in diff.align(a, b, "lyric_match_title_different")["lines"]][-1] == "changed"
    assert d["summary"] == "Lyric similarity 0.61; 1 chord-only difference(s); 1 metadata difference(s)".replace("0.61", f"{d['similarity']:.2f}") and not d["separate"]
    far = diff.align("Title: A\n" + "one two\n" * 9, "Title: A\nzzz", "title_match_lyrics_different")
    assert far["separate"] and far["partial"] == "B" and far["summary"].endswith("Source B may be partial; sources may be separate songs")
    assert diff.align(None, None)["lines"] == []
    assert diff.align("x\n" * 2000, "x\n" * 2000)["simplified"]


def test_large_diff_is_whole(spark):
    a = [f"l{i}" for i in range(700)]
    b = ["new first", *a[:400], *["w"] * 300]
    pair = spark.createDataFrame([(1, "\n".join(a), "\n".join(b))], "k int, x string, y string")
    d = diff.song_diffs(pair, "x", "y", ["k"]).first()
    assert d.simplified and d.truncated and len(d.lines) == diff.RENDERED + 1 and d.lines[-1].left == diff.CUT and d.summary.endswith("; rendered diff truncated") and d.row_count == 1 + 400 + 600
    assert [x.status for x in d.lines[:401]] == ["b_only"] + ["equal"] * 400
    assert 0.5 < d.similarity < 1.0


def test_diffs_are_kept(spark, tmp_path, monkeypatch):
    store = VersionedTable(spark, str(tmp_path / "d"), "diff_key")
    pairs = lambda *x: spark.createDataFrame(list(x), "diff_key string, a_text string, b_text string, classification string, extra int")
    one, two, three = ("k1", "a\nb", "a\nc", "", 1), ("k2", None, "x", None, 2), ("k3", "x", "x", "", 3)
    first = {r.diff_key: r.cached for r in diff.read_through(pairs(one, one, two, (None, "a", "b", "", 0)), store).collect()}
    assert first == {"k1": False, "k2": False}
    again = {r.diff_key: r for r in diff.read_through(pairs(one, three), store).collect()}
    assert {k: r.cached for k, r in again.items()} == {"k1": True, "k3": False} and again["k3"].similarity == 1.0 and [tuple(x) for x in again["k1"].lines] == [("a", "a", "equal"), ("b", "", "a_only"), ("", "c", "b_only")]
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        diff.read_through(pairs(("k4", "a", "b", "", 0)), store)
    monkeypatch.undo()
    assert store.read().count() == 3
    assert diff.read_through(pairs(one).limit(0), VersionedTable(spark, str(tmp_path / "e"), "diff_key")).count() == 0


def test_coverage_equals_plain_alignment():
    rng = random.Random(8)
    words = "amber basin cedar delta ember fable grove haven".split()
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 7)))
    for _ in range(150):
        b = [line() for _ in range(rng.randint(0, 6))]
        a = [line() for _ in range(3)] + [x[: rng.randint(0, len(x))] + rng.choice(["", "x", " zz"]) + x[len(x) // 2 :] for x in b]
        plain = sum(x in b or any(similarity.line_score(x, y) >= 0.82 for y in b) for x in a) / len(a) if a and b else 0.0
        assert similarity.coverage(a, b) == plain


def test_measures_of_pairs(spark):
    songs = spark.createDataFrame(
        [(1, "t", "one two", ["one two three", "same"]), (2, None, "one two", ["one two three four", "other"]), (3, "t", "", None), (4, "t", "one two", []), (2, None, "one two", ["one two three four", "other"]), (None, "t", "one two", [])],
        "song_index bigint, normalized_title string, normalized_lyrics string, lyric_lines array<string>",
    )
    pairs = spark.createDataFrame([(1, 2, "z"), (1, 3, "z"), (1, 9, "z")], "a bigint, b bigint, lyric_lines string")
    got = {(r.a, r.b): (r.a_in_b, r.b_in_a) for r in similarity.line_coverages(pairs.select("a", "b"), songs).collect()}
    assert got == {(1, 2): (0.5, 0.5), (1, 3): (0.0, 0.0)}
    best = sorted((r.b, r.place, r.score) for r in similarity.best_line_scores(pairs.select("a", "b"), songs).collect())
    assert best == [(2, 0, 1.0), (2, 1, similarity.ratio("same", "other")), (3, 0, 0.0), (3, 1, 0.0)]
    assert {(r.b, r.normalized_lyrics) for r in similarity.text_ratios(pairs.select("a", "b"), songs, ["normalized_lyrics"]).collect()} == {(2, 1.0), (3, 0.0)}
    assert sorted(map(tuple, similarity.equal_lyrics(songs).collect())) == [(1, 2, False), (1, 4, True)]
    assert similarity.equal_lyrics(songs.limit(0)).count() == 0


def test_rounding_is_that_of_python(spark):
    rng = random.Random(1)
    values = [2.6666665, 1.0000015, 0.0000025, 0.5, 0.0, 1.0, -0.1234565] + [(k + 0.5) / 1e6 for k in range(3000)] + [rng.random() for _ in range(3000)] + [rng.randint(0, 10**7) / 1e7 for _ in range(3000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(-1, None)], "i int, v double")
    got = {r.i: r.r for r in df.select("i", T.round_even(F.col("v")).alias("r")).collect()}
    assert got.pop(-1) is None
    assert [got[i] for i in range(len(values))] == [round(v, 6) for v in values]


def test_review(spark):
    df = spark.createDataFrame([("A", "The Hill", None), ("B", "River", "ann")], "k string, title string, artist string")
    assert [r.k for r in review.matching(df, ["title", "artist"], "hill the").collect()] == ["A"]
    assert review.matching(df, ["title", "artist"], "", k="all").count() == 2
    assert [r.k for r in review.matching(df, ["title"], "", k="b").collect()] == ["B"]
    m = spark.createDataFrame([("r: T [p] || odd || ",), (None,)], "m string").select(review.parse_members(F.col("m")).alias("x")).collect()
    assert [tuple(x) for x in m[0].x] == [("r", "T", "p"), ("", "odd", "")] and m[1].x == []


def test_classes(spark):
    songs = spark.createDataFrame(
        [(1, False, "repo_a", "t"), (2, True, "repo_b", "t"), (3, True, "repo_b", "u"), (4, True, "repo_a", "v"), (5, None, "repo_a", None), (6, True, "repo_b", "w"), (7, True, "repo_c", "w"), (8, False, "repo_a", "x"), (9, True, "repo_b", "x")],
        "song_index bigint, has_chords boolean, source_repo string, normalized_title string",
    )
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8), (9, 9)], "song_index bigint, group_min bigint")
    scores = spark.createDataFrame([(1, 2, 0.97, 0.9, 1.0), (6, 7, 0.99, 0.9, 1.0), (8, 9, 0.2, 0.1, 0.1)], "a bigint, b bigint, lyric_identity_score double, lyric_score double, line_coverage_max double")
    features = catalog.group_features(members, songs, catalog.conflict_songs(catalog.conflict_pairs(scores, songs)))
    got = {r.group_min: r["class"] for r in catalog.classify(features, catalog.best_pairs(members, scores), songs).collect()}
    assert got == {1: "clean_match", 3: "unmatched_non_openlyrics", 4: "single_source", 5: "lyrics_only", 6: "multiple_chorded_sources", 8: "title_match_lyrics_different", 9: "title_match_lyrics_different"}
