"""A run from files to exports, over songs of every class."""

import json

from stanzaflow.config import RunConfig
from stanzaflow.plans.pipeline import build
from stanzaflow.sources.files import read_report

WORDS = "amber basin cedar delta ember fable grove haven inlet jewel knoll linen maple north ocean petal quiet river stone tower umber vivid willow xenon yonder zephyr".split()


def lyrics(seed, n=8):
    return [" ".join(WORDS[(seed * 7 + i * 5 + j * (3 + seed % 5)) % len(WORDS)] + str(seed) for j in range(6)) for i in range(n)]


def xml(title, lines, chord=False):
    body = "<br/>".join(('<chord name="G"/>' if chord and i == 0 else "") + x for i, x in enumerate(lines))
    return f'<song xmlns="urn:x"><properties><titles><title>{title}</title></titles></properties><lyrics><verse name="v1"><lines>{body}</lines></verse></lyrics></song>'


def sheet(title, lines, chord=True):
    return "\n".join([f"{{title: {title}}}", "", *[("[G]" if chord else "") + x for x in lines]]) + "\n"


def test_all_classes(spark, tmp_path):
    a, b, c = (tmp_path / n for n in "abc")
    for d in (a, b, c):
        d.mkdir()
    put = lambda d, n, t: (d / n).write_text(t, encoding="utf-8")
    put(a, "01.xml", xml("Clean Song", lyrics(1)))
    put(b, "01.onsong", sheet("Clean Song", lyrics(1)))
    put(a, "02.xml", xml("First Name", lyrics(2)))
    put(b, "02.onsong", sheet("Other Label", lyrics(2)))
    put(b, "03.onsong", sheet("Two Chorded", lyrics(3)))
    put(c, "03.txt", sheet("Two Chorded", lyrics(3)))
    put(a, "04.xml", xml("Same Heading", lyrics(4)))
    put(b, "04.onsong", sheet("Same Heading", lyrics(5)))
    put(a, "05.xml", xml("Only Words", lyrics(6)))
    put(a, "06.xml", xml("Lone Chords", lyrics(7), chord=True))
    put(b, "07.onsong", sheet("Not Known", lyrics(8)))
    near = lyrics(9, 9)
    put(a, "08.xml", xml("Nearly", [*near, "alpha unique phrase sits here alone"]))
    put(c, "08.txt", sheet("Nearly", [*near, "other words entirely appear below now"]))
    put(a, "09.xml", "<broken")
    out = str(tmp_path / "out")
    summary = build(spark, {"openlyrics": str(a), "onsong": str(b), "txt_chordpro": str(c)}, out)
    kinds = {r.canonical_title: r.classification for r in read_report(spark, f"{out}/reports/02_match_groups.csv", ["canonical_title", "classification"]).collect()}
    assert kinds["Clean Song"] == "clean_match" and kinds["Other Label"] == "lyric_match_title_different" and kinds["Two Chorded"] == "multiple_chorded_sources"
    assert kinds["Same Heading"] == "title_match_lyrics_different" and kinds["Only Words"] == "lyrics_only" and kinds["Lone Chords"] == "single_source"
    assert kinds["Not Known"] == "unmatched_non_openlyrics" and kinds["Nearly"] == "needs_review"
    assert summary["source_count"] == 14 and summary["group_count"] == summary["exported_count"] == 10
    inventory = {r.source_path.rsplit("/", 1)[1]: r for r in read_report(spark, f"{out}/reports/01_inventory_all.csv", ["index", "source_path", "parse_status", "title"]).collect()}
    assert inventory["09.xml"].parse_status == "warning" and inventory["09.xml"].title == "09"
    assert (tmp_path / "out/01_clean_match_chordpro/Clean Song.chopro").read_text(encoding="utf-8").startswith("{title: Clean Song}\n")
    assert len(list((tmp_path / "out/05_title_match_lyrics_different_chordpro").iterdir())) == 2
    assert json.loads((tmp_path / "out/reports/run_summary.json").read_text())["title_lyric_conflicts"] == 1
    dry = build(spark, {"onsong": str(tmp_path / "none")}, str(tmp_path / "dry"), RunConfig(dry_run=True))
    assert dry["source_count"] == dry["exported_count"] == 0


def test_more_equal_songs_than_the_caps_are_one_group(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for i in range(6):
        (tmp_path / f"b/{i}.onsong").write_text(sheet("Clean Song", lyrics(1)), encoding="utf-8")
    kept, old = tmp_path / "out/mine/x.txt", tmp_path / "out/01_clean_match_chordpro/old.chopro"
    for f in (kept, old):
        f.parent.mkdir(parents=True)
        f.write_text("x")
    summary = build(spark, {"onsong": str(tmp_path / "b")}, str(tmp_path / "out"), RunConfig(title_cap=5, line_cap=5, dry_run=True, clear=True))
    assert kept.exists() and not old.exists()
    assert summary["source_count"] == 6 and summary["group_count"] == 1
