"""Components, survivors and formatting copies."""

import datetime as dt
import random
import re
import unicodedata
from collections import defaultdict

from pyspark.sql import functions as F

from stanzaflow.llm import components, formatting, survivor

T0 = dt.datetime(2024, 3, 1)
PAIRS = "a bigint, b bigint, final_score double, decision_hint string, scored_at timestamp, v string"


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(parent)}


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900 + i) for i in range(1, 80)]
    edges += [(b, a) for a, b in edges[:20]] + edges[:10]
    df = spark.createDataFrame([*edges, (3, None), (None, 4)], "a bigint, b bigint")
    got = dict(map(tuple, components.components(df).collect()))
    assert got == union_find([(a, b) for a, b in edges if a != b])
    assert components.components(df.limit(0)).count() == 0


def test_hub_goes_through_the_hot_branch(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    edges = [(0, i) for i in range(1, 100)] + [(i, i + 1000) for i in range(1, 100, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == union_find(edges)


def test_latest_score_of_a_pair_counts(spark):
    h = dt.timedelta(hours=1)
    rows = [
        (1, 2, 0.9, "strong", T0, "clash"), (2, 1, 0.9, "weak", T0 + h, ""), (3, 4, 0.1, "strong", T0, ""), (4, 3, 0.86, "strong", T0 + h, ""), (5, 6, None, "strong", T0, ""), (7, 8, 0.9, None, T0, ""),
        (9, 9, 1.0, "strong", T0, ""), (None, 1, 1.0, "strong", T0, ""), (10, 11, 0.99, "strong", None, ""), (4, 3, 0.86, "strong", T0 + h, ""), (12, 13, 0.8599, "strong", T0, ""),
    ]
    got = dict(map(tuple, components.song_components(spark.createDataFrame(rows, PAIRS)).collect()))
    assert got == {3: 3, 4: 3, 10: 10, 11: 10}


SONG = "song_index bigint, has_chords boolean, chord_count int, line_count int, source_repo string, mtime_ns bigint, title string, group_id string"


def test_survivors(spark):
    songs = spark.createDataFrame(
        [
            (1, False, 9, 9, "repo_c", 1, "", "x"), (2, None, 10, 9, "repo_a", 2, "two", "x"), (3, True, 0, None, "repo_a", 3, None, "x"), (4, True, None, 1, "repo_b", 1, "four", "x"), (5, True, 0, 1, "repo_c", 1, "five", "x"),
            (6, True, 0, 1, "repo_c", 9, "six", "x"), (5, True, 0, 1, "repo_c", 1, "five", "x"), (7, None, None, None, None, None, None, None),
        ],
        SONG,
    )
    groups = spark.createDataFrame([("g1", 1), ("g1", 2), ("g1", 2), ("g2", 3), ("g2", 4), ("g2", 5), ("g2", 6), ("g3", 1), ("g3", 1), ("g3", 99), ("g4", None), (None, 1), ("g5", 7), ("g5", 1)], "group_id string, member_index bigint")
    assert dict(map(tuple, survivor.survivors(groups, songs).collect())) == {"g1": 2, "g2": 5, "g5": 1}
    gold = {r.group_id: r for r in survivor.golden_records(groups, songs, ["title", "chord_count"], survivor.trust(F.col("source_repo")), F.col("mtime_ns")).collect()}
    assert (gold["g1"].title, gold["g1"].chord_count) == ("two", 9)
    assert (gold["g2"].title, gold["g2"].chord_count, gold["g2"].members) == ("six", 0, 4)
    assert gold["g5"].title is None
    assert survivor.survivors(groups.limit(0), songs).count() == 0 and survivor.survivors(groups, songs.limit(0)).count() == 0


def brute_copies(rows):
    def bare(s):
        return "".join(c for c in s.lower().replace("ß", "ss") if not unicodedata.category(c).startswith("P"))

    sets = defaultdict(set)
    for i, t, x in rows:
        sections = sorted(k for s in re.split(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+", x or "") if (k := "".join(bare(s).split())))
        if sections:
            sets[" ".join(bare(t or "").split()), tuple(sections)].add(i)
    return {(min(v), i) for v in sets.values() for i in v if i != min(v)}


def test_formatted_copies(spark, small):
    rows = [
        (1, "Don't Go", "One line,\nand two\n\nSecond — part"), (2, '"dont  GO!"', "second part\r\n\r\nONE LINE AND\r\nTWO"), (3, "Go Don't", "One line,\nand two\n\nSecond part"), (4, None, "x y"), (5, "", "X, y."), (6, "t", ""), (7, "t", None),
        (8, "t", "?!"), (9, "Straße", "1,000 groß"), (10, "STRASSE", "1000 GROSS"), (11, "long", "word " * 30_000), (12, "LONG", "WORD, " * 30_000), (13, "a", "b\n\nb"), (14, "a", "b"), (1, "Don't Go", "One line,\nand two\n\nSecond — part"), (15, "an", "agram"), (16, "na", "agram"),
    ]
    df = spark.createDataFrame(rows, "song_index bigint, title string, plain_lyrics string").withColumn("class", F.lit("clash"))
    got = set(map(tuple, formatting.formatted_copies(df).collect()))
    assert got == brute_copies(rows) == {(1, 2), (4, 5), (9, 10), (11, 12)}
    assert {r.keep_index: r.copies for r in formatting.collapsed_songs(df).collect()} == {1: 2, 4: 2, 9: 2, 11: 2}
    assert formatting.formatted_copies(df.limit(0)).count() == 0
    songs = spark.read.parquet(f"{small}/songs.parquet").select("song_index", "title", "plain_lyrics")
    assert set(map(tuple, formatting.formatted_copies(songs).collect())) == brute_copies(set(map(tuple, songs.collect())))


def test_hot_class_is_spread(spark, small, monkeypatch):
    monkeypatch.setattr(formatting, "HOT_ROWS", 5)
    rows = [(i, "Same Title", f"One line\n\nTwo {'!' * (i % 3)}") for i in range(300)] + [(1000 + i, f"t{i}", "x y") for i in range(20)] + [(2000, "T0", "X, Y")]
    df = spark.createDataFrame(rows, "song_index bigint, title string, plain_lyrics string")
    assert set(map(tuple, formatting.formatted_copies(df).collect())) == brute_copies(rows)
