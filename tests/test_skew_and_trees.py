"""Tree aggregation, joins with hot keys, the bitmap filter, ranks and groups."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stanzaflow.operators import graph, ranks, skew, unions
from stanzaflow.operators import tree_aggregate as tree
from stanzaflow.operators.bitmap import bitmap_filter
from stanzaflow.sources import tables

SONGS = "song_index bigint, normalized_title string, lyric_lines array<string>, has_chords boolean, line_count int, n bigint"


def test_tree_equals_flat_aggregation(spark):
    rows = [(i % 50, "hot" if i % 3 else f"t{i}", ["a", "b", "a", None, ""] if i % 2 else None, i % 4 == 0, i % 7, 1) for i in range(400)]
    rows += [(None, "x", ["a"], None, None, 1), (7, None, [], None, None, 1), (8, "", ["z" * 5000], True, 3, 1)]
    rows = [r for r in {r[0]: r for r in rows}.values()]
    df = spark.createDataFrame(rows + rows[:10], SONGS)
    want = defaultdict(set)
    for i, t, ls, *_ in rows:
        if t:
            want["normalized_title", t].add(i)
        for x in ls or []:
            if x:
                want["lyric_lines", x].add(i)
    for chunk_rows, fan_in in ((1, 2), (7, 3), (10_000, 16)):
        got = {(r.field_name, r.key_value): r.songs for r in tree.song_key_stats(df, chunk_rows, fan_in).collect()}
        assert got == {k: len(v) for k, v in want.items()}


def test_tree_takes_hot_and_repeated_songs(spark):
    rows = [(1, "t", ["a"], True, 3, 1)] * 300 + [(i, "t" if i % 2 else "", [f"l{i % 5}"], None, None, 1) for i in range(2, 100)] + [(1, "late", ["b"], False, 9, 1)]
    df = spark.createDataFrame(rows, SONGS).repartition(7)
    got = {(r.field_name, r.key_value): (r.songs, r.chorded, r.line_total, r.line_max) for r in tree.song_key_stats(df, 3, 2).collect()}
    assert got["normalized_title", "t"] == (50, 1, 3, 3) and got["normalized_title", "late"] == (1, 0, 9, 9)
    assert got["lyric_lines", "a"] == (1, 1, 3, 3) and got["lyric_lines", "l3"][0] == len([i for i in range(2, 100) if i % 5 == 3])
    assert {r.key_value for r in tree.frequent_song_keys(df, 40, 3, 2).collect()} == {"t"}


def test_small_tables_are_spread_over_the_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    assert tables.row_groups(spark, str(tmp_path / "one.parquet"), 4)[0] == 0  # too small to look at
    assert tables.table(spark, str(tmp_path), "one").rdd.getNumPartitions() == 1
    monkeypatch.setattr(tables, "LEAST_BYTES", 1)
    assert tables.row_groups(spark, str(tmp_path / "one.parquet"), 4)[0] == 1
    df = tables.table(spark, str(tmp_path), "one")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 1000
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "many.parquet"))
    assert tables.row_groups(spark, str(tmp_path / "many.parquet"), 4)[0] == 4


def test_tree_on_empty_table(spark):
    empty = spark.createDataFrame([], SONGS)
    assert tree.song_key_stats(empty).count() == 0
    assert tree.frequent_song_keys(empty).count() == 0


def test_skew_join_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, "hot")] * 50 + [(2, "cold"), (3, None), (4, "absent")], "id int, k string")
    right = spark.createDataFrame([("hot", 10), ("cold", 20), ("unused", 30)], "k string, v int")
    for how in ("inner", "left"):
        plain = left.join(right, "k", how)
        split = skew.skew_join(left, right, "k", how, hot=["hot"])
        assert Counter(map(tuple, split.select("k", "id", "v").collect())) == Counter(map(tuple, plain.select("k", "id", "v").collect()))
    assert skew.hot_keys(left, "k", rows=10) == ["hot"]


def test_skew_join_splits_any_number_of_hot_keys(spark):
    left = spark.range(3000).select("id", (F.col("id") % 300).cast("string").alias("k"))
    right = spark.range(310).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(left, "k", rows=10)
    assert len(hot) == 300
    got = skew.skew_join(left, right, "k", hot=hot)
    assert got.count() == 3000 and got.where("v <> 2 * cast(k as int)").count() == 0
    assert skew.skew_join(left, right, "k", "left", hot=hot[:299]).count() == 3000


def test_pair_join_splits_hot_ends(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    pairs = spark.range(200).selectExpr("id % 7 as a", "case when id < 100 then 1000 else id end as b", "id as n").unionByName(spark.createDataFrame([(None, 3, 0), (1, None, 0)], "a bigint, b bigint, n bigint"))
    one = spark.range(2000).selectExpr("id as a", "id * 2 as va")
    other = spark.range(2000).selectExpr("id as b", "id * 3 as vb")
    got = skew.pair_join(pairs, one, other)
    assert got.count() == 200 and got.where("va <> 2 * a or vb <> 3 * b").count() == 0


def test_unions_are_counted_with_and_without_bitmaps(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 2, 5, 300]), sorted(rng.sample(range(-40, 40), rng.randrange(1, 4)))) for i in range(200)] + [(900, 7, [1 << 62]), (901, 1, [-(1 << 63)])]
    df = spark.createDataFrame(rows, "id bigint, n bigint, sets array<bigint>").repartition(3)
    want = {i: sum(n for _, n, other in rows if set(own) & set(other)) for i, _, own in rows}
    for bitmap_bytes, block_links in ((unions.BITMAP_BYTES, unions.BLOCK_LINKS), (0, 150), (100, 150)):
        monkeypatch.setattr(unions, "BITMAP_BYTES", bitmap_bytes)
        assert sorted(map(tuple, unions.union_weights(df, block_links).collect())) == sorted(want.items())
    assert unions.union_weights(df.limit(0)).count() == 0


def test_shared_folder(spark):
    folder = skew.shared_folder(spark)
    assert folder == skew.shared_folder(spark) and skew.scratch(spark, "x").startswith(folder)


def test_bitmap_filter_loses_nothing(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"), "id")
    wanted = df.where("id % 97 = 0").select("h")
    got = bitmap_filter(df, "h", wanted)
    assert got.join(wanted, "h", "left_semi").count() == wanted.count()
    assert got.count() < 1000
    assert bitmap_filter(df, "h", wanted.limit(0)).count() == 0


def test_once_adds_the_value(spark):
    assert [r.y for r in skew.once(spark.range(3), "y", F.col("id") + 1).collect()] == [1, 2, 3]
    again = skew.once(spark.range(3).withColumn("y", F.lit(5)), "y", F.col("y") + F.col("id"))
    assert again.columns == ["id", "y"] and [r.y for r in again.collect()] == [5, 6, 7]


def test_groups_and_ids(spark):
    songs = spark.createDataFrame([(i,) for i in range(1, 8)] + [(3,), (None,)], "song_index bigint")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (6, 5), (4, 4), (None, 2)], "a bigint, b bigint")
    got = dict(map(tuple, graph.groups(songs, edges).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    ids = {r.song_index: r.group_id for r in graph.group_ids(graph.groups(songs, edges)).collect()}
    assert ids == {1: "G00001", 2: "G00001", 3: "G00001", 4: "G00002", 5: "G00003", 6: "G00003", 7: "G00004"}
    assert graph.linked_labels(edges.limit(0)).count() == 0


def test_long_chain_is_one_group(spark):
    n = 200
    edges = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)], "a bigint, b bigint")
    assert {r.label for r in graph.linked_labels(edges).collect()} == {0}


def test_ranks(spark):
    df = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 1), (None, 5), (None, 6)], "k string, o int")
    got = Counter((r.k, r.o, r.n) for r in ranks.grouped_rank(df, ["k"], "o", "n").collect())
    assert got == Counter([("a", i, i + 1) for i in range(40)] + [("b", 1, 1), (None, 5, 1), (None, 6, 2)])
    assert sorted(r.n for r in graph.global_rank(spark.range(100).select("id"), "id", "n").collect()) == list(range(1, 101))
