"""Candidate pairs by shared keys: five inverted indexes, whole or with the caps of the reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stanzaflow.functions.text import WEAK_LINES
from stanzaflow.operators.bitmap import bitmap_filter, bitmaps_for
from stanzaflow.operators.skew import HOT_KEYS, HOT_ROWS, hottest, materialize, once, scratch, skew_join
from stanzaflow.operators.unions import BLOCK_LINKS, union_weights

#: By index: the largest bucket that ``candidate_pairs`` still takes, as in the reference, and the block of ``covered_pairs``.
CAPS = {"title": 500, "compact": 500, "token": 500, "line": 250, "shingle": 250}
SHORTEST_LINE = 10


def _keys(once_each: bool = False) -> Column:
    """The keys (kind, key) of a song in the five indexes, empty and null ones among them; in order and once if wished."""
    none = F.array().cast("array<string>")
    values_of = lambda values: F.array_sort(F.array_distinct(F.coalesce(values, none))) if once_each else F.coalesce(values, none)
    keyed = lambda kind, values: F.transform(values_of(values), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    long = F.filter(F.coalesce(F.col("lyric_lines"), none), lambda x: (F.length(x) >= SHORTEST_LINE) & ~x.isin(WEAK_LINES))
    return F.concat(
        keyed("title", F.array("normalized_title")), keyed("compact", F.array("compact_title")), keyed("token", F.col("title_tokens")), keyed("line", long), keyed("shingle", F.col("lyric_shingles"))
    )


def blocking_keys(songs: DataFrame) -> DataFrame:
    """(kind, key, id) of the five indexes; a title token that a title repeats gives a row each time.

    Empty and null titles and lines give no key, nor do lines that are short or say too little.
    """
    rows = songs.select(F.col("song_index").alias("id"), F.explode(_keys()).alias("k")).select("k.kind", "k.key", "id")
    return rows.where("id is not null and key <> ''")


def bucket_sizes(keys: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(kind, key, n, kept): rows of every bucket and whether it gives pairs, counted before the shuffle."""
    counts = keys.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("kept", (F.col("n") >= 2) & (F.col("n") <= _cap(caps)))


def _hashed(rows: DataFrame) -> DataFrame:
    """(kind, h, g, id): keys as two 64-bit hashes, so no text is shuffled; two keys in 10^18 are taken for one at 10^10 keys."""
    return rows.select("kind", F.xxhash64("kind", "key").alias("h"), F.xxhash64("key", F.lit(7), "kind").alias("g"), "id")


def _cap(caps: dict[str, int] | None) -> Column:
    return F.create_map(*[F.lit(x) for kv in (caps or CAPS).items() for x in kv])[F.col("kind")]


def kept_pairs(songs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """(kind, a, b), a < b: pairs of songs that share a bucket of 2 to cap rows, once for each such bucket.

    The largest buckets over their caps, at most HOT_KEYS of them, are dropped where the rows lie and no other holds more
    than a fair share of a task; a bitmap drops most keys that one song has alone. Only kept buckets are gathered, so no
    task holds more of a bucket than its cap.
    """
    keys = _hashed(blocking_keys(songs))
    sizes = materialize(keys.groupBy("kind", "h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    kept = sizes.where(F.col("n") <= _cap(caps)).select("h", "g")
    over = sizes.where((F.col("n") > _cap(caps)) & (F.col("n") >= HOT_ROWS)).orderBy(F.desc("n")).limit(HOT_KEYS).select("h", "g")
    rows = bitmap_filter(keys.join(F.broadcast(over), ["h", "g"], "left_anti"), "h", kept.select("h"), bitmaps_for(kept.count()))
    buckets = rows.join(kept, ["h", "g"], "left_semi").groupBy("kind", "h", "g").agg(F.sort_array(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    pair = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice(F.col("ids"), i + 2, F.size("ids")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return buckets.select("kind", F.explode(pair).alias("p")).select("kind", "p.a", "p.b")


def candidate_pairs(songs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of songs that share a bucket of 2 to cap rows in any index: the rule of the reference.

    Pairs that only share a larger bucket are lost; ``covered_pairs`` has them all, and ``candidate_classes`` has them in
    short.
    """
    return kept_pairs(songs, caps).select("a", "b").distinct()


def candidate_classes(songs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """All candidates in a table that grows with the songs: (kind, bucket, rep, song_index, links, over_cap).

    Every bucket of at least two songs, however large, is a class with its smallest song as representative, and each of its
    songs has a row: two songs are candidates if and only if they are in a bucket together. ``bucket`` is the MD5 of
    kind and key, ``links`` the number of other songs in it, and ``over_cap`` says that ``candidate_pairs`` leaves it out. The
    rows of a hot bucket are not gathered.
    """
    keys = F.filter(_keys(once_each=True), lambda k: k["key"] != "")
    rows = songs.where("song_index is not null").select(F.col("song_index").alias("id"), F.explode(keys).alias("k")).select("k.kind", F.xxhash64("k").alias("h"), F.md5(F.encode(F.concat_ws("|", "k.kind", "k.key"), "utf-8")).alias("bucket"), "id")
    sizes = rows.groupBy("kind", "h", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1")
    stars = materialize(sizes.select("h", F.col("bucket").alias("_b"), "n", "rep", (F.col("n") > _cap(caps)).alias("over_cap")))
    hot = hottest(stars.select(F.col("h").alias("k"), "n"))
    met = skew_join(bitmap_filter(rows, "h", stars.select("h"), bitmaps_for(stars.count())), stars, "h", hot=hot).where("bucket = _b")
    return met.select("kind", "bucket", "rep", F.col("id").alias("song_index"), (F.col("n") - 1).alias("links"), "over_cap")


def candidate_links(pairs: DataFrame) -> DataFrame:
    """(id, links): of every song that is in a pair the number of its candidates."""
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))


def _block_pairs(keys: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids that share a bucket, of different rows (kind, h, g, id).

    A bucket over its cap is split by a hash of the id into blocks of about cap ids, and every two blocks meet in a
    group of their own; so no bucket is left out and no task holds more than two blocks of it at a time.
    """
    sizes = keys.groupBy("kind", "h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = materialize(sizes.select("h", F.col("g").alias("_g"), "n", F.ceil(F.col("n") / _cap(caps)).cast("int").alias("blocks")))
    hot = hottest(kept.select(F.col("h").alias("k"), "n"))
    rows = skew_join(bitmap_filter(keys, "h", kept.select("h"), bitmaps_for(kept.count())), kept, "h", hot=hot).where("g = _g")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = rows.select("h", "g", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("h", "g", "id", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    side = lambda end: F.collect_list(F.when(F.col("own") == F.col(end), F.col("id")))
    n = rows.sparkSession.sparkContext.defaultParallelism * 16
    both = met.repartition(n, "h", "g", "lo", "hi").groupBy("h", "g", "lo", "hi").agg(side("lo").alias("left"), side("hi").alias("right"))
    pairs = both.select("lo", "hi", "right", F.explode("left").alias("x")).select("lo", "hi", "x", F.explode("right").alias("y")).where("lo < hi or x < y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def covered_classes(songs: DataFrame, caps: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """All candidates in short: (id, rep) of songs with a key, and pairs (a, b), a < b, of representatives.

    Songs with the same keys have one representative, the smallest. Two songs share a bucket, whatever its size, if and
    only if they have the same representative or their representatives are a pair. ``songs`` has one row per song.
    """
    keys = F.filter(_keys(once_each=True), lambda k: k["key"] != "")
    keyed = once(songs.where("song_index is not null").withColumn("id", F.col("song_index")), "keys", keys).select("id", "keys").where(F.size("keys") > 0)
    ids = materialize(keyed.select("id", F.sha2(F.to_json("keys"), 256).alias("class")))
    members = materialize(skew_join(ids, ids.groupBy("class").agg(F.min("id").alias("rep")), "class").select("id", "rep"))
    one = keyed.join(members.where("id = rep").select("id"), "id", "left_semi")
    return members, _block_pairs(_hashed(one.select("id", F.explode("keys").alias("k")).select("k.kind", "k.key", "id")), caps or CAPS)


def covered_pairs(songs: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of songs that share a bucket of any size in any index; caps only size the blocks."""
    members, pairs = covered_classes(songs, caps)
    side = lambda p: members.select(F.col("rep").alias(p), F.col("id").alias(f"{p}_id"))
    apart = pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    alike = _block_pairs(_hashed(members.select(F.lit("class").alias("kind"), F.col("rep").cast("string").alias("key"), "id")), {"class": CAPS["title"]})
    return apart.unionByName(alike)


def shared_sets(songs: DataFrame) -> DataFrame:
    """(id, sets): of every song that shares a bucket its distinct buckets of at least two songs, as sorted 64-bit numbers.

    The number of a bucket is made of its songs, so buckets of the same songs, such as the shingles of one line, are one:
    two songs share a bucket if and only if they share a number. Keys are grouped by 96 bits of hash, so no text is shuffled. A bucket
    has a song once, so even the largest is a small part of all rows. ``songs`` has one row per song.
    """
    none, kinds = F.array().cast("array<string>"), list(CAPS)
    lists = [F.array("normalized_title"), F.array("compact_title"), *[F.array_distinct(F.coalesce(c, none)) for c in ("title_tokens", "lyric_lines", "lyric_shingles")]]
    each = songs.where("song_index is not null").select(F.col("song_index").alias("id"), F.posexplode(F.array(*lists)).alias("kind", "keys")).select("id", "kind", F.explode("keys").alias("key"))
    rows = each.where((F.col("key") != "") & ((F.col("kind") != kinds.index("line")) | (F.length("key") >= SHORTEST_LINE) & ~F.col("key").isin(WEAK_LINES)))
    bucket = Window.partitionBy("h", "g")
    hashed = rows.select("id", F.xxhash64("kind", "key").alias("h"), F.hash("key", "kind").alias("g"))
    numbered = hashed.select("id", F.count(F.lit(1)).over(bucket).alias("n"), F.bit_xor(F.xxhash64("id")).over(bucket).alias("set")).where("n > 1")
    return numbered.groupBy("id").agg(F.sort_array(F.collect_set("set")).alias("sets"))


def covered_links(songs: DataFrame, caps: dict[str, int] | None = None, block_links: int = BLOCK_LINKS) -> DataFrame:
    """(id, links): of every song that shares a bucket of any size the number of its candidates, without forming a pair.

    Songs in the same buckets have the same candidates and are counted once, as one column with their number as weight.
    ``caps`` are those of ``covered_pairs`` and change nothing here, as no bucket is split.
    """
    spark = songs.sparkSession
    stored = lambda df, name: df.write.parquet(folder := scratch(spark, name)) or spark.read.parquet(folder)
    lists = stored(shared_sets(songs).withColumn("class", F.sha2(F.array_join(F.col("sets").cast("array<string>"), " "), 256)), "sets")
    ids = lists.select("id", "class")
    members = materialize(skew_join(ids, ids.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "class").select("id", "rep", "n"))
    one = lists.select("id", "sets").join(members.where("id = rep").select("id", "n"), "id")
    unions = union_weights(stored(one.repartition(spark.sparkContext.defaultParallelism * 4, "id"), "classes"), block_links)
    return skew_join(members.select("id", "rep"), unions.select(F.col("id").alias("rep"), (F.col("n") - 1).alias("links")), "rep").select("id", "links")
