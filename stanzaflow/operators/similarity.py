"""Pair scores: set measures in Catalyst, sequence ratios in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions.text import tokens
from stanzaflow.operators.skew import pair_join, skew_join

# Thresholds and weights of the score.
LINE_MATCH, STRONG, POSSIBLE = 0.82, 0.86, 0.65


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct tokens of ``a`` that ``b`` has; 0 if either has none."""
    x, y = F.array_distinct(tokens(F.coalesce(a, F.lit("")))), tokens(F.coalesce(b, F.lit("")))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def shared_lines(a: Column, b: Column) -> Column:
    """Number of different lines that both have."""
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0)).cast("bigint")


def exact_coverage(a: Column, b: Column) -> Column:
    """Share of the lines of ``a`` that ``b`` has word by word; 0 if either has none."""
    found = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), found / F.size(a)).otherwise(F.lit(0.0))


def ratio(a: str, b: str) -> float:
    """Share of matching characters in the longest-block alignment; 0 if either is empty. Not symmetric."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


def line_score(a: str, b: str) -> float:
    """Likeness of two lines: alignment, or tokens of one contained in the other, the second way at a discount."""
    return 1.0 if a == b else max(ratio(a, b), _token_score(set(a.split()), set(b.split())))


def _token_score(x: set[str], y: set[str]) -> float:
    both = len(x & y)
    return max(both / len(x), 0.95 * both / len(y)) if x and y else 0.0


def coverage(a: list[str], b: list[str], least: float = LINE_MATCH) -> float:
    """Share of the lines of ``a`` for which ``b`` has the same or a line of at least that likeness.

    Lines are aligned only where neither their tokens decide nor two upper bounds of the alignment, its lengths and its
    letters, exclude them; the bounds change no result.
    """
    if not a or not b:
        return 0.0
    exact = set(b)
    others = [(y, set(y.split())) for y in exact]
    matcher = SequenceMatcher(None, autojunk=False)

    def like(x: str) -> bool:
        words = set(x.split())
        if any(_token_score(words, ys) >= least for _, ys in others):
            return True
        for y, _ in others:
            if x and y and 2.0 * min(len(x), len(y)) / (len(x) + len(y)) >= least:
                matcher.set_seqs(x, y)
                if matcher.quick_ratio() >= least and matcher.ratio() >= least:
                    return True
        return False

    known = {x: x in exact or like(x) for x in set(a)}
    return sum(known[x] for x in a) / len(a)


def equal_lyrics(songs: DataFrame) -> DataFrame:
    """(rep, song_index, same_title): every song whose normalised lyrics another song has, with the first of them.

    One row per song, so a text that a third of all songs have gives no pairs and no task gathers them. Empty and null
    lyrics equal nothing; a null title equals an empty one.
    """
    rows = songs.where("song_index is not null and normalized_lyrics <> ''").select("song_index", F.coalesce("normalized_title", F.lit("")).alias("title"), F.sha2("normalized_lyrics", 256).alias("class")).distinct()
    first = rows.groupBy("class").agg(F.min(F.struct("song_index", "title")).alias("f"), F.max("song_index").alias("last")).where("f.song_index < last").select("class", "f")
    return skew_join(rows, first, "class").where("song_index <> f.song_index").select(F.col("f.song_index").alias("rep"), "song_index", (F.col("title") == F.col("f.title")).alias("same_title"))


def combine(df: DataFrame) -> DataFrame:
    """Adds coverage bounds, identity, final score and hint to the parts title, lyric, ab, ba, lines and same_title."""
    hi, lo, t, y = F.greatest("ab", "ba"), F.least("ab", "ba"), F.col("title_score"), F.col("lyric_score")
    few = y * 0.65 + hi * 0.20 + t * 0.15
    many = hi * 0.60 + lo * 0.20 + y * 0.15 + t * 0.05
    base = F.when(F.col("lines") < 3, few).otherwise(many)
    aligned = F.col("same_title") & (F.col("lines") >= 4) & (hi >= 0.88) & (y >= 0.72)
    out = df.withColumn("lyric_identity_score", F.when(aligned, F.greatest(base, hi * 0.70 + y * 0.20 + t * 0.10)).otherwise(base))
    identity = F.col("lyric_identity_score")
    out = out.withColumn("final_score", F.greatest(identity, y * 0.85 + t * 0.15))
    hint = F.when(identity >= STRONG, "strong").when(F.col("same_title") & (identity < POSSIBLE), "same_title_different").when(identity >= POSSIBLE, "possible").otherwise("weak")
    return out.select(
        "a", "b", "title_score", "lyric_score", F.col("ab").alias("line_coverage_a_in_b"), F.col("ba").alias("line_coverage_b_in_a"), hi.alias("line_coverage_max"), lo.alias("line_coverage_min"),
        "lyric_identity_score", "final_score", "shared_line_count", hint.alias("decision_hint"),
    )


def pair_sides(pairs: DataFrame, songs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the named columns of both songs, prefixed a_ and b_; pairs with an unknown song drop out.

    A song that is in very many pairs is met by a broadcast of its columns; the rest of the pairs are shuffled.
    """
    one = songs.dropDuplicates(["song_index"]).select("song_index", *columns)
    side = lambda p: one.select(F.col("song_index").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    return pair_join(pairs, side("a"), side("b")).select("a", "b", *[c for c in pairs.columns if c not in ("a", "b")], *[f"{p}_{c}" for p in "ab" for c in columns])


def _mapped(rows: DataFrame, columns: list[str], function, kind: pa.DataType, sql: str, name: str) -> DataFrame:
    """(a, b, name) of a Python function over columns of pairs, in Arrow batches spread evenly over tasks."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(i + 2).to_pylist() for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([function(*x) for x in zip(*sides, strict=True)], kind)], names=["a", "b", name])

    n = rows.sparkSession.sparkContext.defaultParallelism * 4
    return rows.select("a", "b", *columns).repartition(n, "a", "b").mapInArrow(scan, f"a bigint, b bigint, {name} {sql}")


def line_coverages(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """(a, b, a_in_b, b_in_a): the share of lines that the other song has exactly or nearly; 0 where one has none."""
    sides = ["a_lyric_lines", "b_lyric_lines"]
    both = _mapped(pair_sides(pairs, songs, ["lyric_lines"]), sides, lambda x, y: [coverage(x or [], y or []), coverage(y or [], x or [])], pa.list_(pa.float64()), "array<double>", "c")
    return both.select("a", "b", F.col("c")[0].alias("a_in_b"), F.col("c")[1].alias("b_in_a"))


def text_ratios(pairs: DataFrame, songs: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, one ratio for each of the columns) of pairs; null text is empty."""
    sides = [f"{p}_{c}" for c in columns for p in "ab"]
    ratios = lambda *x: [ratio(x[i] or "", x[i + 1] or "") for i in range(0, len(x), 2)]
    both = _mapped(pair_sides(pairs, songs, columns), sides, ratios, pa.list_(pa.float64()), "array<double>", "r")
    return both.select("a", "b", *[F.col("r")[i].alias(c) for i, c in enumerate(columns)])


def best_line_scores(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """(a, b, place, score): of every line of a the likeness of the line of b that is most like it; 0 where b has none."""
    best = lambda x, y: [max((line_score(p, q) for q in set(y or [])), default=0.0) for p in x or []]
    rows = _mapped(pair_sides(pairs, songs, ["lyric_lines"]), ["a_lyric_lines", "b_lyric_lines"], best, pa.list_(pa.float64()), "array<double>", "s")
    return rows.select("a", "b", F.posexplode("s").alias("place", "score"))


def score_pairs(pairs: DataFrame, songs: DataFrame) -> DataFrame:
    """Scores of every pair (a, b) of songs.

    Pairs with the same non-empty normalised lyrics take a branch of their own and never reach Python; the others are
    aligned in Arrow batches, spread evenly over tasks since alignment costs far more than the shuffle. Null text
    counts as empty; ratios follow the order of the pair.
    """
    cols = ["normalized_title", "compact_title", "normalized_lyrics", "lyric_lines"]
    both = pair_sides(pairs, songs, cols)
    for p in ("a", "b"):
        both = both.withColumn(f"{p}_lyric_lines", F.coalesce(f"{p}_lyric_lines", F.array().cast("array<string>")))
        for c in cols[:3]:
            both = both.withColumn(f"{p}_{c}", F.coalesce(f"{p}_{c}", F.lit("")))
    named = (F.col("a_normalized_title") != "") & (F.col("a_normalized_title") == F.col("b_normalized_title"))
    both = both.withColumn("same_title", named).withColumn("lines", F.least(F.size("a_lyric_lines"), F.size("b_lyric_lines"))).withColumn("shared_line_count", shared_lines(F.col("a_lyric_lines"), F.col("b_lyric_lines")))
    same = (F.col("a_normalized_lyrics") != "") & (F.col("a_normalized_lyrics") == F.col("b_normalized_lyrics"))
    compact = (F.col("a_compact_title") != "") & (F.col("a_compact_title") == F.col("b_compact_title"))
    one = F.lit(1.0)
    equal = both.where(same).select(
        "a", "b", F.when(named | compact, 1.0).otherwise(0.0).alias("title_score"), one.alias("lyric_score"), one.alias("line_coverage_a_in_b"), one.alias("line_coverage_b_in_a"), one.alias("line_coverage_max"),
        one.alias("line_coverage_min"), one.alias("lyric_identity_score"), one.alias("final_score"), "shared_line_count", F.lit("strong").alias("decision_hint"),
    )
    keep = ["a", "b", "same_title", "lines", "shared_line_count"]
    schema = "a bigint, b bigint, same_title boolean, lines int, shared_line_count bigint, title_score double, lyric_score double, ab double, ba double"

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            title = [max(ratio(r["a_normalized_title"], r["b_normalized_title"]), ratio(r["a_compact_title"], r["b_compact_title"])) for r in rows]
            lyric = [ratio(r["a_normalized_lyrics"], r["b_normalized_lyrics"]) for r in rows]
            ab = [coverage(r["a_lyric_lines"], r["b_lyric_lines"]) for r in rows]
            ba = [coverage(r["b_lyric_lines"], r["a_lyric_lines"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x, pa.float64()) for x in (title, lyric, ab, ba)]], names=[*keep, "title_score", "lyric_score", "ab", "ba"])

    n = both.sparkSession.sparkContext.defaultParallelism * 4
    rest = both.where(~same).select(*keep, *[f"{p}_{c}" for p in ("a", "b") for c in cols]).repartition(n, "a", "b")
    return combine(rest.mapInArrow(align, schema)).unionByName(equal)
