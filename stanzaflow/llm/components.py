"""Consolidating pairwise matches into groups: connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.skew import HOT_ROWS, hottest, materialize, skew_join

STRONG_SCORE = 0.86


def counting_links(pairs: DataFrame, hint: str = "strong", least: float = STRONG_SCORE) -> DataFrame:
    """Links (a, b), a < b, of scored pairs.

    The direction of a pair does not matter. Of the rows of one unordered pair the latest scored_at counts; a null
    scored_at is the oldest, and rows of the same time are ordered by hint and score. A pair of a song with itself, a
    null index, a null score or a null hint makes no link.
    """
    rows = pairs.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct("scored_at", "decision_hint", "final_score").alias("s")
    )
    return rows.groupBy("a", "b").agg(F.max("s").alias("s")).where((F.col("s.decision_hint") == hint) & (F.col("s.final_score") >= least)).select("a", "b")


def hooked(edges: DataFrame, seed: int) -> DataFrame:
    """(v, rep, degree): every vertex hooks to the first of itself and its neighbours in a fresh hash order."""
    order = lambda c: F.xxhash64(F.col(c), F.lit(seed))
    sides = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
    near = sides.groupBy("v").agg(F.min_by("u", order("u")).alias("u"), F.min(order("u")).alias("h"), F.count(F.lit(1)).alias("degree"))
    return near.select("v", F.when(F.col("h") < order("v"), F.col("u")).otherwise(F.col("v")).alias("rep"), "degree")


def contracted(edges: DataFrame, hooks: DataFrame, hubs: list) -> DataFrame:
    """Relabelled, deduplicated edges between different representatives; the edges of hubs are not gathered."""
    left = skew_join(edges, hooks.select(F.col("v").alias("a"), F.col("rep").alias("ra")), "a", hot=hubs)
    both = skew_join(left.select("ra", "b"), hooks.select(F.col("v").alias("b"), F.col("rep").alias("rb")), "b", hot=hubs)
    return both.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()


def components(links: DataFrame, seed: int = 17) -> DataFrame:
    """(v, component) of every vertex of ``links`` (a, b); component is the smallest vertex that is reached.

    Contracts until no edge is left: the number of vertices falls by a constant factor a round in expectation, so the
    rounds are logarithmic. Only the edges of a round are written; its map is derived from them again when the maps, which
    shrink geometrically, are expanded from the last to the first in one plan. Hubs are found by their degree, which also
    bounds how many vertices share a representative; fewer edges than HOT_ROWS have none, so none are looked for. Loops
    and nulls are dropped; repeated and turned edges count once; no links give no rows.
    """
    edges = materialize(
        links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    rounds: list[tuple[DataFrame, list]] = []
    while several := edges.count():
        hooks = hooked(edges, seed + len(rounds))
        hubs = hottest(hooks.select(F.col("v").alias("k"), F.col("degree").alias("n")), HOT_ROWS) if several >= HOT_ROWS else []
        edges = materialize(contracted(edges, hooks, hubs))
        rounds.append((hooks.select("v", "rep"), hubs))
    if not rounds:
        return links.select(F.col("a").alias("v"), F.col("a").alias("component")).limit(0)
    total = rounds.pop()[0]
    for hooks, hubs in reversed(rounds):
        known = total.select(F.col("v").alias("rep"), F.col("rep").alias("root"))
        total = skew_join(hooks, known, "rep", "left", hot=hubs).select("v", F.coalesce("root", "rep").alias("rep"))
    total = materialize(total)
    smallest = total.groupBy("rep").agg(F.min("v").alias("component"), F.count(F.lit(1)).alias("n"))
    large = hottest(smallest.select(F.col("rep").alias("k"), "n"), HOT_ROWS)
    return skew_join(total, smallest.select("rep", "component"), "rep", hot=large).select("v", "component")


def song_components(pairs: DataFrame) -> DataFrame:
    """One row for each linked song with the smallest index it is linked to, directly or through others."""
    return components(counting_links(pairs)).select(F.col("v").alias("song_index"), F.col("component").alias("component_id"))
