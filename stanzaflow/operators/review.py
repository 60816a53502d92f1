"""Choosing and finding what a reviewer looks at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions import text as T


def matching(df: DataFrame, fields: list[str], search: str = "", **equal: str) -> DataFrame:
    """Rows that hold every term of ``search`` in any of the joined fields, and whose columns equal ``equal``.

    Case does not matter; an empty value or ``all`` lets everything pass. Null fields count as empty.
    """
    out = df
    for c, v in equal.items():
        if v.strip() and v.strip().lower() != "all":
            out = out.where(F.lower(F.col(c)) == v.strip().lower())
    hay = F.lower(F.concat_ws(" ", *[T.text(F.col(c)) for c in fields]))
    for term in search.lower().split():
        out = out.where(F.contains(hay, F.lit(term)))
    return out


def default_pairs(rows: DataFrame, group: str, kind: Column) -> DataFrame:
    """Of every group the pair to compare first, chosen by its kind, one aggregation for all kinds.

    Conflicting titles: the least identity, among pairs of like titles if there are any. Differing titles: the greatest
    identity among pairs whose titles differ, if any. Several chorded sources: most sources that are not primary, then
    identity. All others: the greatest final score. Ties go to the first pair.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    identity = zero("lyric_identity_score")
    differ = T.titles_differ(F.col("a_title"), F.col("b_title"))
    chorded = (F.col("a_source") != "repo_a").cast("double") + (F.col("b_source") != "repo_a").cast("double")
    first, second = (
        F.when(kind == "title_match_lyrics_different", (zero("title_score") >= 0.85).cast("double")).when(kind == "lyric_match_title_different", differ.cast("double")).when(kind == "multiple_chorded_sources", chorded).otherwise(F.lit(0.0)),
        F.when(kind == "title_match_lyrics_different", -identity).when((kind == "lyric_match_title_different") & differ, identity).when(kind == "multiple_chorded_sources", identity).otherwise(F.coalesce("final_score", "lyric_identity_score", F.lit(0.0))),
    )
    best = F.max(F.struct(first.alias("x"), second.alias("y"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")))
    return rows.groupBy(group).agg(best.alias("r")).select(group, (-F.col("r.na")).alias("a"), (-F.col("r.nb")).alias("b"))


def parse_members(c: Column) -> Column:
    """Members of a report's text as structs of source, title and path; what cannot be read is a title."""
    pattern = r"^(.*?): (.*?) \[(.*)\]$"
    one = lambda x: F.when(x.rlike(pattern), F.struct(*[T.trim(F.regexp_extract(x, pattern, i)).alias(n) for i, n in ((1, "source_repo"), (2, "title"), (3, "source_path"))])).otherwise(
        F.struct(F.lit("").alias("source_repo"), x.alias("title"), F.lit("").alias("source_path"))
    )
    return F.transform(F.filter(F.transform(F.split(T.text(c), r" \|\| "), T.trim), lambda x: x != ""), one)


def title_index(pairs: DataFrame) -> DataFrame:
    """(norm_title, a, b): rows of a report by each different normalised title that they name."""
    titles = F.array_distinct(F.filter(F.array(T.normalize_title(F.col("a_title")), T.normalize_title(F.col("b_title"))), lambda x: x != ""))
    return pairs.select(F.explode(titles).alias("norm_title"), "a", "b")
