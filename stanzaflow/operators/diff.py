"""Differences between two versions of a song, line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanzaflow.functions import text as T
from stanzaflow.operators.changes import VersionedTable

#: Above so many lines or cells a pair is marked as simplified, as in the reference; so many rows are kept for display.
FULL_LINES, FULL_CELLS, RENDERED = 1200, 350_000, 900
#: The row that stands for those cut from the display, and the version in the key of a kept result.
CUT, VERSION = "... diff truncated ...", "diff.1"
#: Songs of the same title whose likeness is below this may be separate songs.
SEPARATE = 0.35
_META, _CHORD = re.compile(T.REVIEW_META), re.compile(T.REVIEW_CHORD)


def line_status(a: Column, b: Column) -> Column:
    """equal, metadata, chord_change or changed, for two lines of a pair."""
    same = T.review_line(a) == T.review_line(b)
    meta = (T.line_kind(a) == "metadata") | (T.line_kind(b) == "metadata")
    return F.when(a == b, "equal").when(meta, "metadata").when((T.review_chords(a) != T.review_chords(b)) & same, "chord_change").when(same, "equal").otherwise("changed")


def positional(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """(keys, place, left, right, status): lines of two texts compared by position; lines that both lack are left out."""
    zipped = F.arrays_zip(T.lines(F.col(a)).alias("l"), T.lines(F.col(b)).alias("r"))
    rows = pairs.select(*keys, F.posexplode(zipped).alias("place", "z")).select(*keys, "place", T.text(F.col("z.l")).alias("left"), T.text(F.col("z.r")).alias("right"))
    status = F.when((F.col("left") != "") & (F.col("right") != ""), line_status(F.col("left"), F.col("right"))).when(F.col("left") != "", "a_only").otherwise("b_only")
    return rows.where("left <> '' or right <> ''").withColumn("status", status)


def features(df: DataFrame, text: str) -> DataFrame:
    """Adds chord_count, line_count, lyric_line_count and completeness of a text."""
    lines = T.lines(F.col(text))
    lyric = F.size(F.filter(lines, lambda x: (T.trim(x) != "") & (T.review_line(x) != "")))
    chords = F.aggregate(F.transform(lines, lambda x: F.size(T.review_chords(x))), F.lit(0), lambda x, y: x + y)
    out = df.withColumn("chord_count", chords.cast("bigint")).withColumn("line_count", F.size(lines).cast("bigint")).withColumn("lyric_line_count", lyric.cast("bigint"))
    return out.withColumn("completeness", F.when(F.col("lyric_line_count").between(1, 4), "likely partial").otherwise("complete-looking"))


def _norm(line: str) -> str:
    if _META.search(line):
        return ""
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s']", " ", _CHORD.sub("", line).lower())).strip()


def _status(a: str, b: str) -> str:
    if a == b:
        return "equal"
    if _META.search(a) or _META.search(b):
        return "metadata"
    same = _norm(a) == _norm(b)
    return "chord_change" if same and _CHORD.findall(a) != _CHORD.findall(b) else "equal" if same else "changed"


def _pair(a: str, b: str, split: bool) -> list[tuple[str, str, str]]:
    if not a or not b:
        return [(a, b, "a_only" if a else "b_only")] if a or b else []
    status = _status(a, b)
    return [(a, "", "a_only"), ("", b, "b_only")] if split and status == "changed" else [(a, b, status)]


def align(text_a: str, text_b: str, classification: str = "") -> dict:
    """Aligned lines of two texts as (left, right, status), with likeness, counts, summary and the side that looks partial.

    Lines are aligned on their normalised form; a replaced line is one row per side, or one row for songs classified as
    ``lyric_match_title_different``. Songs classified as ``title_match_lyrics_different`` that are little alike may be
    ``separate``. Very large texts are aligned as well; they are only marked as ``simplified``, since the reference
    compares them by position. Likeness and counts are of all lines; ``lines`` is cut for display, with a row that says
    so, and ``row_count`` is not.
    """
    a, b = (text_a or "").splitlines(), (text_b or "").splitlines()
    simple = len(a) + len(b) > FULL_LINES or len(a) * max(1, len(b)) > FULL_CELLS
    rows: list[tuple[str, str, str]] = []
    side = lambda x, i, end: x[i] if i < end else ""
    key = lambda x: _norm(x) or x.strip().lower()
    blocks = SequenceMatcher(None, [key(x) for x in a], [key(x) for x in b], autojunk=False).get_opcodes()
    for tag, i, i2, j, j2 in blocks:
        for k in range(max(i2 - i, j2 - j)):
            left, right = side(a, i + k, i2), side(b, j + k, j2)
            if tag == "equal":
                rows.append((left, right, _status(left, right)))
            elif tag in ("delete", "insert"):
                rows.append((left, right, "a_only" if tag == "delete" else "b_only"))
            else:
                rows += _pair(left, right, classification != "lyric_match_title_different")
    x, y = [n for n in map(_norm, a) if n], [n for n in map(_norm, b) if n]
    likeness = SequenceMatcher(None, "\n".join(x), "\n".join(y), autojunk=False).ratio()
    short = lambda p, q: len(p) <= max(2, int(len(q) * 0.55))
    partial = "" if not x or not y else "A" if short(x, y) else "B" if short(y, x) else ""
    chords, metadata = sum(s == "chord_change" for _, _, s in rows), sum(s == "metadata" and p != q for p, q, s in rows)
    separate, cut = classification == "title_match_lyrics_different" and likeness < SEPARATE, len(rows) > RENDERED
    notes = [f"Lyric similarity {likeness:.2f}", f"{chords} chord-only difference(s)", f"{metadata} metadata difference(s)"]
    notes += [f"Source {partial} may be partial"] * bool(partial) + ["sources may be separate songs"] * separate + ["rendered diff truncated"] * cut
    return {
        "lines": [{"left": p, "right": q, "status": s} for p, q, s in rows[:RENDERED] + [(CUT, CUT, "changed")] * cut], "row_count": len(rows), "similarity": likeness, "chord_changes": chords,
        "metadata_changes": metadata, "partial": partial, "separate": separate, "summary": "; ".join(notes), "simplified": simple, "truncated": cut,
    }


DIFF = "lines array<struct<left:string,right:string,status:string>>, row_count bigint, similarity double, chord_changes bigint, metadata_changes bigint, partial string, separate boolean, summary string, simplified boolean, truncated boolean"


_TYPES = {"lines": pa.list_(pa.struct([("left", pa.string()), ("right", pa.string()), ("status", pa.string())])), "row_count": pa.int64(), "similarity": pa.float64(), "chord_changes": pa.int64(), "metadata_changes": pa.int64(), "partial": pa.string(), "separate": pa.bool_(), "summary": pa.string(), "simplified": pa.bool_(), "truncated": pa.bool_()}


def song_diffs(pairs: DataFrame, a: str, b: str, keys: list[str], classification: Column | None = None) -> DataFrame:
    """The alignment of every pair of texts, computed in Arrow batches spread evenly over tasks. Null text is empty."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keys)
            texts = [batch.column(n + i).to_pylist() for i in range(3)]
            done = [align(x, y, z or "") for x, y, z in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *[pa.array([r[c] for r in done], t) for c, t in _TYPES.items()]], names=[*keys, *_TYPES])

    schema = ", ".join(f"{k} {t}" for k, t in pairs.select(*keys).dtypes)
    rows = pairs.select(*keys, a, b, (classification if classification is not None else F.lit("")).alias("_class"))
    return rows.repartition(pairs.sparkSession.sparkContext.defaultParallelism * 4, *keys).mapInArrow(scan, f"{schema}, {DIFF}")


def diff_key(a: Column, b: Column, classification: Column) -> Column:
    """Key of a kept result: the hashes of both sources in pair order, the class of the pair and the version."""
    return F.sha2(F.encode(F.concat_ws("|", a, b, classification, F.lit(VERSION)), "utf-8"), 256)


def read_through(pairs: DataFrame, store: VersionedTable) -> DataFrame:
    """Results of ``pairs`` (diff_key, a_text, b_text, classification) with ``cached``, computing only what the store lacks.

    The store is a versioned table with key ``diff_key``; what is computed is one commit, so a run that fails leaves it as it was.
    Pairs with the same key are computed once. Returns (diff_key, the columns of a result, cached), a row per different key.
    """
    wanted = pairs.where("diff_key is not null").groupBy("diff_key").agg(F.min(F.struct("a_text", "b_text", "classification")).alias("p")).select("diff_key", "p.*")
    known = store.read()
    missing = wanted if known is None else wanted.join(known.select("diff_key"), "diff_key", "left_anti")
    before = store.version()
    store.commit(added=song_diffs(missing, "a_text", "b_text", ["diff_key"], F.col("classification")))
    fresh = store.changes(before)
    rows = store.read().join(wanted.select("diff_key"), "diff_key", "left_semi") if store.state()["files"] else None
    if rows is None:
        return pairs.sparkSession.createDataFrame([], f"diff_key string, {DIFF}, cached boolean")
    new = fresh.select("diff_key", F.lit(True).alias("_new")) if fresh is not None else None
    return (rows.join(new, "diff_key", "left") if new is not None else rows.withColumn("_new", F.lit(None))).withColumn("cached", F.col("_new").isNull()).drop("_new")
