"""Files as rows: discovery, decoding, reports and decision logs."""

from __future__ import annotations

import json
import logging
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.operators.graph import global_rank

#: The suffixes of each source format.
SUFFIXES = {"openlyrics": [".xml"], "onsong": [".onsong", ".txt", ".chopro", ".cho", ".pro"], "txt_chordpro": [".txt", ".chopro", ".cho", ".pro"]}
LISTING = "path string, modificationTime timestamp, length bigint, content binary"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system that its scheme names, local, HDFS or an object store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _suffix_glob(suffixes: list[str]) -> str:
    """Names that end in one of the suffixes, in any case."""
    folded = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "*{" + ",".join(folded) + "}"


def discover(spark: SparkSession, roots: list[tuple[str, str, str]], content: bool = True) -> DataFrame:
    """(song_index, source_repo, source_format, path, size, modified, content) of the files of (root, repo, format).

    A root is a path or URI of any file system that Spark reads. The index follows the order of the roots and the path
    within each. A root that does not exist gives no files and a warning in the log. Only files with the suffixes of the
    format are opened; without ``content`` none is.
    """
    parts = []
    for n, (root, repo, kind) in enumerate(roots):
        if not exists(spark, root):
            logging.getLogger(__name__).warning("source root %s of %s does not exist", root, repo)
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", _suffix_glob(SUFFIXES[kind])).load(root)
        cols = [F.lit(n).alias("root"), F.lit(repo).alias("source_repo"), F.lit(kind).alias("source_format"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
        parts.append(files.select(*cols, *(["content"] if content else [])))
    if not parts:
        return spark.createDataFrame([], "song_index bigint, source_repo string, source_format string, path string, size bigint, modified timestamp" + (", content binary" if content else ""))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = F.format_string("%04d|%s", "root", "path")
    ids = global_rank(every.select(order.alias("_order")), "_order", "n").select("_order", (F.col("n") - 1).alias("song_index"))
    rows = every.withColumn("_order", order).join(ids, "_order")
    return rows.select("song_index", "source_repo", "source_format", "path", "size", "modified", *(["content"] if content else []))


def xml_listing(spark: SparkSession, root: str) -> DataFrame:
    """XML files directly in a folder, with ``place`` in the order of their lower-case names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").load(root).select("path", "content")
    return global_rank(files.withColumn("name", F.lower(F.regexp_extract("path", r"([^/]+)$", 1))), "name", "place")


#: Orders in which a file's bytes are tried; bytes marked as UTF-16 are tried as that first.
CATALOGUE_LADDER, SONGBOOK_LADDER = ["utf-8-sig", "utf-16", "cp1252", "latin-1"], ["utf-8-sig", "utf-16"]


def decode_bytes(raw: bytes | None, ladder: list[str], marked_first: bool = True) -> str:
    """The text of a file: the first encoding of the ladder that fits, else with replacements. Null is empty."""
    raw = raw or b""
    first = ["utf-16"] if marked_first and raw[:2] in (b"\xff\xfe", b"\xfe\xff") else []
    for encoding in first + ladder:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8" if "cp1252" in ladder else "cp1252", "replace")


def decoded(files: DataFrame, ladder: list[str] | None = None, content: str = "content") -> DataFrame:
    """Adds ``text``, the decoded content, and drops the bytes."""
    keep = [c for c in files.columns if c != content]
    order = ladder or CATALOGUE_LADDER

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_bytes(x, order, order is not SONGBOOK_LADDER) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"{c} {t}" for c, t in files.select(*keep).dtypes)
    return files.select(*keep, content).mapInArrow(scan, f"{schema}, text string")


def content_hash(content: str = "content"):
    """SHA-256 of a file's bytes."""
    return F.sha2(F.coalesce(F.col(content), F.lit(b"")), 256)


def read_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV report with a header, all columns text; an absent file is an empty report. A byte order mark is dropped."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns])


def detail_rows(report: DataFrame, title: str) -> DataFrame:
    """Rows of a report that name the title in any of its title columns."""
    named = [c for c in ("title", "canonical_title", "a_title", "b_title") if c in report.columns]
    hit = F.lit(False)
    for c in named:
        hit = hit | (F.col(c) == title)
    return report.where(hit)


def orphan_exports(exports: DataFrame, report: DataFrame, path: str = "export_path") -> DataFrame:
    """Exported files that the report does not name, ordered columns as given."""
    return exports.join(report.select(path).distinct(), path, "left_anti")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, decision) of a JSON list of decisions; of repeated groups the last counts. Absent or broken files are empty."""
    empty = spark.createDataFrame([], "group_id string, decision string")
    if not exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<map<string,string>>")).alias("place", "d"))
    last = rows.where("d['group_id'] is not null").groupBy(F.col("d")["group_id"].alias("group_id")).agg(F.max_by("d", "place").alias("d"))
    return last.select("group_id", F.to_json("d").alias("decision"))


def resolve_path(spark: SparkSession, out_dir: str, path: str) -> str:
    """Where a path of a report is: as it stands if absolute or present, else below the output folder or its parent."""
    if path.startswith("/") or "://" in path or not path or exists(spark, path):
        return path
    out = out_dir.rstrip("/")
    if path.split("/")[0] == posixpath.basename(out):
        return f"{posixpath.dirname(out)}/{path}" if "/" in out else path
    return f"{out}/{path}"


def read_summary(spark: SparkSession, path: str) -> dict:
    """The summary of a run; an absent or broken one is empty."""
    if not exists(spark, path):
        return {}
    try:
        found = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))  # one small file
    except json.JSONDecodeError:
        return {}
    return found if isinstance(found, dict) else {}
