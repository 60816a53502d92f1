"""Reports, exports and tables that are replaced by key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """Write a CSV report with exactly these columns; flags as 0 or 1. One folder, as many files as there are partitions."""
    types = dict(df.dtypes)
    cells = [F.col(c).cast("int").alias(c) if types[c] == "boolean" else F.col(c) for c in columns]
    df.select(*cells).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8")


def write_files(df: DataFrame, folder: str, name: str, text: str) -> int:
    """Write each row's text to its own file below a shared folder; returns how many. A file that is there is replaced.

    ``folder`` is a path or a URI that Arrow's file systems know (file, hdfs, s3, gs). Files are written where the rows lie.
    The write goes to another name first, so a lost task leaves no half file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import posixpath
        import uuid

        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = posixpath.join(base, n)
                where.create_dir(posixpath.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with where.open_output_stream(part) as f:
                    f.write((t or "").encode())
                where.move(part, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return df.select(name, text).mapInArrow(write, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file on the file system that its path names, replacing it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(text.encode()))
    out.close()


def clear_folders(spark: SparkSession, out: str, names: list[str]) -> list[str]:
    """Delete the named folders directly below ``out``, and nothing else; returns those that were there."""
    gone = []
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if "/" not in n and n not in ("", ".", "..") and fs.exists(path) and fs.delete(path, True):
            gone.append(n)
    return gone


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], latest: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, for writing to a new version.

    Of several new rows of a key the one with the greatest ``latest`` is taken, or any of equal ones. Columns that one
    side lacks are null there, so a table can gain columns.
    """
    rows = [c for c in new.columns if c not in keys]
    order = latest if latest is not None else F.lit(0)
    fresh = new.groupBy(*keys).agg(F.max(F.struct(order.alias("_o"), F.struct(*rows).alias("r"))).alias("e")).select(*keys, "e.r.*")
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def cached_or_missing(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted`` with their cached columns, and the rows that the cache lacks and that have to be computed."""
    return wanted.join(cache, keys, "inner"), wanted.join(cache.select(*keys).distinct(), keys, "left_anti")
