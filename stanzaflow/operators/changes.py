"""Processing only what changed: differences between table versions, and commits that remember what was processed."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanzaflow.operators.skew import materialize, scratch


def recorded_manifest(journal: DataFrame, runs: DataFrame) -> DataFrame:
    """The version that successful runs recorded: of each path the latest row whose run ended ``ok``.

    Rows of failed, running or unknown runs do not count. Ties on updated_at are broken by hash, size and mtime.
    """
    ok = runs.where("status = 'ok'").select(F.col("run_id").alias("last_seen_run")).distinct()
    rows = journal.where("path is not null").select("path", "file_hash", "size", "mtime_ns", "last_seen_run", F.try_to_timestamp("updated_at").alias("at"))
    last = F.max(F.struct("at", "file_hash", "size", "mtime_ns")).alias("e")
    return rows.join(ok, "last_seen_run", "left_semi").groupBy("path").agg(last).select("path", "e.file_hash", "e.size", "e.mtime_ns")


def sighted_manifest(scans: DataFrame) -> DataFrame:
    """The version found on disk: of each path the latest sighting. Ties on scanned_at are broken by scan_id."""
    last = F.max(F.struct("scanned_at", "scan_id", "file_hash", "size", "mtime_ns")).alias("e")
    return scans.where("path is not null").groupBy("path").agg(last).select("path", "e.file_hash", "e.size", "e.mtime_ns")


#: Every so many versions a version file also holds the whole state, so that few files have to be read.
SNAPSHOT_EVERY, BUCKETS = 32, 16


class VersionedTable:
    """A table of immutable parquet files; a version is a manifest of added files, removed files and deletion vectors.

    ``<root>/versions/<n>.json`` says what version n changed: ``added`` (file to bucket), ``removed`` (files),
    ``vectors`` (a parquet folder of deleted rows (file, key), to the files it has rows of) and ``properties``. Rows lie
    in files by a hash of their key, so a commit looks for the keys to delete only in files of their buckets. A version
    file is created exclusively and holds all or nothing. Only names of files are held by the driver, some hundred
    bytes each. ``root`` must be on storage that all executors share. Column names that begin with two underscores are
    reserved. A null key is a key like any other.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.buckets = spark, root, key, buckets
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _load(self, version: int) -> dict | None:
        """The entry of a version; None while its writer has not closed it."""
        stream = self._fs.open(self._path("versions", f"{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except json.JSONDecodeError:
            return None
        finally:
            stream.close()

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        if not self._fs.exists(self._path("versions")):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("versions"))]
        for n in sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[0] != "."), reverse=True):
            if self._load(n) is not None:
                return n
        return 0

    def state(self, version: int | None = None) -> dict:
        """``files`` (file to bucket and vectors) and ``properties`` of a version; version 0 is empty."""
        at, later = self.version() if version is None else version, []
        state: dict = {"files": {}, "properties": {}}
        while at > 0:
            entry = self._load(at)
            if entry is None:
                raise ValueError(f"there is no version {at}")
            if "state" in entry:
                state = entry["state"]
                break
            later.append(entry)
            at -= 1
        for entry in reversed(later):
            self._apply(state, entry)
        return state

    @staticmethod
    def _apply(state: dict, entry: dict) -> None:
        for f in entry["removed"]:
            del state["files"][f]
        for f, bucket in entry["added"].items():
            state["files"][f] = {"bucket": bucket, "vectors": []}
        for folder, files in entry["vectors"].items():
            for f in files:
                state["files"][f]["vectors"].append(folder)
        state["properties"] |= entry["properties"]

    def properties(self) -> dict:
        """Properties of the newest version."""
        return self.state()["properties"]

    def _commit(self, base: int, added: dict[str, int] | None = None, removed: list[str] | None = None, vectors: dict[str, list[str]] | None = None, properties: dict | None = None) -> int:
        """Write version base + 1; fails if another writer did."""
        entry: dict = {"added": added or {}, "removed": removed or [], "vectors": vectors or {}, "properties": properties or {}}
        if (base + 1) % SNAPSHOT_EVERY == 0:
            state = self.state(base)
            self._apply(state, entry)
            entry["state"] = state
        text, target = json.dumps(entry).encode(), self._path("versions", f"{base + 1:012d}.json")
        taken = RuntimeError(f"version {base + 1} was committed by another writer")
        if self._fs.getUri().getScheme() == "file":  # a link is made whole or not at all
            name = target.toUri().getPath()
            part = os.path.join(os.path.dirname(name), f".{uuid.uuid4().hex}.tmp")
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with open(part, "wb") as f:
                f.write(text)
            try:
                os.link(part, name)
            except FileExistsError:
                raise taken from None
            finally:
                os.remove(part)
            return base + 1
        try:
            out = self._fs.create(target, False)
        except Py4JJavaError as e:
            if self._fs.exists(target):
                raise taken from e
            raise
        out.write(bytearray(text))
        out.close()
        return base + 1

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> dict[str, int]:
        """Write rows by bucket; the files with their buckets."""
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("__bucket", self._bucket())
        placed.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        out, files = {}, self._fs.listFiles(self._path(folder), True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().endswith(".parquet"):
                bucket = path.getParent().getName()
                out[f"{folder}/{bucket}/{path.getName()}"] = int(bucket.split("=")[1])
        return out

    def _rows(self, files: Iterable[str]) -> DataFrame | None:
        """Rows of some files with ``__file``, the name of the file they lie in."""
        names = [f"{self.root}/{f}" for f in files]
        if not names:
            return None
        return self.spark.read.parquet(*names).withColumn("__file", F.regexp_extract(F.input_file_name(), "(data/[^/]+/[^/]+/[^/]+)$", 1))

    def _without(self, rows: DataFrame | None, vectors: Iterable[str], how: str = "left_anti") -> DataFrame | None:
        """Rows that no vector names, or with ``left_semi`` those that one names. No file has two vectors with one row."""
        folders = sorted({f"{self.root}/{v}" for v in vectors})
        if rows is None or not folders:
            return rows if how == "left_anti" else None
        dead = self.spark.read.parquet(*folders).select(F.col("__file").alias("__f"), F.col(f"`{self.key}`").alias("__k"))
        return rows.join(dead, (F.col("__file") == F.col("__f")) & F.col(f"`{self.key}`").eqNullSafe(F.col("__k")), how)

    def _live(self, files: dict) -> DataFrame | None:
        return self._without(self._rows(files), [v for f in files.values() for v in f["vectors"]])

    def _vector(self, dead: DataFrame) -> dict[str, list[str]]:
        """Write a deletion vector of rows (``__file``, key); its folder with the files it names."""
        folder = f"deletes/{uuid.uuid4().hex}"
        dead.select("__file", f"`{self.key}`").distinct().write.parquet(f"{self.root}/{folder}")
        touched = [r[0] for r in self.spark.read.parquet(f"{self.root}/{folder}").select("__file").distinct().collect()]
        return {folder: touched} if touched else {}

    def commit(self, added: DataFrame | None = None, deleted_keys: DataFrame | None = None, properties: dict | None = None, replace: bool = False) -> int:
        """Write a new version: rows to add, keys to delete from the files of the present version, and properties.

        A key in both is replaced; with ``replace`` every added key is. ``added`` is evaluated once. Files and earlier
        vectors are never rewritten, and only files in the buckets of the deleted keys are searched.
        """
        base = self.version()
        files = self.state(base)["files"]
        new = self._write(added) if added is not None else {}
        sources = [deleted_keys] if deleted_keys is not None else []
        if replace and new:
            sources.append(self._rows(new))
        vectors = {}
        if sources and files:
            keys = sources[0].select(f"`{self.key}`")
            for s in sources[1:]:
                keys = keys.unionByName(s.select(f"`{self.key}`"))
            keys = keys.distinct()
            hit = {r[0] for r in keys.select(self._bucket()).distinct().collect()}  # at most one row per bucket
            old = self._live({f: e for f, e in files.items() if e["bucket"] in hit})
            if old is not None:
                wanted = keys.select(F.col(f"`{self.key}`").alias("__k"))
                vectors = self._vector(old.join(wanted, F.col(f"`{self.key}`").eqNullSafe(F.col("__k")), "left_semi"))
        return self._commit(base, added=new, vectors=vectors, properties=properties)

    def sync(self, listing: DataFrame, same: Column, properties: dict | None = None) -> int:
        """Write the version that holds exactly ``listing``, one row per key.

        Rows that are ``same``, a condition on the structs ``old`` and ``new`` of one key, stay where they are; only
        changed and added rows are written, and changed and removed ones get a deletion vector. Both versions meet in one
        shuffle by key.
        """
        base = self.version()
        live = self._live(self.state(base)["files"])
        fresh = listing.select(F.col(f"`{self.key}`").alias("__k"), F.struct(*[F.col(f"`{c}`") for c in listing.columns]).alias("new"))
        if live is None:
            return self._commit(base, added=self._write(listing), properties=properties)
        before = live.select(F.col(f"`{self.key}`").alias("__o"), F.struct(*[F.col(f"`{c}`") for c in live.columns if c != "__file"]).alias("old"), "__file")
        both = before.join(fresh, F.col("__o").eqNullSafe(F.col("__k")), "full_outer")
        differ = materialize(both.where(F.col("old").isNull() | F.col("new").isNull() | ~same).select("old", "new", "__file"))
        new = self._write(differ.where("new is not null").select("new.*"))
        vectors = self._vector(differ.where("old is not null").select("__file", F.col("old")[self.key].alias(self.key)))
        return self._commit(base, added=new, vectors=vectors, properties=properties)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None for a version without files."""
        rows = self._live(self.state(version)["files"])
        return None if rows is None else rows.drop("__file")

    def changes(self, since: int, until: int | None = None) -> DataFrame | None:
        """Record deltas between two versions, with ``_change`` insert or delete; None if no file or vector differs.

        Added files give inserts, removed files deletes, and of files in both only the vectors that came since are read.
        Files that are the same in both versions are not opened.
        """
        old, new = self.state(since)["files"], self.state(until)["files"]
        out = [
            (self._live({f: e for f, e in new.items() if f not in old}), "insert"),
            (self._live({f: e for f, e in old.items() if f not in new}), "delete"),
        ]
        later = {f: [v for v in e["vectors"] if v not in old[f]["vectors"]] for f, e in new.items() if f in old and e["vectors"] != old[f]["vectors"]}
        out.append((self._without(self._rows(later), [v for vs in later.values() for v in vs], "left_semi"), "delete"))
        parts = [df.withColumn("_change", F.lit(kind)) for df, kind in out if df is not None]
        if not parts:
            return None
        result = parts[0]
        for df in parts[1:]:
            result = result.unionByName(df, allowMissingColumns=True)
        return result.drop("__file")


def process_delta(source: VersionedTable, target: VersionedTable, work: Callable[[DataFrame], tuple[DataFrame | None, DataFrame | None]]) -> int:
    """Bring ``target`` up to date with ``source``; returns the number of source versions it moved on by.

    ``work`` turns the record deltas into rows to add or replace in the target and keys to delete from it. The processed
    source version is part of the same commit. A run that fails before its commit leaves the target as it was, and the
    next run does the same records again; after the commit they are never done twice.
    """
    done, now = target.properties().get("processed", 0), source.version()
    if done == now:
        return 0
    delta = source.changes(done, now)
    rows, gone = work(delta) if delta is not None else (None, None)
    target.commit(added=rows, deleted_keys=gone, replace=True, properties={"processed": now})
    return now - done


def process_changes(source: VersionedTable, target: VersionedTable, transform: Callable[[DataFrame], DataFrame]) -> int:
    """``process_delta`` for a target that holds ``transform`` of every record of the source under the same key."""
    return process_delta(
        source, target, lambda delta: (transform(delta.where("_change = 'insert'").drop("_change")), delta.where("_change = 'delete'").select(source.key))
    )


def file_changes(scans: DataFrame, journal: DataFrame, runs: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, change) of what the run under way has to do, with change ``added``, ``changed`` or ``removed``.

    What successful runs recorded is one version of a table of files and what was sighted is the next. The record deltas
    between the two go to the work list, whose commit says up to which version they are done; the rows are those that
    this commit added. An entry without a hash was not read again and is compared by size and mtime_ns; otherwise
    the hash decides, and a null only equals a null. Rows without a path are left out; empty tables give no rows.
    ``folder`` is on shared storage; without it a new one is used. A folder with versions of an earlier run is carried on.
    """
    spark = scans.sparkSession
    folder = folder or scratch(spark, "files")
    source, target = VersionedTable(spark, f"{folder}/source", "path"), VersionedTable(spark, f"{folder}/work", "path")
    if not target.version():
        if not source.version():
            source.commit(added=recorded_manifest(journal, runs))
        target.commit(properties={"processed": 1})
    since, old, new = target.version(), F.col("old"), F.col("new")

    def work(delta: DataFrame) -> tuple[DataFrame, None]:
        has = lambda kind: F.max(F.col("_change") == kind)
        each = delta.groupBy("path").agg(has("insert").alias("i"), has("delete").alias("d"))
        return each.select("path", F.when(~F.col("d"), "added").when(~F.col("i"), "removed").otherwise("changed").alias("change")), None

    process_delta(source, target, work)  # what a run left that failed before its commit
    same_meta = old["size"].eqNullSafe(new["size"]) & old["mtime_ns"].eqNullSafe(new["mtime_ns"])
    same = F.when(new["file_hash"].isNull(), same_meta).otherwise(old["file_hash"].eqNullSafe(new["file_hash"]))
    source.sync(sighted_manifest(scans), same)
    process_delta(source, target, work)
    listed = target.changes(since)
    if listed is None:
        return spark.createDataFrame([], "path string, change string")
    return listed.where("_change = 'insert'").select("path", "change")
