"""Differences of versions, and processing that happens exactly once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import changes as C

T0 = dt.datetime(2024, 5, 4, 11, 0)
SCAN = "scan_id bigint, path string, file_hash string, size bigint, mtime_ns bigint, scanned_at timestamp, status string"
JOURNAL = "path string, file_hash string, size bigint, mtime_ns bigint, last_seen_run string, updated_at string, status string"
RUNS = "run_id string, status string"


def test_file_changes(spark):
    m = dt.timedelta(minutes=1)
    scans = spark.createDataFrame(
        [
            (1, "new", "h", 1, 1, T0, "x"), (2, "same", "h", 1, 1, T0, "x"), (3, "same", "old", 1, 1, T0 - m, "x"), (4, "hash", "h2", 1, 1, T0, "x"), (5, "touched", None, 1, 2, T0, "x"), (6, "kept", None, 1, 1, T0, "x"),
            (7, "failed", "h", 1, 1, T0, "x"), (8, "tie", "h", 1, 1, T0, "x"), (9, "tie", "h9", 1, 1, T0, "x"), (10, None, "h", 1, 1, T0, "x"), (11, "nullrec", "h", 1, 1, T0, "x"), (2, "same", "h", 1, 1, T0, "x"),
        ],
        SCAN,
    )
    journal = spark.createDataFrame(
        [
            ("same", "h", 1, 1, "r1", "2024-03-01T00:00:00", "y"), ("hash", "h", 1, 1, "r1", "2024-03-01T00:00:00", "y"), ("hash", "h2", 1, 1, "bad", "2024-04-01T00:00:00", "y"), ("touched", "h", 1, 1, "r1", "2024-03-01T00:00:00", "y"),
            ("kept", "h", 1, 1, "r1", "2024-03-01T00:00:00", "y"), ("failed", "h", 1, 1, "bad", "2024-03-01T00:00:00", "y"), ("gone", "h", 1, 1, "r1", "2024-03-01T00:00:00", "y"), ("tie", "h", 1, 1, "r1", "2024-03-01T00:00:00", "y"),
            ("nullrec", None, 1, 1, "r1", None, "y"), ("same", "older", 1, 1, "r1", "2024-01-01T00:00:00", "y"), ("new", "h", 1, 1, "unknown", "2024-03-01T00:00:00", "y"),
        ],
        JOURNAL,
    )
    runs = spark.createDataFrame([("r1", "ok"), ("bad", "failed"), ("r1", "ok")], RUNS)
    got = dict(map(tuple, C.file_changes(scans, journal, runs).collect()))
    assert got == {"new": "added", "hash": "changed", "touched": "changed", "failed": "added", "gone": "removed", "tie": "changed", "nullrec": "changed"}
    assert C.file_changes(scans.limit(0), journal.limit(0), runs).count() == 0


def test_versions_deltas_and_deletion_vectors(spark, tmp_path):
    t = C.VersionedTable(spark, str(tmp_path / "t"), "id")
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, v string")
    assert t.version() == 0 and t.read() is None
    t.commit(rows((1, "a"), (2, "b"), (3, "c")))
    t.commit(rows((2, "B"), (4, "d")), deleted_keys=rows((2, ""), (3, "")))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "B"), (4, "d")]
    assert sorted(map(tuple, t.read(1).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    delta = sorted((r._change, r.id, r.v) for r in t.changes(1, 2).collect())
    assert delta == [("delete", 2, "b"), ("delete", 3, "c"), ("insert", 2, "B"), ("insert", 4, "d")]
    assert t.changes(2, 2) is None
    t.commit(deleted_keys=rows((4, ""), (99, "")))
    assert sorted((r._change, r.id) for r in t.changes(2, 3).collect()) == [("delete", 4)]


def test_each_change_is_processed_once(spark, tmp_path):
    source, target = (C.VersionedTable(spark, str(tmp_path / n), "id") for n in ("s", "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, v string")
    seen = []

    def transform(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df

    source.commit(rows((1, "a"), (2, "b")))
    assert C.process_changes(source, target, transform) == 1
    source.commit(rows((2, "B"), (3, "c")), deleted_keys=rows((2, ""), (1, "")))

    def broken(df):
        raise OSError("executor lost")

    with pytest.raises(OSError):
        C.process_changes(source, target, broken)
    assert sorted(map(tuple, target.read().collect())) == [(1, "a"), (2, "b")]
    assert C.process_changes(source, target, transform) == 1
    assert C.process_changes(source, target, transform) == 0
    assert seen == [[1, 2], [2, 3]]
    assert sorted(map(tuple, target.read().collect())) == [(2, "B"), (3, "c")]


def test_two_writers_cannot_both_commit(spark, tmp_path):
    t = C.VersionedTable(spark, str(tmp_path / "t"), "id")
    t.commit(spark.createDataFrame([(1,)], "id bigint"))
    with pytest.raises(RuntimeError):
        t._commit(0)
    assert t.version() == 1


def test_commits_follow_the_change(spark, tmp_path, monkeypatch):
    t = C.VersionedTable(spark, str(tmp_path / "t"), "id")
    df = spark.range(200).select(F.col("id"), F.lit("x").alias("v"), F.lit(1).alias("n"))
    t.commit(df.unionByName(spark.createDataFrame([(None, "null", 1)], "id bigint, v string, n int")))
    first = set(t.state()["files"])
    for k in range(3):
        t.commit(deleted_keys=spark.createDataFrame([(k,)], "id bigint"))
    t.commit(spark.createDataFrame([(7, "new", 2), (None, "fresh", 2)], "id bigint, v string, n int"), replace=True)
    assert first < set(t.state()["files"])  # no file is rewritten
    assert t.read().count() == 198 and [r.v for r in t.read().where("id is null").collect()] == ["fresh"]
    opened = []
    rows = t._rows
    monkeypatch.setattr(t, "_rows", lambda files: opened.extend(files) or rows(files))
    t.commit(deleted_keys=spark.createDataFrame([(9,)], "id bigint"))
    assert 0 < len([f for f in opened if f in first]) < len(first)
    opened.clear()
    assert [(r._change, r.id) for r in t.changes(5, 6).collect()] == [("delete", 9)]
    assert len(opened) == 1
    assert t.changes(6, 6) is None and t.read(1).count() == 201


def test_snapshots_hold_the_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 3)
    t = C.VersionedTable(spark, str(tmp_path / "t"), "id")
    for k in range(7):
        t.commit(spark.createDataFrame([(k % 4, k)], "id bigint, v int"), replace=True, properties={"k": k})
    assert sorted(map(tuple, t.read().collect())) == [(0, 4), (1, 5), (2, 6), (3, 3)]
    assert sorted(map(tuple, t.read(3).collect())) == [(0, 0), (1, 1), (2, 2)]
    assert t.properties() == {"k": 6} and t.state(3)["properties"] == {"k": 2}


@pytest.mark.parametrize("broken", ["sync", "_write", "_commit"])
def test_file_changes_survive_failures(spark, tmp_path, monkeypatch, broken):
    m = dt.timedelta(minutes=1)
    scans = spark.createDataFrame([(1, "a", "h", 1, 1, T0, "x"), (2, "b", "new", 1, 1, T0, "x"), (3, "c", "h", 1, 1, T0, "x")], SCAN)
    journal = spark.createDataFrame([(p, "h", 1, 1, "r1", "2024-03-01T00:00:00", "y") for p in "abd"], JOURNAL)
    runs = spark.createDataFrame([("r1", "ok")], RUNS)
    folder, calls, real = str(tmp_path / "f"), [], getattr(C.VersionedTable, broken)

    def fails(self, *args, **kw):
        calls.append(1)
        if len(calls) == {"sync": 1, "_write": 3, "_commit": 4}[broken]:
            raise OSError("driver lost")
        return real(self, *args, **kw)

    monkeypatch.setattr(C.VersionedTable, broken, fails)
    with pytest.raises(OSError):
        C.file_changes(scans, journal, runs, folder)
    assert sorted(map(tuple, C.file_changes(scans, journal, runs, folder).collect())) == [("b", "changed"), ("c", "added"), ("d", "removed")]
    assert C.file_changes(scans, journal, runs, folder).count() == 0  # nothing is done twice
    later = scans.unionByName(spark.createDataFrame([(4, "a", "h3", 1, 1, T0 + m, "x")], SCAN))
    assert [tuple(r) for r in C.file_changes(later, journal, runs, folder).collect()] == [("a", "changed")]
