"""The stream of files, and batches that are delivered twice."""

from stanzaflow.operators.changes import VersionedTable
from stanzaflow.streaming.incremental import file_stream, upsert_batches


def test_stream_upserts(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    rows = lambda *x: spark.createDataFrame(list(x), "id bigint, v string")
    table = VersionedTable(spark, str(tmp_path / "t"), "id")
    rows((1, "a"), (2, "b"), (2, "b"), (None, "x")).write.parquet(source)
    upsert_batches(file_stream(spark, source, "id bigint, v string"), table, check).awaitTermination()
    rows((2, "B"), (3, "c")).write.mode("append").parquet(source)
    upsert_batches(file_stream(spark, source, "id bigint, v string"), table, check).awaitTermination()
    want = [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, table.read().collect())) == want
    before = table.version()
    upsert_batches(file_stream(spark, source, "id bigint, v string"), table, check).awaitTermination()
    assert table.version() == before and sorted(map(tuple, table.read().collect())) == want
