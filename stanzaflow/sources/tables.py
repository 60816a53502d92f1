"""Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer bytes is read as it lies, and so is one of more files, whose footers are not looked at.
LEAST_BYTES, MOST_FILES = 2 << 20, 64


def row_groups(spark: SparkSession, path: str, enough: int) -> tuple[int, int]:
    """Row groups, at most about ``enough`` of them counted, and bytes of a parquet file or folder.

    A row group is what a task can read by itself. Only footers of a few files are read.
    """
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    listed = hadoop.getFileSystem(conf).listFiles(hadoop, True)
    files, size = [], 0
    while listed.hasNext():
        f = listed.next()
        if f.getPath().getName()[0] not in "._":
            files.append(f.getPath())
            size += f.getLen()
            if len(files) >= min(enough, MOST_FILES):
                return enough, size
    groups = 0
    for f in files if size >= LEAST_BYTES else []:
        reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f, conf))
        try:
            groups += reader.getRowGroups().size()
        finally:
            reader.close()
    return groups, size


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name``, a parquet file or folder below ``sf_dir``.

    One with fewer row groups than the session has cores is spread over the cores, since most of them could read none of
    it. That is a shuffle of a small table; a large one has row groups enough and is read where it lies.
    """
    path = f"{sf_dir}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    groups, size = row_groups(spark, path, cores)
    return df.repartition(cores) if groups < cores and size >= LEAST_BYTES else df
