"""Shared folders, materialising intermediate results, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A key is hot if it has at least HOT_ROWS rows and is among the HOT_KEYS most frequent. Any other key has fewer rows,
#: or less than 1/HOT_KEYS of all rows, which is no more than a fair share of a task on a cluster of so many cores.
HOT_KEYS, HOT_ROWS = 10_000, 20_000

_cleared: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session on storage that all executors share, removed when the session ends.

    It lies below ``spark.checkpoint.dir``. Where the session names none, a local session takes a temporary folder and a
    cluster the home folder of its default file system; a cluster whose default is the machine's own disk is refused.
    """
    sc = spark.sparkContext
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="stanzaflow-")
            hadoop.Path(folder).getFileSystem(conf).deleteOnExit(hadoop.Path(folder))
        elif not folder:
            fs = hadoop.FileSystem.get(conf)
            if fs.getUri().getScheme() == "file":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = f"{fs.getHomeDirectory()}/.stanzaflow"
        sc.setCheckpointDir(folder)
    own = sc.getCheckpointDir()
    if own not in _cleared:
        hadoop.Path(own).getFileSystem(conf).deleteOnExit(hadoop.Path(own))
        _cleared.add(own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def hot_keys(df: DataFrame, key: str, rows: int = HOT_ROWS, most: int = HOT_KEYS) -> list:
    """The ``most`` most frequent values of ``key`` that have at least ``rows`` rows.

    Any other key holds less than ``rows`` rows or less than 1/most of all rows. Counts are combined before the
    shuffle, so a hot key costs one partial row per task.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return hottest(counts, rows, most)


def hottest(counts: DataFrame, rows: int = HOT_ROWS, most: int = HOT_KEYS) -> list:
    """Hot keys of counted keys (k, n)."""
    return [r["k"] for r in counts.where(F.col("n") >= rows).orderBy(F.desc("n")).limit(most).select("k").collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join ``left`` with ``right``, which has one row per ``key``; a hot key of ``left`` never lands in one task.

    Rows of hot keys meet a broadcast of their right rows, at most HOT_KEYS of them; all others are shuffled. ``hot``
    gives the hot keys where the caller knows them, at most HOT_KEYS. ``how`` is inner or left. Null keys match nothing
    and are kept by a left join without being shuffled.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if len(hot) > HOT_KEYS:
        raise ValueError(f"more than {HOT_KEYS} hot keys")
    rest, parts = left.where(F.col(key).isNotNull()), []
    if hot:
        kind = StructType([StructField(key, left.schema[key].dataType)])
        known = F.broadcast(left.sparkSession.createDataFrame([(k,) for k in hot], kind))
        few = F.broadcast(right.join(known, key, "left_semi"))
        parts.append((rest.join(known, key, "left_semi") if how == "left" else rest).join(few, key, how))
        rest = rest.join(known, key, "left_anti")
    parts.append(rest.join(right, key, how))
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
        parts.append(left.where(F.col(key).isNull()).select(*[F.col(c) for c in [key, *(x for x in left.columns if x != key)]], *missing))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pair_join(pairs: DataFrame, right_a: DataFrame, right_b: DataFrame) -> DataFrame:
    """Pairs (a, b) joined with one row per ``a`` and one per ``b``; an end that is in very many pairs is met by a broadcast.

    The hot ends of both sides are counted in one job.
    """
    ends = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("a").alias("k")), F.struct(F.lit(1).alias("s"), F.col("b").alias("k")))).alias("e"))
    counts = ends.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS)
    hot = [r["e"] for r in counts.collect()]
    both = skew_join(pairs, right_a, "a", hot=[e["k"] for e in hot if e["s"] == 0 and e["k"] is not None])
    return skew_join(both, right_b, "b", hot=[e["k"] for e in hot if e["s"] == 1 and e["k"] is not None])


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later expressions use several times, evaluated once per row.

    A generator keeps the optimizer from copying the expression into each of its uses. A column of that name is replaced.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
