"""Filling containers of fixed capacity with documents: refined harmonic packing over token lengths."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.operators.skew import materialize

#: Documents of one shard, which a worker packs by itself; lengths are matched on a grid of GRID steps of a unit, units are
#: as small as 1/SMALLEST of a container, and what is shorter than that fills containers in slots.
SHARD_ROWS, GRID, SMALLEST = 100_000, 128, 32
#: Targets are a parameter of the job; a longer table of them is refused, and no more of it is read.
MOST_TARGETS = 1_000


def ranks_of(path: str | None = None) -> tuple[dict[bytes, int], str]:
    """Pieces with their ranks, and the pattern of words, of a public tiktoken vocabulary."""
    spec = importlib.util.find_spec("public_tokenizers")
    if path is None:
        path = os.path.join(os.path.dirname(spec.origin) if spec else "/opt/tokenizers", "byte_bpe_multi_50k.tiktoken")
    pattern = importlib.import_module("public_tokenizers").PATTERN if spec else r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern


def token_lengths(documents: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(doc_id, tokens): tokens of the whole text of every document; 0 for an empty or null text.

    The vocabulary, about 1 MB, is read by the driver and sent to the tasks.
    """
    shared = documents.sparkSession.sparkContext.broadcast(ranks_of(path))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks, pattern = shared.value
        encode = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode.encode_ordinary(t)) for t in texts], pa.int64())], names=["doc_id", "tokens"])

    return documents.select(F.col(key).alias("doc_id"), "text").where("doc_id is not null").mapInArrow(scan, "doc_id bigint, tokens bigint")


def pieces(lengths: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, capacity, doc_id, part, start, tokens) of every document for every target.

    Only a document longer than the capacity is split, into full containers and one remainder. A document without tokens
    has no piece, nor has a target whose capacity is null or not positive. The targets are a short parameter table: they
    become an array in each row, so nothing is joined.
    """
    rows = targets.where("capacity_tokens > 0").select("target_id", F.col("capacity_tokens").cast("bigint").alias("c")).distinct().limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    if not rows:
        return lengths.selectExpr("cast(null as bigint) target_id", "cast(null as bigint) capacity", "doc_id", "0 part", "cast(0 as bigint) start", "tokens").limit(0)
    several = F.array(*[F.struct(F.lit(r["target_id"]).cast("bigint").alias("target_id"), F.lit(r["c"]).cast("bigint").alias("capacity")) for r in rows])
    each = lengths.where("tokens > 0").select("doc_id", F.col("tokens").alias("n"), F.explode(several).alias("t")).select("t.target_id", "t.capacity", "doc_id", "n")
    part = each.select("*", F.explode(F.sequence(F.lit(0), F.expr("cast((n - 1) div capacity as int)"))).alias("part"))
    return part.select("target_id", "capacity", "doc_id", "part", (F.col("part") * F.col("capacity")).alias("start"), F.least("capacity", F.expr("n - part * capacity")).alias("tokens"))


def _within(group: np.ndarray) -> np.ndarray:
    """Place of each element among the equal ones before it."""
    order = np.argsort(group, kind="stable")
    ranked = group[order]
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - np.searchsorted(ranked, ranked)
    return out


def harmonic(sizes: np.ndarray, capacity: int, refined: bool = True) -> np.ndarray:
    """Container number of each item; no item is longer than the capacity.

    Class k holds the items longer than capacity / (k + 1) and at most capacity / k, and exactly k of them fill a
    container. That alone leaves up to half of a container empty, so the classes are refined as Lee and Lee did: a unit is
    the 1/m of a container, m a power of two, and an item longer than half a unit shares it with one shorter
    item of the complementary length class, where both lie on a grid of GRID steps. m units of such pairs fill a container.
    Items without a partner fill containers of their class, k in each; those below 1/SMALLEST of a container
    come one after the other in slots that the last of them may overhang. Every kind of container has a fixed count of
    items, which follows from the lengths alone; only the last one of a kind may hold fewer.
    """
    sizes = np.asarray(sizes, np.int64)
    out = np.full(len(sizes), -1, np.int64)
    left, boxes = np.arange(len(sizes)), 0

    def place(items: np.ndarray, number: np.ndarray) -> None:
        nonlocal boxes
        if len(items):
            out[items] = boxes + number
            boxes = int(out[items].max()) + 1

    m = 1
    while refined and m <= SMALLEST and len(left):
        unit = capacity // m
        n = sizes[left]
        long, short = (2 * n > unit) & (n <= unit), (2 * n <= unit)
        step = np.where(long, (unit - n) * GRID // max(1, unit), -(-n * GRID // max(1, unit)))  # room of a long item, length of a short one
        pairs = np.minimum(np.bincount(step[long], minlength=GRID + 1), np.bincount(step[short], minlength=GRID + 1))
        before = np.cumsum(pairs) - pairs
        taken = np.zeros(len(left), bool)
        for side in (long, short):
            at = np.flatnonzero(side)
            rank = _within(step[at])
            chosen = rank < pairs[step[at]]
            taken[at[chosen]] = True
            out[left[at[chosen]]] = boxes + (before[step[at[chosen]]] + rank[chosen]) // m
        boxes += -(-int(pairs.sum()) // m)
        if m == 1:  # a long item without a partner has a container of its own
            alone = long & ~taken
            taken |= alone
            place(left[alone], np.arange(int(alone.sum())))
        left, m = left[~taken], 2 * m
    k = capacity // np.maximum(1, sizes[left])
    for c in np.unique(k[k < SMALLEST]):
        items = left[k == c]
        place(items, np.arange(len(items)) // c)
    tiny = left[k >= SMALLEST]
    if len(tiny):
        n = sizes[tiny]
        place(tiny, (np.cumsum(n) - n) // (capacity - int(n.max()) + 1))
    return out


def packed(documents: DataFrame, targets: DataFrame, path: str | None = None, shard_rows: int = SHARD_ROWS, refined: bool = True) -> DataFrame:
    """(target_id, doc_id, part, start, tokens, container): every piece of every document in a container of its target.

    A piece that fills a container is emitted where it is made. All others are spread by a hash over shards of about
    ``shard_rows`` documents; each is packed by itself, so workers are independent and hold the lengths of one shard only.
    A container is named by its piece, or by shard and number. Of rows with the same doc_id the longest is packed.
    ``refined`` is false for the plain classes of k items each.
    """
    lengths = materialize(token_lengths(documents, path).groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    shards = max(1, -(-lengths.count() // shard_rows))
    items = pieces(lengths, targets)
    columns = ["target_id", "doc_id", "part", "start", "tokens"]
    full = items.where("tokens = capacity").select(*columns, F.format_string("p%d-%d", "doc_id", "part").alias("container"))
    rest = items.where("tokens < capacity").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("bigint"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", kind="stable")
        boxes = harmonic(group["tokens"].to_numpy(), int(group["capacity"].iloc[0]), refined)
        shard = int(group["shard"].iloc[0])
        return group[columns].assign(container=[f"s{shard}-{b}" for b in boxes.tolist()])

    kind = "target_id bigint, doc_id bigint, part int, start bigint, tokens bigint, container string"
    return full.unionByName(rest.groupBy("target_id", "shard").applyInPandas(pack, kind))


def fill(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(method, target_id, capacity_tokens, containers, tokens, unused): how well the containers of every target are
    filled, by the refined classes of ``packed`` and by the plain ones."""
    caps = targets.select("target_id", "capacity_tokens").distinct()

    def of(method: str) -> DataFrame:
        done = packed(documents, targets, path, refined=method == "refined").groupBy("target_id").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
        unused = F.col("containers") * F.col("capacity_tokens") - F.col("tokens")
        return done.join(caps, "target_id").select(F.lit(method).alias("method"), "target_id", "capacity_tokens", "containers", "tokens", unused.alias("unused"))

    return of("refined").unionByName(of("plain"))
