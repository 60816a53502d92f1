"""Evaluation texts leaking into training text: a prefix-filtered set join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanzaflow.llm.tables import word_hashes
from stanzaflow.operators.skew import scratch

SHINGLE = 5
WINDOW = 20
#: One word in so many may be replaced.
ONE_IN = 10
#: Items are taken in blocks of at most so many words: 16 MB of hashes, the most that is sent to a task at once.
BLOCK_WORDS = 2_000_000
#: Matches and aligned words that are looked at side by side: what a task holds beside its batch.
AT_ONCE = 1 << 20

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """One hash for each run of SHINGLE words; none for fewer words."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = words.astype(np.uint64, copy=False)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        x = w[k : k + n] * _MIX[k]
        out = (out ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def least_shared(window: int = WINDOW, one_in: int = ONE_IN, shingle: int = SHINGLE) -> int:
    """Shingles that a window must share at the least: each replaced word spoils at most ``shingle`` of them."""
    return max(1, window - shingle + 1 - shingle * (window // one_in))


def prefix_positions(tokens: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of an item's shingles that are in the prefix of any of its windows.

    Of the n shingles of a window at least m must occur in a document that contains it, so one of the n - m + 1 rarest
    must; ``rank`` orders all shingles by rarity. Whatever the order, at least (n - m + 1) / n of them are in it, 11 of 16.
    """
    n = WINDOW - SHINGLE + 1
    if len(tokens) < n:
        return np.empty(0, np.int64)
    keep = n - least_shared() + 1
    view = np.lib.stride_tricks.sliding_window_view(rank, n)
    rarest = np.argsort(view, axis=1, kind="stable")[:, :keep] + np.arange(len(view))[:, None]
    return np.unique(rarest)


def holding(equal: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of several rows of aligned words, one after the other in ``equal``, those with a run of at least WINDOW words of
    which at most one in ONE_IN differs. No row is empty."""
    far = len(equal) * ONE_IN + 1
    case = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    score = np.cumsum(np.where(equal, 1, 1 - ONE_IN)) - case * far  # the least score of a row is below that of all before it
    before = score - np.where(equal, 1, 1 - ONE_IN)
    least = np.minimum.accumulate(before)
    at = np.arange(len(equal))
    ok = at - (WINDOW - 1) >= (ends - sizes)[case]
    good = at[ok][score[ok] >= least[at[ok] - (WINDOW - 1)]]
    out = np.zeros(len(sizes), bool)
    out[case[good]] = True
    return out


def _documents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, offsets and all word hashes of a batch, without copying words one by one."""
    lists = batch.column(1)
    return batch.column(0).to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def count_shingles(docs: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often each wanted shingle (sorted hashes) occurs over all documents; batches are combined before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            _, off, words = _documents(b)
            s = shingles(words[off[0] : off[-1]])
            ends = off[1:-1] - off[0]
            ok = np.ones(len(s), bool)
            for k in range(1, SHINGLE):  # no shingle reaches over the end of a document
                e = ends - k
                ok[e[(e >= 0) & (e < len(s))]] = False
            at = np.searchsorted(wanted, s)
            at[at == len(wanted)] = 0
            hit = ok & (wanted[at] == s)
            total += np.bincount(at[hit], minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["k", "n"])

    counted = docs.mapInArrow(partial, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    return {r["k"]: r["n"] for r in counted.collect()}  # at most one row per shingle of the block


def find_leaks(docs: DataFrame, items: list[tuple[int, np.ndarray]]) -> DataFrame:
    """(doc_id, item_id) of one block of items against all documents (doc_id, words)."""
    grams = [shingles(w) for _, w in items]
    wanted = np.unique(np.concatenate([*grams, np.empty(0, np.uint64)]))
    if not len(wanted):
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id")).limit(0)
    often = count_shingles(docs, wanted)
    freq = np.array([often.get(k, 0) for k in range(len(wanted))], np.int64)
    rank = np.empty(len(wanted), np.int64)
    rank[np.lexsort((wanted, freq))] = np.arange(len(wanted))  # the rarest first
    token, item, place = [], [], []
    for k, g in enumerate(grams):
        if len(g):
            p = prefix_positions(g, rank[np.searchsorted(wanted, g)])
            token.append(g[p])
            item.append(np.full(len(p), k, np.int64))
            place.append(p.astype(np.int64))
    if not token:
        return docs.select("doc_id", F.lit(0).cast("bigint").alias("item_id")).limit(0)
    token, item, place = np.concatenate(token), np.concatenate(item), np.concatenate(place)
    order = np.argsort(token, kind="stable")
    token, item, place = token[order], item[order], place[order]
    first, start = np.unique(token, return_index=True)
    count = np.diff(np.append(start, len(token)))
    ids = np.array([i for i, _ in items], np.int64)
    lengths = np.array([len(w) for _, w in items], np.int64)
    words_of, begin = np.concatenate([w for _, w in items]), np.cumsum(lengths) - lengths

    def verified(words: np.ndarray, off: np.ndarray, doc: np.ndarray, it: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """Which candidates hold: their words side by side, AT_ONCE of them at a time."""
        lo = np.maximum(0, -shift)
        size = np.minimum(lengths[it], off[doc + 1] - off[doc] - shift) - lo
        out, done, total = np.zeros(len(doc), bool), 0, np.cumsum(size)
        while done < len(doc):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE, side="right")))
            d, k, n, a = doc[done:upto], it[done:upto], size[done:upto], lo[done:upto]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left = words_of[np.repeat(begin[k] + a, n) + inner]
            right = words[np.repeat(off[d] + a + shift[done:upto], n) + inner]
            out[done:upto] = holding(left == right, n)
            done = upto
        return out

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids, off, words = _documents(b)
            base = off[0]
            s = shingles(words[base : off[-1]])
            at = np.searchsorted(first, s)
            at[at == len(first)] = 0
            pos = np.flatnonzero(first[at] == s)
            doc = np.searchsorted(off - base, pos, side="right") - 1
            inside = pos + SHINGLE <= off[doc + 1] - base
            long = off[doc + 1] - off[doc] >= WINDOW
            pos, doc = pos[inside & long], doc[inside & long]
            n, done, ends = count[at[pos]], 0, np.cumsum(count[at[pos]])
            parts = [np.empty((3, 0), np.int64)]
            while done < len(pos):  # a passage that many items share multiplies its matches
                upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + AT_ONCE, side="right")))
                m, p = n[done:upto], pos[done:upto]
                which = np.repeat(start[at[p]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                p, d = np.repeat(p, m), np.repeat(doc[done:upto], m)
                it, shift = item[which], p - (off[d] - base) - place[which]
                # positional bound: the overlap of item and document at this shift must hold a window
                overlap = np.minimum(off[d + 1] - off[d] - shift, lengths[it]) - np.maximum(-shift, 0)
                parts.append(np.unique(np.stack([d, it, shift])[:, overlap >= WINDOW], axis=1))
                done = upto
            cases = np.unique(np.concatenate(parts, axis=1), axis=1)
            found = np.unique(cases[:2, verified(words, off, *cases)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids[found[0]].astype(np.int64)), pa.array(ids[found[1]])], names=["doc_id", "item_id"])

    return docs.mapInArrow(search, "doc_id bigint, item_id bigint")


def leaked_items(documents: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id): the document contains at least 20 consecutive words of the item, at most one in ten replaced.

    The held-out items are the query set and meet all documents in blocks of at most ``block_words`` words. Within a
    block their shingles are ordered by rarity in the whole corpus, only those in the prefix of a 20-word window are
    joined, length and position bound the candidates, and every candidate is verified word by word along its shift.
    Items and documents of fewer than 20 words, empty ones and nulls have no rows; repeated rows give one. Texts are cleaned
    and hashed once, into a table in the shared folder, however many blocks there are.
    """
    spark, stored = documents.sparkSession, scratch(documents.sparkSession, "words")
    documents.where("doc_id is not null").select("doc_id", word_hashes(F.col("text")).alias("words")).write.parquet(stored)
    docs = spark.read.parquet(stored)
    query = items.where("item_id is not null").select("item_id", word_hashes(F.col("text")).alias("words")).where(F.size("words") >= WINDOW).distinct()
    found: list[DataFrame] = []
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in query.toLocalIterator():
        w = np.array(r["words"], np.int64).view(np.uint64)
        if block and size + len(w) > block_words:
            found.append(find_leaks(docs, block))
            block, size = [], 0
        block.append((r["item_id"], w))
        size += len(w)
    found.append(find_leaks(docs, block))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()
