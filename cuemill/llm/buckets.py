"""Links inside buckets: rows that share a key are compared in blocks, in numpy.

Each bucket gives a spanning forest of its links, never its pairs. A bucket of more than ``block``
rows is dealt into blocks, and each pair of blocks is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import keep

BLOCK = 1024

#: From two arrays of codes (n and m by words of 64 bits), which of n by m pairs link.
Linked = Callable[[np.ndarray, np.ndarray], np.ndarray]


def within(bits: int) -> Linked:
    """Codes that differ in at most so many bits."""

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differing = np.zeros((len(a), len(b)), np.uint16)
        for k in range(a.shape[1]):
            differing += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
        return differing <= bits

    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """For a square symmetric matrix of links, the smallest member of each row's component."""
    root = np.arange(len(linked))
    left = np.ones(len(linked), bool)
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], front = False, np.array([start])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            root[front] = start
    return root


def _edges(ids: np.ndarray, codes: np.ndarray, linked: Linked) -> tuple[np.ndarray, np.ndarray]:
    root = forest(linked(codes, codes))
    other = np.flatnonzero(root != np.arange(len(root)))
    return ids[root[other]], ids[other]


def _arrays(batch: pa.RecordBatch, codes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    return column("key"), column("id"), np.stack([column(c).view(np.uint64) for c in codes], axis=1)


def bucket_edges(rows: DataFrame, codes: list[str], linked: Linked, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join what links within buckets.

    rows: key, id and the named code columns, all long and never null. An id may have many keys.
    """
    rows = rows.select("key", "id", *codes)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of key. Buckets beyond a block go out as they came, with kind 1."""

        def made(kind: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array(c[:, k].view(np.int64)) for k in range(len(codes))]], names)

        names = ["kind", "a", "b", *codes]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, large, hot_key = 0, False, None

        def flush() -> Iterator[pa.RecordBatch]:
            """The end of the held bucket, or of a part of it."""
            if held and (large or size > block):
                for key, ids, own in held:
                    yield made(1, key, ids, own)
            elif size > 1:
                a, b = _edges(np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held]), linked)
                if len(a):
                    yield made(0, a, b, np.zeros((len(a), len(codes)), np.uint64))

        for batch in batches:
            key, ids, own = _arrays(batch, codes)
            cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            if not len(key):
                continue
            sizes = np.diff(cuts)
            inner = sizes[1:-1]
            pairs = cuts[1:-2][inner == 2]
            if len(pairs):  # buckets of two are the most, and are done together
                hit = pairs[_pairwise(own[pairs], own[pairs + 1], linked)]
                if len(hit):
                    yield made(0, ids[hit], ids[hit + 1], np.zeros((len(hit), len(codes)), np.uint64))
            for k in range(len(sizes)):
                if 0 < k < len(sizes) - 1 and sizes[k] < 3:
                    continue
                part = slice(cuts[k], cuts[k + 1])
                if (held and held[-1][0][-1] != key[cuts[k]]) or (large and hot_key != key[cuts[k]]):
                    yield from flush()
                    held, size, large = [], 0, False
                held.append((key[part], ids[part], own[part]))
                size += sizes[k]
                if large or size > block:
                    large = True
                    yield from flush()
                    held, size = [], 0
                    hot_key = key[cuts[k]]
        yield from flush()

    schema = "kind int, a long, b long, " + ", ".join(f"{c} long" for c in codes)
    first = keep(rows.repartition("key").sortWithinPartitions("key").mapInArrow(small, schema), "buckets")
    found = first.where("kind = 0").select("a", "b").distinct()
    hot = first.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("id"), *codes)
    sizes = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return found
    return found.union(block_edges(hot.join(sizes, "key"), codes, linked)).distinct()


def _pairwise(a: np.ndarray, b: np.ndarray, linked: Linked) -> np.ndarray:
    step = 64
    return np.concatenate([linked(a[k : k + step], b[k : k + step]).diagonal() for k in range(0, len(a), step)])


def block_edges(rows: DataFrame, codes: list[str], linked: Linked) -> DataFrame:
    """Edges of buckets dealt into blocks: rows also have blocks, the number of their bucket's blocks."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    dealt = rows.withColumn("own", own).select("*", other).select("key", "id", *codes, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                all_of = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                _, ids, own = _arrays(all_of, codes)
                a, b = _edges(ids, own, linked)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = list(zip(*[batch.column(x).to_pylist() for x in ("key", "i", "j")], strict=True))
            start = 0
            for at in range(1, len(marks) + 1):
                if at == len(marks) or marks[at] != marks[start]:
                    if last is not None and marks[start] != last:
                        yield from done(held)
                        held = []
                    held.append(batch.slice(start, at - start))
                    last, start = marks[start], at
        yield from done(held)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(pair, "a long, b long")
