"""Embedding near-duplicates through iterative quantisation and multi-index Hamming tables.

Equal vectors are one, with a count. Iterative quantisation (Gong and Lazebnik, 2011) learns rotations
of the centred unit vectors, on a bounded sample, that make their signs balanced and faithful binary
codes. Tables of bits drawn from the codes are the index: every vector is put in every table, vectors
in one bucket are compared by their whole codes, and what is near enough joins a group. Within groups,
all pairs are then reranked with the original vectors in double precision, in blocks; no pair of rows
is ever emitted.

The bits of a key grow with the logarithm of the rows, so that buckets stay small, and the number of
tables follows from them and from the recall wanted of pairs at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.buckets import bucket_edges, within
from cuemill.llm.components import components
from cuemill.llm.shared import keep

SAMPLE = 4096
ROTATIONS, ROUNDS = 4, 30
CODE_BITS = 256
RECALL = 0.97
#: Vectors of a group that one task compares with as many others.
BLOCK = 2048
#: Of the mean, as much is taken off as leaves this squared length on average: nearness survives that.
LEAST_SQUARE = 2 / 3
#: Vectors with copies that are broadcast, at about 50 bytes each; more are joined.
MOST_BROADCAST = 200_000


@dataclass
class Index:
    """Projections by number of components, and how codes become keys."""

    projections: dict[int, np.ndarray]
    centres: dict[int, np.ndarray]
    tables: np.ndarray  # tables by bits: places in the code
    most_bits: int

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Rows by four words of 64 bits."""
        d = vectors.shape[1]
        return np.packbits((vectors - self.centres[d]) @ self.projections[d] > 0, axis=1, bitorder="little").view(np.uint64)

    def keys(self, codes: np.ndarray, components: int) -> np.ndarray:
        """Rows by tables: 62-bit keys, the number of components in them."""
        bits = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little")
        power = np.int64(1) << np.arange(self.tables.shape[1], dtype=np.int64)
        own = bits[:, self.tables].astype(np.int64) @ power
        salt = (np.arange(len(self.tables), dtype=np.uint64) + np.uint64(1 + 1000 * components)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (own.astype(np.uint64) ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
        return ((mixed ^ mixed >> np.uint64(29)) >> np.uint64(1)).astype(np.int64)


def learn_rotation(x: np.ndarray, seed: int) -> np.ndarray:
    """Iterative quantisation: signs of the rotated vectors, then the rotation nearest to them."""
    start = np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1]))
    rotation = np.linalg.qr(start)[0]
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(x.T @ np.sign(x @ rotation))
        rotation = left @ right
    return rotation


def learn_projection(x: np.ndarray) -> np.ndarray:
    """As many rotations as the code has bits for, or the first bits of one."""
    d = x.shape[1]
    parts = [learn_rotation(x, seed) for seed in range(max(ROTATIONS, -(-CODE_BITS // d)))]
    return np.concatenate(parts, axis=1)[:, :CODE_BITS] if d <= CODE_BITS else parts[0][:, :CODE_BITS]


def plan_tables(rows: int, threshold: float, recall: float = RECALL) -> np.ndarray:
    """Bits of each table: about log2 of the rows each, and enough tables for pairs at the threshold."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(12, math.ceil(math.log2(max(2, rows)))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
    drawn = np.random.default_rng(bits)
    return np.stack([drawn.choice(CODE_BITS, bits, replace=False) for _ in range(tables)])


def _most_bits(threshold: float) -> int:
    """Differing bits of 256 at the threshold, and four deviations more."""
    differ = math.acos(threshold) / math.pi
    return math.ceil(CODE_BITS * differ + 4 * math.sqrt(CODE_BITS * differ * (1 - differ)))


def _matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None if x.as_py() is None or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if v is None or not len(v) or not np.isfinite(v).all() or not v.any():
            out.append(None)
        else:
            v = v / np.abs(v).max()
            out.append(v / np.sqrt(v @ v))
    return out


def _units(rows: DataFrame) -> DataFrame:
    """(uid, components, unit, same): rows (uid, embedding) that can link; same is a digest of the unit vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, v) for u, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1)), strict=True) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([u for u, _ in found], pa.int64()), pa.array([len(v) for _, v in found], pa.int32()), pa.array([v for _, v in found], pa.list_(pa.float64())), pa.array([md5((v + 0.0).tobytes(), usedforsecurity=False).digest() for _, v in found], pa.binary())],
                ["uid", "components", "unit", "same"],
            )

    return rows.select("uid", "embedding").mapInArrow(task, "uid long, components int, unit array<double>, same binary")


def learn_centre(x: np.ndarray) -> tuple[np.ndarray, float]:
    """What is taken off the unit vectors, and the mean squared length that is left of them."""
    mean = x.mean(axis=0)
    m = float(mean @ mean)
    share = 1.0 if 1 - m >= LEAST_SQUARE else 1 - math.sqrt(max(0.0, 1 - (1 - LEAST_SQUARE) / m))
    return share * mean, 1 - 2 * share * m + share * share * m


def learn_index(units: DataFrame, threshold: float, sample: int = SAMPLE) -> Index:
    """Centres and rotations for each number of components, from at most so many rows of it, drawn by hash; counts cover all rows.

    Vectors of a cosine c and squared length q after centring have a cosine of about 1 - (1 - c) / q.
    """
    counts = {r[0]: r[1] for r in units.groupBy("components").count().collect()}
    projections, centres, nearest = {}, {}, threshold
    for d, n in counts.items():
        share = min(1.0, sample / n)
        drawn = units.where((F.col("components") == d) & (F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < int(share * (1 << 30)))).limit(sample)
        x = np.array([r[0] for r in drawn.select("unit").collect()]).reshape(-1, d)
        x = x if len(x) else np.random.default_rng(d).normal(size=(1, d))
        centres[d], square = learn_centre(x) if n > d else (np.zeros(d), 1.0)
        projections[d] = learn_projection(x - centres[d])
        nearest = min(nearest, 1 - (1 - threshold) / square)
    return Index(projections, centres, plan_tables(sum(counts.values()), nearest), _most_bits(nearest))


def _keyed(units: DataFrame, index: Index) -> DataFrame:
    shared = units.sparkSession.sparkContext.broadcast(index)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            uids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for d in np.unique(sizes):
                rows = np.flatnonzero(sizes == d)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    x = np.stack([batch.column(2)[int(k)].values.to_numpy() for k in part])
                    codes = index.codes(x)
                    keys = index.keys(codes, int(d))
                    n = keys.shape[1]
                    spread = np.repeat(codes, n, axis=0).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(uids[part], n)), *[pa.array(spread[:, k]) for k in range(4)]], ["key", "id", "c0", "c1", "c2", "c3"])

    return units.select("uid", "components", "unit").mapInArrow(task, "key long, id long, c0 long, c1 long, c2 long, c3 long")


def _rerank(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(uid, n, root) for members (root, uid, components, unit, copies, blocks) of groups, block by block.

    n counts a member's links in a pair of blocks, with copies of the others, root is the smallest member that links there lead
    to. A group's members are dealt into blocks; each pair of blocks meets in one task.
    """
    own = F.pmod(F.xxhash64("uid", F.lit(3)), F.col("blocks")).cast("int")
    spread = members.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = spread.select(F.col("root").alias("key"), "components", "uid", "unit", "copies", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    marks = ["key", "components", "i", "j"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(mark: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            uid = np.concatenate([p.column("uid").to_numpy() for p in parts])
            own = np.concatenate([p.column("own").to_numpy() for p in parts])
            x = np.concatenate([p.column("unit").flatten().to_numpy().reshape(p.num_rows, -1) for p in parts])
            order = np.argsort(uid, kind="stable")
            copies = np.concatenate([p.column("copies").to_numpy() for p in parts])
            uid, own, x, copies = uid[order], own[order], x[order], copies[order]
            count, root = np.zeros(len(uid), np.int64), np.arange(len(uid))
            a = np.flatnonzero(own == mark[2])
            b = a if mark[2] == mark[3] else np.flatnonzero(own == mark[3])
            linked = x[a] @ x[b].T >= threshold
            if mark[2] == mark[3]:
                np.fill_diagonal(linked, False)
                count[a] = linked @ copies[a]
            else:
                count[a], count[b] = linked @ copies[b], copies[a] @ linked
            root = _roots(a, b, linked, len(uid))
            on = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(uid[on]), pa.array(count[on]), pa.array(uid[root[on]])], ["uid", "n", "root"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            here = list(zip(*[batch.column(m).to_pylist() for m in marks], strict=True))
            start = 0
            for at in range(1, len(here) + 1):
                if at == len(here) or here[at] != here[start]:
                    if held and here[start] != last:
                        yield done(last, held)
                        held = []
                    held.append(batch.slice(start, at - start))
                    last, start = here[start], at
        if held:
            yield done(last, held)

    return dealt.repartition(*marks).sortWithinPartitions(*marks).mapInArrow(task, "uid long, n long, root long")


def _roots(a: np.ndarray, b: np.ndarray, linked: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that links between places a and b lead to, for each of n places."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.where(linked, root[b][None, :], n).min(axis=1, initial=n)
        np.minimum.at(new, a, low)
        high = np.where(linked, new[a][:, None], n).min(axis=0, initial=n)
        np.minimum.at(new, b, high)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def near_duplicates(table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Links join rows whose vectors have a cosine of at least the threshold; a vector that is null,
    empty or zero, or has a null or non-finite component, links with nothing, as do vectors of different length.
    Repeated rows are rows of their own and link; component_id is the smallest vec_id reached, a null
    one never being the smallest. An empty table gives no rows.
    """
    rows = keep(table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].alias("embedding")).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    all_units = keep(_units(rows), "unit-vectors")
    same = keep(all_units.groupBy("same").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "equal-vectors")
    if same.count() <= MOST_BROADCAST:
        same = F.broadcast(same)
    marked = all_units.join(same, "same", "left")
    alone = F.col("rep").isNull() | (F.col("rep") == F.col("uid"))
    units = keep(marked.where(alone).select("uid", "components", "unit", F.coalesce("copies", F.lit(1)).cast("long").alias("copies")), "distinct-vectors")
    index = learn_index(units, threshold, sample)
    groups = keep(components(bucket_edges(_keyed(units, index), ["c0", "c1", "c2", "c3"], within(index.most_bits))), "vector-groups")
    sizes = groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = groups.join(sizes, "root").withColumnRenamed("node", "uid").join(units, "uid")
    found = keep(_rerank(members, threshold, block), "vector-links")
    counts = found.groupBy(F.col("uid").alias("rep")).agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    stands_for = marked.where("copies > 1").select("uid", F.col("rep").alias("of"), "copies")
    own = rows.select("uid", "vec_id").join(stands_for, "uid", "left").select("vec_id", F.coalesce("of", "uid").alias("rep"), F.coalesce(F.col("copies") - 1, F.lit(0)).alias("equal"))
    named = own.join(counts, "rep", "left").join(linked, "rep", "left").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("equal")).alias("n"), F.coalesce("root", "rep").alias("root"))
    firsts = named.where("n > 0").groupBy("root").agg(F.min("vec_id").alias("first"))
    out = named.join(firsts, "root", "left").select("vec_id", F.col("n").cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
