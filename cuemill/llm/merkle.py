"""A Merkle manifest of a dataset: every row's digest, and the proof that ties it to one root.

Rows are leaves of a binary tree of their group, and the groups' roots are leaves of a tree above
them. Leaves are numbered by a range partition and dealt into aligned blocks; each block hashes its
own subtree. Then blocks swap subtree roots in a butterfly: in round r, blocks whose numbers differ
in their r-th digit alone meet, and each of them hashes the same ancestors by itself. After the last
round every block holds all upper siblings of its leaves and the root; nothing is handed down again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.llm.shared import keep

#: Nodes under a node, leaves of a block, and the tree's levels that a round climbs: so many that 16 blocks meet.
FANOUT, BLOCK_LEVELS, ROUND_LEVELS = 2, 8, 4
MEET = FANOUT**ROUND_LEVELS
#: Rows of a table that is counted and sent to all tasks, else joined.
MOST_BROADCAST = 100_000
DIGEST = 64


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts, one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else how many bytes of UTF-8 it has, a colon, and itself; whole numbers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """A leaf: the digest of a row's encoded values."""
    return digest(*map(encoded, values))


def _small(frame: DataFrame) -> DataFrame:
    """To be broadcast if it is counted to be small."""
    return F.broadcast(frame) if frame.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else frame


def numbered(leaves: DataFrame) -> DataFrame:
    """Adds position, from 0 in each group, and size, its number of leaves, to (group, order, leaf, ...), written to the shared folder.

    Rows are range partitioned, so a group of any size is spread over tasks; its rows of each task are
    counted, and the counts of the tasks before are added.
    """
    order = ["group", "order", "leaf"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ranged = keep(ranged.withColumn("at", at).withColumn("part", F.shiftright("at", 33).cast("int")), "leaves")
    runs = ranged.groupBy("group", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # A group has at most one run for each task.
    totals = runs.groupBy(F.col("group").alias("g")).agg(F.sort_array(F.collect_list(F.struct("part", "first", "n"))).alias("runs"), F.sum("n").alias("size"))
    before = lambda k: F.aggregate(F.slice("runs", 1, k), F.lit(0).cast("long"), lambda a, r: a + r["n"])
    placed = totals.select("g", "size", F.explode(F.transform("runs", lambda r, k: F.struct(r["part"].alias("p"), (r["first"] - before(k)).alias("shift")))).alias("r")).select("g", "size", "r.*")
    found = ranged.join(_small(keep(placed, "runs")), F.col("group").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return found.withColumn("position", F.col("at") - F.col("shift")).drop("g", "p", "part", "at", "shift")


def lifted(nodes: list[str]) -> list[str]:
    """The level above; the last run may be shorter."""
    return [hashlib.sha256("".join(nodes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(nodes), FANOUT)]


def levels_of(nodes: list[str], least: int) -> list[list[str]]:
    """All levels up to a single node, or up to so many beyond the first if there are other blocks."""
    levels = [nodes]
    while len(levels) <= least if least else len(levels[-1]) > 1:
        levels.append(lifted(levels[-1]))
    return levels


def _height(size: Column) -> Column:
    """How often a level of so many nodes is lifted until one is left."""
    return F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)


def _blocks(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """(group, block, size, rows): a row for each aligned block, with its leaves in order."""
    row = F.struct("position", "order", "leaf", *carried)
    return leaves.groupBy("group", F.shiftright("position", BLOCK_LEVELS).alias("block"), "size").agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _least(size: int) -> int:
    """Levels that a block of a group of so many leaves has in any case."""
    return BLOCK_LEVELS if size > 1 << BLOCK_LEVELS else 0


def _block_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("size").to_pylist()
        roots = [levels_of(leaves, _least(size))[-1][0] for leaves, size in zip(batch.column("leaves").to_pylist(), sizes, strict=True)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("group", "block", "size")], pa.array(roots, pa.string())], ["group", "block", "size", "root"])


def _lift(nodes: Column) -> Column:
    """`lifted` of an array of at most MEET nodes."""
    pair = lambda i: digest(F.get(nodes, i * FANOUT), *[F.coalesce(F.get(nodes, i * FANOUT + k), F.lit("")) for k in range(1, FANOUT)])
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1), pair)


def _swap(state: DataFrame, span: int) -> DataFrame:
    """One round: blocks (group, block, of, root, above) learn the roots of the MEET subtrees of `span` blocks beside their own.

    The last subtree of a group may have fewer blocks than the others; each of its blocks stands in
    for those that are not there, so that all have someone to meet.
    """
    subtrees = F.ceil(F.col("of") / span).cast("long")
    mine = F.floor(F.col("block") / span)
    own = state.withColumn("digit", (mine % MEET).cast("int")).withColumn("low", F.col("block") % span)
    there = F.col("of") - (subtrees - 1) * span
    alone = (mine < subtrees - 1) | (there == span) | (mine % MEET == 0)
    sent = own.withColumn("to", F.explode(F.when(alone, F.array("low")).otherwise(F.sequence(F.col("low"), F.lit(span - 1).cast("long"), there))))
    met = sent.groupBy("group", F.floor(F.col("block") / (span * MEET)).alias("above_no"), "to").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("digit", "root"))), lambda x: x["root"]).alias("level0"),
        F.first(subtrees).alias("subtrees"),
        F.collect_list(F.when(F.col("low") == F.col("to"), F.struct("block", "of", "digit", "above"))).alias("members"),
    )
    # Up to a single node in the last round, else all levels, also where one subtree stands alone.
    climbs = F.when(F.col("subtrees") > MEET, ROUND_LEVELS).otherwise(_height(F.col("subtrees")))
    met = met.withColumn("climbs", climbs)
    for k in range(ROUND_LEVELS):
        met = met.withColumn(f"level{k + 1}", F.when(F.lit(k) < F.col("climbs"), _lift(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
    levels = F.array(*[F.col(f"level{k}") for k in range(ROUND_LEVELS)])
    one = met.select("group", F.explode("members").alias("m"), F.get(f"level{ROUND_LEVELS}", 0).alias("root"), levels.alias("levels"), "climbs")
    sibling = lambda nodes, k: F.when(k < F.col("climbs"), F.coalesce(F.get(nodes, F.floor(F.col("m.digit") / F.pow(F.lit(2), k)).cast("int").bitwiseXOR(F.lit(1))), F.lit(""))).otherwise("")
    return one.select("group", "m.block", "m.of", "root", F.concat("m.above", F.array_join(F.transform("levels", sibling), "")).alias("above"))


def butterfly(roots: DataFrame) -> DataFrame:
    """(group, block, above, root) of blocks (group, block, size, root): the siblings above each block, and its group's root."""
    state = keep(roots.select("group", "block", F.ceil(F.col("size") / (1 << BLOCK_LEVELS)).alias("of"), "root", F.lit("").alias("above")), "roots")
    most = state.agg(F.max("of")).first()[0] or 0
    span = 1
    while span < most:
        state = keep(_swap(state, span), "roots")
        span *= MEET
    return state.select("group", "block", "above", "root")


def _climbed(leaves: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks with their leaves, and blocks (group, block, above, root) after the butterfly."""
    blocks = keep(_blocks(numbered(leaves), carried), "blocks")
    thin = blocks.select("group", "block", "size", F.transform("rows", lambda r: r["leaf"]).alias("leaves"))
    schema = T.StructType([leaves.schema["group"], *[T.StructField(c, T.LongType()) for c in ("block", "size")], T.StructField("root", T.StringType())])
    return blocks, butterfly(thin.mapInArrow(_block_roots, schema))


def _proofs(names: list[str], of_block: list[str]):  # noqa: ANN202
    """Of blocks, their leaves, each with its siblings in the block and above it; columns of a block are repeated."""

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                one = batch.slice(at, 1)
                rows, above = one.column("rows").flatten(), one.column("above")[0].as_py()
                levels = levels_of(rows.field("leaf").to_pylist(), _least(one.column("size")[0].as_py()))
                pairs = [(j, nodes, len(nodes)) for j, nodes in enumerate(levels[:-1])]
                siblings = ["".join([nodes[k >> j ^ 1] for j, nodes, n in pairs if k >> j ^ 1 < n]) + above for k in range(len(rows))]
                repeated = pa.array(np.zeros(len(rows), np.int32))
                columns = [one.column(c).take(repeated) if c in of_block else rows.field(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(siblings, pa.string())], [*names, "siblings"])

    return prove


def _told(blocks: DataFrame, met: DataFrame, leaves: DataFrame, carried: list[str]) -> DataFrame:
    """The rows of blocks, with what is known of each block: met has group, block, above and any others."""
    others = [c for c in met.columns if c not in ("group", "block", "above")]
    right = met.withColumnsRenamed({"group": "_group", "block": "_block"})
    whole = blocks.join(right, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))).select("group", "size", "rows", "above", *others)
    names = ["group", "order", "leaf", *carried, "position", "size", *others]
    kinds = {f.name: f.dataType for f in (*met.schema, *leaves.schema)} | {"position": T.LongType(), "size": T.LongType()}
    schema = T.StructType([*[T.StructField(c, kinds[c]) for c in names], T.StructField("siblings", T.StringType())])
    return whole.mapInArrow(_proofs(names, ["group", "size", *others]), schema)


def tree(leaves: DataFrame, *carried: str) -> DataFrame:
    """(group, order, leaf, ..., position, size, root, siblings) of leaves (group, order, leaf, ...): a binary tree for each group.

    Leaves ascend by order (null first), equal ones by leaf; two nodes are hashed to one, a last one
    without a partner by itself, until one is left. siblings are the digests of a leaf's partners,
    level by level, in one text. A group may be null; no rows give none.
    """
    return _told(*_climbed(leaves, list(carried)), leaves, list(carried))


def manifest(leaves: DataFrame, *carried: str) -> DataFrame:
    """(group, order, leaf, ..., position, size, subroot, group_position, groups, root, siblings) of leaves (group, order, leaf, ...).

    As `tree`, and the groups' roots, ordered by group (null first), are the leaves of one more tree:
    siblings go on through it to the root of all.
    """
    blocks, met = _climbed(leaves, list(carried))
    met = keep(met, "roots")
    top = tree(met.where("block = 0").select(F.lit(0).alias("group"), F.col("group").alias("order"), F.col("root").alias("leaf")))
    top = keep(top.select(F.col("order").alias("_of"), F.col("position").alias("group_position"), F.col("size").alias("groups"), "root", F.col("siblings").alias("upper")), "subroots")
    both = met.withColumnRenamed("root", "subroot").join(_small(top), F.col("group").eqNullSafe(F.col("_of")))
    return _told(blocks, both.select("group", "block", F.concat("above", "upper").alias("above"), "subroot", "group_position", "groups", "root"), leaves, list(carried))


def folded(leaf: Column, siblings: Column, *paths: tuple[Column, Column]) -> Column:
    """The root that a leaf and its siblings give, climbing the paths (position, size) of its trees one after the other."""
    state = F.struct(leaf.alias("node"), F.lit(1).alias("at"))
    for position, size in paths:
        heights = _height(size)
        steps = F.when(heights > 0, F.sequence(F.lit(0), heights - 1)).otherwise(F.array().cast("array<int>"))
        state = F.aggregate(steps, state, _climb(siblings, position, size))
    return state["node"]


def _climb(siblings: Column, position: Column, size: Column) -> Callable[[Column, Column], Column]:
    """From a node on a path's k-th level to its parent; at is where the next sibling begins."""

    def climb(s: Column, k: Column) -> Column:
        step = F.pow(F.lit(2), k).cast("long")
        mine, last = F.floor(position / step), F.ceil(size / step) - 1
        right = mine % 2 == 1
        other = F.substring(siblings, s["at"], F.lit(DIGEST))
        both = F.when(right, digest(other, s["node"])).otherwise(digest(s["node"], other))
        paired = right | (mine < last)
        return F.struct(F.when(paired, both).otherwise(digest(s["node"])).alias("node"), F.when(paired, s["at"] + DIGEST).otherwise(s["at"]).alias("at"))

    return climb
