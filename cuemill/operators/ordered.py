"""Order over all rows without one task: range partitions, and what is carried from one to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.sources.shared import keep

#: Columns that `ranged` adds: a row's place in the order, and the task that has it.
AT, PART = "_at", "_part"


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """The rows with AT and PART, written to the shared folder: range partitioned and sorted, so that AT grows along the order."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    return keep(placed.withColumn(PART, F.shiftright(AT, 33).cast("int")), "ordered")


def numbered(rows: DataFrame, *order: str | Column, name: str = "line") -> DataFrame:
    """Adds a row's number, from 0, in the order of all: counts of each part, their running sums, and the place within the part."""
    placed = ranged(rows, *order)
    counts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.min(AT).alias("first"))  # a row for each part
    before = F.coalesce(F.sum("n").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(PART, (F.col("first") - before).alias("_shift"))
    return placed.join(F.broadcast(shifts), PART).withColumn(name, F.col(AT) - F.col("_shift")).drop(AT, PART, "_shift")


def island_numbers(placed: DataFrame, key: str, breaks: Column, of: list[str], name: str) -> DataFrame:
    """Numbers, from 0 for each key, the islands of rows that `ranged` has placed by key first.

    breaks says from a row's columns and `before`, a struct of the columns `of` in the key's row
    before it (null for its first), whether an island starts. Within a part, `before` is the row
    above. A part that begins within a key is told the last row and the number of islands of the
    parts before: there is one such row for each part, whatever the size of the key.
    """
    own = Window.partitionBy(PART, key).orderBy(AT)
    last = F.struct(*of)
    ends = placed.groupBy(key, PART).agg(F.max_by(last, AT).alias("last"), F.min(AT).alias("first"))
    earlier = Window.partitionBy(key).orderBy(PART)
    carried = ends.select(F.col("first").alias("_first"), F.lag("last").over(earlier).alias("_carried")).where("_carried is not null")
    told = placed.join(F.broadcast(carried), F.col(AT) == F.col("_first"), "left").drop("_first")
    told = told.withColumn("before", F.coalesce(F.lag(last).over(own), "_carried")).drop("_carried")
    marked = keep(told.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int")).drop("before"), "islands")
    sums = marked.groupBy(key, PART).agg(F.sum("_break").alias("n"))
    sofar = F.sum("n").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(F.col(key).alias("_key"), F.col(PART).alias("_of"), sofar.alias("_offset")).where("_offset is not null")
    both = marked.join(F.broadcast(offsets), (F.col(PART) == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    number = F.sum("_break").over(own) - 1 + F.coalesce("_offset", F.lit(0))
    return both.withColumn(name, number.cast("int")).drop("_break", "_offset", "_key", "_of")


def neighbours(placed: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Adds <name>_before and <name>_after to rows that `ranged` has placed by key first: the nearest values in each direction.

    values grow along the order where they are not null, as times do in the order of time; a row's
    own value is on both sides. Within a part they are running ones; the greatest of the parts before
    and the least of those behind are told to a part that begins or ends within a key, which are two
    rows for each part, whatever the size of the key.
    """
    back = Window.partitionBy(PART, key).orderBy(AT)
    ahead = back.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by_part = placed.groupBy(key, PART).agg(*[f(v).alias(f"{name}_{end}") for name, v in values.items() for f, end in ((F.max, "high"), (F.min, "low"))])
    parts = Window.partitionBy(key).orderBy(PART)
    told = by_part.select(
        F.col(key).alias("_key"),
        F.col(PART).alias("_of"),
        *[F.max(f"{n}_high").over(parts.rowsBetween(Window.unboundedPreceding, -1)).alias(f"{n}_earlier") for n in values],
        *[F.min(f"{n}_low").over(parts.rowsBetween(1, Window.unboundedFollowing)).alias(f"{n}_later") for n in values],
    )
    told = told.where(F.coalesce(*[F.col(f"{n}_{end}") for n in values for end in ("earlier", "later")]).isNotNull())
    both = placed.join(F.broadcast(told), (F.col(PART) == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    found = both.select(
        *placed.columns,
        *[F.coalesce(F.last(v, ignorenulls=True).over(back), f"{n}_earlier").alias(f"{n}_before") for n, v in values.items()],
        *[F.coalesce(F.first(v, ignorenulls=True).over(ahead), f"{n}_later").alias(f"{n}_after") for n, v in values.items()],
    )
    return found.drop(AT, PART)


def places(placed: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a row's number, from 1, among those of its key, in the order in which `ranged` has placed them by key first."""
    parts = Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(key, PART).agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col(key).alias("_key"), F.col(PART).alias("_of"), F.sum("n").over(parts).alias("_offset")).where("_offset is not null")
    both = placed.join(F.broadcast(before), (F.col(PART) == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    number = F.row_number().over(Window.partitionBy(PART, key).orderBy(AT)) + F.coalesce("_offset", F.lit(0))
    return both.withColumn(name, number).drop(AT, PART, "_key", "_of", "_offset")
