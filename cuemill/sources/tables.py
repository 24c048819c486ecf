"""Tables that are kept in buckets, so that what is joined to them by their key comes to them, and they stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTITY, URL = ["identity_kind", "identity"], ["url"]
BUCKETS = 200
#: Rows of names that are sent to all tasks; more are shuffled, and thin columns of the table with them.
MOST_BROADCAST = 100_000


def save_bucketed(rows: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write a table in so many buckets of its keys, one file for each, sorted by them."""
    dealt = rows.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def upsert_bucketed(existing: DataFrame, incoming: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """As `store.upsert`, with existing a table in buckets by identity: its rows are not shuffled.

    What goes is told by identity: that of each incoming transcript, and of each file whose name is
    taken, for which thin columns are read. Files without an identity go by their names alone.
    """
    by_name = ["channel_folder", "filename"]
    taken = incoming.select(*by_name).distinct()
    if taken.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        taken = F.broadcast(taken)
    known = existing.where("identity_kind is not null")
    replaced = known.select(*IDENTITY, *by_name).join(taken, by_name, "left_semi").select(*IDENTITY)
    gone = incoming.where("identity_kind is not null").select(*IDENTITY).union(replaced).distinct().repartition(buckets, *IDENTITY)
    kept = known.join(gone.hint("shuffle_hash"), IDENTITY, "left_anti")
    nameless = existing.where("identity_kind is null").join(taken, by_name, "left_anti")
    return kept.select(*existing.columns).unionByName(nameless.select(*existing.columns)).unionByName(incoming, allowMissingColumns=True)
