"""SimHash near-duplicates: fingerprints of word shingles, linked through Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits. Of at most four differing bits,
either every segment has at most two, or one has three or more and the others at most one between
them. So two fingerprints to be linked have in common either a Golay key of each segment, or an
entire segment and a Golay key of another. Keys are joined and every pair of a bucket is verified.
Only distinct fingerprints are compared; copies follow their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm import golay
from cuemill.llm.buckets import bucket_edges, within
from cuemill.llm.components import components
from cuemill.llm.shared import keep, take_over

SEED = 42
MOST_BITS = 4
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Shingles whose bits are summed at once.
AT_ONCE = 1 << 16

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, shingle: int) -> int:
    """Bits set in over half of the XXH64 of the text's shingles of so many words."""
    from xxhash import xxh64_digest

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = list(zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in spans[at : at + AT_ONCE]])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, id_type: str = "long") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. A null text, or one with no word, has 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("simhash")
        for batch in batches:
            made = np.array([fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast(id_type).alias("doc_id"), docs[text_col].cast("binary").alias("text")).mapInArrow(task, f"doc_id {id_type}, fp long")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for each key of each fingerprint."""
    segments = [(fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.uint32) for low, width in SEGMENTS]
    coded = [golay.keys(s, width) for s, (_, width) in zip(segments, SEGMENTS, strict=True)]
    (a, a_ok), (b, b_ok), (c, c_ok) = [(k.astype(np.int64), ok) for k, ok in coded]
    place, i, j, k = np.nonzero(a_ok[:, :, None, None] & b_ok[:, None, :, None] & c_ok[:, None, None, :])
    places, keys = [place], [a[place, i] << 24 | b[place, j] << 12 | c[place, k]]
    table = 1
    for whole in range(3):
        for coarse in range(3):
            if whole != coarse:
                code, ok = coded[coarse]
                place, i = np.nonzero(ok)
                places.append(place)
                keys.append(np.int64(table) << 36 | segments[whole][place].astype(np.int64) << 12 | code[place, i])
                table += 1
    return np.concatenate(places), np.concatenate(keys)


def _with_keys(distinct: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 2048):
                part = fps[at : at + 2048]
                place, key = fuzzy_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[place])], ["key", "id"])

    return distinct.select("fp").mapInArrow(task, "key long, id long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of the docs.

    component_id is the smallest doc_id that links lead to. Null and empty texts have fingerprint
    zero and link like any other. Repeated rows stay; a null doc_id is never the smallest, and a
    component of null ids alone has a null component_id. An empty table gives no rows. Columns other
    than the two named are ignored.
    """
    prints = keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    grouped = keep(_grouped(prints), "fingerprint-groups")
    firsts = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(firsts, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(prints: DataFrame) -> DataFrame:
    """(fp, first_id, root) of each distinct fingerprint: its smallest doc_id, and its component's smallest fingerprint."""
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    keyed = _with_keys(distinct).withColumn("code", F.col("id"))
    linked = components(bucket_edges(keyed, ["code"], within(MOST_BITS)))
    return distinct.join(linked, distinct.fp == linked.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """The rows of docs, one of each component: the one with the smallest identifier.

    Null identifiers come last; rows alike in identifier and text are one document, and stay once.
    All columns are kept, whatever their names.
    """
    twin = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    row = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")
    work = docs.select(docs[id_col].cast("long").alias("doc_id"), twin.alias("twin"), row)
    named = fingerprints(docs.select(F.struct(docs[id_col].cast("long").alias("doc_id"), twin.alias("twin")).alias("doc_id"), docs[text_col].alias("text")), shingle=shingle, id_type="struct<doc_id:long,twin:long>")
    prints = keep(named.select("doc_id.doc_id", "doc_id.twin", "fp"), "fingerprints")
    roots = prints.join(_grouped(prints).select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "twin")
    chosen = roots.groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.doc_id").alias("k_doc"), F.col("o.twin").alias("k_twin"))
    # A document has one place at most, so the rows of a place are as few as its repeats.
    kept = work.join(chosen, work.doc_id.eqNullSafe(chosen.k_doc) & (work.twin == chosen.k_twin))
    first = Window.partitionBy("doc_id", "twin").orderBy("doc_id")
    return kept.withColumn("n", F.row_number().over(first)).where("n = 1").select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(docs.columns)])
