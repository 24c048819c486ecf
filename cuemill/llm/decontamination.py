"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items.

Items and documents are normalised alike: A-Z in lower case, everything but digits, letters and
non-ASCII characters a separator. Each item gives its windows of ``window`` consecutive words; an
item of fewer words is one window. All windows go into one automaton, which reads each normalised
document once. Hits come back as word ranges and as offsets (code points) in the original text.

The items are collected and broadcast only while their texts hold at most ``max_item_bytes``. Beyond
it, they are dealt by hash into parts of about that size, and the documents pass through one
automaton after another, each pass written to the shared folder.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import keep, rows_and_texts, take_over

WINDOW = 10
_OUT = ["n_words", "spans", "items"]
#: Texts of items in one automaton. Every word opens a window of ten, which takes about 300 bytes of each
#: worker's memory for a byte of text: 300 MB in all.
MAX_ITEM_BYTES = 1 << 20

#: Bytes of separators become spaces, A-Z become a-z, all others stay.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

SPAN = "struct<word_start:long,word_end:long,start:long,end:long>"
_SPAN_TYPE = pa.struct([(x, pa.int64()) for x in ("word_start", "word_end", "start", "end")])

_automata: dict[str, "Matcher"] = {}


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8, normalised."""
    return text.translate(_TABLE).split()


class Matcher:
    """The automaton over the windows of items [(id, text)]."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        import ahocorasick

        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            words = words_of((text or "").encode())
            for k in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[k : k + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for words, ids in owners.items():
            self.automaton.add_word((b" " + b" ".join(words) + b" ").decode("latin-1"), (len(words), ids))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
        """Which words lie in an occurrence of a window, and the items; None where there is none."""
        if self.empty or not words:
            return None
        line = b" " + b" ".join(words) + b" "
        found = list(self.automaton.iter(line.decode("latin-1")))
        if not found:
            return None
        before = np.cumsum(np.frombuffer(line, np.uint8) == 32)
        edges, items = np.zeros(len(words) + 1, np.int64), set()
        for at, (n, ids) in found:
            end = int(before[at]) - 1
            edges[end - n] += 1
            edges[end] -= 1
            items |= ids
        return np.cumsum(edges[:-1]) > 0, items


def matcher_of(key: str, items: Broadcast, window: int) -> Matcher:
    """The automaton of a broadcast, built once in each Python worker."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = Matcher(items.value, window)
    return _automata[key]


def forget() -> None:
    _automata.clear()


def spans_of(text: str, hit: np.ndarray) -> list[dict]:
    """Runs of hit words, with their offsets in the original text."""
    change = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    places = [m.span() for m in _WORD.finditer(text)]
    return [{"word_start": a, "word_end": b, "start": places[a][0], "end": places[b - 1][1]} for a, b in change.reshape(-1, 2).tolist()]


def _scan(docs: DataFrame, items: list[tuple[str, str]], window: int, names: list[str], texts_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The named columns of the docs (row, text, n_words, spans, items), with a part's hits added."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("decontamination", forget)
        matcher = matcher_of(key, shared, window)
        for batch in batches:
            texts = texts_of(batch)
            rows = list(zip(texts, batch.column("spans"), batch.column("items"), strict=True))
            counts, spans, owners = [], [], []
            for text, had_spans, had_items in rows:
                text = text.as_py() or ""
                words = words_of(text.encode())
                found = matcher.find(words)
                counts.append(len(words))
                spans.append(had_spans.as_py() or [])
                owners.append(had_items.as_py() or [])
                if found:
                    hit, ids = found
                    for x in spans[-1]:
                        hit[x["word_start"] : x["word_end"]] = True
                    spans[-1] = spans_of(text, hit)
                    owners[-1] = sorted({*owners[-1], *ids})
            made = {"n_words": pa.array(counts, pa.int64()), "spans": pa.array(spans, pa.list_(_SPAN_TYPE)), "items": pa.array(owners, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([made[name] if name in made else batch.column(name) for name in names], names)

    return docs.mapInArrow(task, docs.select(*names).schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep_cols: list[str] | None = None, window: int = WINDOW, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The kept columns of each document (all but the text unless named) with n_words, spans and items.

    spans: runs of hit words, as word and code point ranges. items: identifiers, as strings, of the
    items with an occurring window, sorted. A null text has no words; an item with a null identifier
    is named "null". Repeated rows are scanned each by itself; with an empty benchmark or an empty
    table nothing is hit. Texts of any length are read whole. Columns of any name can be kept, but for
    those that are named like one of the three, whose place these take.
    """
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c not in _OUT and (keep_cols is not None or c != text_col)]
    items = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("null")).alias("item"), benchmark[item_text_col].alias("words")).where("words is not null")
    size = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    parts = max(1, -(-size // max_item_bytes))
    work, texts_of = rows_and_texts(docs, kept, text_col)
    work = work.select(
        "*",
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(f"array<{SPAN}>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for part in range(parts):
        chosen = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part)
        names = [c for c in work.columns if c != "text" or part + 1 < parts]  # after the last pass nobody reads the text
        work = _scan(work if part == 0 else keep(work, "decontamination"), [tuple(x) for x in chosen.collect()], window, names, texts_of)
    return work.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(kept)], *_OUT)


def with_counts(found: DataFrame) -> DataFrame:
    """Adds n_hit (words in spans), n_items, items_sha256 and contaminated to what find_contamination gave."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["word_end"] - x["word_start"])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
