"""From a track to its words, in one Arrow function: cues, their clean lines, and what is said in them.

The removal of rolling repeats is a fold that built-in functions cannot say, and to cut cues into arrays takes them longer
than reading the text. `heard` is given a whole track, `spoken` the text that `cue_text` makes of cues. A row is read by
itself, so a task holds the words of one piece of a batch of tracks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuemill.functions.artifacts import has_marks, strip_artifacts
from cuemill.functions.text import ENTITIES, SPACES, TIMING, clean_lines
from cuemill.functions.turns import Stream, borders, lowered

#: Ends a cue in the text of a track; taken out of captions first.
CUE = "\ue000"
#: Bytes of tracks that are read at once.
PIECE = 2_000_000

_TIMING = re.compile(TIMING.translate({ord(c): None for c in "()"}).replace(r"\d{2}", r"\d\d").replace(r"\d{3}", r"\d\d\d"), re.ASCII)
_TAG = re.compile(f"<[^>\n{CUE}]*>")
_RARE = SPACES.translate({ord(c): None for c in " \n"})
_RUN = re.compile(f"[ {_RARE}]+")


def cue_text(cues: Column) -> Column:
    """The clean lines of cues (array<array<string>>) as one text: newlines end lines, CUE ends cues."""
    return clean_lines(F.array_join(F.transform(cues, lambda lines: F.translate(F.array_join(lines, "\n"), CUE, "")), CUE), "\n" + CUE)


def _block(lines: list[str]) -> Iterator[str]:
    """The cues of a block: an end for each timing line, then the lines up to the next."""
    inside = False
    for line in lines:
        if "-->" in line and _TIMING.search(line):
            inside = True
            yield CUE
        elif inside:
            yield line.replace(CUE, "")


def track_text(raw: str) -> str:
    """What `cue_text` gives of the cues that `parse_cues` finds in a track, but for empty lines and cues."""
    found: list[str] = []
    mark = CUE in raw
    for block in raw.replace("\r\n", "\n").split("\n\n"):
        head, _, said = block.lstrip("\n").partition("\n")
        if mark or "-->" in said or not ("-->" in head and _TIMING.search(head)):
            if "-->" in block:
                found += _block(block.split("\n"))
        else:
            found += CUE, said
    text = "\n".join(found)
    if "<" in text:
        # As all are whole tags there is nothing to search for.
        text = text.replace("<c>", "").replace("</c>", "") if text.count("<") == text.count("<c>") + text.count("</c>") else _TAG.sub("", text)
    if "&" in text:
        for entity, plain in ENTITIES:
            text = text.replace(entity, plain)
    if "  " in text or any(c in text for c in _RARE):
        text = _RUN.sub(" ", text)
    return text.replace(" \n", "\n").replace("\n ", "\n").strip(" ")


def _cues(text: str) -> list[str]:
    """The texts of cues, without empty lines; none is empty."""
    while "\n\n" in text:
        text = text.replace("\n\n", "\n")
    return [said for cue in text.split(CUE) if (said := cue.strip("\n"))]


def _rolled(cues: list[str]) -> list[str]:
    """Words of cues without markers and events, less what each cue repeats of the words before it."""
    lines = list(dict.fromkeys("\n".join(cues).split("\n")))  # that come again are read once
    plain = dict(zip(lines, (line.split(" ") for line in lowered("\n".join(lines), " \n").split("\n")), strict=True))
    words: list[str] = []
    norms: list[str] = []
    for cue in cues:
        own = plain.get(cue) or list(chain.from_iterable(map(plain.__getitem__, cue.split("\n"))))
        if norms and own == norms[-len(own) :] and any(own):
            continue
        seen = next(borders(own, norms), 0)
        if seen and not any(own[:seen]):
            seen = 0
        words += cue.replace("\n", " ").split(" ")[seen:]
        norms += own[seen:]
    return words


def stream(text: str, notation: str, dedup: bool) -> tuple[list[str], list[int]]:
    """Words of a track without artifacts and rolling repeats, and the turn starts among them."""
    cues = _cues(text)
    if cues and dedup and notation == "auto" and not has_marks(text.replace(CUE, "\n"), notation):
        return _rolled(cues), []
    said = Stream()
    for words, turns, lines in strip_artifacts(cues, notation):
        said.add(words, turns, lines, dedup)
    return said.words, said.turn_starts


def _lists(rows: list[list], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(rows)), kind))


_STREAM = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("turn_starts", T.ArrayType(T.IntegerType()))])


def _streams(texts: list, notations: pa.Array, dedup: pa.Array) -> pa.Array:
    rows = [stream(t or "", n, d) for t, n, d in zip(texts, notations.to_pylist(), dedup.to_pylist(), strict=True)]
    return pa.StructArray.from_arrays([_lists([w for w, _ in rows], pa.string()), _lists([s for _, s in rows], pa.int32())], ["words", "turn_starts"])


@F.arrow_udf(_STREAM)
def _spoken(texts: pa.Array, notations: pa.Array, dedup: pa.Array) -> pa.Array:
    return _streams(texts.to_pylist(), notations, dedup)


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of rows of about so many bytes, so that what is made of a batch is never held whole."""
    start = size = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1):
        size += n
        if size >= most or k == len(texts):
            yield start, k
            start, size = k, 0


def release() -> None:
    """Give back what a batch took, before the next one is read: tasks share a machine's memory with all their Python workers."""
    pa.default_memory_pool().release_unused()


@F.arrow_udf(_STREAM)
def _heard(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for raws, notations, dedup in batches:
        for start, end in pieces(raws):
            texts = (track_text(raw or "") for raw in raws[start:end].to_pylist())
            yield _streams(texts, notations[start:end], dedup[start:end])
        del raws, notations, dedup
        release()


#: Not to be worked out inside of an expression that uses it: lambdas cannot call Python.
_spoken, _heard = _spoken.asNondeterministic(), _heard.asNondeterministic()


def spoken(text: Column, notation: Column, dedup: Column) -> Column:
    """struct<words, turn_starts> of the text that cue_text gives."""
    return _spoken(text, notation, dedup)


def heard(raw: Column, notation: Column, dedup: Column) -> Column:
    """The same of a whole track."""
    return _heard(raw, notation, dedup)
