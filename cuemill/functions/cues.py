"""Cues of a caption track, as an array inside the track's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import TIMING, let, to_milliseconds, trim


def _block_cues(lines: Column, ids: bool, times: bool) -> Column:
    """Cues of a block of trimmed lines: one for each timing line, with the lines up to the next."""
    places = F.filter(F.transform(lines, lambda line, k: F.when(line.contains("-->") & line.rlike(TIMING), k)), lambda k: k.isNotNull())

    def cues(at: Column) -> Column:
        def cue(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(at, k + 1), F.size(lines))
            clock = lambda n: to_milliseconds(F.regexp_extract(F.get(lines, start), TIMING, n))
            fields = [
                *([clock(1).alias("start_ms"), clock(2).alias("end_ms")] if times else []),
                F.filter(F.slice(lines, start + 2, end - start - 1), lambda line: line != "").alias("lines"),
            ]
            if ids:
                fields.append(F.get(lines, F.get(at, 0) - 1).alias("id"))
            return F.struct(*fields)

        return F.transform(at, cue)

    return let(places, cues)


def parse_cues(raw: Column, ids: bool = False, times: bool = True) -> Column:
    """array<struct<start_ms, end_ms, lines[, id]>> of a WebVTT or SRT text, in the text's order.

    Only an empty line ends a block: one that holds a space does not. Blocks without a timing line
    give nothing, cues without text stay. With ids, the line before a block's first timing line is
    the id of its cues, null if there is none. Without times, start_ms and end_ms are left out.
    """
    blocks = F.split(raw, r"\r?\n(?:\r?\n)+")
    return F.flatten(F.transform(blocks, lambda b: let(F.transform(F.filter(F.split(b, r"\r?\n"), lambda x: x != ""), trim), lambda lines: _block_cues(lines, ids, times))))
