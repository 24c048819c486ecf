"""Transcript documents: frontmatter and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.text import format_fetched, format_upload_date, quote_yaml

DASH = "— "


def render_frontmatter(title: Column, url: Column, channel: Column, duration: Column, upload_date: Column, fetched: Column, subtitles: Column, layout: Column) -> Column:
    """The block of eight keys; a null url or duration is left out."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    return F.concat_ws(
        "\n",
        F.lit("---"),
        line("title", quote_yaml(title)),
        line("url", url),
        line("channel", quote_yaml(channel)),
        F.when(duration.isNotNull(), line("duration", quote_yaml(duration))),
        line("upload_date", format_upload_date(upload_date)),
        line("fetched", format_fetched(fetched)),
        line("subtitles", subtitles),
        line("layout", layout),
        F.lit("---"),
    )


def render_body(turns: Column, layout: Column) -> Column:
    """Paragraphs with empty lines between; outside of prose a turn opens with a dash, and its speaker's name if it has one.

    turns: array<struct<speaker, paragraphs>>.
    """

    def opened(turn: Column) -> Column:
        name = F.when(turn["speaker"].isNull(), "").otherwise(F.concat(F.lit("**"), turn["speaker"], F.lit(":** ")))
        opening = F.when(layout == "prose", "").otherwise(F.concat(F.lit(DASH), name))
        return F.transform(turn["paragraphs"], lambda p, k: F.when(k == 0, F.concat(opening, p)).otherwise(p))

    return F.array_join(F.flatten(F.transform(turns, opened)), "\n\n")


def unnamed(turns: Column) -> Column:
    """A video's turns (array<array<string>>) as turns without speakers."""
    return F.transform(turns, lambda p: F.struct(F.lit(None).cast("string").alias("speaker"), p.alias("paragraphs")))


def render_contents(frontmatter: Column, body: Column) -> Column:
    return F.concat(frontmatter, F.lit("\n\n"), body, F.lit("\n"))
