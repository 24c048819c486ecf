"""What a track carries besides speech: credits, speaker marks and sound events.

Everything works from places in a cue's text: what a marker or an event takes up is blanked out where
it stands, and turns and lines start after as many words as stand before their places.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

from cuemill.functions.text import SPACE, SPACE_INSIDE

#: Fixed values.
CREDIT = r"(?i)^(?:Transcriber|Reviewer|Translator|Subtitles by|Captions by|Amara)(?![A-Za-z0-9_])"
MARKER = {"auto": "(?m)^>>>? *", "manual": "(?m)^- +"}
OPENS = {"auto": ">", "manual": "-"}
CONTINUATION = ("...", "…")
MOST_EVENT_WORDS = 4
BRACKETS = {"auto": "[]", "manual": "()"}

#: (words, turn starts, line starts), the starts as numbers of words before them.
Stripped = tuple[list[str], list[int], list[int]]


def event_pattern(notation: str) -> str:
    """A bracketed token of at most four words without a full stop."""
    opening, closing = map(re.escape, BRACKETS[notation])
    word = f"[^{opening}{closing}.?!{SPACE_INSIDE}]+"
    return f"{opening}{SPACE}*(?:{word}(?:{SPACE}+{word}){{0,{MOST_EVENT_WORDS - 1}}})?{SPACE}*{closing}"


_MARKER = {kind: re.compile(x) for kind, x in MARKER.items()}
_EVENT = {kind: re.compile(event_pattern(kind)) for kind in BRACKETS}
_CREDIT, _WORD = re.compile(CREDIT), re.compile("[^ \n]+")


def has_marks(text: str, notation: str) -> bool:
    """Whether lines could hold a marker or an event."""
    return BRACKETS[notation][0] in text or OPENS[notation] in text and _MARKER[notation].search(text) is not None


def _blank(found: re.Match) -> str:
    """As many spaces; a line's end stays one."""
    return "\n".join(" " * len(line) for line in found[0].split("\n"))


def strip_cue(text: str, notation: str) -> Stripped:
    """Words of a cue of clean lines, without its markers and events, and where its turns and lines start."""
    marks = [m for m in _MARKER[notation].finditer(text)] if text[0] in ">-" or "\n>" in text or "\n-" in text else []
    opening = BRACKETS[notation][0]
    if not marks and opening not in text:
        by_line = [line.split(" ") for line in text.split("\n")]
        return [w for line in by_line for w in line], [], [0, *accumulate(map(len, by_line[:-1]))]
    lines = [0, *[m.end() for m in re.finditer("\n", text)]]
    turns = [m.start() for m in marks if notation == "auto" or not text.startswith(CONTINUATION, m.end())]
    for m in marks:
        text = text[: m.start()] + " " * (m.end() - m.start()) + text[m.end() :]
    if opening in text:
        text = _EVENT[notation].sub(_blank, text)
    found = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    places = [at for at, _ in found]
    return [w for _, w in found], [bisect_left(places, at) for at in turns], [bisect_left(places, at) for at in lines]


def is_credit(text: str) -> bool:
    return any(map(_CREDIT.match, text.split("\n")))


def strip_artifacts(cues: list[str], notation: str) -> list[Stripped]:
    """Of cues, each the text of its clean lines: those that have words or a turn start.

    A manual track's credit goes if it is the first or the last cue; none becomes so by that.
    """
    ends = {0, len(cues) - 1} if notation == "manual" else ()
    stripped = (strip_cue(text, notation) for k, text in enumerate(cues) if k not in ends or not is_credit(text))
    return [s for s in stripped if s[0] or s[1]]
