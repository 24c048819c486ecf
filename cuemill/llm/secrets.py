"""Secrets in texts: patterns that tell by themselves, and parts that tell only together.

An access identifier, a secret and an endpoint are parts of a credential. Alone each is weak: a
user's name, a long mixed token, a host. Parts are intervals on a text; those of one scope (lines up
to a blank one) that lie within reach of each other are joined, by their order and never pair by
pair, and a weak part is reported only if parts that complete it are there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import rows_and_texts

#: Patterns of the kinds that are reported in any case, and how long a match must be.
BASE = {
    "assign": (re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
#: Kinds in the order in which they are listed; the last three are parts that were weak.
KINDS = [*BASE, "identifier", "secret", "endpoint"]
#: How far apart, in code points, two parts of a credential may be within their scope.
REACH = 300

_NAME = r"(?<![A-Za-z0-9])(?:user(?:[ _-]?name|[ _-]?id)?|login|account(?:[ _-]?name|[ _-]?id)?|client[ _-]?id|(?:access[ _-]?)?key[ _-]?id|app(?:lication)?[ _-]?id|tenant[ _-]?id|uid)"
_HIDDEN = r"(?<![A-Za-z0-9])(?:pwd|pass(?:phrase|code)?|secret[ _-]?(?:access[ _-]?)?key|private[ _-]?key|access[ _-]?key|account[ _-]?key|shared[ _-]?key|signing[ _-]?key|auth(?:orization)?|bearer|credentials?|signature)"
_PLACE = r"(?<![A-Za-z0-9])(?:host(?:[ _-]?name)?|server|endpoint|data[ _-]?source|address|url|uri|bucket)"
_GIVEN = r"""["']?\x20*[:=]\x20*["']?"""
_LABELLED = {
    "identifier": re.compile(_NAME + _GIVEN + r"""([^\s"',;:=&<>]{3,128})""", re.I | re.A),
    "secret": re.compile(_HIDDEN + _GIVEN + r"""(?:(?:Bearer|Basic)\x20+)?([^\s"',;&<>]{6,})""", re.I | re.A),
    "endpoint": re.compile(_PLACE + _GIVEN + r"""([A-Za-z0-9][A-Za-z0-9.-]*[A-Za-z0-9](?::[0-9]{1,5})?)""", re.I | re.A),
}
_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://(?:([^\s"'<>/:@?#]+):([^\s"'<>/@?#]+)@)?([^\s"'<>@?#]+)""")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,128}={0,2}(?![A-Za-z0-9+/_=-])")
_SCOPE = re.compile(r"\n[^\S\n]*(?=\n)")
#: Bits a character of a bare token: less is a word, a path or a row of digits.
MIXED = 3.5

Part = tuple[str, int, int, bool]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and without overlaps within a kind; a match that fails is dropped, not tried again."""
    out = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "access" and "AKIA" not in text or kind == "assign" and ":" not in text and "=" not in text:
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return out


def mixed(token: str) -> bool:
    """Whether a token has letters of both cases and digits, as evenly spread as in a random one."""
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= MIXED


def weak_parts(text: str) -> list[Part]:
    """(role, start, end, labelled): weak parts, those of a role without overlaps. A bare token has no label."""
    found: list[Part] = []
    if ":" in text or "=" in text:
        found += [(role, m.start(), m.end(), True) for role, pattern in _LABELLED.items() for m in pattern.finditer(text)]
        if "://" in text:
            for m in _URL.finditer(text):
                if m[1]:
                    found += [("identifier", *m.span(1), True), ("secret", *m.span(2), True), ("endpoint", *m.span(3), True)]
                else:
                    found.append(("endpoint", *m.span(), True))
    found += [("secret", *m.span(), False) for m in _BARE.finditer(text) if mixed(m[0])]
    out: list[Part] = []
    reached: dict[str, int] = {}
    for part in sorted(found, key=lambda p: (p[1], -p[2], not p[3])):
        if part[1] >= reached.get(part[0], 0):
            out.append(part)
            reached[part[0]] = part[2]
    return out


def _meets(lows: np.ndarray, highs: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of intervals [low, high), which meet one of the others, (n, 2) in order and without overlaps: one search each, no pairs."""
    if not len(others):
        return np.zeros(len(lows), bool)
    at = np.searchsorted(others[:, 1], lows, side="right")
    return (at < len(others)) & (others[np.minimum(at, len(others) - 1), 0] < highs)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Intervals in order, those that overlap as one."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    if not len(spans):
        return spans
    reached = np.maximum.accumulate(spans[:, 1])
    starts = np.flatnonzero(np.r_[True, spans[1:, 0] >= reached[:-1]])
    return np.stack([spans[starts, 0], reached[np.r_[starts[1:] - 1, len(spans) - 1]]], axis=1)


def linked_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], reach: int = REACH) -> list[list[tuple[str, int, int]]]:
    """The weak parts of each text that complementary parts in reach make reports.

    All texts of a batch lie on one axis, each in scopes of its own, so that their parts are joined at
    once. An identifier needs a secret; a labelled secret an identifier or an endpoint; a bare token
    an identifier; an endpoint a labelled secret, or a secret that an identifier joins. Spans that
    are reported in any case count as parts: access keys as identifiers, the others as secrets.
    """
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    parts: list[tuple[int, str, int, int, int, int, bool, bool]] = []  # text, role, start, end, scope's start and end, labelled, base
    origin = 0
    for k, (text, base) in enumerate(zip(texts, bases, strict=True)):
        weak = weak_parts(text)
        if weak:
            cuts = np.array([0, *[m.end() for m in _SCOPE.finditer(text)], len(text)])
            own = [*[(role, a, b, labelled, False) for role, a, b, labelled in weak], *[("identifier" if kind == "access" else "secret", a, b, True, True) for kind, a, b in base]]
            for role, a, b, labelled, is_base in own:
                at = int(np.searchsorted(cuts, a, side="right"))
                parts.append((k, role, origin + a, origin + b, origin + int(cuts[at - 1]), origin + (int(cuts[at]) if at < len(cuts) else len(text)), labelled, is_base))
        origin += len(text) + reach
    if not parts:
        return out
    spans = np.array([p[2:6] for p in parts])
    role, labelled, is_base = np.array([p[1] for p in parts]), np.array([p[6] for p in parts]), np.array([p[7] for p in parts])
    lows, highs = np.maximum(spans[:, 0] - reach, spans[:, 2]), np.minimum(spans[:, 1] + reach, spans[:, 3])
    near = lambda which: _meets(lows, highs, _merged(spans[which, :2]))
    identifier, secret, endpoint = role == "identifier", role == "secret", role == "endpoint"
    by_name, by_place = near(identifier), near(endpoint)
    told_secret = secret & (is_base | by_name | (labelled & by_place))
    told = is_base | told_secret | (identifier & near(secret)) | (endpoint & near(told_secret & (labelled | by_name)))
    taken = _merged(spans[is_base, :2])
    told &= ~_meets(spans[:, 0], spans[:, 1], taken)
    origins = np.cumsum([0, *[len(t) + reach for t in texts]])
    reached = -1
    for n in np.lexsort((spans[:, 1], [KINDS.index(r) for r in role], spans[:, 0])):
        if told[n] and spans[n, 0] >= reached:
            k = parts[n][0]
            out[k].append((role[n].item(), int(spans[n, 0] - origins[k]), int(spans[n, 1] - origins[k])))
            reached = spans[n, 1]
    return out


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_secrets(docs: DataFrame, *, text_col: str = "text", keep_cols: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """The kept columns (all but the text unless named) and spans: kind, start, end (code points), base.

    Spans are in order of start, then kind; base ones are those of the patterns, and no other
    overlaps them. A null text is empty and has none. Whole texts are read, whatever their length.
    Repeated rows are read each by itself; an empty table gives no rows; columns of any name can be
    kept, but for one named spans, whose place the result takes. Nothing is shuffled.
    """
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c != "spans" and (keep_cols is not None or c != text_col)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in texts_of(batch).to_pylist()]
            bases = [base_spans(t) for t in texts]
            rows = []
            for base, more in zip(bases, linked_spans(texts, bases, reach), strict=True):
                both = [(*s, True) for s in base] + [(*s, False) for s in more]
                both.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _SPANS)], ["row", "spans"])

    work, texts_of = rows_and_texts(docs, kept, text_col)
    out = work.mapInArrow(task, f"row {work.schema['row'].dataType.simpleString()}, spans {SPANS}")
    return out.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(kept)], "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def with_counts(found: DataFrame) -> DataFrame:
    """Adds n_assign, n_access, n_hex and base_sha256 of the base spans, and n_linked, how many others there are; spans become a string."""
    base = F.filter("spans", lambda s: s["base"])
    counted = {f"n_{kind}": F.size(F.filter(base, _is(kind))).cast("long") for kind in BASE}
    counted |= {"base_sha256": F.sha2(joined(base).cast("binary"), 256), "n_linked": (F.size("spans") - F.size(base)).cast("long")}
    return found.withColumns(counted).withColumn("spans", joined(F.col("spans")))
