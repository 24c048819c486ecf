"""Personal data in texts: plain patterns, and a linear-chain conditional random field beside them.

The patterns give the base spans. The field labels tokens by word-shape features, with weights
trained by gradient ascent on a small labelled table; windows of tokens around digits, at-signs and
spelled-out ones are decoded by Viterbi in numpy batches, and tokens outside of all windows are
outside of all spans. A decoded span is added if it overlaps no other and passes its kind's check.
Besides the kinds of the patterns the field knows secrets: keys, tokens and passwords.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm import pii_examples
from cuemill.llm.shared import rows_and_texts

KINDS = ("email", "ip", "card", "phone")
#: The kinds of the field: secrets are found by their shape and by the words before them.
FIELD_KINDS = (*KINDS, "secret")
#: Rounds of `drawn` lines, seventeen lines each, that the built-in table has besides those written down.
DRAWN = 45
MAX_LABELLED = 5000
#: Tokens that a window keeps on both sides of its triggers.
REACH = 6
#: Windows decoded together, and tokens that they may take with their padding; a longer window is decoded by itself, whole.
BATCH, CELLS = 512, 100_000
#: Tokens whose features are named at once, and how far the features look.
PIECE, LOOK = 4096, 5

LABELS = ("O", *[f"{p}-{k}" for k in FIELD_KINDS for p in "BI"])
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

# ---- plain patterns ----

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BEFORE_AT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(sum(divmod(2 * d, 10)) for d in back[1::2])) % 10 == 0


def _small_parts(parts: Iterable[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in parts)


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at-signs, so that long runs of letters cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _BEFORE_AT:
            start -= 1
        found = _AFTER_AT.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if _small_parts(m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the field ----

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]|[(\[] ?(?:at|dot) ?[)\]]|\bdot\b|\bpass(?:word|wd)\b|\btoken\b|\bsecret\b|\ba[ks]ia[a-z2-7]{16}\b", re.IGNORECASE)
_RUN = re.compile(r"(.)\1+")
_NAMED = frozenset("at dot com org net de es io fr tel phone call fax mobile line number ip host server card visa mastercard amex mail email password passwd pwd pass token secret key apikey bearer sha commit ghp xoxb".split())
_HEX = frozenset("0123456789abcdef")
#: How the identifiers of access keys begin; a fixed value.
_KEY_STARTS = ("AKIA", "ASIA")


def shape(token: str) -> str:
    """Letters as x or X, digits as d: short numbers by length, words by their runs."""
    if token.isdigit():
        return f"d{min(len(token), 12)}"
    drawn = "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in token)
    return _RUN.sub(r"\1+", drawn)


def _runs(tokens: list[tuple[str, bool]]) -> list[tuple[str, bool]]:
    """For each token, what the letters and digits that it is joined to are like, as far as the features look, and whether it is their first."""
    words = [t[0].isalnum() for t, _ in tokens]
    joined = [k > 0 and not gap and words[k] and words[k - 1] for k, (_, gap) in enumerate(tokens)]
    out = []
    for k, (token, _) in enumerate(tokens):
        if not words[k] or not (joined[k] or (k + 1 < len(tokens) and joined[k + 1])):
            out.append(("", not words[k] or not joined[k]))
            continue
        a = b = k
        while k - a < LOOK and joined[a]:
            a -= 1
        while b - k < LOOK and b + 1 < len(tokens) and joined[b + 1]:
            b += 1
        run = "".join(t for t, _ in tokens[a : b + 1])
        size = "few" if len(run) < 7 else "some" if len(run) < 12 else "many"
        out.append((f"{size}{'hex' if set(run) <= _HEX else 'upper' if run.isupper() else 'any'}", not joined[k]))
    return out


def token_features(tokens: list[tuple[str, bool]]) -> list[list[str]]:
    """Names of each token's features: shapes and named words nearby, and the run of letters and digits; (token, whether space is before)."""
    shapes = [shape(t) for t, _ in tokens]
    words = ["access-key" if t.startswith(_KEY_STARTS) else t.lower() if t.lower() in _NAMED else "" for t, _ in tokens]
    runs = _runs(tokens)
    edge = ["^"] * LOOK
    padded, named = [*edge, *shapes, *edge], [*[""] * LOOK, *words, *[""] * LOOK]
    out = []
    for k, (_, gap) in enumerate(tokens):
        at = k + LOOK
        names = ["bias", f"gap={gap}"]
        names += [f"s{d}={padded[at + d]}" for d in range(-3, 4)]
        names += [f"w{d}={named[at + d]}" for d in range(-LOOK, 4) if named[at + d]]
        names += [f"s-1,0={padded[at - 1]}|{padded[at]}", f"s0,1={padded[at]}|{padded[at + 1]}|{gap}", f"s0,2={padded[at]}|{padded[at + 2]}", f"s-2,0={padded[at - 2]}|{padded[at]}"]
        run, first = runs[k]
        if run:
            before = next((named[at - d] for d in range(LOOK + 1) if named[at - d]), "") if first else ""
            names += [f"run={run}", f"run={run}|{first}", f"run={run[:4]}|{before}|{first}"]
        else:
            names += [f"single|{padded[at - 1]}"]
        out.append(names)
    return out


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _gaps(tokens: list[tuple[str, int, int]]) -> list[tuple[str, bool]]:
    return [(t, k == 0 or tokens[k - 1][2] < a) for k, (t, a, _) in enumerate(tokens)]


class Field:
    """Weights of features by label, of label after label, and of the first label."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.place: dict[str, int] = {}
        self.emit = np.zeros((0, n))
        self.step = np.zeros((n, n))
        self.first = np.zeros(n)
        for b, label in enumerate(LABELS):  # an inside label only goes on with its own kind
            if label[0] == "I":
                self.first[b] = -1e4
                for a, before in enumerate(LABELS):
                    if before[1:] != label[1:]:
                        self.step[a, b] = -1e4

    def scores(self, tokens: list[tuple[str, bool]]) -> np.ndarray:
        place, emit = self.place, self.emit
        out = np.empty((len(tokens), len(LABELS)))
        for at in range(0, len(tokens), PIECE):
            lead = min(at, LOOK)
            named = token_features(tokens[at - lead : at + PIECE + LOOK])[lead : lead + PIECE]
            out[at : at + len(named)] = [emit[[place[f] for f in names if f in place]].sum(axis=0) for names in named]
        return out

    def decode(self, score: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of a batch of sequences, by Viterbi over all of them at once."""
        length = np.array([len(s) for s in score])
        most = int(length.max())
        padded = np.zeros((len(score), most, len(LABELS)))
        for k, s in enumerate(score):
            padded[k, : len(s)] = s
        best = padded[:, 0] + self.first
        back = np.zeros((most, len(score), len(LABELS)), np.int8)
        for t in range(1, most):
            paths = best[:, :, None] + self.step[None]
            back[t] = paths.argmax(axis=1)
            on = (t < length)[:, None]
            back[t] = np.where(on, back[t], np.arange(len(LABELS), dtype=np.int8))
            best = np.where(on, paths.max(axis=1) + padded[:, t], best)
        label = np.zeros((most, len(score)), np.int8)
        label[-1] = best.argmax(axis=1)
        for t in range(most - 1, 0, -1):
            label[t - 1] = np.take_along_axis(back[t], label[t][:, None].astype(np.int64), 1)[:, 0]
        return [label[:n, k] for k, n in enumerate(length)]


def _labels(tokens: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[int]:
    out = [0] * len(tokens)
    for kind, start, end in spans:
        inside = [k for k, (_, a, b) in enumerate(tokens) if a >= start and b <= end]
        for n, k in enumerate(inside):
            out[k] = LABELS.index(("I-" if n else "B-") + kind)
    return out


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 150, rate: float = 0.2, decay: float = 1e-4) -> Field:
    """Maximum likelihood by Adam on all rows (text, spans) at once, forward and backward in numpy."""
    field = Field()
    rows = [(t, s) for t, s in ((tokens_of(text), spans) for text, spans in rows) if t]
    if not rows:
        return field
    named = [token_features(_gaps(tokens)) for tokens, _ in rows]
    for name in sorted({f for x in named for names in x for f in names}):
        field.place[name] = len(field.place)
    n, most, k = len(rows), max(len(t) for t, _ in rows), len(LABELS)
    length = np.array([len(t) for t, _ in rows])
    truth = np.zeros((n, most), np.int64)
    for r, (tokens, spans) in enumerate(rows):
        truth[r, : len(tokens)] = _labels(tokens, spans)
    on = np.arange(most)[None] < length[:, None]
    cell = np.array([r * most + t for r, x in enumerate(named) for t, names in enumerate(x) for _ in names])
    feature = np.array([field.place[f] for x in named for names in x for f in names])
    by_cell = np.flatnonzero(np.diff(cell, prepend=-1))  # where the features of the next token begin
    order = np.argsort(feature, kind="stable")
    by_feature = np.flatnonzero(np.diff(feature[order], prepend=-1))
    fixed_step, fixed_first = field.step, field.first
    one = np.eye(k)[truth] * on[:, :, None]
    pairs = np.einsum("rta,rtb->ab", one[:, :-1], one[:, 1:])
    weights = [np.zeros((len(field.place), k)), np.zeros((k, k)), np.zeros(k)]
    first_moment, second_moment = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def from_top(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Powers of e relative to the largest of each row, and that one."""
        top = x.max(axis=-1, keepdims=True)
        return np.exp(x - top), top

    for epoch in range(1, epochs + 1):
        emit, step, first = weights[0], weights[1] + fixed_step, weights[2] + fixed_first
        score = np.zeros((n * most, k))
        score[cell[by_cell]] = np.add.reduceat(emit[feature], by_cell)
        score = score.reshape(n, most, k)
        alpha, beta = np.zeros((n, most, k)), np.zeros((n, most, k))
        alpha[:, 0] = score[:, 0] + first
        reach = np.exp(step)
        with np.errstate(divide="ignore"):  # of a label that no path leads to
            for t in range(1, most):
                power, top = from_top(alpha[:, t - 1])
                alpha[:, t] = np.where(on[:, t, None], np.log(power @ reach) + top + score[:, t], alpha[:, t - 1])
            for t in range(most - 2, -1, -1):
                power, top = from_top(score[:, t + 1] + beta[:, t + 1])
                beta[:, t] = np.where(on[:, t + 1, None], np.log(power @ reach.T) + top, 0)
        power, top = from_top(alpha[:, -1])
        total = (np.log(power.sum(axis=-1, keepdims=True)) + top)[:, None]
        chance = np.exp(alpha + beta - total) * on[:, :, None]
        before, top_before = from_top(alpha[:, :-1])
        after, top_after = from_top(score[:, 1:] + beta[:, 1:])
        before = before * np.exp(np.minimum(top_before + top_after - total, 700)) * on[:, 1:, None]
        expected = reach * (before.reshape(-1, k).T @ after.reshape(-1, k))
        missed = (one - chance).reshape(-1, k)[cell[order]]
        slope = [np.add.reduceat(missed, by_feature), pairs - expected, (one[:, 0] - chance[:, 0]).sum(axis=0)]
        for w, g, m, v in zip(weights, slope, first_moment, second_moment, strict=True):
            g = g / n - decay * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    field.emit, field.step, field.first = weights[0], weights[1] + fixed_step, weights[2] + fixed_first
    return field


def windows(text: str) -> Iterator[list[tuple[str, int, int]]]:
    """Tokens around triggers, never across lines; windows are whole, whatever their length."""
    for line in re.finditer(r"[^\n]+", text) if "\n" in text else [re.match(r"(?s).*", text)]:
        places = [m.span() for m in _TRIGGER.finditer(text, *line.span())]
        if not places:
            continue
        tokens = tokens_of(text, *line.span())
        ends = [b for _, _, b in tokens]
        near: list[list[int]] = []
        for p, q in places:
            k, last = bisect_left(ends, p + 1), bisect_left(ends, q)
            if near and k - REACH <= near[-1][1]:
                near[-1][1] = last + REACH
            else:
                near.append([k - REACH, last + REACH])
        for a, b in near:
            yield tokens[max(0, a) : b + 1]


def plausible(kind: str, text: str) -> bool:
    """The check of an added span."""
    digits = _digits(text)
    if kind == "email":
        return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"\.|\bdot\b", text, re.I)) and text.count("\n") == 0
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and _small_parts(parts)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(digits) * 2 > len(text)
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9_+/.=-]{8,}", text)) and (bool(digits) and bool(re.search("[A-Za-z]", text)) or text.startswith(_KEY_STARTS))
    return 10 <= len(digits) <= 15 and not re.search(r"[^\W\d_]", text)


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """The field's own spans of each text, in batches of windows of like length. Windows share no tokens, so added spans never overlap."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    reached = [list(accumulate((y for _, _, y in base), max)) for base in bases]

    def free(k: int, a: int, b: int) -> bool:
        """Whether no base span of the text, which are in order of start, overlaps."""
        n = bisect_left(bases[k], b, key=lambda s: s[1])
        return not n or reached[k][n - 1] <= a

    def settle(held: list[tuple[int, list[tuple[str, int, int]]]]) -> None:
        for (k, tokens), labels in zip(held, field.decode([field.scores(_gaps(w)) for _, w in held]), strict=True):
            at = 0
            while at < len(tokens):
                label = LABELS[labels[at]]
                end = at + 1
                while label != "O" and end < len(tokens) and LABELS[labels[end]] == "I" + label[1:]:
                    end += 1
                if label != "O":
                    kind, a, b = label[2:], tokens[at][1], tokens[end - 1][2]
                    if plausible(kind, texts[k][a:b]) and free(k, a, b):
                        out[k].append((kind, a, b))
                at = end

    def settle_all(held: list[tuple[int, list[tuple[str, int, int]]]]) -> None:
        held.sort(key=lambda x: len(x[1]))
        start = 0
        for at in range(1, len(held) + 1):
            if at == len(held) or (at + 1 - start) * len(held[at][1]) > CELLS:
                settle(held[start:at])
                start = at

    held: list[tuple[int, list[tuple[str, int, int]]]] = []
    size = 0
    for k, text in enumerate(texts):
        if _TRIGGER.search(text):
            for window in windows(text):
                if window:
                    held.append((k, window))
                    size += len(window)
                if len(held) == BATCH or size > CELLS:
                    settle_all(held)
                    held, size = [], 0
    if held:
        settle_all(held)
    return out


def labelled_table(df: DataFrame | None, *, text_col: str = "text", spans_col: str = "spans", max_rows: int = MAX_LABELLED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Rows for training: of a table with spans array<struct<kind,start,end>>, at most max_rows; the built-in ones without a table."""
    if df is None:
        return [pii_examples.parse(x) for x in [*pii_examples.MARKED, *pii_examples.drawn(DRAWN)]]
    rows = df.select(F.col(text_col).alias("t"), F.col(spans_col).alias("s")).where("t is not null").limit(max_rows).collect()
    return [(r.t, [(s.kind, s.start, s.end) for s in r.s or []]) for r in rows]


@cache
def default_field() -> Field:
    """The field of the built-in table."""
    return train(labelled_table(None))


def find_pii(docs: DataFrame, *, field: Field | None = None, text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text unless named) and spans: kind, start, end (code points), base.

    Spans are in order of start, then kind. A null text is empty and has none. Whole texts are read,
    whatever their length. Repeated rows are read each by itself; an empty table gives no rows;
    columns of any name can be kept, but for one named spans, whose place the result takes.
    """
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c != "spans" and (keep_cols is not None or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in texts_of(batch).to_pylist()]
            bases = [base_spans(t) for t in texts]
            added = added_spans(texts, bases, shared.value)
            rows = []
            for base, more in zip(bases, added, strict=True):
                both = [(*s, True) for s in base] + [(*s, False) for s in more]
                both.sort(key=lambda s: (s[1], FIELD_KINDS.index(s[0])))
                rows.append([dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span_type)], ["row", "spans"])

    work, texts_of = rows_and_texts(docs, kept, text_col)
    out = work.mapInArrow(task, f"row {work.schema['row'].dataType.simpleString()}, spans {SPANS}")
    return out.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(kept)], "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def with_counts(found: DataFrame) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, n_secret and secrets; spans become a string.

    n_secret counts the secrets; they stand in secrets, all other spans in spans.
    """
    base = F.filter("spans", lambda s: s["base"])
    counted = {f"n_{k}": F.size(F.filter(base, _is(k))).cast("long") for k in KINDS}
    secret = F.filter("spans", _is("secret"))
    counted |= {"base_sha256": F.sha2(joined(base).cast("binary"), 256), "n_secret": F.size(secret).cast("long"), "secrets": joined(secret)}
    return found.withColumns(counted).withColumn("spans", joined(F.filter("spans", lambda s: s["kind"] != "secret")))
