"""Language identification by error-correcting output codes.

Each language has a codeword; each bit of the code is a binary classifier over hashed byte n-grams
(of one to three bytes, of lower-cased letters). Decoding is loss-weighted: the loss of each bit counts by how well
classifiers of that bit told the language on rows that they were not fitted on, and the language with the
smallest loss is chosen. A document is ambiguous if the second smallest is nearly as small.

The classifiers are fitted (ridge regression in its dual form) on at most ``max_rows`` labelled rows,
drawn by hash evenly over the languages; counts of labels cover all rows. One task fits them: at most ``max_rows``
times ``FEATURES`` floats of 4 bytes, 32 MB by default. Only the model reaches the driver.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import rows_and_texts, take_over

FEATURES = 4096
MAX_ROWS = 2000
RIDGE = 1.0
#: Codes for more languages than this are drawn, not exhaustive; so many bits for each doubling.
EXHAUSTIVE, BITS_A_DOUBLING = 7, 12
#: Loss gap, of the mean loss per bit, under which a document is ambiguous.
AMBIGUOUS = 0.02
#: Parts of the sample that are left out in turn, to weigh the bits and to calibrate the score.
FOLDS = 5
#: Softness of the score: the likeliest of these on rows left out.
SHARPNESS = (1.0, 2.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0)
UNKNOWN = "und"
#: Bytes of a text that are counted at once.
AT_ONCE = 1 << 20

_OUT = ["lang_pred", "score", "ambiguous"]
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_SPACES = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is a letter by its Unicode category; what only counts, as '½', 'Ⅷ' or '²', is none."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed n-grams: a vector of length 1, or zeros."""
    raw = b" " + text.lower().encode().translate(_SPACES) + b" "
    counts = np.zeros(FEATURES, np.int64)
    for at in range(0, len(raw), AT_ONCE):
        a = np.frombuffer(raw[max(0, at - 2) : at + AT_ONCE], np.uint8).astype(np.uint32)
        skip = min(at, 2)
        two = a[:-1] * np.uint32(256) + a[1:]
        three = two[:-1] * np.uint32(256) + a[2:]
        for gram, first in ((a, skip), (two + np.uint32(1 << 25), max(0, skip - 1)), (three + np.uint32(1 << 26), 0)):
            counts += np.bincount(gram[first:] * np.uint32(2654435761) >> np.uint32(20), minlength=FEATURES)
    total = counts.sum()
    return np.sqrt(counts / max(1, total)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1. Few languages: every split in two. More: the best of drawn codes."""
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1)) if n > 1 else np.array([1])
        return np.where(splits[None, :] >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    drawn, best = np.random.default_rng(n), (-1, None)
    bits = int(BITS_A_DOUBLING * np.ceil(np.log2(n)))
    for _ in range(200):
        code = np.where(drawn.random((n, bits)) < 0.5, -1.0, 1.0)
        near = (code @ code.T - 2 * bits * np.eye(n)).max()
        if -near > best[0] or best[1] is None:
            best = (-near, code)
    return best[1]


def weighted_losses(margin: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted exponential loss of each language, rows by languages, from the margins of rows by bits."""
    return np.einsum("nlb,lb->nl", np.exp(-np.clip(margin, -2, 2)[:, None, :] * code[None]), weight)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages by bits, -1 and 1
    weight: np.ndarray  # languages by bits, rows sum to 1
    linear: np.ndarray  # features by bits
    bias: np.ndarray
    sharpness: float = 6.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted exponential loss of each language, rows by languages."""
        return weighted_losses(x @ self.linear + self.bias, self.code, self.weight)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
        rows = [k for k, t in enumerate(texts) if t is not None and has_letter(t)]
        if not rows or not self.languages:
            return out
        loss = self.losses(np.stack([features(texts[k]) for k in rows]))
        order = np.argsort(loss, axis=1, kind="stable")
        share = np.exp(-self.sharpness * (loss - loss.min(axis=1, keepdims=True)))
        best = 1 / share.sum(axis=1)
        for n, k in enumerate(rows):
            second = loss[n, order[n, 1]] if len(self.languages) > 1 else np.inf
            out[k] = (self.languages[order[n, 0]], float(best[n]), bool(second - loss[n, order[n, 0]] < AMBIGUOUS))
        return out


def _linear(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of ridge regression, all bits at once. Only the products of rows are doubles: the rows are many times as long."""
    mean = x.mean(axis=0, dtype=np.float64)
    z = x - mean.astype(np.float32)
    gram = (z @ z.T).astype(np.float64)
    gram[np.diag_indices(len(z))] += RIDGE
    linear = z.T @ np.linalg.solve(gram, y - y.mean(axis=0)).astype(np.float32)
    return linear, y.mean(axis=0) - mean @ linear


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """A model of the rows; each fifth of them is judged by classifiers of the other four fifths, for weights and sharpness."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    own = np.array([languages.index(v) for v in labels])
    y, margin = code[own], np.zeros((len(x), code.shape[1]))
    part = np.arange(len(x)) % FOLDS
    for k in range(FOLDS if len(x) > FOLDS else 0):
        linear, bias = _linear(x[part != k], y[part != k])
        margin[part == k] = x[part == k] @ linear + bias
    right = (margin * y > 0).astype(float)
    # How much better than chance each bit is on each language; a bit that is no better still counts a little.
    weight = np.maximum(np.stack([right[own == k].mean(axis=0) for k in range(len(languages))]) - 0.5, 0) + 1e-3
    weight /= weight.sum(axis=1, keepdims=True)
    loss = weighted_losses(margin, code, weight)
    likely = [np.mean(s * loss[np.arange(len(own)), own] + np.log(np.exp(-s * loss).sum(axis=1))) for s in SHARPNESS]
    linear, bias = _linear(x, y)
    return Model(languages, code, weight, linear.astype(np.float32), bias.astype(np.float32), SHARPNESS[int(np.argmin(likely))])


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the identifier as text is divisible by 5; a null one counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """A model from the rows with a language. No such rows: one that knows no language."""
    rows = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in labelled.select(labelled[lang_col].alias("lang")).where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((FEATURES, 0)), np.zeros(0))
    each = max(1, max_rows // len(counts))
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    draw = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / (1 << 30)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        for batch in batches:
            made = [features(x.as_py()).tobytes() for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *batch.columns[1:]], ["x", "lang", "draw", "tie"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        x, labels = np.empty((max_rows, FEATURES), np.float32), []
        for batch in batches:
            for k in range(batch.num_rows):
                x[len(labels)] = np.frombuffer(batch.column(0)[k].as_buffer(), np.float32)
                labels.append(batch.column(1)[k].as_py())
            del batch  # else the last one stays while the model is fitted
        if labels:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(fit(x[: len(labels)], labels)))], pa.binary())], ["model"])

    drawn = rows.where(draw < share[F.col("lang")]).select("text", "lang", draw.alias("draw"), F.xxhash64("text").alias("tie"))
    vectors = drawn.mapInArrow(task, "x binary, lang string, draw double, tie long")
    # In an order of its own, so that a task that is done again fits the same model.
    model = vectors.orderBy("draw", "tie", "lang").limit(max_rows).select("x", "lang").mapInArrow(fitted, "model binary").collect()
    return Model(**pickle.loads(model[0].model)) if model else Model([], np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((FEATURES, 0)), np.zeros(0))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text unless named) with lang_pred, score (0 to 1) and ambiguous.

    A null text, or one with no letter, is `und` with score 0, as is every text if the model knows no
    language. Texts of any length are read whole. Of languages that tie, the first by name is given,
    as ambiguous. Repeated rows are judged alike; an empty table gives no rows; columns of any name
    can be kept, but for those that are named like one of the three, whose place these take.
    """
    kept = [c for c in (docs.columns if keep_cols is None else keep_cols) if c not in _OUT and (keep_cols is not None or c != text_col)]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over("language")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                langs, scores, vague = zip(*shared.value.predict(texts_of(part).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(vague)], ["row", *_OUT])

    work, texts_of = rows_and_texts(docs, kept, text_col)
    out = work.mapInArrow(task, "row " + work.schema["row"].dataType.simpleString() + ", lang_pred string, score double, ambiguous boolean")
    return out.select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(kept)], *_OUT)
