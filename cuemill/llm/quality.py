"""Quality by hierarchical empirical Bayes: what a document says, and what its site is like.

A document's own evidence is the probability of a logistic classifier over hashed words and a few
shape figures, fitted on a bounded sample of labelled rows and calibrated by its held-out part. Hosts
and the paths below them get posteriors: the sum of their documents' probabilities as good ones out
of all, under a Beta prior whose strength is estimated from the spread between the sites (method of
moments), so that sparse sites shrink towards their host and sparse hosts towards the whole corpus.
The score of a document adds to its own log odds those of its path's other documents, relative to the
corpus: on a site of one document the score is that document's own evidence under its host's prior.

The text is read once; sites are small sums, grouped in two steps, and come back by joins that a host
with most of the rows does not hold up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.shared import keep

FEATURES = 1 << 12
FIGURES = 8
MAX_ROWS = 4000
#: Share of the sample that calibrates, and is not fitted on.
CALIBRATION = 5
EPOCHS, RATE, DECAY = 300, 0.05, 1e-3
#: Bounds of a prior's strength, in documents, and of a probability.
STRENGTH = (1.0, 1000.0)
EDGE = 1e-4
#: Words whose bucket a Python worker remembers.
REMEMBERED = 1 << 19


@cache
def _none() -> np.ndarray:
    return np.zeros(FEATURES + FIGURES, np.float32)


class Buckets(dict):
    """The feature of each word: its hash, remembered for as many words as there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        value = self[word] = crc32(word.encode()) % FEATURES
        return value


_buckets = Buckets()


def features(text: str | None) -> np.ndarray:
    """Hashed words by the square root of their share, then figures of the text's shape."""
    if not text:
        return _none()
    words = text.lower().split()
    if not words:
        return _none()
    counts = np.bincount([_buckets[w] for w in words], minlength=FEATURES).astype(np.float32)
    n, size = len(words), len(text)
    lines = text.split("\n")
    symbols = sum(map(text.count, "#%&*$|!{}<>=_~^"))
    figures = [
        np.log1p(n) / 10,
        min(1.0, size / n / 20),
        len(set(words)) / n,
        min(1.0, 4 * symbols / size),
        1 - len(set(lines)) / len(lines),
        sum(map(text.count, "0123456789")) / size,
        min(1.0, text.count("\n") / n),
        min(1.0, 10 * (text.count(".") + text.count(",")) / n),
    ]
    return np.concatenate((np.sqrt(counts / n), np.array(figures, np.float32)))


@dataclass
class Classifier:
    weight: np.ndarray
    bias: float
    scale: float  # of the log odds, from calibration
    shift: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.scale * (x @ self.weight + self.bias) + self.shift


def _logistic(x: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adam on all rows at once; both classes weigh the same."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    share = np.where(y > 0, 0.5 / max(y.mean(), EDGE), 0.5 / max(1 - y.mean(), EDGE)) / len(y)
    for k in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = np.append(x.T @ (share * (p - y)) + decay * w, (share * (p - y)).sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def fit(x: np.ndarray, y: np.ndarray) -> Classifier:
    """Fitted on four fifths; scale and shift are chosen on the last fifth (Platt)."""
    if len(y) < 10 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Classifier(np.zeros(FEATURES + FIGURES), 0.0, 0.0, float(np.log(p / (1 - p))))
    held = np.arange(len(y)) % CALIBRATION == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    w, b = _logistic(x[~held].astype(np.float64), y[~held], EPOCHS, RATE, DECAY)
    z = (x @ w + b)[held] if held.any() else x @ w + b
    t = y[held] if held.any() else y
    best, grid = None, np.geomspace(0.25, 16, 13)
    for scale in grid:
        shift = 0.0
        for _ in range(20):  # Newton's steps for the shift
            p = 1 / (1 + np.exp(-(scale * z + shift)))
            shift -= (p - t).sum() / max(1e-6, (p * (1 - p)).sum())
            shift = float(np.clip(shift, -10, 10))
        p = np.clip(1 / (1 + np.exp(-(scale * z + shift))), 1e-9, 1 - 1e-9)
        loss = -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(scale), shift)
    return Classifier(w, b, best[1], best[2])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str | None = None, max_rows: int = MAX_ROWS) -> Classifier:
    """From at most max_rows labelled documents, drawn by hash; rows without a label are no part of it.

    Without labels of both classes, the classifier gives every document the labels' own share.
    """
    own_id = label_id_col or id_col
    marked = labels.select(labels[own_id].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y is not null")
    n = marked.count()
    draw = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1 << 30))
    some = marked.where(draw < int(min(1.0, max_rows / max(1, n)) * (1 << 30))).groupBy("id").agg(F.min("y").alias("y")).limit(max_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(some), "id").select("id", "text", "y")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary()), batch.column(2)], ["id", "x", "y"])

    found = sorted(rows.mapInArrow(task, "id long, x binary, y int").limit(2 * max_rows).collect(), key=lambda r: crc32(str(r.id).encode()))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in found]) if found else np.zeros((0, FEATURES + FIGURES), np.float32)
    return fit(x, np.array([float(r.y > 0) for r in found]))


def _strength(sites: DataFrame, mean: Column, prior: Column) -> Column:
    """Documents that a prior is worth, from how much sites vary beyond chance; an aggregate.

    Of sites with n documents and mean m under prior p: (m - p)^2 is expected to be p (1 - p)
    (1 + (n - 1) r) / n, r the correlation within sites; the strength is (1 - r) / r.
    """
    chance = prior * (1 - prior)
    expected = F.sum(chance * (1 - 1 / F.col("n")))
    excess = F.sum((mean - prior) ** 2 - chance / F.col("n"))
    r = F.greatest(F.lit(1e-6), F.least(F.lit(0.999), excess / F.when(expected > 0, expected)))
    return F.coalesce(F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), (1 - r) / r)), F.lit(STRENGTH[1]))


def _posterior(good: Column, n: Column, strength: Column, prior: Column) -> Column:
    return (good + strength * prior) / (n + strength)


def posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n_path, good_path, n_host, good_host, k_host, k_path, host_post, path_post, prior) of scored (host, path, p), null-safe."""
    paths = keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    whole = hosts.agg(F.sum("n"), F.sum("good")).first()
    prior = F.lit(min(1 - EDGE, max(EDGE, (whole[1] or 0.0) / (whole[0] or 1))))
    k_host = F.lit(hosts.agg(_strength(hosts, F.col("good") / F.col("n"), prior)).first()[0])
    host = hosts.select(F.col("host").alias("h"), F.col("n").alias("n_host"), F.col("good").alias("good_host"), _posterior(F.col("good"), F.col("n"), k_host, prior).alias("host_post"))
    both = paths.join(host, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    k_path = F.lit(both.agg(_strength(both, F.col("good") / F.col("n"), F.col("host_post"))).first()[0])
    post = _posterior(F.col("good"), F.col("n"), k_path, F.col("host_post"))
    own = [F.col("n").alias("n_path"), F.col("good").alias("good_path"), "n_host", "good_host", k_host.alias("k_host"), k_path.alias("k_path")]
    return both.select("host", "path", *own, "host_post", post.alias("path_post"), prior.alias("prior"))


def score(docs: DataFrame, model: Classifier, host: Column, path: Column, *, id_col: str = "doc_id", text_col: str = "text", min_quality: float = 0.5) -> DataFrame:
    """(doc_id, host, path, p_doc, host_post, path_post, quality, keep) for every row.

    A null or wordless text has the evidence of an empty one, very long ones are read whole; null hosts
    and paths are sites of their own. Repeated rows count each and are scored alike. An empty table
    gives no rows; columns other than those named are ignored, whatever their names. keep is quality
    of min_quality or more, so that a tie is kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                odds = shared.value.log_odds(np.stack([features(t) for t in part.column(3).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.clip(1 / (1 + np.exp(-odds)), EDGE, 1 - EDGE), pa.float64())], ["doc_id", "host", "path", "p"])

    work = docs.select(docs[id_col].cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), docs[text_col].alias("text"))
    scored = keep(work.mapInArrow(task, "doc_id long, host string, path string, p double"), "document-scores")
    sites = keep(posteriors(scored), "sites").withColumnsRenamed({"host": "h", "path": "q"})
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")), "left")
    odds = lambda c: F.log(c / (1 - c))
    # What the other documents of the host and of the path say: a document's own evidence counts once.
    host_rest = _posterior(F.col("good_host") - F.col("p"), F.col("n_host") - 1, F.col("k_host"), F.col("prior"))
    path_rest = _posterior(F.col("good_path") - F.col("p"), F.col("n_path") - 1, F.col("k_path"), host_rest)
    total = odds(F.col("p")) + odds(F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), path_rest))) - odds(F.col("prior"))
    out = joined.select("doc_id", "host", "path", F.col("p").alias("p_doc"), "host_post", "path_post", (1 / (1 + F.exp(-total))).alias("quality"))
    return out.withColumn("keep", F.col("quality") >= min_quality)
