"""Quality classifier: Bradley-Terry scores learned from preference pairs, cut at a score quantile.

A document's latent score is linear in counts of its text (signs, capitals,
digits, repeated words, line shapes).  Pairs of a document labelled 1 and one
labelled 0 are preferences; the weights minimise the logistic loss on the
difference of their features.  The threshold is the quantile of the scores of
all labelled documents that leaves as many of them below as are labelled 0;
the reported score is the logistic of the distance to it, shifted to ``cut``
there.

The weights are fitted on a bounded sample of labelled rows (``train_docs``, by
a hash of doc_id); the threshold is an exact quantile over all of them.
Features and scores are one pass without a shuffle over whole texts.

Defined results: NULL and empty texts have all counts zero and get the score
of that; labels other than 0 and 1 are ignored; several labels of a doc_id
count as their mean, rounded; without labels of both kinds every score is
``cut``; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlake.llm.common import slices, written
from tremorlake.operators.quantiles import exact_quantiles

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_BLANK = b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 256))
#: signs that are counted one by one
_SIGNS = b"!|#$%&*<>{}[]=_/@+;:()\"'?.,-"


def features(text: bytes | None) -> list[float]:
    """Counts of a whole text as rates."""
    data = text or b""
    size, words = len(data), data.split()
    n = len(words)
    if not n:
        return [0.0] * N_FEATURES
    count = lambda chars: size - len(data.translate(None, chars))
    upper, lower, digit, blank, high = (count(c) for c in (_UPPER, _LOWER, _DIGIT, _BLANK, _HIGH))
    signs = size - upper - lower - digit - blank - high
    lines = data.split(b"\n")
    again = sum(map(eq, words, words[1:]))
    distinct = len(set(words))
    ended = sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines)
    letters = max(1, upper + lower + high)
    rates = [upper / letters, digit / size, signs / size, high / size, again / n, 1 - distinct / n,
             1 - len(set(lines)) / len(lines), 1 - ended / len(lines), len(lines) / n]
    rates += [min(1.0, data.count(s) / n) for s in (bytes([c]) for c in _SIGNS)]
    return [np.log1p(n), (size - blank) / n / 10, 1 / n, *rates, *(r ** 0.5 for r in rates),
            float(again / n > 0.2), float(upper / letters > 0.3), float(signs / n > 0.6)]


N_FEATURES = 0
N_FEATURES = len(features(b"a"))


@dataclass
class PairwiseModel:
    """Latent score ``x . weights``; ``threshold`` is its cut, reported as ``cut``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(self.latent(x) - self.threshold + np.log(self.cut / (1 - self.cut)), -60, 60)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int, ridge: float, cut: float, rounds: int = 30) -> PairwiseModel:
    """Bradley-Terry weights by Newton steps on the logistic loss of preference pairs (label 1 over label 0).

    The threshold is that of the rows of ``x``.
    """
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    model = PairwiseModel(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(N_FEATURES), 0.0, cut)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if len(good) and len(bad):
        total = min(pairs, len(good) * len(bad))
        z = np.clip((x - model.mean) / model.scale, -8, 8)
        w = model.weights
        for _ in range(rounds):
            grad, hess = ridge * w, ridge * np.eye(len(w))
            for a in range(0, total, 20_000):  # a few megabytes of differences at a time
                k = np.arange(a, min(total, a + 20_000))
                # every document of the rarer label meets many others; the shift makes each pass pair them anew
                diff = z[good[(k + k // len(good)) % len(good)]] - z[bad[k % len(bad)]]
                p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))  # probability of the wrong order
                grad = grad - diff.T @ p / total
                hess = hess + (diff * (p * (1 - p))[:, None]).T @ diff / total
            step = np.linalg.solve(hess, grad)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        model.weights = w
        latent = np.sort(model.latent(x))
        below = len(bad)
        model.threshold = float((latent[below - 1] + latent[min(below, len(latent) - 1)]) / 2)
    return model


def _with_features(docs: DataFrame, keep: list[str], make, name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """Columns ``keep`` plus ``make(features of the whole text)`` in one pass."""
    keep = [c for c in keep if c != name]
    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("binary").alias("__llm_text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, T.DataType.fromDDL(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = np.array([features(t.as_py()) for t in b.column(b.num_columns - 1)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(make(x), arrow)], schema.fieldNames())

    return chosen.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 30_000, pairs: int = 200_000, ridge: float = 1e-3,
          cut: float = 0.3) -> PairwiseModel:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    The weights see about ``train_docs`` labelled rows (a hash of doc_id at a
    rate that follows from their number); this bounds what is broadcast to
    find their texts and what reaches the driver.  The threshold sees all.
    """
    known = (labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL")
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.round(F.avg("quality")).cast("int").alias("y")))
    count = known.count()
    rate = min(1.0, train_docs / max(1, count))
    draw = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text") \
        .join(F.broadcast(known.filter(draw < rate)), "id")
    rows = _with_features(sample, ["id", "y"], lambda x: list(x), "x", "array<double>", pa.list_(pa.float64()))
    got = rows.select("id", "y", "x").toArrow().sort_by("id").combine_chunks()
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    model = fit_pairs(x, got.column("y").to_numpy(), pairs, ridge, cut)
    model.threshold = _threshold(docs, known, model)
    return model


def _threshold(docs: DataFrame, known: DataFrame, model: PairwiseModel) -> float:
    """Latent score below which as many labelled documents lie as are labelled 0, half way to the next; else 0.

    Latent scores are joined with the labels, not the texts: two numbers a document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    latent = _with_features(texts, ["id"], model.latent, "latent", "double", pa.float64())
    rated = written(latent.join(known, "id").select("latent", "y"), "quality-latent")
    n, below = rated.agg(F.count(F.lit(1)), F.count(F.when(F.col("y") == 0, 1))).first()
    if not 0 < below < n:
        return 0.0
    return exact_quantiles(rated, ["latent"], [(below - 0.5) / (n - 1)]).first()["value"]


def score(docs: DataFrame, model: PairwiseModel, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus ``score`` (which replaces a column of that name)."""
    return _with_features(docs, keep, model.score, "score", "double", pa.float64())
