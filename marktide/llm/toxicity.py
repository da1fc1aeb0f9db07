"""Toxicity by a support vector machine over a gapped subsequence kernel, with Nystroem landmarks.

A text is read as units: white-space words, of which only letters count, so that marks and digits put between the letters
change nothing; letters that stand alone one after another are one unit. The kernel of two units sums, over all four-letter
subsequences (the ends of a unit count as letters), the product of their decayed occurrences. A subsequence may skip
letters up to a span of SPAN, which is what tolerates inserted characters. Values are scaled by the units' lengths.

The machine is trained on sentences that carry the label of their document: a unit is an example of either label, weighed
by its share of toxic and of clean sentences that hold it. Landmarks are the units most associated with either label. A
Nystroem machine is a weighted sum of kernels with landmarks, hence linear in the subsequences: it folds into one table of 32^4 weights,
and a document is scored in one vectorised pass. Its most suspicious units and its length give the score by a logistic
curve fitted on the same sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .tokens import in_small_batches

SPAN, DECAY = 6, 0.6
LETTERS = 32**4
#: Bounds of the training sample (documents of each label, those with the smallest hash of their id), of the units learned
#: from, and of the landmarks. Nothing else depends on a bound.
MAX_DOCS, MAX_UNITS, LANDMARKS = 6_000, 12_000, 160
#: A unit that no sentence holds would count as clean with this many sentences' weight, so a single toxic one is little evidence.
PRIOR = 0.25
#: Slack of the machine; unit scores below FLOOR are no evidence for a document; so many of its units count.
SLACK, FLOOR, TOP = 10.0, 0.25, 3
THRESHOLD = 0.3
_SENTENCE = re.compile(r"[.!?\n]+")


def _symbols() -> tuple[bytes, bytes]:
    """Bytes to 0 (white space), 1-26 (letters), 27-31 (parts of other letters); and the bytes that are left out."""
    table = bytearray(256)
    for b in range(97, 123):
        table[b] = table[b - 32] = b - 96
    for b in range(0x80, 0xC0):
        table[b] = 27 + b % 5
    white = set(b"\t\n\v\f\r ")
    return bytes(table), bytes(b for b in range(256) if not table[b] and b not in white)


_TABLE, _DROPPED = _symbols()


def symbols(text: str | None) -> np.ndarray:
    """The symbols of a text, with one 0 before, between and after its units."""
    raw = np.frombuffer(b" " + (text or "").encode("utf-8", "replace") + b" ", np.uint8).tobytes().translate(_TABLE, _DROPPED)
    c = np.frombuffer(raw, np.uint8)
    c = c[np.r_[True, (c[1:] != 0) | (c[:-1] != 0)]]
    if len(c) > 4:
        z = c == 0
        lone = np.zeros(len(c), bool)  # a gap between two units of one letter
        lone[2:-2] = z[2:-2] & z[:-4] & z[4:] & ~z[1:-3] & ~z[3:-1]
        c = c[~lone]
    return c


def length_norms(n: np.ndarray) -> np.ndarray:
    """The scale of units of n letters: what their kernel with themselves is if no subsequence repeats."""
    total = np.zeros(len(n))
    for s in range(3, SPAN + 1):
        total += np.maximum(n + 2 - s, 0) * ((s - 1) * (s - 2) // 2) * DECAY ** (2 * s)
    return np.sqrt(np.maximum(total, 1e-9))


def unit_sums(c: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit of c, in order: the sum of its subsequences' decayed weights over its scale, and where it starts."""
    zero = c == 0
    ends = np.flatnonzero(zero)
    if len(ends) < 2:
        return np.zeros(0), np.zeros(0, np.int64)
    of = np.cumsum(zero, dtype=np.int32)
    x = c.astype(np.int32)
    first, second, third = x << 15, x << 10, x << 5
    total = np.zeros(len(c), np.float32)
    for s in range(3, SPAN + 1):
        m = len(c) - s
        if m <= 0:
            break
        i = np.flatnonzero(of[s - 1 : s - 1 + m] == of[:m])  # all of it lies in one unit
        outer, part = first[i] + x[i + s], np.zeros(len(i), np.float32)
        for a in range(1, s - 1):
            two = outer + second[i + a]
            for b in range(a + 1, s):
                part += weights[two + third[i + b]]
        total[i] += part * np.float32(DECAY**s)
    sums = np.add.reduceat(total.astype(np.float64), ends)[:-1]
    return sums / length_norms(np.diff(ends) - 1), ends[:-1]


def subsequences(unit: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The scaled features of one unit (its symbols): their places in a table of LETTERS, and their values."""
    c = np.frombuffer(b"\0" + unit + b"\0", np.uint8).astype(np.int64)
    place, value = [], []
    for s in range(3, SPAN + 1):
        for i in range(len(c) - s):
            for a in range(1, s - 1):
                for b in range(a + 1, s):
                    place.append((c[i] << 15) + (c[i + a] << 10) + (c[i + b] << 5) + c[i + s])
                    value.append(DECAY**s)
    known, at = np.unique(np.array(place, np.int64), return_inverse=True)
    return known, (np.bincount(at, weights=value, minlength=len(known)) / length_norms(np.array([len(unit)]))).astype(np.float32)


class Model(NamedTuple):
    weights: np.ndarray  # LETTERS, of the units' machine
    bias: float
    mean: np.ndarray  # of the document features
    scale: np.ndarray
    curve: np.ndarray  # of the logistic curve, its constant last


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = SLACK, steps: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton's method; the constant is not regularised."""
    x = np.c_[z, np.ones(len(z))]
    w, ridge = np.zeros(x.shape[1]), np.r_[np.ones(z.shape[1]), 1e-6]
    weight = weight * (c * len(weight) / weight.sum())
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xa = x[on] * weight[on, None]
        grad = ridge * w - xa.T @ (y[on] * slack[on])
        step = np.linalg.solve(np.diag(ridge) + xa.T @ x[on], grad)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w, r = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(np.diag(r) + (x * (p * (1 - p) + 1e-9)[:, None]).T @ x, r * w + x.T @ (p - y))
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_units(units: list[bytes], toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
    """Units with the numbers of toxic and clean sentences that hold them: the weight table and the bias."""
    toxic, clean = toxic.astype(float), clean.astype(float)
    if not len(units) or not toxic.sum() or not clean.sum():
        return np.zeros(LETTERS, np.float32), FLOOR
    balance = clean.sum() / toxic.sum()
    for_, against = toxic * balance, clean + PRIOR * balance
    lean = (for_ - against) / (for_ + against)
    lift = np.maximum(lean, 0) * np.sqrt(toxic) - np.maximum(-lean, 0) * np.sqrt(clean / balance)
    order = np.lexsort((np.arange(len(units)), -lift))
    half = LANDMARKS // 2
    chosen = [k for k in dict.fromkeys([*order[:half], *order[::-1][:half]]) if len(units[k]) > 1]
    phi = [subsequences(units[k]) for k in chosen]
    line, table = np.frombuffer(b"\0" + b"".join(u + b"\0" for u in units), np.uint8), np.zeros(LETTERS, np.float32)
    kernel = np.empty((len(units), len(chosen)))
    for k, (place, value) in enumerate(phi):
        table[place] = value
        kernel[:, k] = unit_sums(line, table)[0]
        table[place] = 0
    values, vectors = np.linalg.eigh(kernel[chosen] + 1e-3 * np.eye(len(chosen)))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    z = kernel @ root
    weight = np.sqrt(for_ + against)
    w, bias = _svm(np.r_[z, z], np.r_[np.ones(len(z)), -np.ones(len(z))], np.r_[weight * (1 + lean), weight * (1 - lean)] / 2 + 1e-9)
    for (place, value), x in zip(phi, root @ w, strict=True):
        table[place] += value * np.float32(x)
    return table, bias


def document_features(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """For each text: the TOP largest unit scores (FLOOR at least) and the logarithm of its number of units."""
    parts = [symbols(t) for t in texts]
    out = np.full((len(texts), TOP + 1), FLOOR)
    out[:, TOP] = 0
    if not parts:
        return out
    lengths = np.array([len(p) - 1 for p in parts])
    start = np.r_[0, np.cumsum(lengths)]
    score, at = unit_sums(np.concatenate([*(p[:-1] for p in parts), np.zeros(1, np.uint8)]), weights)
    doc = np.searchsorted(start, at, side="right") - 1
    out[:, TOP] = np.log1p(np.bincount(doc, minlength=len(texts)))
    score = score + bias
    high = np.flatnonzero(score > FLOOR)
    order = high[np.lexsort((-score[high], doc[high]))]
    place = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    best = place < TOP
    out[doc[order[best]], place[best]] = np.minimum(score[order[best]], 3.0)
    return out


def probabilities(features: np.ndarray, model: Model) -> np.ndarray:
    x = (features - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.curve[:-1] + model.curve[-1], -30, 30)))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: dict[bytes, list[int]] = {}
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for sentence in _SENTENCE.split(text or ""):
                for u in {x for x in symbols(sentence).tobytes().split(b"\0") if x}:
                    found.setdefault(u, [0, 0])[int(toxic)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), *(pa.array([v[k] for v in found.values()], pa.int64()) for k in (1, 0))], names=["unit", "toxic", "clean"])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [probabilities(document_features(texts, model.weights, model.bias), model) for _, texts in in_small_batches(b.column(2).to_pylist())]
            score = np.concatenate(p) if p else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def _features(weights: np.ndarray, bias: float):
    names = [f"f{k}" for k in range(TOP + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = document_features(b.column(0).to_pylist(), weights, bias)
            yield pa.RecordBatch.from_arrays([*(pa.array(f[:, k], pa.float64()) for k in range(TOP + 1)), b.column(1)], names=[*names, "toxic"])

    return run


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): the model, from at most MAX_DOCS documents of each label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out(F.col("label_id"))).withColumn("order", F.xxhash64("label_id"))
    picked = known.where("toxic = 1").orderBy("order", "label_id").limit(MAX_DOCS).union(known.where("toxic = 0").orderBy("order", "label_id").limit(MAX_DOCS))
    picked = F.broadcast(saved(picked.select("label_id", "toxic"), "toxic-labels"))  # at most 2 * MAX_DOCS short rows
    sample = saved(docs.join(picked, F.col("doc_id") == F.col("label_id")).select("text", "toxic"), "toxic-sample")
    counts = sample.mapInArrow(_count_units, "unit binary, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = saved(counts.where("toxic > 0 or clean > 1"), "toxic-units")
    most = [counts.orderBy(F.desc(c), "unit").limit(MAX_UNITS // 2) for c in ("toxic", "clean")]
    rows = most[0].union(most[1]).distinct().toPandas().sort_values("unit")
    weights, bias = fit_units([bytes(u) for u in rows["unit"]], rows["toxic"].to_numpy(), rows["clean"].to_numpy())
    schema = ", ".join([*(f"f{k} double" for k in range(TOP + 1)), "toxic int"])
    f = sample.mapInArrow(_features(weights, bias), schema).toPandas().to_numpy(dtype=float)
    if not len(f) or f[:, -1].min() == f[:, -1].max():
        share = f[:, -1].mean() if len(f) else 0.0
        return Model(weights, bias, np.zeros(TOP + 1), np.ones(TOP + 1), np.r_[np.zeros(TOP + 1), 20 * share - 10])
    f = f[np.lexsort(f.T)]
    mean, scale = f[:, :-1].mean(axis=0), np.maximum(f[:, :-1].std(axis=0), 0.25)
    return Model(weights, bias, mean, scale, _logistic((f[:, :-1] - mean) / scale, f[:, -1]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts have no unit and get the score of a text without any. Labels other than 0 and 1 and labels of
    unknown documents have no effect; of conflicting labels toxic counts. Without labels of both kinds all scores are
    equal. Repeated rows are scored each; an empty table gives an empty result; other input columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(rows, labels)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
