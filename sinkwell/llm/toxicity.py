"""Toxicity by cumulative-link ordinal regression.

Severity grades 0 < 1 < ... < K have K ordered thresholds.  P(grade > j) = sigmoid(w . x - t_j) with one weight vector w shared
by all thresholds, over sparse text features (hashed words that occur, with log counts).  The weights are fitted by proximal
gradient steps with an L1 penalty, so words that carry nothing get a weight of exactly 0.  The result is the expected
severity, the sum of P(grade > j), with the most probable grade.

The classifier is fitted on about ``sample`` labels at most (a documented bound), drawn by hash of the id from the distinct (id, grade)
rows, each with one text; so the broadcast ids and what reaches the driver, feature codes and grades, are bounded however labels or
documents crowd on an id.  The fit takes a bounded number of rounds.

Defined cases: a null or empty text has no features and gets the severity of the thresholds alone; labels with a null grade or id
are not fitted on; different grades of one document are all fitted on, equal ones once; of rows that share a doc_id the least text is
fitted on; a table without labels gives severity 0; rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, unit
from .groups import ship

BITS = 18
SAMPLE = 8000
PENALTY = 5e-5
ROUNDS = 200
WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and 1 + log of their counts."""
    words = WORD.findall((text or "").lower())
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) >> (64 - BITS) for w in words), np.int64, len(words))
    at, count = np.unique(code, return_counts=True)
    return at, 1 + np.log(count)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Model:
    at: np.ndarray  # codes with a weight, ascending
    weight: np.ndarray
    thresholds: np.ndarray

    def exceed(self, text: str | None) -> np.ndarray:
        """P(grade > j) for each threshold."""
        at, x = features(text)
        place = np.searchsorted(self.at, at)
        place[place == len(self.at)] = 0
        known = self.at[place] == at if len(self.at) else np.zeros(len(at), bool)
        return _sigmoid((self.weight[place[known]] * x[known]).sum() - self.thresholds)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grade: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> Model:
    """Accelerated proximal gradient on the likelihood of the cumulative-link model."""
    n, k = len(rows), int(grade.max(initial=0))
    row = np.repeat(np.arange(n), [len(a) for a, _ in rows])
    codes, col = np.unique(np.concatenate([a for a, _ in rows]) if n else np.empty(0, np.int64), return_inverse=True)
    value = np.concatenate([x for _, x in rows]) if n else np.empty(0)
    w = np.zeros(len(codes))
    share = np.array([np.clip((grade > j).mean(), 1e-6, 1 - 1e-6) for j in range(k)])
    t = np.log((1 - share) / share)
    momentum_w, momentum_t, a, last = w.copy(), t.copy(), 1.0, np.inf
    step = 1.0

    def scores(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[col], n) if len(codes) else np.zeros(n)

    def loss_of(z: np.ndarray, t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cum = np.concatenate([np.ones((n, 1)), _sigmoid(z[:, None] - t[None, :]), np.zeros((n, 1))], axis=1)
        p = np.maximum(cum[np.arange(n), grade] - cum[np.arange(n), grade + 1], 1e-12)
        return -np.log(p).mean(), cum, p

    z = momentum_z = np.zeros(n)  # scores are linear in the weights, so those of the momentum need no pass of their own
    for _ in range(rounds if k else 0):
        loss, cum, p = loss_of(momentum_z, momentum_t)
        slope = cum * (1 - cum)
        upper, lower = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        dz = -(upper - lower) / p / n
        gw = np.bincount(col, value * dz[row], len(codes))
        gt = np.array([(np.where(grade == j + 1, upper / p, 0) - np.where(grade == j, lower / p, 0)).sum() / n for j in range(k)])
        while True:
            new_w = momentum_w - step * gw
            new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
            new_t = np.maximum.accumulate(momentum_t - step * gt)
            new_z = scores(new_w)
            d = ((new_w - momentum_w) ** 2).sum() + ((new_t - momentum_t) ** 2).sum()
            bound = loss + (gw * (new_w - momentum_w)).sum() + (gt * (new_t - momentum_t)).sum() + d / (2 * step)
            now = loss_of(new_z, new_t)[0]
            if now <= bound + 1e-12 or step < 1e-6:
                break
            step /= 2
        total = now + penalty * np.abs(new_w).sum()
        next_a = 1.0 if total > last else (1 + np.sqrt(1 + 4 * a * a)) / 2
        pull = 0.0 if total > last else (a - 1) / next_a
        momentum_w, momentum_t = new_w + pull * (new_w - w), np.maximum.accumulate(new_t + pull * (new_t - t))
        momentum_z = new_z + pull * (new_z - z)
        w, t, z, a = new_w, new_t, new_z, next_a
        if abs(last - total) < 1e-9:
            break
        last, step = total, step * 1.1
    keep = w != 0
    return Model(codes[keep], w[keep], t)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in rows], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in rows], pa.binary())], ["grade", "at", "x"])


def fit(docs: DataFrame, labels: DataFrame, grade: Column, sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """Learn from the documents that ``labels`` (doc_id and what ``grade`` reads) covers."""
    small_batches(docs.sparkSession)
    known = labels.select("doc_id", grade.cast("long").alias("grade")).filter("doc_id is not null and grade is not null").distinct()
    n = known.count()
    chosen = known.filter(unit(F.xxhash64("doc_id", F.lit(8))) < sample / max(n, 1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("grade", "text")
    got = sorted(rows.mapInArrow(_code, "grade long, at binary, x binary").collect(), key=lambda r: (r["grade"], r["at"], r["x"]))
    data = [(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(np.float64)) for r in got]
    return fit_ordinal(data, np.array([r["grade"] for r in got], np.int64), penalty)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            severity, grade, toxic = [], [], []
            for text in b.column(1).to_pylist():
                p = model.exceed(text)
                severity.append(float(p.sum()))
                grade.append(int(np.argmax(np.concatenate(([1.0], p)) - np.concatenate((p, [0.0])))))
                toxic.append(bool(len(p) and p[0] >= 0.5))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic, pa.bool_())], ["doc_id", "severity", "grade", "toxic"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (expected grade), grade (most probable) and toxic (P(grade > 0) >= 1/2)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, severity double, grade int, toxic boolean")


ship(__name__)
