"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight per hashed token, shared by all grades, gives a text its score s; ordered thresholds t1 < t2 < ... turn it into
P(grade >= k) = 1 / (1 + exp(t_k - s)). Outputs are the expected grade and the tail probability of the top grade.

Tokens are A-Z lower-cased words (letters, digits, non-ASCII) and their first 4 and 5 bytes, runs of other visible
characters, whether these are joined to a word, and that a word stands REPEATS times in a row; each counts once per text.
Weights are evidence against a text, never for it (w <= 0), so a long text cannot outweigh what a few words show and a
text without known defects has the grade of clean ones. Fitting takes at most MAX_TRAIN rated
documents, first by a hash; tokens are screened by how far their document frequency departs between grades, and the
weights of those that stay are fitted by full-batch gradient steps with an L2 penalty. Of near copies of equal grade
(two equal neighbours among their MinHash values) only the first counts: copies repeat chance tokens, which would
pass the screen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import SIGNATURE, _settle, _signatures, shingle_sets
from .textvec import ALNUM, BYTE_VALUE_LOWER, NONSPACE, chunks, hash_ranges, mix, runs

BITS = 22
REPEATS = 6
MAX_TRAIN = 8_000
#: A token stays if it is in MIN_DOCS texts and its frequency departs by MIN_Z standard errors.
MIN_DOCS, MIN_Z = 5, 6.0
STEPS, RATE, PENALTY = 500, 0.4, 1e-5
#: Share of the rated documents of the top grade that selection may lose.
LOST = 0.005


def token_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every token of the texts."""
    found, at = [], []

    def add(starts: np.ndarray, hashes: np.ndarray) -> None:
        found.append(hashes >> np.uint64(64 - BITS))
        at.append(starts)

    s, e = runs(ALNUM[data], offs)
    words = hash_ranges(data, s, e, BYTE_VALUE_LOWER)
    add(s, words)
    for k in (4, 5):
        long = e - s > k
        add(s[long], mix(hash_ranges(data, s[long], s[long] + k, BYTE_VALUE_LOWER) + np.uint64(10 + k)))
    same = np.r_[0, np.cumsum(words[1:] == words[:-1])] if len(words) else np.zeros(0, np.int64)
    again = np.flatnonzero(same[REPEATS - 1 :] - same[: max(0, len(words) - REPEATS + 1)] == REPEATS - 1) + REPEATS - 1
    add(s[again], np.full(len(again), mix(np.array([101], np.uint64))[0]))
    s2, e2 = runs(NONSPACE[data] & ~ALNUM[data], offs)
    marks = hash_ranges(data, s2, e2, BYTE_VALUE_LOWER)
    add(s2, mix(marks + np.uint64(1)))
    joined = np.zeros(len(s2), bool)
    if len(s2):
        joined = (s2 > 0) & ALNUM[data[np.maximum(s2 - 1, 0)]]
    add(s2[joined], mix(marks[joined] + np.uint64(2)))
    place = np.concatenate(at)
    return np.concatenate(found).astype(np.int64), np.searchsorted(offs, place, side="right") - 1


def _distinct(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << BITS) | bucket)
    return key & ((1 << BITS) - 1), key >> BITS


@dataclass
class OrdinalModel:
    bucket: np.ndarray  # sorted, of the tokens with a weight
    weight: np.ndarray
    thresholds: np.ndarray  # ascending
    least_tail: float = 0.5  # a text below it is not of the top grade

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        bucket, row = token_buckets(data, offs)
        if not len(self.bucket):
            return np.zeros(len(offs) - 1)
        i = np.minimum(np.searchsorted(self.bucket, bucket), len(self.bucket) - 1)
        own = self.bucket[i] == bucket
        bucket, row = _distinct(bucket[own], row[own])
        return np.bincount(row, self.weight[np.searchsorted(self.bucket, bucket)], minlength=len(offs) - 1).astype(np.float64)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def loss_and_gradient(w: np.ndarray, t: np.ndarray, row: np.ndarray, col: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades with its penalty, and its gradient by weights and thresholds.

    (row, col): text and weight of each token that has one.
    """
    s = np.bincount(row, w[col], minlength=len(grades))
    upper = np.concatenate([np.ones((len(grades), 1)), 1 / (1 + np.exp(np.clip(t[None, :] - s[:, None], -40, 40))), np.zeros((len(grades), 1))], axis=1)
    i = np.arange(len(grades))
    p = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-12)
    slope = upper * (1 - upper)
    gs = (slope[i, grades] - slope[i, grades + 1]) / p  # of ln p by the score
    gw = -np.bincount(col, gs[row], minlength=len(w)) / len(grades) + PENALTY * w
    gt = np.array([(np.where(grades == k, slope[:, k] / p, 0) - np.where(grades == k - 1, slope[:, k] / p, 0)).mean() for k in range(1, len(t) + 1)])
    return float(-np.log(p).mean() + PENALTY * (w * w).sum() / 2), gw, gt


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """rows: the distinct buckets of each text; grades: 0, 1, ... of each."""
    top = int(grades.max()) if len(grades) else 1
    none = OrdinalModel(np.zeros(0, np.int64), np.zeros(0), np.arange(1, max(top, 1) + 1) - 1.5)
    if len(rows) < 2 or len(np.unique(grades)) < 2:
        return none
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    bucket, col = np.unique(np.concatenate(rows), return_inverse=True)
    df = np.bincount(col, minlength=len(bucket)).astype(float)
    z = np.zeros(len(bucket))
    for k in range(1, top + 1):  # for each cut between grades
        above = grades >= k
        for part in (np.ones(len(rows), bool), grades >= k - 1):  # against all below, and against the grade below
            n1, n0 = (above & part).sum(), (~above & part).sum()
            if n1 and n0:
                a = np.bincount(col, (above & part)[row], minlength=len(bucket)) / n1
                b = np.bincount(col, (~above & part)[row], minlength=len(bucket)) / n0
                p = (a * n1 + b * n0) / (n1 + n0)
                z = np.maximum(z, np.abs(a - b) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0)))
    stay = (df >= MIN_DOCS) & (z >= MIN_Z)
    if not stay.any():
        return none
    own = stay[col]
    row, col, bucket = row[own], (np.cumsum(stay) - 1)[col[own]], bucket[stay]
    w = np.zeros(len(bucket))
    share = np.array([(grades >= k).mean() for k in range(1, top + 1)])
    t = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for step in range(1, STEPS + 1):
        _, gw, gt = loss_and_gradient(w, t, row, col, grades)
        mw, vw, mt, vt = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mt + 0.1 * gt, 0.99 * vt + 0.01 * gt**2
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w = np.minimum(w - RATE * (mw / a) / (np.sqrt(vw / b) + 1e-8), 0.0)
        t = np.maximum.accumulate(t - RATE * (mt / a) / (np.sqrt(vt / b) + 1e-8))
        t += np.arange(len(t)) * 1e-6
    model = OrdinalModel(bucket, w, t)
    best = model.tails(np.bincount(row, w[col], minlength=len(rows)))[grades == top, -1]
    model.least_tail = float(min(max(np.quantile(best, LOST), 0.5), 0.98)) if len(best) else 0.5
    return model


def one_of_copies(signatures: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Places of the texts that stay: the first of each group of near copies and grade."""
    label = np.arange(len(grades))
    for j in range(0, 32, 2):
        key = mix(signatures[:, j].astype(np.uint64) << np.uint64(32) | signatures[:, j + 1].astype(np.uint64) << np.uint64(8) | grades.astype(np.uint64))
        _, first, own = np.unique(key, return_index=True, return_inverse=True)
        _settle(label, np.arange(len(grades)), first[own])
    return np.flatnonzero(label == np.arange(len(grades)))


def fit_quality(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> OrdinalModel:
    """A model of ratings(id_col, grade), from at most max_train rated ids.

    Null grades and ids are left out; of an id that is rated more than once the lowest grade counts, of one that has several
    texts the one of the smallest hash. A null text is empty. Empty tables give a model without weights.
    """
    known = ratings.where("grade IS NOT NULL").groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").cast("int").alias("grade"))
    some = known.orderBy(F.xxhash64(F.lit("rating"), "_id"), "_id").limit(max_train)
    rated = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "_id")
    rated = rated.groupBy("_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text an id, on the executors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(2)):
                bucket, row = _distinct(*token_buckets(data, offs))
                parts = np.split(bucket.astype(np.uint32), np.searchsorted(row, np.arange(1, j - i)))
                sig = _signatures(*shingle_sets(data, offs, 5))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j].cast(pa.string()), b.column(1)[i:j], pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["id", "grade", "buckets", "sig"],
                )

    rows = sorted(rated.mapInArrow(run, "id string, grade int, buckets binary, sig binary").collect())  # one row an id, so max_train at most
    if not rows:
        return fit_ordinal([], np.zeros(0, np.int64))
    grades = np.array([r["grade"] for r in rows], np.int64)
    stay = one_of_copies(np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, SIGNATURE), grades)
    return fit_ordinal([np.frombuffer(rows[i]["buckets"], np.uint32).astype(np.int64) for i in stay], grades[stay])


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least_tail: float | None = None) -> DataFrame:
    """For each row of docs: id_col, score, expected_grade, tail (P of the top grade), kept (tail >= least_tail,
    by default the model's own, which loses a share LOST of the rated documents of the top grade).

    A null text is empty: its score is 0, so it gets the grades of a text without known tokens. Repeated rows get equal
    rows, other columns are never read, and an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    least = model.least_tail if least_tail is None else least_tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                s = shared.value.scores(data, offs)
                tails = shared.value.tails(s)
                last = tails[:, -1]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(s), pa.array(tails.sum(axis=1)), pa.array(last), pa.array(last >= least)], ["id", "score", "expected_grade", "tail", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {id_type}, score double, expected_grade double, tail double, kept boolean").withColumnRenamed("id", id_col)
