"""Target-distribution importance resampling over hashed n-gram features, with CRC-32 combination instead of n-gram strings.

A feature is a run of n consecutive words joined by one space, its bucket the CRC-32 of its bytes modulo the number of
buckets. CRC-32 is linear over GF(2): crc(AB) = Z^len(B) crc(A) xor crc(B), where Z appends a zero byte. The CRC of each
word is computed once; runs grow by one word at a time with the powers of Z, so no n-gram is ever put together as bytes.

Two passes over the texts: one sums the buckets of the corpus and of the target, one scores each document. What leaves
the first is a row per task and bucket at most. Documents are drawn by the exponential-race form of weighted sampling
without replacement (a Gumbel noise is added to the weight); a histogram of whole scores, whose range is bounded, tells
where the last one drawn must lie, and only what lies above is range-sorted and numbered.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .textvec import ALNUM, chunks, runs

BUCKETS = 10_000
#: Words of up to so many bytes go through the CRC together, a byte of each at a time; longer ones one by one.
TOGETHER = 48
_U4 = np.uint32
#: Width of the bins of the histogram of scores.
BIN = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=_U4)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ _U4(0xEDB88320), t >> 1).astype(_U4)
    return t


TABLE = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _as_bytes(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 bit matrix (its columns as integers) as four tables of 256 products, one for each byte of the argument."""
    out = np.zeros((4, 256), _U4)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, columns[8 * k + bit], 0).astype(_U4)
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> _U4(8) & 255] ^ tables[2][x >> _U4(16) & 255] ^ tables[3][x >> _U4(24)]


def _zero_byte_powers() -> list[np.ndarray]:
    """Z^1, Z^2, Z^4, ... Z^(2^31), as byte tables: appending that many zero bytes."""
    one = _U4(1) << np.arange(32, dtype=_U4)
    columns = (TABLE[one & 255] ^ (one >> _U4(8))).astype(_U4)
    out = []
    for _ in range(32):
        out.append(_as_bytes(columns))
        columns = _times(out[-1], columns)  # squared
    return out


ZEROS = _zero_byte_powers()
SPACE_CRC = _U4(zlib.crc32(b" "))


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Z^length times each crc."""
    out, rest = crc.astype(_U4, copy=True), lengths.astype(np.int64)
    for k in range(int(rest.max(initial=0)).bit_length()):
        on = rest >> k & 1 == 1
        out[on] = _times(ZEROS[k], out[on])
    return out


def combined(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """The CRC of each pair of byte strings put together, from theirs."""
    return shifted(first, second_length) ^ second


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte range."""
    size = ends - starts
    out = np.zeros(len(starts), _U4)
    for i in np.flatnonzero(size > TOGETHER):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = np.flatnonzero(size <= TOGETHER)
    order = order[np.argsort(-size[order], kind="stable")]
    by_size = size[order]
    state, at = np.full(len(order), 0xFFFFFFFF, _U4), starts[order]
    for k in range(int(by_size[0]) if len(order) else 0):
        n = int(np.searchsorted(-by_size, -k, side="left"))  # those longer than k come first
        x = state[:n]
        state[:n] = TABLE[(x ^ data[at[:n] + k]) & 255] ^ (x >> _U4(8))
    out[order] = ~state
    return out


def features(data: np.ndarray, offs: np.ndarray, least: int, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, text of each feature) for runs of least to most words."""
    data = _LOWER[data]
    s, e = runs(ALNUM[data], offs)
    row = np.searchsorted(offs, s, side="right") - 1
    word, size = word_crcs(data, s, e), e - s
    found, of, run = [], [], word
    for n in range(1, most + 1):
        if n > 1:  # runs of n words from those of n - 1 and the word after them, within a text
            same = row[: len(row) - n + 1] == row[n - 1 :]
            run = combined(combined(run[: len(same)], np.broadcast_to(SPACE_CRC, same.shape), np.ones(same.shape, np.int64)), word[n - 1 :], size[n - 1 :])
            if n >= least:
                found.append(run[same])
                of.append(row[: len(same)][same])
        elif n >= least:
            found.append(run)
            of.append(row)
    bucket = (np.concatenate(found) % _U4(buckets)).astype(np.int64) if found else np.zeros(0, np.int64)
    return np.bincount(row, minlength=len(offs) - 1), bucket, np.concatenate(of) if of else np.zeros(0, np.int64)


def bucket_counts(texts: DataFrame, text_col: str, least: int, most: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; a task sends each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offs in chunks(b.column(0)):
                total += np.bincount(features(data, offs, least, most, buckets)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


@dataclass
class Gains:
    """floor(1000 ln of the target's smoothed share over the corpus's) of each bucket."""

    least: int
    most: int
    of: np.ndarray


def fit_gains(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, text_col: str = "text", target_col: str = "text") -> Gains:
    """Gains of the buckets from all texts of docs and target; null texts and empty tables have no features."""
    corpus, own = np.zeros(buckets, object), np.zeros(buckets, object)
    for counts, texts, col in ((corpus, docs, text_col), (own, target, target_col)):
        for r in bucket_counts(texts, col, least, most, buckets).collect():  # one row a bucket
            counts[r["bucket"]] = r["n"]
    all_s, all_t = int(corpus.sum()), int(own.sum())
    gain = [math.floor(1000 * math.log((t + 1.0) * (all_s + float(buckets)) / ((s + 1.0) * (all_t + float(buckets))))) for s, t in zip(corpus, own, strict=True)]
    return Gains(least, most, np.array(gain, np.int64))


def _noise(prefix: str, key: str | None) -> int:
    h = int(hashlib.sha256(f"{prefix}{key or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: Gains, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_words, n_features, weight (floored mean of its features' gains, 0 without any), score."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    prefix = f"{seed}:"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            keys = b.column(1).to_pylist()
            for i, j, data, offs in chunks(b.column(2)):
                words, bucket, row = features(data, offs, g.least, g.most, len(g.of))
                n = np.bincount(row, minlength=j - i)
                order = np.argsort(row, kind="stable") if g.most > 1 else slice(None)  # runs of one length are in order
                sums = np.concatenate([[0], np.cumsum(g.of[bucket[order]])])
                ends = np.cumsum(n)
                weight = np.where(n > 0, (sums[ends] - sums[ends - n]) // np.maximum(n, 1), 0)
                score = weight + np.array([_noise(prefix, k) for k in keys[i:j]], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *[pa.array(x.astype(np.int64)) for x in (words, n, weight, score)]], ["id", "n_words", "n_features", "weight", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = 20, least: int = 1, most: int = 1, buckets: int = BUCKETS, seed: str = "2024",
             id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, n_words, n_features, weight, score, rank; floor(share * N) of the N rows of min_words
    or more are drawn, ranked 1, 2, ... by falling score and, of equal scores, rising id; rank is null for all others.

    A null or empty text has no features and the weight 0, an empty table gives none, an empty target a gain as if each
    bucket stood there equally. A null id is hashed as an empty one and comes last among equal scores. Repeated rows are
    rows of their own: they tie in all but rank. Other columns are ignored.
    """
    rows = written(scored(docs, fit_gains(docs, target, least, most, buckets, text_col, target_col), seed, id_col, text_col), "weights")
    long_enough = F.col("n_words") >= min_words
    bins = sorted(rows.where(long_enough).groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect(), key=lambda r: -r["bin"])  # scores are bounded
    drawn = sum(r["count"] for r in bins) * share[0] // share[1]
    floor, reached = None, 0
    for r in bins:
        if reached >= drawn:
            break
        reached, floor = reached + r["count"], r["bin"] * BIN
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if floor is None:
        return none.withColumnRenamed("id", id_col)
    high = F.coalesce(long_enough & (F.col("score") >= floor), F.lit(False))
    order = [F.desc("score"), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("n_words")]
    dealt = rows.where(high).withColumn("_deal", F.xxhash64(F.monotonically_increasing_id()))  # equal rows go to several tasks
    top = dealt.repartitionByRange(*order, "_deal").sortWithinPartitions(*order).drop("_deal")
    place = written(top.withColumn("_at", F.monotonically_increasing_id()), "drawn")  # task and row within it
    per_task = sorted(place.groupBy(F.shiftright("_at", 33).alias("task")).count().collect())  # one row a task
    before, total = {}, 0
    for r in per_task:
        before[r["task"]], total = total, total + r["count"]
    starts = docs.sparkSession.createDataFrame(list(before.items()), "task long, _before long")
    ranked = place.join(F.broadcast(starts), F.shiftright("_at", 33) == F.col("task"))
    position = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranked.select(*rows.columns, F.when(position <= drawn, position).alias("rank"))
    return none.where(~high).unionByName(ranked).withColumnRenamed("id", id_col)
