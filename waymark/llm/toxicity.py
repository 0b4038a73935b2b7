"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features of a text (FEATURES) are counts and densities of words of a lexicon, however they are disguised, how many of these stand near words of the
second person, and rates of capitals, punctuation and obfuscated spelling. The lexicon is learned: words, and first letters
of words, that labelled toxic texts have far more often than others. The labelled sample is dealt by a hash of its ids into
three parts, so that no step is fitted on texts that an earlier one has seen: the lexicon on the first, the trees on the
second, the calibration on the third. Trees and calibration are Spark's own; features are made in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .near_dup import SIGNATURE, _signatures, shingle_sets
from .quality_classifier import one_of_copies
from .textvec import ALNUM, BYTE_VALUE_LOWER, NONSPACE, chunks, hash_ranges, mix, runs

#: Labelled ids that are fitted on, first by a hash.
MAX_TRAIN = 16_000
#: Bytes of texts whose features are made together; a byte takes about 150 bytes of memory.
CHUNK = 1 << 18
#: A word is in the lexicon if it is in MIN_DOCS toxic texts of the part and its share among toxic texts exceeds that
#: among others by MIN_Z standard errors and RATIO times.
MIN_DOCS, MIN_Z, RATIO = 4, 5.0, 8.0
STEM = 5
TREES, DEPTH, STEP = 20, 3, 0.3
NEAR = 6
#: Words of the second person in the languages of the corpus.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti contigo tuyo usted ustedes vosotros os vuestro"
).split()
#: Signs that stand for letters in obfuscated words, and signs put between letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
BETWEEN = b"*._-~^'"

_UNMASK = np.arange(256, dtype=np.uint8)
for _sign, _letter in STANDS_FOR.items():
    _UNMASK[ord(_sign)] = ord(_letter)
_DROPPED = np.zeros(256, bool)
_DROPPED[list(BETWEEN)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

FEATURES = (
    "log_words", "log_hits", "density", "log_kinds", "log_stem_hits", "stem_density", "log_addressed", "addressed_share", "second_person", "capitals", "shouted_words",
    "exclamations", "questions", "repeated_marks", "other_marks", "mixed_words", "log_unmasked", "long_runs",
)


def _hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, e = runs(ALNUM[data], np.array([0, len(data)], np.int64))
    return np.unique(hash_ranges(data, s, e, BYTE_VALUE_LOWER))


_SECOND = _hashes(SECOND_PERSON)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes and texts of the words (letters, digits and non-ASCII, A-Z lower-cased)."""
    s, e = runs(ALNUM[data], offs)
    return s, e, hash_ranges(data, s, e, BYTE_VALUE_LOWER), np.searchsorted(offs, s, side="right") - 1


def _stems(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are longer than a stem, and the hashes of their stems."""
    long = e - s > STEM
    return long, mix(hash_ranges(data, s[long], s[long] + STEM, BYTE_VALUE_LOWER) + np.uint64(STEM))


@dataclass
class Lexicon:
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    stems: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known, which are sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def text_features(data: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text; rates are per word or per byte and 0 for an empty text."""
    n = len(offs) - 1
    size = np.diff(offs).astype(float)
    s, e, h, row = _words(data, offs)
    of_rows = lambda mask: np.bincount(row[mask], minlength=n).astype(float)
    words = np.bincount(row, minlength=n).astype(float)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    hit = _within(h, lexicon.words)
    hits = of_rows(hit)
    kinds = np.bincount(np.unique(np.stack([row[hit].astype(np.uint64), h[hit]]), axis=1)[0].astype(np.int64), minlength=n) if hit.any() else np.zeros(n)
    long, stem = _stems(data, s, e)
    stem_hit = np.zeros(len(s), bool)
    stem_hit[long] = _within(stem, lexicon.stems)
    stem_hits = of_rows(stem_hit)
    second = _within(h, _SECOND)
    beside = np.zeros(len(s) + 1, np.int64)
    np.cumsum(second, out=beside[1:])
    at = np.flatnonzero(hit | stem_hit)
    first, last = np.searchsorted(row, row[at], side="left"), np.searchsorted(row, row[at], side="right")  # words of the same text only
    addressed = np.bincount(row[at][beside[np.minimum(at + NEAR + 1, last)] > beside[np.maximum(at - NEAR, first)]], minlength=n).astype(float)

    def rate(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[offs[1:]] - total[offs[:-1]]).astype(float)

    upper, digit = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_DIGIT[data])])
    letters = rate(_LETTER[data])
    length, uppers, digits = e - s, upper[e] - upper[s], digit[e] - digit[s]
    visible = NONSPACE[data] & ~ALNUM[data]
    again = np.zeros(len(data), bool)
    again[1:] = data[1:] == data[:-1]
    inside = np.ones(len(data), bool)
    inside[offs[:-1][offs[:-1] < len(data)]] = False  # a text's first byte repeats nothing
    again &= inside
    thrice = np.zeros(len(data), bool)
    thrice[1:] = again[1:] & again[:-1]

    plain = _UNMASK[data]  # signs read as letters, those between letters taken out
    stay = ~_DROPPED[data]
    moved = np.concatenate([[0], np.cumsum(stay)])
    s2, e2, h2, row2 = _words(plain[stay], moved[offs])
    unmasked = np.maximum(np.bincount(row2[_within(h2, lexicon.words)], minlength=n) - hits, 0)
    hits = hits + unmasked  # a word counts however it is written; how many are disguised is a feature of its own

    return np.stack([
        np.log1p(words), np.log1p(hits), hits / per_word, np.log1p(kinds), np.log1p(stem_hits), stem_hits / per_word, np.log1p(addressed), addressed / np.maximum(hits + stem_hits, 1), of_rows(second) / per_word,
        rate(_UPPER[data]) / np.maximum(letters, 1), of_rows((length >= 3) & (uppers == length)) / per_word, rate(data == 33) / per_byte, rate(data == 63) / per_byte, rate(visible & again) / per_byte,
        rate(visible) / per_byte, of_rows((digits > 0) & (digits < length)) / per_word, np.log1p(unmasked), rate(thrice & _LETTER[data]) / per_byte,
    ], axis=1)


def _with_features(docs: DataFrame, lexicon: Lexicon, keep: str, kinds: str) -> DataFrame:
    """keep columns (one list of names and types) and x, the features of `text`, as an array."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = keep.split(",")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(len(names)), CHUNK):
                x = text_features(data, offs, shared.value)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k)[i:j] for k in range(len(names))], flat], [*names, "x"])

    return docs.select(*names, "text").mapInArrow(run, f"{kinds}, x array<double>")


def learned_lexicon(texts: DataFrame) -> Lexicon:
    """The lexicon of texts(text, label), a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, data, offs in chunks(b.column(0), CHUNK):
                s, e, h, row = _words(data, offs)
                long, stem = _stems(data, s, e)
                for kind, values, of in ((0, h, row), (1, stem, row[long])):
                    own = np.unique(np.stack([of.astype(np.uint64), values]), axis=1)  # once a text
                    toxic = label[i:j][own[0].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(toxic), kind, np.int32)), pa.array(own[1].view(np.int64)), pa.array(toxic.astype(np.int64))], ["kind", "h", "toxic"])

    n1, n0 = texts.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n1 or not n0:
        return Lexicon()
    count = texts.select("text", "label").mapInArrow(run, "kind int, h long, toxic long").groupBy("kind", "h").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b, p = F.col("a") / n1, F.col("b") / n0, (F.col("a") + F.col("b")) / (n1 + n0)
    far = (a - b) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) >= MIN_Z
    found = count.where((F.col("a") >= MIN_DOCS) & (a >= RATIO * b) & far).collect()  # words of a bounded sample
    of = lambda kind: np.sort(np.array([r["h"] for r in found if r["kind"] == kind], np.int64).view(np.uint64))
    return Lexicon(of(0), of(1))


@dataclass
class Trees:
    """Boosted trees as arrays: a row a tree, nodes numbered as in a heap (children of k are 2k + 1 and 2k + 2)."""

    feature: np.ndarray  # -1 at a leaf
    threshold: np.ndarray
    value: np.ndarray  # of leaves, times the tree's weight
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                right = x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]
                at = np.where(f >= 0, 2 * at + 1 + right, at)
            margin += value[at]
        return 1 / (1 + np.exp(-2 * margin))


def _exported(model) -> Trees:
    """The trees of a fitted GBTClassificationModel, so that texts are scored where their features are made."""
    depth, weights = max([1, *(t.depth for t in model.trees)]), model.treeWeights
    shape = (len(weights), (2 << depth) - 1)
    out = Trees(np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape), depth)

    def walk(k: int, node, at: int) -> None:
        if node.subtreeDepth() == 0:
            out.value[k, at] = node.prediction() * weights[k]
            return
        out.feature[k, at], out.threshold[k, at] = node.split().featureIndex(), node.split().threshold()
        walk(k, node.leftChild(), 2 * at + 1)
        walk(k, node.rightChild(), 2 * at + 2)

    for k, tree in enumerate(model.trees):
        walk(k, tree._java_obj.rootNode(), 0)
    return out


@dataclass
class ToxicityModel:
    """Without trees every score is the share; without a curve it is the trees' probability."""

    lexicon: Lexicon
    share: float
    trees: Trees | None = None
    curve: tuple[np.ndarray, np.ndarray] | None = None  # ascending probabilities and their calibrated values

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.trees is None:
            p = np.full(len(offs) - 1, self.share)
            return p, p
        p = self.trees.probability(text_features(data, offs, self.lexicon))
        return p, p if self.curve is None else np.clip(np.interp(p, *self.curve), 0.0, 1.0)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """(id, text, label, part) of the labelled ids, without near copies of equal label, written."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).where("id IS NOT NULL")
    some = known.orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    rows = rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(2), CHUNK):
                sig = _signatures(*shingle_sets(data, offs, 5))
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], b.column(1)[i:j], b.column(2)[i:j], pa.array([x.tobytes() for x in sig], pa.binary())], ["id", "label", "text", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(rows.mapInArrow(run, f"id {kind}, label int, text string, sig binary").withColumn("key", F.xxhash64(F.lit("part"), "id")), "rated")
    sigs = sorted((r["key"], r["label"], r["sig"]) for r in rows.select("key", "label", "sig").collect())  # max_train rows of 64 bytes
    if not sigs:
        return rows.select("text", "label", F.lit(0).alias("part"))
    stay = one_of_copies(np.frombuffer(b"".join(x[2] for x in sigs), np.uint16).reshape(-1, SIGNATURE), np.array([x[1] for x in sigs], np.int64))
    kept = docs.sparkSession.createDataFrame([(sigs[i][0], k % 6) for k, i in enumerate(stay)], "key long, deal int")
    part = F.when(F.col("deal") < 3, 0).when(F.col("deal") < 5, 1).otherwise(2)  # keys are hashes, so this deals them by chance
    return rows.join(F.broadcast(kept), "key").select("text", "label", part.alias("part"))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> ToxicityModel:
    """A model of labels(id_col, label_col in 0 and 1), from at most max_train labelled ids.

    Null labels and ids are left out; an id with several labels is toxic if one says so, of one with several texts that of
    the smallest hash counts. Where a part has one label only, what needs it is left out: without trees every score is the
    share of toxic labels (0.5 without labels), without calibration it is the trees' own probability.
    """
    from pyspark.ml.classification import GBTClassifier  # on the driver only, so workers do not load them
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    sample = written(_sample(docs, labels, id_col, text_col, label_col, max_train), "parts")
    kinds = {(r["part"], r["label"]): r["count"] for r in sample.groupBy("part", "label").count().collect()}  # six rows
    total, toxic = sum(kinds.values()), sum(n for (_, label), n in kinds.items() if label)
    model = ToxicityModel(learned_lexicon(sample.where("part = 0")), toxic / total if total else 0.5)
    both = lambda part: kinds.get((part, 0), 0) and kinds.get((part, 1), 0)
    if not both(1):
        return model
    rows = _with_features(sample, model.lexicon, "part,label", "part int, label int").select("part", F.col("label").cast("double").alias("label"), "x")
    rows = written(rows.coalesce(4), "features").withColumn("features", array_to_vector("x"))  # a row a text of the sample
    fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=64, minInstancesPerNode=2, seed=7).fit(rows.where("part = 1"))
    model.trees = _exported(fitted)
    if both(2):
        own = fitted.transform(rows.where("part = 2")).select("label", vector_to_array("probability")[1].alias("p"))
        curve = IsotonicRegression(featuresCol="p", labelCol="label").fit(own)
        model.curve = np.array(curve.boundaries.toArray()), np.array(curve.predictions.toArray())
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, p (the trees' probability), score (calibrated, 0 to 1).

    Only the text is read. A null text is empty; an empty text has the features 0. Repeated rows get equal rows, and an
    empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(1), CHUNK):
                p, score = shared.value.scores(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(p), pa.array(score)], ["id", "p", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {kind}, p double, score double").withColumnRenamed("id", id_col)
