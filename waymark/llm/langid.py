"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-cased letters with one blank for everything between them. Each language has a model of up to ORDER
characters with absolute discounts estimated from its counts of counts, lower orders over continuation counts, and a
uniform distribution at the end. All models are stored together: for each order one sorted array of 64-bit gram hashes
with the log-probability of the gram in every language, and one of context hashes with the backoff weights. A text goes to
the language of the lowest cross-entropy per character.

Fitting takes `sample_texts` whole texts of each language, those that come first by a hash; every language is learned. A
fifth of them is kept out of the counts to calibrate the score (a logistic curve over the margin to the second language)
and the rejection (a cross-entropy beyond all but `reject` of the calibration texts). The grams of the highest order are
counted on the executors; as each lower order counts in how many different grams it continues, their counts are all that
the driver needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_dup import _small
from ..scratch import written
from .textvec import chunks, mix

ORDER = 5
#: Texts of each language that are learned from, by default.
SAMPLE_TEXTS = 400
_tables: list[np.ndarray] = []


def _lower_table() -> np.ndarray:
    """Lower case of every letter (of one character), 0 for all that is no letter."""
    if not _tables:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def letter_codes(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each led by order - 1 blanks and closed by one; ends of the texts; how many letters each has."""
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
    code = _lower_table()[cp]
    keep = code != 0
    letters = np.diff(np.r_[0, np.cumsum(keep)][place])
    again = keep.copy()
    again[1:] |= keep[:-1]  # the first blank after a letter
    first = place[:-1][place[:-1] < place[1:]]
    again[first] = keep[first]
    size = np.diff(np.r_[0, np.cumsum(again)][place])
    kept = code[again]
    last = np.cumsum(size)
    ended = np.zeros(len(size), bool)  # whether the text's last code is its closing blank already
    ended[size > 0] = kept[last[size > 0] - 1] == 0
    total = order - 1 + size + ~ended
    end = np.cumsum(total)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint32)
    out[np.repeat(end - total + order - 1 - (last - size), size) + np.arange(len(kept))] = kept
    return out, end, letters


def gram_keys(code: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[m][i]: hash of the m codes that end at i, for m from 1 to order; wrong where a text has fewer codes before."""
    one = mix(code.astype(np.uint64) + np.uint64(7))
    keys, total = [np.zeros(len(code), np.uint64)], np.zeros(len(code), np.uint64)
    for m in range(1, order + 1):
        total[m - 1 :] += one[: len(code) - m + 1] * np.uint64(pow(0xD1342543DE82EF95, m, 1 << 64))
        keys.append(mix(total + np.uint64(m)))
    return keys


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return i, table[i] == keys


def gram_counts(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Different grams of the highest order, a row of codes each, and how often they occur; every code of a text ends one."""
    code, end, _ = letter_codes(data, offs, order)
    at = _scored(len(code), end, order)
    if not len(at):
        return np.zeros((0, order), np.uint32), np.zeros(0, np.int64)
    _, first, count = np.unique(gram_keys(code, order)[order][at], return_index=True, return_counts=True)
    return code[at[first][:, None] + np.arange(1 - order, 1)], count


def _scored(n: int, end: np.ndarray, order: int) -> np.ndarray:
    """Places of all codes but the blanks that lead each text."""
    scored = np.ones(n, bool)
    for j in range(order - 1):
        scored[np.r_[0, end[:-1]] + j] = False
    return np.flatnonzero(scored) if len(end) else np.zeros(0, np.int64)


def _suffix_keys(codes: np.ndarray) -> list[np.ndarray]:
    """keys[m] of the last m codes of each row, as gram_keys has them."""
    one = mix(codes.astype(np.uint64).ravel() + np.uint64(7)).reshape(codes.shape)
    keys, total = [np.zeros(len(codes), np.uint64)], np.zeros(len(codes), np.uint64)
    for m in range(1, codes.shape[1] + 1):
        total = total + one[:, codes.shape[1] - m] * np.uint64(pow(0xD1342543DE82EF95, m, 1 << 64))
        keys.append(mix(total + np.uint64(m)))
    return keys


class _Counts:
    """One language's counts: for each order the grams and the contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = codes.shape[1]
        self.order, self.grams, self.contexts = order, {}, {}
        self.own, self.before = _suffix_keys(codes), [np.zeros(len(codes), np.uint64), *_suffix_keys(codes[:, :-1])]  # of grams, and of their contexts
        at = np.arange(len(codes))
        for m in range(order, 0, -1):
            gram, first, count = np.unique(self.own[m][at], return_index=True, return_counts=True)
            where = at[first]
            count = counts[where] if m == order else count
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
            context = self.before[m][where] if m > 1 else np.zeros(len(where), np.uint64)
            name, own = np.unique(context, return_inverse=True)
            self.grams[m] = (gram, count.astype(np.float64), where)
            self.contexts[m] = (name, np.bincount(own, count), np.bincount(own).astype(np.float64), discount)
            at = where  # each different gram once: continuation counts of the next order
        self.size = len(self.grams[1][0])

    def backoff(self, m: int, context: np.ndarray) -> np.ndarray:
        name, total, kinds, discount = self.contexts[m]
        i, found = _find(name, context)
        return np.where(found, discount * kinds[i] / total[i], 1.0)

    def probability(self, keys: list[np.ndarray], contexts: list[np.ndarray], order: int) -> np.ndarray:
        p = np.full(len(keys[1]), 1.0 / (self.size + 1))
        for m in range(1, order + 1):
            gram, count, _ = self.grams[m]
            name, total, kinds, discount = self.contexts[m]
            i, seen = _find(gram, keys[m])
            c, known = _find(name, contexts[m])
            own = np.where(seen & known, np.maximum(count[i] - discount, 0) / total[c], 0.0)
            p = own + np.where(known, discount * kinds[c] / total[c], 1.0) * p
        return p


class LanguageModels:
    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """grams: of each language the different grams of the highest order and how often they occur."""
        grams = {k: v for k, v in grams.items() if len(v[1])}
        self.order, self.languages = order, sorted(grams)
        self.slope, self.shift, self.limit = 20.0, 0.0, np.full(len(self.languages), np.inf)
        if not grams:
            return
        counts = [_Counts(*grams[lang]) for lang in self.languages]
        self.grams, self.contexts = {}, {}
        for m in range(1, order + 1):
            everything = np.concatenate([c.grams[m][0] for c in counts])
            gram, first = np.unique(everything, return_index=True)
            who = np.repeat(np.arange(len(counts)), [len(c.grams[m][0]) for c in counts])[first]
            where = np.concatenate([c.grams[m][2] for c in counts])[first]
            own, before = [np.zeros(len(gram), np.uint64) for _ in range(m + 1)], [np.zeros(len(gram), np.uint64) for _ in range(m + 1)]
            for i, c in enumerate(counts):
                mine = who == i
                for k in range(1, m + 1):
                    own[k][mine] = c.own[k][where[mine]]
                    before[k][mine] = c.before[k][where[mine]] if k > 1 else 0
            self.grams[m] = (gram, np.stack([np.log(c.probability(own, before, m)) for c in counts], axis=1).astype(np.float32))
            name = np.unique(np.concatenate([c.contexts[m][0] for c in counts]))
            self.contexts[m] = (name, np.stack([np.log(c.backoff(m, name)) for c in counts], axis=1).astype(np.float32))
        self.floor = np.log([c.backoff(1, np.zeros(1, np.uint64))[0] / (c.size + 1) for c in counts]).astype(np.float32)

    def _log_p(self, keys: list[np.ndarray], at: np.ndarray, m: int) -> np.ndarray:
        if m == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.languages))).copy()
        gram, value = self.grams[m]
        i, found = _find(gram, keys[m][at])
        out = value[i]
        if not found.all():
            miss = ~found
            low = self._log_p(keys, at[miss], m - 1)
            if m > 1:
                name, weight = self.contexts[m]
                c, known = _find(name, keys[m - 1][at[miss] - 1])
                low += np.where(known[:, None], weight[c], 0)
            out[miss] = low
        return out

    def entropies(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text in each language, and how many letters it has."""
        code, end, letters = letter_codes(data, offs, self.order)
        keys = gram_keys(code, self.order)
        at = _scored(len(code), end, self.order)
        bound = np.searchsorted(at, np.r_[0, end])
        total = np.zeros((len(end), len(self.languages)))
        step = max(1, 4_000_000 // len(self.languages))
        for low in range(0, len(at), step):  # a slice of the letters at a time, whatever the texts' lengths
            high = min(low + step, len(at))
            first, last = np.searchsorted(bound, low, side="right") - 1, np.searchsorted(bound, high, side="left")
            cuts = np.maximum(bound[first:last], low) - low
            total[first:last] += np.add.reduceat(self._log_p(keys, at[low:high], self.order), cuts, axis=0, dtype=np.float64)
        return -total / np.maximum(np.diff(bound), 1)[:, None], letters

    def _margin(self, h: np.ndarray) -> np.ndarray:
        if h.shape[1] < 2:
            return np.ones(len(h))
        two = np.partition(h, 1, axis=1)
        return two[:, 1] - two[:, 0]

    def calibrate(self, lang: np.ndarray, margin: np.ndarray, right: np.ndarray, entropy: np.ndarray, reject: float) -> None:
        """From texts of known language: its number, the margin, whether the prediction is right, and the entropy in it."""
        for k in np.unique(lang):
            self.limit[k] = np.quantile(entropy[lang == k], 1 - reject)
        if len(margin):
            x, y = margin, right.astype(float)
            a, b = 5.0, 0.0
            for _ in range(200):  # gradient steps, with a weak pull towards the start
                p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
                a -= 5.0 * (((p - y) * x).mean() + 1e-4 * (a - 5.0))
                b -= 1.0 * ((p - y).mean() + 1e-3 * b)
            self.slope, self.shift = max(a, 0.1), b

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language ("und" without a letter), score, cross-entropy, whether it is rejected."""
        n = len(offs) - 1
        if not self.languages or n == 0:
            return ["und"] * n, np.zeros(n), np.zeros(n), np.ones(n, bool)
        h, letters = self.entropies(data, offs)
        best = h.argmin(axis=1)
        score = 1 / (1 + np.exp(-np.clip(self.slope * self._margin(h) + self.shift, -30, 30)))
        low = h[np.arange(n), best]
        none = letters == 0
        lang = [("und" if z else self.languages[k]) for k, z in zip(best.tolist(), none.tolist(), strict=True)]
        return lang, np.where(none, 0.0, score), np.where(none, 0.0, low), none | (low > self.limit[best])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of (lang, text): each language's different grams, as bytes of their codes."""
    for b in batches:
        for lang in b.column(0).unique().to_pylist():
            for _, _, data, offs in chunks(b.column(1).filter(pa.compute.equal(b.column(0), lang))):
                codes, n = gram_counts(data, offs, ORDER)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(n, pa.int64())], ["lang", "gram", "n"])


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str, reject: float = 0.005, sample_texts: int = SAMPLE_TEXTS) -> LanguageModels:
    """Models of all languages of docs, from sample_texts whole texts of each.

    Rows of null language, null or empty text are left out; rows of equal id come first or not together, repeated rows
    count as often as they stand; other columns are ignored; an empty table gives a model without languages.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(text_col) != ""))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.lit("langid"), F.col(id_col)).alias("key"))
    # about twice the sample by hash, then the first of them: a bounded number of rows meets in a window
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), (2 * sample_texts + 100) / F.count("*")).alias("share"))
    share = written(share, "shares")
    some = known.join(F.broadcast(share) if _small(share) else share, "lang").where((F.shiftrightunsigned("key", 11) / float(1 << 53)) <= F.col("share"))
    ranked = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).where(F.col("n") <= sample_texts)
    held = (F.col("n") % 5 == 1) & (F.max("n").over(Window.partitionBy("lang")) >= 5)
    sample = written(ranked.select("lang", "text", held.alias("held")), "sample")
    table = sample.where("NOT held").select("lang", "text").mapInArrow(_count_grams, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, number = np.unique(np.array(table["lang"].to_pylist(), object), return_inverse=True) if table.num_rows else ([], None)
    codes = np.frombuffer(b"".join(table["gram"].to_pylist()), np.uint32).reshape(-1, ORDER)
    counts = table["n"].to_numpy()
    models = LanguageModels({k: (codes[number == i], counts[number == i]) for i, k in enumerate(names)})
    if not models.languages:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        place = {k: i for i, k in enumerate(m.languages)}
        for b in batches:
            own = np.array([place.get(x, -1) for x in b.column(0).to_pylist()], np.int64)
            for i, j, data, offs in chunks(b.column(1), 1 << 18):
                h, letters = m.entropies(data, offs)
                use = np.flatnonzero((letters > 0) & (own[i:j] >= 0))
                k = own[i:j][use]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m._margin(h)[use]), pa.array(h.argmin(axis=1)[use] == k), pa.array(h[use, k])], ["k", "margin", "right", "h"])

    seen = sample.where("held").select("lang", "text").mapInArrow(judge, "k long, margin double, right boolean, h double").toArrow()
    models.calibrate(*(np.asarray(seen[c].to_pylist(), t) for c, t in (("k", np.int64), ("margin", float), ("right", bool), ("h", float))), reject)
    return models


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: id_col, lang_pred, score (0 to 1), cross_entropy (nats a character), rejected.

    A text that is null, empty or without a letter is "und" with score 0 and rejected. Repeated rows get equal rows, other
    columns are never read, and an empty table gives none. The models are of bounded size and go to every worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                lang, score, low, out = shared.value.predict(data, offs)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(out)], ["id", "lang_pred", "score", "cross_entropy", "rejected"])

    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"id {id_type}, lang_pred string, score double, cross_entropy double, rejected boolean").withColumnRenamed("id", id_col)
