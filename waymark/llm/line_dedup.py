"""Line deduplication through a deletion-neighbourhood join.

A line goes if an earlier line is equal to it or within one edit of it (a code point inserted, deleted or replaced);
earlier means a smaller (document id, hash of its text, line number). Lines under `min_chars` go only with `short`, where an
earlier line is equal and they are not blank.

1. Equal lines (told apart by 128 bits) meet in one grouped minimum, so a line of any frequency costs one row a task. What
   stands first is marked at its place, not looked up by every equal line, so no line's frequency makes a hot key.
2. Of two lines within one edit, one half is intact. Each distinct line has four half keys; a line without a partner on
   any of them has no neighbour and emits nothing more. This test loses no pair.
3. The others emit their deletion variants as hashed keys. Equal variants with equal gaps are lines that differ by one
   replaced code point; a variant equal to a whole line is an insertion. Within a key everything is linked to the
   earliest line in one pass over the sorted keys, so a large group makes as many links as it has lines, never pairs.
4. Each line's earliest neighbour is verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import _binary, _small
from ..scratch import written
from .textvec import _power, chunks, mix

_U = np.uint64


class _Lines:
    """Lines of a chunk of texts: code points, prefix sums of their hash polynomial, ranges and places."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.text = data.tobytes().decode("utf-8")
        self.cp = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offs]
        breaks = np.flatnonzero(self.cp == 10)
        row = np.searchsorted(place, breaks, side="right") - 1
        self.start = np.sort(np.r_[place[:-1], breaks + 1])
        self.end = np.sort(np.r_[place[1:], breaks])
        # an empty text and a break at a text's end give empty lines; sorting pairs each start with its end
        self.row = np.sort(np.r_[np.arange(len(offs) - 1), row])
        first = np.r_[0, np.flatnonzero(np.diff(self.row)) + 1]
        self.number = np.arange(len(self.row)) - np.repeat(first, np.diff(np.r_[first, len(self.row)]))
        self.power, self.inverse = _power(len(self.cp) + 2)
        self.sum = np.zeros(len(self.cp) + 1, _U)
        self.value = mix(self.cp.astype(_U) + _U(3))
        np.cumsum(self.value * self.power[: len(self.cp)], out=self.sum[1:])

    def names(self) -> pa.Array:
        """128 bits of each line: its hash and that of a second polynomial, over the squares of the values."""
        total = np.zeros(len(self.cp) + 1, _U)
        np.cumsum(self.value * self.value * self.power[: len(self.cp)], out=total[1:])
        second = mix((total[self.end] - total[self.start]) * self.inverse[self.start])
        return _binary(np.stack([self.hash(self.start, self.end), second], axis=1))

    def hash(self, start: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.inverse[start] + mix((end - start).astype(_U) * _U(0x9E3779B97F4A7C15) + np.asarray(salt).astype(_U)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


_BLANK = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _scan(min_chars: int, short_lines: bool):
    """Every line: (id, tie, line, hash) and four half keys, null for a short line, whose hash is null too if it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in chunks(b.column(2)):
                x = _Lines(data, offs)
                n = x.end - x.start
                short = n < min_chars
                absent = short
                if short_lines:
                    said = np.r_[0, np.cumsum(~np.isin(x.cp, _BLANK))]
                    absent = short & (said[x.end] == said[x.start])
                keys = []
                for m in (n, np.maximum(n - 1, 0)):
                    f = m // 2
                    keys += [x.hash(x.start, x.start + f, 2 * m), x.hash(x.end - (m - f), x.end, 2 * m + 1)]
                own = pa.array(x.row)
                halves = np.stack(keys, axis=1).view(np.int64)
                flat = pa.array(halves.reshape(-1))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(n) + 1, 4), pa.int32()), flat)
                empty = pa.nulls(len(n), lists.type)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:j].take(own), b.column(1)[i:j].take(own), pa.array(x.number, pa.int32()), x.names().take(pa.array(np.arange(len(n)), mask=absent)),
                     pa.array(n, pa.int32()), pa.concat_arrays([lists, empty]).take(pa.array(np.where(short, np.arange(len(n)) + len(n), np.arange(len(n)))))],
                    ["id", "tie", "line", "hash", "size", "halves"],
                )

    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tie, line, text) of every line."""
    for b in batches:
        for i, j, data, offs in chunks(b.column(2)):
            x = _Lines(data, offs)
            own = pa.array(x.row)
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[i:j].take(own), b.column(1)[i:j].take(own), pa.array(x.number, pa.int32()), pa.array([x.text[s:e] for s, e in zip(x.start.tolist(), x.end.tolist(), strict=True)], pa.string())],
                ["id", "tie", "line", "text"],
            )


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each line (hash, text, id, tie, line): (key, role, id, tie, line, hash).

    Role 0 is a whole line, 1 a line that has the key as a variant, 2 one that has it with the gap at one place.
    """
    for b in batches:
        for i, j, data, offs in chunks(b.column(1), 1 << 18):
            x = _Lines(data, offs)  # texts are single lines
            n = x.end - x.start
            row = np.repeat(np.arange(j - i), n)
            at = np.arange(len(row))
            low, high = x.start[row], x.end[row]
            # the line without the code point at `at`: what follows moves down by one power
            gone = (x.sum[at] - x.sum[low] + (x.sum[high] - x.sum[at + 1]) * x.inverse[1]) * x.inverse[low]
            name = mix(gone + mix((high - low - 1).astype(_U) * _U(0x9E3779B97F4A7C15)))
            fresh = np.r_[True, x.cp[1:] != x.cp[:-1]] if len(at) else np.zeros(0, bool)
            fresh[low == at] = True  # of equal neighbours each removal gives the same text
            key = np.concatenate([x.hash(x.start, x.end), name[fresh], mix(name + (at - low).astype(_U) * _U(0xD1342543DE82EF95) + _U(1))])
            who = np.concatenate([np.arange(j - i), row[fresh], row])
            role = np.concatenate([np.zeros(j - i, np.int8), np.ones(int(fresh.sum()), np.int8), np.full(len(row), 2, np.int8)])
            to = pa.array(who)
            yield pa.RecordBatch.from_arrays([_signed(key), pa.array(role), *[b.column(c)[i:j].take(to) for c in (2, 3, 4, 0)]], ["key", "role", "id", "tie", "line", "hash"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(one, other) within runs of equal keys; the input is sorted by key, role and place, so first means earliest."""
    key = whole = first = None  # of the open run: its key, its whole line, its earliest line with the gap
    for b in batches:
        k = b.column(0).to_numpy()
        if not len(k):
            continue
        alone = np.zeros(len(k), bool)  # a run that may reach into another batch is never taken for a lone row
        alone[1:-1] = (k[1:-1] != k[:-2]) & (k[1:-1] != k[2:])
        rest = np.flatnonzero(~alone)
        one, other = [], []
        for i, r, h in zip(k[rest].tolist(), b.column(1).to_numpy()[rest].tolist(), b.column(2).take(pa.array(rest)).to_pylist(), strict=True):
            if i != key:
                key, whole, first = i, None, None
            if r == 0:
                whole = h
            elif r == 2:  # replaced at one place: all are neighbours of the first
                if first is None:
                    first = h
                elif h != first:
                    one.append(h), other.append(first)
            elif whole is not None:  # inserted into the whole line
                one.append(h), other.append(whole)
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.binary()), pa.array(other, pa.binary())], ["late", "early"])


def within_one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [within_one_edit(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(same, pa.bool_()))], ["hash"])


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, short: bool = False) -> DataFrame:
    """For each row of docs: (id_col, tie, n_lines, n_equal, n_near, removed).

    tie is a hash of the text; n_equal counts lines equal to an earlier one, n_near those within one edit of one;
    removed are the numbers (from 0) of both, ascending. Rows equal in id and text are one document and get equal rows. A
    null or empty text is one empty line, which stays. An id may be null, which comes before all others. Other columns are
    ignored; an empty table gives none. With `short`, lines under min_chars that are not blank go where an earlier line is equal.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("tie"), "text")
    lines = written(own.mapInArrow(_scan(min_chars, short), f"id {id_type}, tie long, line int, hash binary, size int, halves array<long>"), "lines")
    place = F.struct("id", "tie", "line")
    first = written(lines.where("hash IS NOT NULL").groupBy("hash").agg(F.min(place).alias("at"), F.first("halves").alias("halves")), "first")

    halves = first.select("hash", F.explode("halves").alias("half"))
    met = halves.groupBy("half").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("half")
    near = written(first.select("hash", "at").join(halves.join(met, "half", "left_semi").select("hash").distinct(), "hash", "left_semi"), "near")
    where = near.select("hash", F.col("at.id").alias("_id"), F.col("at.tie").alias("_tie"), F.col("at.line").alias("_line"))
    send = F.broadcast if _small(where) else lambda df: df
    of = own["id"].eqNullSafe(F.col("_id")) & (own["tie"] == F.col("_tie"))
    texts = own.join(send(where.select("_id", "_tie").distinct()), of, "left_semi").mapInArrow(_texts, f"id {id_type}, tie long, line int, text string")
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")) & (F.col("line") == F.col("_line"))
    texts = written(texts.join(send(where), on).select("hash", "text", "id", "tie", "line").dropDuplicates(["hash"]), "texts")

    keys = texts.mapInArrow(_variants, f"key long, role tinyint, id {id_type}, tie long, line int, hash binary")
    runs = keys.repartition("key").sortWithinPartitions("key", "role", "id", "tie", "line").select("key", "role", "hash")
    links = written(runs.mapInArrow(_links, "late binary, early binary").distinct(), "links")

    pairs = links.join(texts.select(F.col("hash").alias("late"), F.col("text").alias("x"), place.alias("at_x")), "late")
    pairs = pairs.join(texts.select(F.col("hash").alias("early"), F.col("text").alias("y"), place.alias("at_y")), "early")
    later = F.when(F.col("at_x") > F.col("at_y"), F.col("late")).otherwise(F.col("early"))
    gone = written(pairs.select(later.alias("hash"), "x", "y").mapInArrow(_verify, "hash binary").distinct(), "gone").withColumn("near", F.lit(True))
    # a document's lines and what stands first meet by document: kind 0 takes part, 1 does not, 2 is a first that stays, 3 one near an earlier line
    kept = first.select("hash", "at").join(gone, "hash", "left").select("at.*", F.when(F.col("near"), 3).otherwise(2).alias("kind"))
    marks = lines.select("id", "tie", "line", F.col("hash").isNull().cast("int").alias("kind")).unionByName(kept)
    of_kind = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("line")))
    by = marks.groupBy("id", "tie").agg(*[of_kind(k).alias(f"k{k}") for k in range(4)])
    out = by.select(
        F.col("id").alias("_id"), F.col("tie").alias("_tie"), (F.size("k0") + F.size("k1")).cast("long").alias("n_lines"), (F.size("k0") - F.size("k2") - F.size("k3")).cast("long").alias("n_equal"),
        F.size("k3").cast("long").alias("n_near"), F.sort_array(F.array_except("k0", "k2")).alias("removed"),
    )
    out = own.select("id", "tie").join(written(out, "verdicts"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")))
    return out.select(F.col("id").alias(id_col), "tie", "n_lines", "n_equal", "n_near", "removed")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, short: bool = False) -> DataFrame:
    """docs with text_col cut to the lines that stay, all other columns as they were; a null text stays null."""
    v = line_verdicts(docs, id_col, text_col, min_chars, short).where(F.size("removed") > 0).dropDuplicates([id_col, "tie"]).select(F.col(id_col).alias("__wm_id"), F.col("tie").alias("__wm_tie"), F.col("removed").alias("__wm_gone"))
    own = docs.withColumn("__wm_of", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = own.join(v, F.col(f"`{id_col}`").eqNullSafe(F.col("__wm_id")) & (F.col("__wm_of") == F.col("__wm_tie")), "left")
    numbered = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    # removed numbers are looked up among the lines by one sort of both, which stays linear for long texts
    marks = F.transform("__wm_gone", lambda g: F.struct(g.alias("i"), F.lit(None).cast("string").alias("x")))
    both = F.sort_array(F.concat(marks, numbered))  # a mark stands right before its line
    joined = joined.withColumn("__wm_both", F.when(F.col("__wm_gone").isNotNull(), both))
    kept = F.filter("__wm_both", lambda s, i: s["x"].isNotNull() & ~((i > 0) & (F.get("__wm_both", i - 1)["i"] == s["i"])))
    text = F.when(F.col("__wm_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    return joined.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
