"""Benchmark decontamination with an Aho-Corasick automaton over the normalised windows of test items.

Texts are normalised to A-Z lower-cased words of letters, digits and all non-ASCII characters, with one space between
and around them; each window of `window` consecutive words of an item (an item of fewer words, but not none, is one
window) is a pattern with a space at either end. The automaton reads each text once; hits are word ranges, which map
back to places in the original text.

The items are a query set: up to `item_bytes` of them make one automaton, which a Python worker builds once. More items are
dealt into blocks of that size, and the text passes through one scan for each block; what a block has hit is written
before the next block is read, so a worker and the driver hold one block at a time. The last scan reports in the same
worker: a second pass over its output would hold a second Python worker, and the texts twice more, for every task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from .textvec import ALNUM, runs, text_buffers

#: Bytes of items in one automaton; what is found does not depend on it.
ITEM_BYTES = 16_000_000
_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(items: list[tuple[str | None, bytes]], window: int) -> dict[bytes, tuple[int, dict[str, None]]]:
    """Pattern -> (its number of words, ids of the items that have it); a null id is no id."""
    out: dict[bytes, tuple[int, dict[str, None]]] = {}
    for item, text in items:
        words = normal_words(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            own = out.setdefault(b" " + b" ".join(words[i : i + size]) + b" ", (size, {}))
            if item is not None:
                own[1][item] = None
    return out


_automata: dict[tuple[str, int], ahocorasick.Automaton] = {}


def _automaton(name: str, items: list[tuple[str | None, bytes]], window: int) -> ahocorasick.Automaton:
    """The automaton of a block; a worker keeps the last one from task to task."""
    if (name, window) not in _automata:
        a = ahocorasick.Automaton()
        for pattern, (size, ids) in windows_of(items, window).items():
            a.add_word(pattern.decode("latin-1"), (size, tuple(ids)))
        a.make_automaton()
        _automata.clear()
        _automata[name, window] = a
    return _automata[name, window]


_HITS = pa.schema([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def _scan(name: str, items: Broadcast, window: int):
    """Adds the word ranges and item ids that a block of items hits in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(name, items.value, window)
        for b in batches:
            raw, offs = text_buffers(b.column(1))
            view = memoryview(raw)
            held = [b.column(k).to_pylist() for k in (2, 3, 4)]
            if len(auto):
                for i in range(b.num_rows):
                    words = normal_words(bytes(view[offs[i] : offs[i + 1]]))
                    if not words:
                        continue
                    line = b" " + b" ".join(words) + b" "
                    found = list(auto.iter(line.decode("latin-1")))
                    if found:
                        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        end = np.searchsorted(gaps, [e for e, _ in found]).tolist()
                        held[0][i] = held[0][i] + [e - size for e, (_, (size, _)) in zip(end, found, strict=True)]
                        held[1][i] = held[1][i] + end
                        held[2][i] = sorted({*held[2][i], *(x for _, (_, ids) in found for x in ids)})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(h, f.type) for h, f in zip(held, _HITS, strict=True)]], ["id", "text", *_HITS.names])

    return run


def _union(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends, strict=True)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offs = text_buffers(b.column(1))
        starts, ends = b.column(2).to_pylist(), b.column(3).to_pylist()
        n, hit, spans = [], [], []
        for i in range(b.num_rows):
            data = raw[offs[i] : offs[i + 1]]
            s, e = runs(ALNUM[data], np.array([0, len(data)], dtype=np.int64))
            n.append(len(s))
            ranges = _union(starts[i], ends[i]) if starts[i] else []
            hit.append(sum(y - x for x, y in ranges))
            if ranges:
                place = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # code points before each byte
                ranges = [{"start": int(place[s[x]]), "end": int(place[e[y - 1]])} for x, y in ranges]
            spans.append(ranges)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), b.column(4), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["id", "n_words", "n_hit", "item_ids", "spans"],
        )


def _scan_and_report(scan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _report(scan(batches))

    return run


def benchmark_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13,
                   item_bytes: int = ITEM_BYTES) -> DataFrame:
    """For each row of docs: id_col, n_words, n_hit (words inside a hit, once each), item_ids (array of distinct ids as strings,
    sorted), spans (places in the original text, in code points, end exclusive, overlapping and adjoining hits joined).

    A null or empty text, of either table, has no words and no hits; an item of null id hits words but has no id to list.
    Repeated rows get equal rows, other columns are ignored, and an empty docs table gives none.
    """
    own = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / item_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    empty = [F.expr(f"cast(array() as array<{t}>)").alias(n) for n, t in (("starts", "int"), ("ends", "int"), ("items", "string"))]
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *empty)
    for k in range(blocks):  # the rows of a block are of bounded size
        block = own.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else own
        rows = docs.sparkSession.sparkContext.broadcast([(r["i"], r["t"].encode()) for r in block.collect()])
        scan = _scan(uuid.uuid4().hex, rows, window)
        if k < blocks - 1:
            df = written(df.mapInArrow(scan, f"id {id_type}, text string, starts array<int>, ends array<int>, items array<string>"), "hits")
    out = df.mapInArrow(_scan_and_report(scan), f"id {id_type}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def contaminated(share: int = 20) -> Column:
    """Whether hits make up one word in `share` at least."""
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
