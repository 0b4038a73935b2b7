"""Token ids in Re-Pair compressed shards.

Documents are range-partitioned by id, or in another order that is asked for, tokenised in order and cut into shards at document ends. In a shard, Re-Pair
replaces frequent pairs of neighbouring symbols by nonterminals, many pairs a round: pairs are counted by one sort, the
most frequent become rules, and of overlapping places every second one is replaced. The shard holds the rules, the
expansion length of every rule and the expanded place of every STRIDE-th symbol, so any range of ids is decoded without
the rest.

Files: a Parquet table of one row per shard, written by Spark's committer (lost tasks leave nothing behind), with
shard, n_docs, n_tokens and payload. A payload is little-endian:
  "WMRP", u32 version, u32 base (ids below it are terminals), u32 docs, u32 rules, u32 symbols, u32 symbol bytes (2 or 4),
  u32 stride; then i64 document ids, u8 null flags, u32 tokens of each document; u32 left and right of each rule;
  u32 expansion length of each rule; the symbols; u64 expanded place of every stride-th symbol.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder as shared_encoder
from ..scratch import new_path
from .textvec import chunks

MAGIC, VERSION, STRIDE = b"WMRP", 1, 256
SHARD_TOKENS = 1 << 20
#: Re-Pair's rules a round and the least count of a pair: below it a rule, of 12 bytes, costs more than it saves, so pairs are
#: replaced until none is as frequent.
PER_ROUND, LEAST = 2048, 8


def repair(ids: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right); rule k is symbol base + k and names terminals and earlier rules only.

    Replacing only lowers the counts of older pairs, so a place whose pair is rarer than LEAST is counted again only once
    one of its symbols is new.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules = 0
    live = np.arange(max(len(seq) - 1, 0), dtype=np.int32)  # places of pairs that may be frequent
    while len(seq) >= 2 * LEAST and len(live):
        key, at, width = _sorted_pairs(seq, live, int(base + n_rules).bit_length())
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        count, kind = np.diff(edge), key[edge[:-1]]
        often = count >= LEAST
        top = np.flatnonzero(often)
        if not len(top):
            break
        top = np.sort(top[np.argsort(-count[top], kind="stable")[:PER_ROUND]])
        number = np.full(len(count), -1, np.int32)
        number[top] = np.arange(len(top))
        rule = np.full(len(seq), -2, np.int32)  # -1: frequent, but not in this round
        rule[at[np.repeat(often, count)]] = np.repeat(number[often], count[often])
        alive = rule > -2
        place = np.flatnonzero(rule >= 0).astype(np.int32)
        first = np.r_[True, place[1:] != place[:-1] + 1]
        run = np.maximum.accumulate(place * first)
        place = place[((place - run) & 1) == 0]
        own = rule[place]
        keep = np.bincount(own, minlength=len(top)) >= LEAST // 2
        kept = keep[own]
        place, own = place[kept], own[kept]
        if not len(place):
            break
        seq[place] = (base + n_rules + np.cumsum(keep) - 1)[own]
        alive[place], alive[np.maximum(place - 1, 0)] = True, True
        stay = np.ones(len(seq), bool)
        stay[place + 1] = False
        kind = kind[top[keep]]
        rules.append(np.stack([kind >> np.uint64(width), kind & np.uint64((1 << width) - 1)], axis=1).astype(np.uint32))
        n_rules += int(keep.sum())
        stay = np.flatnonzero(stay)
        seq, alive = seq[stay], alive[stay]
        live = np.flatnonzero(alive[:-1]).astype(np.int32)
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def _sorted_pairs(seq: np.ndarray, live: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs of seq that begin at the places live, sorted, their places, and the bits of a pair's right symbol; symbols have width bits at most."""
    place_bits = len(seq).bit_length()
    left, right = seq[live].astype(np.uint64), seq[live + 1]
    if place_bits + 2 * width > 64:  # place and pair don't fit one number
        pair = (left << np.uint64(32)) | right
        order = np.argsort(pair, kind="stable")
        return pair[order], live[order], 32
    left <<= np.uint64(width)
    left |= right
    left <<= np.uint64(place_bits)
    left |= live.view(np.uint32)
    left.sort()
    at = (left & np.uint64((1 << place_bits) - 1)).astype(np.int32)
    left >>= np.uint64(place_bits)
    return left, at, width


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of each rule; rules of a level name earlier levels only."""
    out = np.zeros(len(rules), np.int64)
    side = rules.astype(np.int64) - base
    todo = np.arange(len(rules))
    while len(todo):
        s = side[todo]
        ready = ((s < 0) | (out[np.maximum(s, 0)] > 0)).all(axis=1)
        done = todo[ready]
        s = side[done]
        out[done] = np.where(s < 0, 1, out[np.maximum(s, 0)]).sum(axis=1)
        todo = todo[~ready]
    return out


def pack(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, base: int) -> bytes:
    seq, rules = repair(ids, base)
    length = _lengths(rules, base)
    width = 2 if base + len(rules) <= 1 << 16 and (not len(seq) or int(seq.max()) < 1 << 16) else 4
    size = np.where(seq < base, 1, length[np.maximum(seq.astype(np.int64) - base, 0)] if len(length) else 1)
    before = np.cumsum(size) - size
    return b"".join([
        MAGIC, struct.pack("<7I", VERSION, base, len(doc_ids), len(rules), len(seq), width, STRIDE),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), counts.astype("<u4").tobytes(),
        rules[:, 0].astype("<u4").tobytes(), rules[:, 1].astype("<u4").tobytes(), length.astype("<u4").tobytes(),
        seq.astype(f"<u{width}").tobytes(), before[::STRIDE].astype("<u8").tobytes(),
    ])


class Shard:
    """A payload, read."""

    def __init__(self, payload: bytes):
        self._rules_flat: tuple[np.ndarray, np.ndarray] | None = None
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        version, self.base, docs, rules, symbols, width, self.stride = struct.unpack_from("<7I", payload, 4)
        if version != VERSION:
            raise ValueError(f"token shard of version {version}")
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.counts = take("<u4", docs).astype(np.int64)
        left, right = take("<u4", rules), take("<u4", rules)
        self.rules = np.stack([left, right], axis=1).astype(np.int64)
        self.length = take("<u4", rules).astype(np.int64)
        self.seq = take(f"<u{width}", symbols).astype(np.int64)
        self.place = take("<u8", -(-symbols // self.stride)).astype(np.int64)

    def _size(self, seq: np.ndarray) -> np.ndarray:
        return np.where(seq < self.base, 1, self.length[np.maximum(seq - self.base, 0)] if len(self.length) else 1)

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Terminals of all rules in a row, and where each rule's begin; made when first asked for."""
        if self._rules_flat is None:
            seq = np.arange(len(self.rules)) + self.base
            while (deep := seq >= self.base).any():  # all nonterminals at once, level by level
                size = np.where(deep, 2, 1)
                at = np.cumsum(size) - size
                out = np.empty(int(size.sum()), np.int64)
                out[at[~deep]] = seq[~deep]
                pair = self.rules[seq[deep] - self.base]
                out[at[deep]], out[at[deep] + 1] = pair[:, 0], pair[:, 1]
                seq = out
            self._rules_flat = seq.astype(np.uint32), np.cumsum(self.length) - self.length
        return self._rules_flat

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        """Terminals of symbols: one gather from the terminals themselves and those of the rules."""
        flat, begin = self._flat()
        size = self._size(seq)
        end = np.cumsum(size)
        out = np.repeat(seq, size)
        deep = np.flatnonzero(out >= self.base)
        if len(deep):
            k = out[deep] - self.base
            out[deep] = flat[begin[k] + (deep - np.repeat(end - size, size)[deep])]
        return out.astype(np.uint32)

    def all_ids(self) -> np.ndarray:
        return self._expand(self.seq)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard; reads the symbols around them only."""
        if start >= end:
            return np.zeros(0, np.uint32)
        k = int(np.searchsorted(self.place, start, side="right")) - 1
        stop = int(np.searchsorted(self.place, end, side="left")) * self.stride
        part = self.seq[k * self.stride : stop]
        size = self._size(part)
        before = self.place[k] + np.cumsum(size) - size
        a, b = int(np.searchsorted(before, start, side="right")) - 1, int(np.searchsorted(before, end, side="left"))
        return self._expand(part[a:b])[start - before[a] : end - before[a]]

    def document(self, i: int) -> np.ndarray:
        start = int(self.counts[:i].sum())
        return self.ids(start, start + int(self.counts[i]))


def _write(tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, number = shared_encoder(tokenizer), TaskContext.get().partitionId(), 0
        base = max(encoder.library.get_vocab_size(with_added_tokens=True), end_id + 1)
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, held
            count = np.concatenate(counts)
            payload = pack(np.concatenate(ids), docs, count, base)
            row = [[(part << 32) + number], [len(docs)], [int(count.sum())], [payload]]
            number, held = number + 1, 0
            ids.clear(), docs.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["shard", "n_docs", "n_tokens", "payload"])

        for b in batches:
            own = b.column(0).to_pylist()
            for i, j, data, offs in chunks(b.column(1)):
                got, count = encoder.encode(data, offs)
                out = np.full(len(got) + len(count), end_id, np.uint32)
                end = np.cumsum(count + 1) - 1
                mask = np.ones(len(out), bool)
                mask[end] = False
                out[mask] = got
                ids.append(out), counts.append(count + 1), docs.extend(own[i:j])
                held += len(out)
                if held >= shard_tokens:
                    yield shard()
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_tokens: int = SHARD_TOKENS, order_by: tuple[Column, ...] = ()) -> str:
    """Writes the shards of docs in ascending order of order_by and then of id, nulls first, and returns the folder.

    A null text is empty: its document has the end id only. Equal ids stand in the order of a hash of their texts; equal
    rows are all written. Other columns are ignored. An empty table writes no shard. Ids are cast to long.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    order = [f"o{i}" for i in range(len(order_by))] + ["id", "tie"]
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), *[c.alias(n) for c, n in zip(order_by, order, strict=False)])
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    ordered.mapInArrow(_write(tokenizer, end_id, shard_tokens), "shard long, n_docs long, n_tokens long, payload binary").write.parquet(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for number, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            s = Shard(payload.as_py())
            ids = s.all_ids()
            end = np.cumsum(s.counts)
            start = end - s.counts
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * len(crc), pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(start), pa.array(s.counts), pa.array(crc, pa.int64())],
                ["shard", "id", "own", "n", "crc"],
            )


def read_shards(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """For each document of the files: id_col, start (ids of all documents before it), n_tokens (with the end id), ids_crc32."""
    files = spark.read.schema("shard long, n_docs long, n_tokens long, payload binary").parquet(path)
    found = files.select("shard", "payload").mapInArrow(_read, "shard long, id long, own long, n long, crc long")
    sizes = files.select("shard", F.shiftright("shard", 32).alias("part"), "n_tokens")  # the writing task's number leads a shard's
    ahead = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", ahead(Window.orderBy("part")).alias("parts_before"))  # one small row for each task that wrote
    starts = sizes.withColumn("own_before", ahead(Window.partitionBy("part").orderBy("shard"))).join(parts, "part")
    starts = starts.select("shard", (F.col("parts_before") + F.col("own_before")).alias("before"))
    return found.join(starts, "shard").select(F.col("id").alias(id_col), (F.col("before") + F.col("own")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
