"""Byte-level BPE ids of many texts at once.

The tokenizers library cuts a text into pieces with one pattern and encodes each piece by itself, so a piece has the same
ids wherever it stands. The pieces of a chunk are found with numpy, and the library encodes each different piece once;
a bounded cache keeps their ids. A text that holds an added token's string goes to the library whole, and so do all texts
where the file's normalizer or pre-tokenizer is not the one that is cut here.

The pattern (of the byte-level pre-tokenizer): 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

from .textvec import hash_ranges

#: Pieces of a line that goes to the library.
LINE_PIECES = 500
#: Size of the direct-mapped table, as a power of 2.
NEAR_BITS = 18
#: Low bits of a piece's place that hold its number of ids; a text has fewer bytes, and thus ids, than 2**31.
SIZE_BITS = 31
#: ASCII blanks, the separators that some take as blanks, and the first bytes of all others.
_MAY_BE_BLANK = np.array([*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3], np.uint8)
_OTHER, _LETTER, _DIGIT, _BLANK = range(4)
_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    if not _classes:
        table = np.zeros(0x110000, np.uint8)
        for low, high in ((0, 0xD800), (0xE000, 0x110000)):
            every = "".join(map(chr, range(low, high)))
            for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
                for m in regex.finditer(pattern, every):
                    table[low + m.start() : low + m.end()] = kind
        _classes.append(table)
    return _classes[0]


def _kinds(data: np.ndarray, raw: bytes) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text is part of."""
    table = _class_table()
    kind = np.frombuffer(raw.translate(table[:256].tobytes()), np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return kind
    kind = kind.copy()
    first = data[lead].astype(np.int32)
    size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
    cp = first & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
    for k in (1, 2, 3):
        longer = slice(None) if k == 1 else np.flatnonzero(size > k)
        cp[longer] = cp[longer] << 6 | data[lead[longer] + k] & 0x3F
    own = table[cp]
    kind[lead] = own
    for k in (1, 2, 3):
        longer = slice(None) if k == 1 else np.flatnonzero(size > k)
        kind[lead[longer] + k] = own[longer]
    return kind


def piece_starts(data: np.ndarray, offs: np.ndarray, raw: bytes) -> np.ndarray:
    """Places where the pattern starts a piece, in bytes of UTF-8 texts; offs: ends of texts within data, whose bytes are raw."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kinds(data, raw)
    first = np.zeros(n + 1, bool)
    first[offs] = True  # of each text, and one past the end
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(start)
    end = np.r_[run[1:], n]
    own = kind[run]
    piece = start
    word = run[own != _BLANK]
    led = word[(word > 0) & ~first[word]]
    led = led[data[led - 1] == 32]
    piece[led], piece[led - 1] = False, True
    blank = np.flatnonzero((own == _BLANK) & (end - run > 1))
    blank = blank[~first[end[blank]]]
    last = end[blank] - 1  # start of the run's last character, which may be the first
    while (inner := (data[last] & 0xC0) == 0x80).any():
        last[inner] -= 1
    piece[last] = True
    tick = run[(own == _OTHER) & (end - run == 1)]
    tick = tick[(data[tick] == 39) & piece[tick] & (tick + 1 < n)]
    tick = tick[~first[tick + 1] & (kind[tick + 1] == _LETTER)]
    if len(tick):
        one = data[tick + 1]
        within = tick + 2 < n
        two = np.where(within & ~first[np.minimum(tick + 2, n)], data[np.minimum(tick + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for a, b in ("re", "ve", "ll"):
            size[(one == ord(a)) & (two == ord(b))] = 2
        tick, size = tick[size > 0], size[size > 0]
        piece[tick + 1] = False
        after = tick + 1 + size
        after = after[after < n]
        after = after[~first[after] & (kind[after] == _LETTER)]
        piece[after] = True
    return np.flatnonzero(piece)


def _joined(data: np.ndarray, starts: np.ndarray, length: np.ndarray, gap: int) -> str:
    """Ranges of data in a row, with gap line breaks between them."""
    end = np.cumsum(length + gap)
    at = end - gap - length
    out = np.full(int(end[-1]) - gap, 10, np.uint8)
    step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + step] = data[np.repeat(starts, length) + step]
    return out.tobytes().decode("utf-8")


class Encoder:
    """Ids of texts, with a cache of at most `most` pieces."""

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        file = json.loads(self.library.to_str())
        cut = file["pre_tokenizer"] or {}
        #: Whether pieces are those of piece_starts.
        self.plain = file["normalizer"] is None and file["truncation"] is None and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.hash, self.where, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.near_hash, self.near_where = np.zeros(1 << NEAR_BITS, np.uint64), np.zeros(1 << NEAR_BITS, np.int64)

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Has the library encode the different pieces of data; where each of all those given is."""
        new, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        starts, length = starts[at], (ends - starts)[at]
        # A blank and then anything but blanks is a piece of its own wherever it follows another such piece, and one that
        # begins with no blank wherever it stands between line breaks, so these go to the library in long lines; it says
        # which id belongs to which piece.
        blank = np.isin(data[starts], _MAY_BE_BLANK)
        second = data[np.minimum(starts + 1, len(data) - 1)]
        is_led = (data[starts] == 32) & (length > 1) & ~np.isin(second, _MAY_BE_BLANK)
        alone, order, parts, sizes = [np.flatnonzero(blank & ~is_led)], [], [], []
        for kind, gap in ((is_led, 0), (~blank, 1)):
            own = np.flatnonzero(kind)
            lines = [own[k : k + LINE_PIECES] for k in range(0, len(own), LINE_PIECES)]
            texts = [_joined(data, starts[x], length[x], gap) for x in lines]
            for x, e in zip(lines, self.library.encode_batch(texts, add_special_tokens=False), strict=True):
                word = np.array(e.word_ids, np.int64)
                if word[-1] != (len(x) - 1) * (1 + gap):
                    alone.append(x)
                    continue
                got = np.array(e.ids, np.uint32)
                if gap:
                    got, word = got[word % 2 == 0], word[word % 2 == 0] // 2
                order.append(x)
                parts.append(got)
                sizes.append(np.bincount(word, minlength=len(x)))
        alone = np.concatenate(alone)
        found = [e.ids for e in self.library.encode_batch([data[i : i + n].tobytes().decode("utf-8") for i, n in zip(starts[alone].tolist(), length[alone].tolist(), strict=True)], add_special_tokens=False)]
        order.append(alone)
        parts.append(np.fromiter((i for x in found for i in x), np.uint32))
        sizes.append(np.fromiter(map(len, found), np.int64))
        in_order = np.concatenate(sizes)
        where = np.zeros(len(new), np.int64)
        where[np.concatenate(order)] = (len(self.ids) + np.cumsum(in_order) - in_order) << SIZE_BITS | in_order
        self.ids = np.concatenate([self.ids, *parts])
        to = np.searchsorted(self.hash, new)
        self.hash, self.where = np.insert(self.hash, to, new), np.insert(self.where, to, where)
        return where[inverse]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids are, their number in the low SIZE_BITS, and whether it is known.

        A direct-mapped table of pieces seen of late answers for most; the sorted arrays are searched for the others.
        """
        slot = (hashes >> np.uint64(64 - NEAR_BITS)).astype(np.int64)
        known = self.near_hash[slot] == hashes
        where = self.near_where[slot]
        far = np.flatnonzero(~known)
        if len(far) and len(self.hash):
            own = hashes[far]
            i = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
            found = self.hash[i] == own
            far, i = far[found], i[found]
            known[far], where[far] = True, self.where[i]
            self.near_hash[slot[far]], self.near_where[slot[far]] = hashes[far], where[far]
        return where, known

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and their offsets) in a row, and each text's number of ids."""
        raw = data.tobytes()
        if not self.plain:
            found = [e.ids for e in self.library.encode_batch([raw[i:j].decode("utf-8") for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        whole = {i for i in range(len(offs) - 1) if any(a in raw[offs[i] : offs[i + 1]] for a in self.added)} if any(a in raw for a in self.added) else set()
        starts = piece_starts(data, offs, raw)
        ends = np.r_[starts[1:], len(data)] if len(starts) else starts
        hashes = hash_ranges(data, starts, ends)
        where, known = self._find(hashes)
        if not known.all():
            if len(self.hash) > self.most:
                self._clear()
                known[:] = False
            new = np.flatnonzero(~known)
            where[new] = self._learn(data, starts[new], ends[new], hashes[new])
        at, size = where >> SIZE_BITS, where & ((1 << SIZE_BITS) - 1)
        last = np.cumsum(size)
        ids = self.ids[np.repeat(at - (last - size), size) + np.arange(last[-1] if len(last) else 0)]
        bound = np.searchsorted(starts, offs)
        count = np.diff(np.r_[0, last][bound])
        if whole:
            parts = np.split(ids, np.cumsum(count)[:-1])
            for k in whole:
                parts[k] = np.array(self.library.encode(raw[offs[k] : offs[k + 1]].decode("utf-8"), add_special_tokens=False).ids, np.uint32)
            count, ids = np.array([len(x) for x in parts], np.int64), np.concatenate(parts)
        return ids, count


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file; a worker keeps it, and its cache, from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
