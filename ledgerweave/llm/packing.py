"""Packing documents into token sequences by the sum-of-squares rule.

A document is its token ids and an end id.  Only one that is longer than a
sequence is cut: into full pieces after a first piece that may be shorter.  A
shorter piece goes where the sum over all gaps of the squared number of open
sequences with that gap becomes smallest (sum-of-squares bin packing), longest
pieces first; among equal sums, the fullest open sequence.

Each partition of the input packs its own pieces, so no text is shuffled and
the state is one counter for each gap.  What the partitions leave in sequences
that are not nearly full is packed anew, in tasks that hold many partitions'
left-overs each and whose number grows with their count.
"""

from __future__ import annotations

import itertools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, slices, text_buffers, written
from ledgerweave.llm.wordhash import BLANK, running, span_hash

CAPACITY = 2048
END_ID = 0
#: A sequence with at least so many free places is packed anew.
LOOSE = 64
#: Left-over pieces in a task of the second round, about.
SECOND_ROUND = 150_000
#: Distinct spans whose ids a Python worker keeps (about 50 bytes each); beyond, it starts over.
WORDS_KEPT = 1_500_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place and the bin's final fill for each length (1 .. capacity), in the order given.

    With N(g) open bins of gap g, moving a bin from gap g to g - s changes the
    sum of squares by 2 (N(g - s) - N(g)) + 2; closing one, by 1 - 2 N(g); and a
    new bin, by 2 N(capacity - s) + 1.
    """
    count = np.zeros(capacity + 1, np.int64)
    twice_open = np.full(capacity + 1, -(1 << 40), np.int64)  # 2 N(g), where there is such a bin
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    twice = np.zeros(capacity + 1, np.int64)
    bins, place, fills = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        if s == capacity:
            bins[i], place[i] = len(fills), 0
            fills.append(s)
            continue
        change = twice[: capacity + 1 - s] - twice_open[s:]
        change[0] -= 1  # a closed bin is no longer counted
        k = int(change.argmin())
        if int(change[k]) + 2 <= int(twice[capacity - s]) + 1:
            gap = s + k
            b = open_bins[gap].pop()
            count[gap] -= 1
            twice[gap] -= 2
            twice_open[gap] = twice[gap] if count[gap] else -(1 << 40)
        else:
            gap, b = capacity, len(fills)
            fills.append(0)
        bins[i], place[i] = b, capacity - gap
        fills[b] += s
        left = gap - s
        if left:
            open_bins[left].append(b)
            count[left] += 1
            twice[left] += 2
            twice_open[left] = twice[left]
    return bins, place, np.array(fills, np.int64)[bins] if len(lengths) else np.empty(0, np.int64)


#: Blanks outside ASCII, which the tokenizer's pattern counts as blanks, in UTF-8.
_WIDE_BLANKS = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_LEAD = np.zeros(256, bool)
_LEAD[sorted({b[0] for b in _WIDE_BLANKS})] = True
#: Control characters that some patterns count as blanks.
_CONTROL = np.zeros(256, bool)
_CONTROL[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: Punctuation that ends words; an apostrophe is none, since it may begin a part of its own.
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ".,;:!?%$&"]] = True


class WordTable:
    """Ids of spans by the spans' hashes: open addressing in arrays, looked up and filled for whole arrays at once."""

    def __init__(self, kept: int) -> None:
        self.limit = kept
        self.bits = max(10, (2 * kept - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.start, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, np.uint32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Number of each span, -1 where it is not held."""
        out, mask = np.full(len(key), -1, np.int64), (1 << self.bits) - 1
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.key[slot]
        same = held == key
        out[same] = self.at[slot[same]]
        rest = np.flatnonzero(~same & (held != 0))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & mask
            held = self.key[slot]
            same = held == key[rest]
            out[rest[same]] = self.at[slot[same]]
            on = ~same & (held != 0)
            rest, slot = rest[on], slot[on]
        return out

    def add(self, key: np.ndarray, ids: list[list[int]]) -> None:
        """``key``: distinct and not held."""
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(count.sum())
        while self.n + len(key) > len(self.start):
            self.start, self.count = np.concatenate([self.start, self.start]), np.concatenate([self.count, self.count])
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + total] = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, total)
        number = np.arange(self.n, self.n + len(key))
        self.start[number], self.count[number] = self.used + np.cumsum(count) - count, count
        slot, mask = (key >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.key[slot[todo]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            one = free[one]
            self.key[slot[one]], self.at[slot[one]] = key[one], number[one]
            todo = todo[self.key[slot[todo]] != key[todo]]
            taken = self.key[slot[todo]] != 0
            slot[todo[taken]] = (slot[todo[taken]] + 1) & mask
        self.n, self.used = self.n + len(key), self.used + total


class ByteLevelEncoder:
    """Token ids of whole texts as little-endian unsigned 32-bit numbers, by a byte-level BPE tokenizer file.

    Such a tokenizer cuts a text by a fixed pattern before it merges anything: a
    run of blanks gives all but its last blank as one part; the last one begins
    the next word's span.  Punctuation that follows a word's last letter up to the
    next blank is a part of its own.  So a text is cut into spans whose ids do
    not depend on what surrounds them, and each distinct span goes through the
    tokenizer once, found again by a 64-bit hash.  Texts with control characters
    or blanks outside ASCII, with a special token, or with a span of more than
    ``LONG`` bytes, and all texts under another kind of file, go through the
    tokenizer whole.  The ids are the same either way.
    """

    LONG = 256

    def __init__(self, path: str, kept: int = WORDS_KEPT) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.by_span = (
            kind.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space")
            and before.get("use_regex", True)
            and kind["model"].get("type", "BPE") == "BPE"
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in kind.get("added_tokens", []))
        )
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.table = WordTable(kept)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _numbers(self, buf: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = self.table.find(key)
        if not (found < 0).any():
            return found
        missing = np.flatnonzero(found < 0)
        new, first = np.unique(key[missing], return_index=True)
        if self.table.n + len(new) > self.table.limit:
            self.table.clear()
            new, first = np.unique(key, return_index=True)
            missing = np.arange(len(key))
        data = buf.tobytes()
        for k in range(0, len(new), 20_000):
            at = missing[first[k : k + 20_000]]
            spans = [data[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            self.table.add(new[k : k + 20_000], self._encode(spans))
        found[missing] = self.table.find(key[missing])
        return found

    def _odd(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that go through the tokenizer whole."""
        out = np.zeros(len(off) - 1, bool)
        at = np.flatnonzero(_CONTROL[buf])
        lead = np.flatnonzero(_LEAD[buf])
        if len(lead):
            after = np.concatenate([buf, np.zeros(2, np.uint8)])
            for wide in _WIDE_BLANKS:
                is_wide = after[lead] == wide[0]
                for k in range(1, len(wide)):
                    is_wide &= after[lead + k] == wide[k]
                at = np.concatenate([at, lead[is_wide]])
        if self.special:
            data = buf.tobytes()
            for token in self.special:
                k = data.find(token)
                while k >= 0:
                    at = np.append(at, k)
                    k = data.find(token, k + 1)
        out[np.searchsorted(off, at, "right") - 1] = True
        return out

    def _spans(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all spans, in order, and for each row (and the end) the index of its first span."""
        n = len(buf)
        begins = np.zeros(n + 1, bool)
        begins[off] = True
        row_start = begins.copy()
        blank = BLANK[buf]
        edge = np.concatenate([[True], blank[:-1] != blank[1:]])
        # A run of blanks: its start, and its last blank unless the text ends there
        begins[:n] |= edge & blank
        last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~row_start[1:n])
        begins[last] = True
        # Closing punctuation behind a letter, up to the end of the word
        closing = _CLOSING[buf]
        starts = np.flatnonzero(closing[1:] & ~closing[:-1]) + 1
        before, wider = buf[starts - 1], buf[np.maximum(starts - 2, 0)]
        letter = _LETTER[before] | ((wider == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))
        starts = starts[letter]
        if len(starts):
            stops = np.flatnonzero(~closing)
            nxt = np.searchsorted(stops, starts)
            stop = np.where(nxt < len(stops), stops[np.minimum(nxt, max(len(stops) - 1, 0))], n) if len(stops) else np.full(len(starts), n)
            row_end = off[np.searchsorted(off, starts, "right")]
            stop = np.minimum(stop, row_end)
            whole = (stop == row_end) | blank[np.minimum(stop, n - 1)]
            begins[starts[whole & (starts > off[np.searchsorted(off, starts, "right") - 1])]] = True
        start = np.flatnonzero(begins[:n])
        return start, np.append(start[1:], n), np.searchsorted(start, off)

    def column(self, texts: pa.Array) -> Iterator[bytes | memoryview]:
        buf, off = text_buffers(texts)
        if not self.by_span or not len(buf):
            for text in texts.to_pylist():
                yield np.array(self._encode([text or ""])[0], "<u4").tobytes()
            return
        start, end, row = self._spans(buf, off)
        odd = self._odd(buf, off)
        long = np.flatnonzero(end - start > self.LONG)
        odd[np.searchsorted(off, start[long], "right") - 1] = True
        use = np.repeat(~odd, np.diff(row))
        start, end = start[use], end[use]
        row = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(row)))])
        key = span_hash(running(buf), start, end)
        number = self._numbers(buf, np.where(key == 0, np.uint64(1), key), start, end)
        count = self.table.count[number].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.table.start[number] - before[:-1], count) + np.arange(before[-1])
        ids = memoryview(self.table.ids[source].astype("<u4").tobytes())
        at = (4 * before[row]).tolist()
        for k, whole in enumerate(odd.tolist()):
            if whole:
                yield np.array(self._encode([buf[off[k] : off[k + 1]].tobytes().decode()])[0], "<u4").tobytes()
            else:
                yield ids[at[k] : at[k + 1]]


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(path: str) -> ByteLevelEncoder:
    """One for each Python worker and file, so that the table of words outlives a task."""
    if path not in _encoders:
        _encoders[path] = ByteLevelEncoder(path)
    return _encoders[path]


def _pieces(doc_ids: list[int | None], encoded: Iterator[bytes | memoryview], capacity: int, end_id: int) -> list[tuple]:
    rows, end = [], end_id.to_bytes(4, "little")
    for doc, ids in zip(doc_ids, encoded, strict=True):
        n = len(ids) // 4 + 1
        first = n % capacity or capacity
        for k, start in enumerate([0, *range(first, n, capacity)]):
            length = first if not k else capacity
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            rows.append((doc, k, start, length, zlib.crc32(end, crc) if start + length == n else crc))
    return rows


def _packed(rows: list[tuple], capacity: int, base: int) -> pa.RecordBatch:
    """Longest first, then by id and piece, so that a task that runs again gives the same."""
    length = np.array([r[3] for r in rows], np.int64)
    doc = np.array([-1 if r[0] is None else r[0] for r in rows], np.int64)
    order = np.lexsort((np.array([r[1] for r in rows]), doc, -length))
    bins, place, fill = sum_of_squares(length[order], capacity)
    cols = [pa.array([rows[i][k] for i in order], pa.int32() if k == 1 else pa.int64()) for k in range(5)]
    return pa.record_batch([*cols, pa.array(bins + base), pa.array(place), pa.array(fill)], names=[f.split()[0] for f in PIECES.split(", ")])


def _first_round(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(path), []
        for batch in batches:
            for part in slices(batch, 1):
                rows += _pieces(part["doc_id"].to_pylist(), encode.column(part["text"]), capacity, end_id)
        if rows:
            yield _packed(rows, capacity, TaskContext.get().partitionId() << 32)

    return run


def _second_round(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True)]
        if rows:
            yield _packed(rows, capacity, (1 << 62) + (TaskContext.get().partitionId() << 32))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read.

    * Null or empty text: one piece that holds the end id alone.
    * Pieces of equal length are placed by id, then piece; a null id comes first.
    * Each of several rows with the same id is packed by itself.
    * An empty table gives an empty result; other columns are not read.
    """
    rows = id_and_text(docs, id_col, text_col)
    packed = written(rows.mapInArrow(_first_round(tokenizer, capacity, end_id), PIECES), "packed")
    loose = F.col("fill") <= F.lit(capacity - LOOSE)
    left = packed.filter(loose)
    tasks = max(1, round(left.count() / SECOND_ROUND))
    again = written(left.repartition(tasks).mapInArrow(_second_round(capacity), PIECES), "repacked")
    return packed.filter(~loose).unionByName(again).drop("fill")
