"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE file and encodes a space and the text; tokenizer
B is a sentence-piece BPE file, which adds that space itself.  Both give a list of
byte ends over the same bytes.  A merge of the two lists of ends finds the bytes
where a token of each side ends; these cut the tokens into groups, and all tokens
of A in a group are linked with all tokens of B in it.

1.  ``mapInArrow`` takes blocks of about ``BLOCK_BYTES`` of text (one document at
    least).  Each document gives one row with its groups' digest and its distinct
    id pairs, and each block one row with its distinct pairs and the number of
    documents in it that hold them, so that a frequent pair is one row a block.
2.  Spark sums the blocks' counts by pair and takes the maximum by A id.
3.  Counts and maxima are joined back to the blocks' pairs, not to every
    document's, and meet the documents of their block in one bounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, partitions, slices, text_buffers, written
from ledgerweave.llm.packing import ByteLevelEncoder

#: Bytes of text in a block, about, and in one step of a task.
BLOCK_BYTES, STEP_BYTES = 12 << 20, 1 << 20
#: Fixed value: how the piece model writes a space.
PIECE_SPACE = "▁"
#: Groups with at most so many links are written out by repetition; larger ones by their distinct ids.
PLAIN_LINKS = 256

FOUND = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, digest string, pairs binary, counts binary, is_doc boolean"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class PlainEncoder(ByteLevelEncoder):
    """Byte-level ids in which the strings of special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.whole.encode_special_tokens = True
        self.special = []
        vocabulary = self.whole.get_vocab()
        entries = [b""] * (max(vocabulary.values()) + 1)
        plain = byte_characters()
        for entry, k in vocabulary.items():
            entries[k] = bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode()
        self.entries = entries


class PieceEncoder(ByteLevelEncoder):
    """Ids by a sentence-piece BPE file, whose pieces hold a space only at their beginning.

    So a text falls into spans, each the blanks before a word and the word, whose ids do
    not depend on one another; each distinct span goes through the model once.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        from ledgerweave.llm.packing import WORDS_KEPT, WordTable

        self.whole = SentencePieceProcessor(model_file=path)
        self.table = WordTable(WORDS_KEPT)
        pieces = [self.whole.id_to_piece(k) for k in range(self.whole.get_piece_size())]
        self.by_span = not any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces)
        self.entries = [bytes([int(p[3:5], 16)]) if self.whole.is_byte(k) else p.replace(PIECE_SPACE, " ").encode() for k, p in enumerate(pieces)]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        # The model adds the space that each span begins with
        return self.whole.encode([t[1:] for t in texts], num_threads=1)

    def _odd(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.zeros(len(off) - 1, bool)

    def _spans(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begins = np.zeros(len(buf) + 1, bool)
        space = buf == 0x20
        begins[1 : len(buf)] = space[1:] & ~space[:-1]
        begins[off] = True
        start = np.flatnonzero(begins[: len(buf)])
        return start, np.append(start[1:], len(buf)), np.searchsorted(start, off)


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


_pairs: dict[tuple[str, str], Aligner] = {}


def aligner(a: str, b: str) -> Aligner:
    """One for each Python worker and pair of files, so that its tables outlive a task."""
    if (a, b) not in _pairs:
        _pairs[a, b] = Aligner(a, b)
    return _pairs[a, b]


class Aligner:
    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = PlainEncoder(a), PieceEncoder(b)
        self.size_a = np.array([len(e) for e in self.a.entries], np.int64)
        self.size_b = np.array([len(e) for e in self.b.entries], np.int64)
        na, nb = len(self.size_a), len(self.size_b)
        # What is written for an id: in a list, or at its end
        self.shown = [*(f"{k},".encode() for k in range(na)), *(f"{k}|".encode() for k in range(na)), *(f"{k},".encode() for k in range(nb)), *(f"{k};".encode() for k in range(nb))]

    def ids(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text (which begins with the space); none where their bytes are not the text's."""
        out = ([], [])
        column = pa.array(texts, pa.binary()).cast(pa.large_string()) if texts else pa.array([], pa.large_string())
        for side, encoder in zip(out, (self.a, self.b), strict=True):
            for ids in encoder.column(column):
                side.append(np.frombuffer(ids, "<u4").astype(np.int64))
        for k, text in enumerate(texts):
            for side, encoder in zip(out, (self.a, self.b), strict=True):
                if b"".join(map(encoder.entries.__getitem__, side[k].tolist())) != text:
                    # A span's ids come by its hash: ask the tokenizer itself before giving up
                    whole = np.array(encoder._encode([text.decode()])[0], np.int64)
                    side[k] = whole if b"".join(map(encoder.entries.__getitem__, whole.tolist())) == text else None
            if len(text) == 1 or out[0][k] is None or out[1][k] is None:
                out[0][k] = out[1][k] = np.empty(0, np.int64)
        return out

    def align(self, texts: list[bytes]) -> list[tuple]:
        """For each text: n_a, n_b, n_groups, n_links, digest, distinct pairs (a << 16 | b, ascending) and how often each is linked."""
        side_a, side_b = self.ids(texts)
        count_a, count_b = (np.array([len(x) for x in s], np.int64) for s in (side_a, side_b))
        a, b = (np.concatenate([np.empty(0, np.int64), *s]) for s in (side_a, side_b))
        if not len(a):
            return [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        # Texts lie end to end, and every text's end is an end of both sides
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = merged(end_a, end_b)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(both)), np.bincount(group_b, minlength=len(both))
        row_a, row_b = np.repeat(np.arange(len(texts)), count_a), np.repeat(np.arange(len(texts)), count_b)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        row = row_a[first_a]
        groups = np.bincount(row, minlength=len(texts))
        links = np.bincount(row, weights=in_a * in_b, minlength=len(texts)).astype(np.int64)
        digests = self._digests(texts, a, b, group_a, group_b, row_a, row_b)
        key, weight = self._links(a, b, in_a, in_b, first_a, first_b, row)
        upto = np.searchsorted(key, np.arange(len(texts) + 1) << 32)
        pair = (key & 0xFFFFFFFF).astype("<u4")
        return [
            (int(count_a[k]), int(count_b[k]), int(groups[k]), int(links[k]), digests[k], pair[upto[k] : upto[k + 1]].tobytes(), weight[upto[k] : upto[k + 1]].astype("<i8").tobytes())
            for k in range(len(texts))
        ]

    def _digests(self, texts: list[bytes], a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, row_a: np.ndarray, row_b: np.ndarray) -> list[str]:
        last = lambda g: np.append(g[1:] != g[:-1], True)
        na, nb = len(self.size_a), len(self.size_b)
        what = np.concatenate([a + na * last(group_a), 2 * na + b + nb * last(group_b)])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")  # two ascending runs: one merge
        parts = list(map(self.shown.__getitem__, what[order].tolist()))
        upto = np.cumsum(np.bincount(np.concatenate([row_a, row_b]), minlength=len(texts))).tolist()
        return [hashlib.sha256(b"".join(parts[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *upto[:-1]], upto, strict=True)]

    def _links(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, pair) as text << 32 | a << 16 | b, ascending, and the links of each."""
        plain = np.flatnonzero(in_a * in_b <= PLAIN_LINKS)
        n, width = (in_a * in_b)[plain], in_b[plain]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.repeat(plain, n)
        width = np.repeat(width, n)
        key = (row[group] << 32) | (a[first_a[group] + within // width] << 16) | b[first_b[group] + within % width]
        keys, weights = [key], [np.ones(len(key), np.int64)]
        for g in np.flatnonzero(in_a * in_b > PLAIN_LINKS).tolist():
            ids_a, n_a = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            ids_b, n_b = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            keys.append(((row[g] << 32) | (ids_a[:, None] << 16) | ids_b[None, :]).ravel())
            weights.append((n_a[:, None] * n_b[None, :]).ravel())
        every, weight = np.concatenate(keys), np.concatenate(weights)
        if len(keys) == 1:
            return np.unique(every, return_counts=True)
        key, back = np.unique(every, return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, weight)
        return key, total


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The values that two ascending lists without repeats share: both are merged, and equal neighbours stay."""
    both = np.concatenate([one, other])
    both.sort(kind="stable")  # two ascending runs: one merge
    return both[:-1][both[1:] == both[:-1]]


def _aligned(a: str, b: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a, b).align
        block, used, held = TaskContext.get().partitionId() << 32, 0, []

        def ended() -> pa.RecordBatch:
            pair, docs = np.unique(np.concatenate(held), return_counts=True)
            one = lambda v, t: pa.array([v], t)
            none = [one(None, pa.int64())] * 5
            return pa.record_batch([one(block, pa.int64()), *none, one(None, pa.string()), one(pair.tobytes(), pa.binary()), one(docs.astype("<i8").tobytes(), pa.binary()), one(False, pa.bool_())], names=names)

        names = [f.split()[0] for f in FOUND.split(", ")]
        for batch in batches:
            for part in slices(batch, 1, STEP_BYTES):
                buf, off = text_buffers(part["text"])
                texts = [b" " + buf[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)]
                rows = align(texts)
                cols = list(zip(*rows, strict=True))
                numbers = [pa.array(c, pa.int64()) for c in cols[:4]]
                yield pa.record_batch(
                    [pa.array([block] * len(rows), pa.int64()), part["doc_id"], *numbers, pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.binary()), pa.array([True] * len(rows))],
                    names=names,
                )
                held += [np.frombuffer(r[5], "<u4") for r in rows]
                used += int(off[-1])
                if used >= block_bytes:
                    yield ended()
                    block, used, held = block + 1, 0, []
        if held:
            yield ended()

    return run


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, pairs, counts in zip(batch["block"].to_pylist(), batch["pairs"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            pair, docs = np.frombuffer(pairs, "<u4").astype(np.int64), np.frombuffer(counts, "<i8")
            for k in range(0, len(pair), 100_000):
                n = len(pair[k : k + 100_000])
                yield pa.record_batch([pa.array(np.full(n, block)), pa.array(pair[k : k + n]), pa.array(docs[k : k + n])], names=["block", "pair", "docs"])


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, its pairs (ascending) before its documents."""
    block, pairs, counts, best, done = None, [], [], [], True
    pair = count = top = np.empty(0, np.int64)
    for batch in batches:
        is_doc = batch["is_doc"].to_numpy(zero_copy_only=False)
        blocks = batch["block"].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (is_doc[1:] != is_doc[:-1]) | (blocks[1:] != blocks[:-1])]))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(blocks)], strict=True):
            part = batch.slice(i, j - i)
            if blocks[i] != block:
                block, pairs, counts, best, done = blocks[i], [], [], [], False
            if not is_doc[i]:
                pairs.append(part["pair"].to_numpy(zero_copy_only=False))
                counts.append(part["count"].to_numpy(zero_copy_only=False))
                best.append(part["best"].to_numpy(zero_copy_only=False))
                continue
            if not done:
                pair, count, top = (np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in (pairs, counts, best))
                done = True
            n_best, count_sum = [], []
            for own, links in zip(part["pairs"].to_pylist(), part["counts"].to_pylist(), strict=True):
                at = np.searchsorted(pair, np.frombuffer(own, "<u4").astype(np.int64))
                n = np.frombuffer(links, "<i8")
                n_best.append(int(n @ top[at]) if len(at) else 0)
                count_sum.append(int(n @ count[at]) if len(at) else 0)
            names = [f.split()[0] for f in OUT.split(", ")]
            columns = [*(part[c] for c in names[:5]), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), part["digest"]]
            yield pa.record_batch(columns, names=names)


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row for each row of ``docs``, and one for each linked pair of ids.

    The first: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    The second: a, b, documents (how many hold the pair linked), best (whether no pair of ``a`` has more).
    Both files must be readable by every executor.

    * Null or empty text, and texts that the bytes of either side's tokens do not
      spell (the piece model reads U+2581 as a space): no tokens, zeros and an empty digest.
    * A text of blanks is text.  Rows that share an id, or have none, are documents each.
    * Groups without a common end are bounded by their text; their pairs come from
      distinct ids, not from every pair of tokens.  Very long texts are blocks of their own.
    * Empty tables give empty results; other columns are not read.
    """
    spark = docs.sparkSession
    found = written(id_and_text(docs, id_col, text_col).mapInArrow(_aligned(byte_level, pieces, block_bytes), FOUND), "aligned")
    held = written(found.filter(~F.col("is_doc")).select("block", "pairs", "counts").mapInArrow(_block_pairs, "block long, pair long, docs long"), "block-pairs")
    counts = held.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 16))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    pairs = written(counts.join(highest, "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pairs")
    table = held.join(pairs, "pair").select("block", "pair", "count", F.col("best").cast("long").alias("best"), F.lit(False).alias("is_doc"))
    rows = found.filter("is_doc").unionByName(table, allowMissingColumns=True)
    rows = rows.repartition(partitions(spark), "block").sortWithinPartitions("block", "is_doc", "pair")
    by_doc = rows.mapInArrow(_looked_up, OUT)
    by_pair = pairs.select(F.shiftright("pair", 16).cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFF).cast("int").alias("b"), F.col("count").alias("documents"), "best")
    return by_doc, by_pair
