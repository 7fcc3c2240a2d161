"""Substring dedup by sliding sentence spans.

Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.  A sentence ends with a
word whose last byte is ``.``, ``!`` or ``?``, before a run of blanks that holds
a line feed, or with the text; blanks inside it and behind it belong to it but
do not count when sentences are compared.

A run of consecutive sentences is large enough with ``span`` sentences and
``least_words`` words, or with ``long_words`` words whatever its sentences.  From
every sentence the smallest large enough run that starts there and the smallest
that ends there are hashed (128 bits over the words), so a repeated passage is
covered whole however its sentences are cut: each of its sentences either
starts such a run inside it or lies in the one that ends with it.  Short runs go
on to further sentences; none is dropped for its size.  Of each run that occurs
more than once in the corpus, all but the first occurrence (smallest id, then
place) count, and a sentence that one of those covers is removed.

Each task keeps the first occurrence of a run among its own rows, whose other
occurrences are repeats at once, and sends that one on; so a run that a third of
all rows have is one row a task where occurrences meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, partitions, slices, text_buffers, written
from ledgerweave.llm.wordhash import mix, powers, running, second_hash, second_running, span_hash, words

#: Sentences and words of a run at least, and the words with which any number of sentences is a run.
SPAN, LEAST_WORDS, LONG_WORDS = 2, 16, 30
#: Runs that a task holds before it sends them on.
HELD = 1_000_000
#: Stands for a null id, which is the smallest.
NULL_ID = -(1 << 63)

_RUN = "key long, second long, doc_id long, at int, n int"
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word; the first word of every sentence (and the number of words); for each row (and the end) its first sentence."""
    start, end, row = words(buf, off)
    n = len(start)
    if not n:
        return start, end, np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    feeds = np.concatenate([[0], np.cumsum(buf == 0x0A)])
    after = np.append(start[1:], len(buf))
    last = _ENDS[buf[end - 1]] | (feeds[after] > feeds[end])
    opens = np.concatenate([[True], last[:-1]])
    opens[row[:-1][row[:-1] < n]] = True
    first = np.flatnonzero(opens)
    return start, end, np.append(first, n), np.searchsorted(first, row)


def large_enough(cum: np.ndarray, row: np.ndarray, span: int, least_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the smallest large enough run from, and to, every sentence; each run once.

    ``cum``: words before each sentence (and in all); ``row``: each row's first sentence.
    """
    n = len(cum) - 1
    here = np.arange(n)
    of = np.repeat(np.arange(len(row) - 1), np.diff(row))
    stop, begin = row[1:][of], row[:-1][of]
    ahead = np.minimum(np.maximum(here + span, np.searchsorted(cum, cum[:-1] + least_words)), np.searchsorted(cum, cum[:-1] + long_words))
    total = cum[1:]
    back = np.maximum(np.minimum(here + 1 - span, np.searchsorted(cum, total - least_words, "right") - 1), np.searchsorted(cum, total - long_words, "right") - 1)
    code = np.concatenate([(here << 32 | ahead - 1)[ahead <= stop], (back << 32 | here)[back >= begin]])
    code = np.unique(code)
    return code >> 32, code & 0xFFFFFFFF


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x) + 1)[0][: len(x)], out=out[1:])
    return out


def _runs(span: int, least_words: int, long_words: int):
    def of_batch(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part in slices(batch, 1):
            buf, off = text_buffers(part["text"])
            start, end, cum, row = sentences(buf, off)
            if len(cum) < 2:
                continue
            ids = part["doc_id"].to_numpy()
            word, other = span_hash(running(buf), start, end), second_hash(second_running(buf), start, end)
            a, b = large_enough(cum, row, span, least_words, long_words)
            hashes = [span_hash(_sums(word), cum[a], cum[b + 1]), second_hash(second_running(other), cum[a], cum[b + 1])]
            whose = np.searchsorted(row, a, "right") - 1
            yield hashes[0], hashes[1], ids[whose], a - row[whose], b - a + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for found in of_batch(batch):
                held.append(found)
                size += len(found[0])
                if size >= HELD:
                    yield from _firsts(held, True)
                    held, size = [], 0
        if held:
            yield from _firsts(held, True)

    return run


def covered(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs with those of one document that touch or overlap made one."""
    if not len(doc):
        return doc, at, n
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order].astype(np.int64), (at + n)[order].astype(np.int64)
    rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) << 32
    reach = np.maximum.accumulate(rank + end)
    new = np.concatenate([[True], rank[1:] + at[1:] > reach[:-1]])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], at[head], (reach[last] - rank[last]) - at[head]


def _firsts(held: list[tuple], send: bool) -> Iterator[pa.RecordBatch]:
    """The first occurrence of each run (if ``send``), and what the others cover (n negative)."""
    key, second, doc, at, n = (np.concatenate(x) for x in zip(*held, strict=True))
    if not len(key):
        return
    order = np.lexsort((at, doc, second, key))
    key, second, doc, at, n = (x[order] for x in (key, second, doc, at, n))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    # Rows that share an id and a place are one occurrence
    late = (doc != doc[head]) | (at != at[head])
    names = [f.split()[0] for f in _RUN.split(", ")]
    if send:
        yield pa.record_batch([pa.array(key[new].view(np.int64)), pa.array(second[new].view(np.int64)), pa.array(doc[new]), pa.array(at[new].astype(np.int32)), pa.array(n[new].astype(np.int32))], names=names)
    doc, at, n = covered(doc[late], at[late], n[late])
    spread = mix(doc.view(np.uint64)).view(np.int64)
    yield pa.record_batch([pa.array(spread), pa.array(np.zeros(len(doc), np.int64)), pa.array(doc), pa.array(at.astype(np.int32)), pa.array((-n).astype(np.int32))], names=names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, at, n of what is covered by occurrences that are not the first."""

    def late(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = -batch["n"].to_numpy()
        return pa.record_batch([batch["doc_id"], batch["at"], pa.array(n)], names=["doc_id", "at", "n"]).filter(pa.array(n > 0))

    held = []
    for batch in batches:
        yield late(batch)
        keep = batch["n"].to_numpy() > 0
        held.append(tuple(batch[c].to_numpy()[keep] for c in ("key", "second", "doc_id", "at", "n")))
    # By shares of the key, so that what sorting needs stays small beside what is held
    share = -(-sum(len(h[0]) for h in held) // 1_000_000)
    of = [(mix(h[0].view(np.uint64)) % np.uint64(max(share, 1))).astype(np.int32) for h in held]
    for k in range(share):
        for batch in _firsts([tuple(x[o == k] for x in h) for h, o in zip(held, of, strict=True)], False):
            yield late(batch)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, at, n: sentences covered by runs that are not the first of their kind (a null id as ``NULL_ID``)."""
    runs = _filled(docs, id_col, text_col).mapInArrow(_runs(span, least_words, long_words), _RUN)
    met = runs.repartition(partitions(docs.sparkSession), "key")
    return met.mapInArrow(_repeats, "doc_id long, at int, n int")


def _filled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            buf, off = text_buffers(part["text"])
            start, _, cum, row = sentences(buf, off)
            count = np.diff(row)
            gone, kept = [], []
            data = memoryview(buf.tobytes())
            for k, runs in enumerate(part["runs"].to_pylist()):
                if not runs or not count[k]:
                    gone.append([])
                    kept.append(str(data[off[k] : off[k + 1]], "utf-8"))
                    continue
                out = np.zeros(count[k], bool)
                for r in runs:
                    out[r["at"] : r["at"] + r["n"]] = True
                gone.append(np.flatnonzero(out).tolist())
                # A sentence goes up to the next one's first word; blanks ahead of all belong to the first
                edge = [int(off[k]), *start[cum[row[k] + 1 : row[k + 1]]].tolist(), int(off[k + 1])]
                kept.append("".join(str(data[a:b], "utf-8") for a, b, x in zip(edge[:-1], edge[1:], out.tolist(), strict=True) if not x))
            columns = [part["doc_id"], pa.array(count.astype(np.int64)), pa.array([len(g) for g in gone], pa.int64()), pa.array(gone, pa.list_(pa.int32())), pa.array(kept, pa.string())]
            yield pa.record_batch(columns, names=["doc_id", "n_sentences", "n_removed", "removed", "kept_text"])


def remove_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_sentences, n_removed, removed (array of places from 0), kept_text.

    * Null text counts as empty: no sentences and empty kept text.  A text of
      blanks alone has no sentences and stays.
    * A text without a large enough run loses nothing.  Very long texts are read
      whole; a task works on one at a time.
    * Rows that share an id count as one occurrence, so equal ones keep their text,
      and each loses what any of them does; a null id is the smallest.  An empty
      table gives an empty result; other columns are not read.
    """
    found = written(repeated_spans(docs, id_col, text_col, span, least_words, long_words), "spans")
    found = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    rows = _filled(docs, id_col, text_col).join(found.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "runs")
    out = rows.mapInArrow(_kept, "doc_id long, n_sentences long, n_removed long, removed array<int>, kept_text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
