"""Repeated-substring removal by a suffix array over the text that can repeat.

A byte is removed when a string of ``LENGTH`` bytes that covers it also starts
earlier (smaller id, or the same document and an earlier start).

Sorting every suffix of a corpus moves many times its size, so the order is
built where it is needed:

1.  Sampled positions.  In each window of ``LENGTH`` bytes the leftmost smallest
    hash of its ``GRAM``-byte strings is its sample.  Equal windows have the same
    sample at the same offset, so only windows with one sample can be equal.
    Windows in a row that share a sample are one segment, named by its sample
    and its bytes.
2.  Names.  Segments with equal names are equal throughout: the first keeps its
    place, every other start is a repeat.  Each task does this for its own
    segments before it sends them, so a segment that a third of all rows have
    is sent once a task.  A sample with one name only needs no more.
3.  Samples with several names: their segments, one for each name, meet in a
    task.  A window whose bucket of a hash holds no other window of the task
    cannot repeat and is dropped.  All suffixes of the rest are sorted with the
    difference-cover algorithm modulo 3 (sort the triples at sampled places,
    recurse on their names until they cover ``LENGTH`` bytes, sort the other
    suffixes by their first byte and the sample's rank, and merge), and adjacent
    suffixes' first ``LENGTH`` bytes are compared.  Segments of a sample with
    very many names go one window at a time, dealt out by the window's own
    bytes, once for each task and window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, partitions, slices, text_buffers, written
from ledgerweave.llm.wordhash import mix, running, second_hash, second_running, span_hash

LENGTH, GRAM = 100, 28
#: A sample with more names than this is split by window.
CROWDED = 256
#: Names that a sample has in one task at least to be counted before names are shuffled, and the samples known to all
#: tasks at most.  Both only spread the shuffle of names; where names meet, every sample is counted in full.
COUNTED_FROM, CROWDED_KEPT = 8, 100_000
#: Segments that a task holds before it sends them on.
HELD = 1_000_000
LAST_ID = (1 << 63) - 1

_SEGMENT = "key long, sample long, name long, doc_id long, start int, n int, crowded boolean"
_FOUND = "repeat boolean, key long, doc_id long, start int, n int, crowded boolean"


def segments(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, start in the row, number of windows, sample and name of every segment of the rows' bytes."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    wide = length - gram + 1
    if len(buf) < length:
        return none
    sums = running(buf)
    at = np.arange(len(buf) - gram + 1)
    hashes = span_hash(sums, at, at + gram)
    # The leftmost smallest of each run of ``wide``: upper half of the hash, then the place.
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(key) // wide)
    padded = np.full(blocks * wide, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    padded = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(buf) - length + 1
    low = np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[:windows]
    valid = np.arange(windows) + length <= off[1:][row]
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return none
    last = valid.copy()
    last[:-1] &= ~valid[1:] | first[1:]
    n = np.flatnonzero(last) - start + 1
    sample = hashes[place[start]]
    shape = ((place[start] - start) * 1024 + n).astype(np.uint64)
    name = mix(second_hash(second_running(buf), start, start + n + length - 1) ^ mix(shape))
    return row[start], start - off[:-1][row[start]], n, sample, name


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in rows sorted by the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def ranges(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with those that touch made one; the order is by document and start."""
    if not len(doc):
        return doc, start, n
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    new = _groups(doc)
    new[1:] |= start[:-1] + n[:-1] != start[1:]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], start[head], start[last] + n[last] - start[head]


def _rows(columns: list[np.ndarray | None], step: int = 200_000) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    for k in range(0, len(columns[3]), step):
        size = min(step, len(columns[3]) - k)
        yield pa.record_batch([pa.nulls(size, t) if c is None else pa.array(c[k : k + step].astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _SEGMENT.split(", ")])


def _of_batch(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for part in slices(batch, 1):
        buf, off = text_buffers(part["text"])
        ids = part["doc_id"].fill_null(LAST_ID).to_numpy(zero_copy_only=False)
        row, start, n, sample, name = segments(buf, off)
        yield ids[row], start, n, sample, name


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """doc_id, start, n, sample and name of the segments of the rows, about ``HELD`` at a time."""
    parts, size = [], 0
    for batch in batches:
        for found in _of_batch(batch):
            parts.append(found)
            size += len(found[0])
            if size >= HELD:
                yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                parts, size = [], 0
    if parts:
        yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, sample, name in _held(batches):
        sample = np.sort(sample[np.unique(mix(sample) ^ name, return_index=True)[1]])
        head = np.flatnonzero(_groups(sample))
        n = np.diff(np.append(head, len(sample)))
        many = n >= COUNTED_FROM
        yield pa.record_batch([pa.array(sample[head[many]].view(np.int64)), pa.array(n[many])], names=["sample", "n"])


def _named(crowded: np.ndarray):
    """Each task's segments, once for each name; the others are repeats at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, start, n, sample, name in _held(batches):
            order = np.lexsort((start, doc, name, sample))
            doc, start, n, sample, name = (x[order] for x in (doc, start, n, sample, name))
            new = _groups(sample, name)
            head = np.flatnonzero(new)
            whose = head[np.cumsum(new) - 1]
            # Rows that share an id and a place are one occurrence.
            repeat = (doc != doc[whose]) | (start != start[whose])
            many = np.isin(sample[new], crowded)
            key = np.where(many, mix(sample[new] ^ name[new]), sample[new])
            yield from _rows([key.view(np.int64), *(c[new] for c in (sample.view(np.int64), name.view(np.int64), doc, start, n)), many])
            doc, start, n = ranges(doc[repeat], start[repeat], n[repeat])
            yield from _rows([mix(doc.astype(np.uint64)).view(np.int64), np.zeros_like(doc), None, doc, start, n, np.zeros(len(doc), bool)])

    return run


def _first_of_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats of names, and the first segment of each name whose sample has several."""
    columns = [f.split()[0] for f in _FOUND.split(", ")]
    held = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        done = table.filter(table["name"].is_null())
        yield from done.append_column("repeat", pa.array(np.ones(done.num_rows, bool))).select(columns).to_batches()
        held.append(table.filter(table["name"].is_valid()))
    if not held:
        return
    held = pa.concat_tables(held)
    # By ranges of the key, so that what sorting needs stays small beside what is held
    share = -(-held.num_rows // 500_000)
    part = (mix(held["key"].to_numpy().view(np.uint64)) % np.uint64(max(share, 1))).astype(np.int32)
    for k in range(share):
        table = held.filter(pa.array(part == k))
        sample, name, doc, start, n = (table[c].to_numpy() for c in ("sample", "name", "doc_id", "start", "n"))
        order = np.lexsort((start, doc, name, sample))
        sample, name, doc, start, n = (x[order] for x in (sample, name, doc, start, n))
        new = _groups(sample, name)
        head = np.flatnonzero(new)
        whose = head[np.cumsum(new) - 1]
        repeat = (doc != doc[whose]) | (start != start[whose])
        group = np.cumsum(_groups(sample)) - 1
        names = np.bincount(group, new)[group]
        crowded = table["crowded"].to_numpy()[order] | (names > CROWDED)
        several = new & ((names > 1) | crowded)
        first = [c[several] for c in (sample, sample, name, doc, start, n, crowded)]
        for batch in _rows(first):
            yield batch.append_column("repeat", pa.array(np.zeros(batch.num_rows, bool))).select(columns)
        doc, start, n = ranges(doc[repeat], start[repeat].astype(np.int64), n[repeat].astype(np.int64))
        for batch in _rows([np.zeros_like(doc), np.zeros_like(doc), None, doc, start, n, np.zeros(len(doc), bool)]):
            yield batch.append_column("repeat", pa.array(np.ones(batch.num_rows, bool))).select(columns)


def _bits(largest: int) -> int:
    return max(1, int(largest).bit_length())


def _sorted_by(keys: list[np.ndarray], bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by the keys (the first counts most), and where in it a new group begins.

    Keys and row number are sorted as one integer; where they are too wide for
    64 bits, the first two keys are replaced by their rank first.
    """
    low = _bits(len(keys[0]))
    while len(keys) > 1 and sum(bits) + low > 64:
        if bits[0] + bits[1] + low > 64:
            order = np.lexsort(keys[::-1])
            return order, _groups(*(k[order] for k in keys))
        order, new = _sorted_by(keys[:2], bits[:2])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        keys, bits = [rank, *keys[2:]], [low, *bits[2:]]
    packed = keys[0].astype(np.uint64)
    for key, width in zip(keys[1:], bits[1:], strict=True):
        packed = packed << np.uint64(width) | key.astype(np.uint64)
    packed = packed << np.uint64(low) | np.arange(len(packed), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).astype(np.int64)
    return order, _groups(packed >> np.uint64(low))


def difference_cover_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a sequence of small positive numbers, sorted by their first ``depth`` symbols at least.

    The difference-cover algorithm modulo 3; past the end stands 0.  Recursion
    ends when all names differ or a name covers ``depth`` symbols.
    """
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    wide, deep = _bits(t.max()), _bits(n + 3)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    order, new = _sorted_by([t[sampled], t[sampled + 1], t[sampled + 2]], [wide] * 3)
    by = sampled[order]
    if new.all() or depth <= 3:
        ranked = by
    else:  # the two runs of sampled places one after the other, a divider between them
        names = np.empty(len(sampled), np.int64)
        names[order] = np.cumsum(new)
        deeper = difference_cover_order(np.concatenate([names[: len(ones)] + 1, [1], names[len(ones) :] + 1]), -(-depth // 3))
        deeper = deeper[deeper != len(ones)]
        ranked = sampled[np.where(deeper > len(ones), deeper - 1, deeper)]
    rank = np.zeros(n + 3, np.int64)
    rank[ranked] = np.arange(1, len(ranked) + 1)
    ranked = ranked[ranked < n]
    others = np.arange(0, n, 3)
    others = others[_sorted_by([t[others], rank[others + 1]], [wide, deep])[0]]
    # Merge: a suffix of the others goes behind the sampled suffixes that are smaller, compared by
    # (symbol, rank) with those at 1 mod 3 and by (symbol, symbol, rank) with those at 2 mod 3.
    # Sampled suffixes that are equal to the depth asked for may stand in any order: their keys are levelled.
    behind = np.zeros(len(others), np.int64)
    for kind in (1, 2):
        mine = ranked[ranked % 3 == kind]
        head = [t[x] if kind == 1 else t[x] << wide | t[x + 1] for x in (mine, others)]
        if wide * kind + deep > 63:
            flat = np.unique(np.concatenate(head), return_inverse=True)[1]
            head = [flat[: len(mine)], flat[len(mine) :]]
        a, b = (h << deep | rank[x + kind] for h, x in zip(head, (mine, others), strict=True))
        behind += np.searchsorted(np.maximum.accumulate(a), b)
    out = np.empty(n, np.int64)
    at = np.arange(len(others)) + np.maximum.accumulate(behind)
    mask = np.zeros(n, bool)
    mask[at] = True
    out[at], out[~mask] = others, ranked
    return out


def _may_repeat(raw: np.ndarray, base: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, offset and number of windows of the runs of windows that share a hash's bucket with another window."""
    windows = np.maximum(size - length + 1, 0)
    ends = np.cumsum(windows)
    part = np.repeat(np.arange(len(size)), windows)
    offset = np.arange(len(part)) - np.repeat(ends - windows, windows)
    at = base[part] + offset
    hashes = span_hash(running(raw), at, at + length)
    width = max(10, _bits(2 * len(at)))
    alive = np.arange(len(at))
    for shift in (64 - width, 32 - width if width < 32 else 0):  # two numbers of buckets, since other windows fall there by chance
        bucket = (hashes[alive] >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        alive = alive[np.bincount(bucket, minlength=1)[bucket] > 1]
    new = _groups(part[alive])
    new[1:] |= alive[1:] != alive[:-1] + 1
    head = np.flatnonzero(new)
    return part[alive[head]], offset[alive[head]], np.diff(np.append(head, len(alive)))


def repeats_in(parts: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Part and offset of every window of the parts that starts earlier in another place of them."""
    whole = np.array([len(p) for p in parts])
    base = np.concatenate([[0], np.cumsum(whole)])[:-1]
    every = np.frombuffer(b"".join(parts), np.uint8)
    source, first, n = _may_repeat(every, base, whole, length)
    size = n + length - 1
    if not len(size):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # The runs that are left, each behind a divider that no byte equals
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.repeat(base[source] + first - begin[:-1], size + 1) + np.arange(begin[-1])
    place[begin[1:] - 1] = 0
    raw = every[place]
    text = raw.astype(np.int64) + 2
    text[begin[1:] - 1] = 1
    order = difference_cover_order(text, length)
    run = (np.cumsum(np.bincount(begin[1:-1], minlength=begin[-1])))[order]
    offset = order - begin[run]
    window = offset + length <= size[run]
    order, part, offset = order[window], source[run[window]], offset[window] + first[run[window]]
    same = np.zeros(len(order), bool)
    reach = np.arange(length)
    for k in range(1, len(order), 50_000):  # adjacent suffixes' first bytes, in full
        a, b = order[k - 1 : k + 49_999], order[k : k + 50_000]
        a = a[: len(b)]
        likely = (raw[a] == raw[b]) & (raw[a + length - 1] == raw[b + length - 1])
        i = np.flatnonzero(likely)
        same[k + i[(raw[a[i, None] + reach] == raw[b[i, None] + reach]).all(axis=1)]] = True
    group = np.cumsum(~same) - 1
    where = start[part] + offset
    by = np.lexsort((where, doc[part], group))
    group, part, offset, where = group[by], part[by], offset[by], where[by]
    head = np.flatnonzero(_groups(group))[group] if len(group) else group
    later = (doc[part] != doc[part[head]]) | (where != where[head]) if len(group) else np.zeros(0, bool)
    return part[later], offset[later]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text; a crowded sample's, one window at a time.

    Of equal windows that a task holds at once the first is sent, and the others
    are repeats: n is 1 and part null.
    """
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())

    def rows(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(found), 50_000):
            cols = list(zip(*found[k : k + 50_000], strict=True))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "doc_id", "start", "n", "part"])

    def sent(first: dict[bytes, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        yield from rows([(int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True), doc, at, 1, part) for part, (doc, at) in first.items()])

    first: dict[bytes, tuple[int, int]] = {}
    for batch in batches:
        found = []
        for doc, text, wanted in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            data = text.encode()
            for w in wanted:
                if not w["crowded"]:
                    found.append((w["key"], doc, w["start"], w["n"], data[w["start"] : w["start"] + w["n"] + LENGTH - 1]))
                    continue
                for at in range(w["start"], w["start"] + w["n"]):
                    part, here = data[at : at + LENGTH], (doc, at)
                    held = first.setdefault(part, here)
                    if held != here:
                        first[part] = min(held, here)
                        late = max(held, here)
                        found.append((late[0] * 2654435761 % (1 << 62), *late, 1, None))
            if len(first) > 500_000:
                yield from sent(first)
                first = {}
        yield from rows(found)
    yield from sent(first)


def _sorted_parts(limit: int = 2 << 20):
    """Keys come sorted: whole keys are gathered up to about ``limit`` bytes, and their suffixes sorted together."""

    def found(held: list[tuple]) -> pa.RecordBatch:
        doc, start = np.array([r[1] for r in held], np.int64), np.array([r[2] for r in held], np.int64)
        part, offset = repeats_in([r[3] for r in held], doc, start)
        where, whose = start[part] + offset, doc[part]
        whose, where, n = ranges(whose, where, np.ones(len(where), np.int64))
        return pa.record_batch([pa.array(whose), pa.array(where.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc_id", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            done = pa.Table.from_batches([batch])
            yield from done.filter(done["part"].is_null()).select(["doc_id", "start", "n"]).to_batches()
            for row in zip(*(batch[c].to_pylist() for c in ("key", "doc_id", "start", "part")), strict=True):
                if row[3] is None:
                    continue
                if size > limit and row[0] != last:
                    yield found(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield found(held)

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
            data = text.encode()
            if not ranges:
                out.append((len(data), [], hashlib.sha256(data).hexdigest(), data))
                continue
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, [r["start"] for r in ranges], 1)
            np.add.at(change, [r["start"] + r["n"] + LENGTH - 1 for r in ranges], -1)
            gone = np.cumsum(change)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)], hashlib.sha256(rest).hexdigest(), rest))
        spans = pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([batch["doc_id"], pa.array([o[0] for o in out], pa.int64()), spans, pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, spans (removed, as start and end), kept_sha256, kept (bytes).

    * Null text counts as empty.  Texts of fewer than ``LENGTH`` bytes lose nothing.
    * Rows that share an id are one document as to what comes earlier: equal
      places in them are one occurrence, and each row loses what any of them
      does.  A null id comes last.
    * An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = id_and_text(docs, id_col, text_col)
    crowded = rows.mapInArrow(_crowded, "sample long, n long").groupBy("sample").agg(F.sum("n").alias("n")).filter(F.col("n") > CROWDED).orderBy(F.desc("n"), "sample").limit(CROWDED_KEPT).collect()
    crowded = np.array([r["sample"] for r in crowded], np.int64).view(np.uint64)
    named = rows.mapInArrow(_named(crowded), _SEGMENT).repartition(partitions(spark), "key")
    found = written(named.mapInArrow(_first_of_name, _FOUND), "segments")

    wanted = found.filter("not repeat").groupBy("doc_id").agg(F.collect_list(F.struct("key", "start", "n", "crowded")).alias("wanted"))
    filled = rows.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text")
    parts = filled.join(wanted.hint("shuffle_hash"), "doc_id").mapInArrow(_cut, "key long, doc_id long, start int, n int, part binary")
    parts = parts.repartition(partitions(spark), "key").sortWithinPartitions("key", "doc_id", "start")
    late = written(parts.mapInArrow(_sorted_parts(), "doc_id long, start int, n int"), "repeats")

    ranges = found.filter("repeat").select("doc_id", "start", "n").unionByName(late)
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    joined = filled.join(ranges.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "ranges")
    out = joined.mapInArrow(_kept, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))
