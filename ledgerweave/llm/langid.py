"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte 3-grams and 4-grams (ASCII
letters lower-cased, each blank one space, so grams know where words begin and
end), each hashed to one of ``2**BITS`` rows; a linear softmax over the mean
gives the languages.  Both tables are trained by stochastic gradient descent in
numpy on a bounded sample of labelled rows.  A temperature fitted on rows that
training did not see calibrates the probability, and the largest probability
below which those rows are right too seldom is the limit of rejection.

As mean and softmax weights are linear, scoring needs one number for each gram
and language: the product of both tables.  It goes over every byte of each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, slices, text_buffers
from ledgerweave.llm.wordhash import BLANK, LOWER

BITS = 15
SIZE = 1 << BITS
WIDTH = 16
#: Labelled rows that train the model, about, and those of one language at least; with very many languages that share falls, down to one row, so that about ``MOST_ROWS`` are learned from.
TRAIN_ROWS, LEAST_ROWS, MOST_ROWS = 3000, 200, 100_000
EPOCHS = 6
UNKNOWN = "und"
#: Share of right answers that accepted texts should reach at least.
TRUST = 0.95

FOLD = LOWER.copy()
FOLD[BLANK] = 0x20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays of rows in the table, by the place where the gram begins; a gram that leaves its row gets row ``SIZE``."""
    folded = FOLD[buf].astype(np.uint32)
    n = len(folded)
    out = []
    for width in (3, 4):
        x = np.zeros(n, np.uint32)
        for k in range(min(width, n)):
            x[: n - k] |= folded[k:] << np.uint32(8 * k)
        x *= np.uint32(0x9E3779B1 + 2 * width)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        bucket = (x >> np.uint32(32 - BITS)).astype(np.int32)
        for k in range(1, width):
            at = off[1:] - k
            bucket[at[(at >= off[:-1]) & (at >= 0)]] = SIZE
        out.append(bucket)
    return out[0], out[1]


def row_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row; 0 for an empty row."""
    out = np.zeros(len(off) - 1, np.float64)
    full = off[1:] > off[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, off[:-1][full], dtype=np.float64)
    return out


def has_letter(texts: pa.Array, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    found = row_sums(_LETTER[buf].astype(np.uint8), off) > 0
    for k in np.flatnonzero(~found & (off[1:] > off[:-1])):
        found[k] = any(c.isalpha() for c in texts[int(k)].as_py())
    return found


class Model:
    """Trained tables: ``gram`` holds one row of language scores for each hashed gram."""

    def __init__(self, langs: list[str], gram: np.ndarray, bias: np.ndarray, temperature: float, limit: float) -> None:
        self.langs, self.bias, self.temperature, self.limit = langs, bias, temperature, limit
        self.gram = np.concatenate([gram, np.zeros((1, gram.shape[1]), gram.dtype)]).astype(np.float32)

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        pair = grams(buf, off)
        count = np.zeros(len(off) - 1)
        for width in (3, 4):
            count += np.maximum(np.diff(off) - width + 1, 0)
        logits = np.empty((len(off) - 1, len(self.langs)))
        for k in range(len(self.langs)):
            scores = np.ascontiguousarray(self.gram[:, k])
            total = row_sums(scores[pair[0]] + scores[pair[1]], off)
            logits[:, k] = total / np.maximum(count, 1) + self.bias[k]
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, classes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding table, softmax weights and bias from rows of (gram rows, shares that sum to 1)."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (SIZE, WIDTH))
    out, bias = rng.normal(0, 0.1, (WIDTH, classes)), np.zeros(classes)
    steps, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            idx, share = rows[i]
            rate = 4.0 * (1 - done / steps) + 0.05
            done += 1
            hidden = share @ emb[idx]
            error = softmax(hidden @ out + bias)
            error[target[i]] -= 1
            back = out @ error
            out -= 0.1 * rate * np.outer(hidden, error)
            bias -= 0.01 * rate * error
            emb[idx] -= rate * share[:, None] * back
    return emb, out, bias


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram rows and shares of each text, as raw bytes."""
    for batch in batches:
        idx, share = [], []
        buf, off = text_buffers(batch["text"])
        for a, b in zip(off[:-1], off[1:], strict=True):
            pair = grams(buf[a:b], np.array([0, b - a]))
            both = np.concatenate(pair)
            found, n = np.unique(both[both < SIZE], return_counts=True)
            idx.append(found.astype(np.uint16).tobytes())
            share.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
        yield pa.record_batch([batch["lang"], batch["doc_id"], pa.array(idx, pa.binary()), pa.array(share, pa.binary())], names=["lang", "doc_id", "idx", "share"])


def sampled(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[DataFrame, dict[str, int]]:
    """Rows to learn from, and the rows of each language in all of ``labelled``.

    Each language gets its share of ``train_rows``, and ``LEAST_ROWS`` at least (all
    rows, where it has fewer; less, where that many languages would pass ``MOST_ROWS``):
    those whose hash lies under the language's threshold, about a fifth more than
    wanted, and of them the smallest.  Ids give the hash; where null, texts do.
    """
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    every = {r["lang"]: r["count"] for r in counts}
    total = sum(every.values())
    fewest = max(1, min(LEAST_ROWS, MOST_ROWS // max(1, len(every))))
    want = [(lang, w := max(fewest, -(-train_rows * n // total)), min((1 << 63) - 1, int((1 << 63) * min(1.0, 1.2 * w / n)))) for lang, n in every.items()]
    quota = labelled.sparkSession.createDataFrame(want, "its_lang string, quota long, below long")
    rows = labelled.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.coalesce("doc_id", F.xxhash64("text"))), 1))
    rows = rows.join(F.broadcast(quota), F.col("lang") == F.col("its_lang")).filter((F.col("draw") <= F.col("below")) & (F.length("text") > 0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    return rows.withColumn("number", number).filter(F.col("number") <= F.col("quota")).select("doc_id", "lang", "text"), every


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from (doc_id, text, lang), all lang non-null; learns from the texts of :func:`sampled`.

    Where the sample has a language more often than all rows have it, the
    language's bias is lowered by the logarithm of the ratio.
    """
    sample, every = sampled(labelled, train_rows)
    got = sample.select("doc_id", "lang", "text").mapInArrow(_sparse, "lang string, doc_id long, idx binary, share binary").orderBy("doc_id", "lang").collect()
    rows = [(np.frombuffer(r.idx, np.uint16).astype(np.int64), np.frombuffer(r.share, np.float32).astype(np.float64)) for r in got]
    kept = [i for i, r in enumerate(rows) if len(r[0])]
    rows, langs_of = [rows[i] for i in kept], [got[i].lang for i in kept]
    langs = sorted(set(langs_of))
    if not langs:
        return Model([UNKNOWN], np.zeros((SIZE, 1)), np.zeros(1), 1.0, 0.0)
    target = np.array([langs.index(x) for x in langs_of])
    held = np.arange(len(rows)) % 5 == 0 if len(rows) >= 50 else np.zeros(len(rows), bool)
    emb, out, bias = train([rows[i] for i in np.flatnonzero(~held)], target[~held], len(langs))
    ratio = np.array([every[x] for x in langs]) / np.bincount(target, minlength=len(langs))
    bias = bias + np.log(ratio / ratio.max())
    gram = emb @ out
    temperature, limit = 1.0, 0.0
    if held.any():
        logits = np.array([rows[i][1] @ gram[rows[i][0]] for i in np.flatnonzero(held)]) + bias
        truth = target[held]
        grid = np.geomspace(0.1, 10, 81)
        loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-best)
        trusted = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TRUST
        limit = float(best[order][np.flatnonzero(trusted).max()]) if trusted.any() else 1.0
    return Model(langs, gram, bias, temperature, limit)


def _predict(model: Model):
    names = np.array(model.langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                buf, off = text_buffers(part["text"])
                letters = has_letter(part["text"], buf, off)
                p = model.probabilities(buf, off)
                best = p.argmax(axis=1)
                score = np.where(letters, p[np.arange(len(best)), best], 0.0)
                lang = np.where(letters, names[best], UNKNOWN)
                yield pa.record_batch([part["doc_id"], pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(letters & (score >= model.limit))], names=["doc_id", "lang_pred", "score", "accepted"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, accepted for each row of ``docs``; ``accepted`` is false below the calibrated limit."""
    rows = id_and_text(docs, id_col, text_col)
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, accepted boolean")


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn_from: Column | None = None) -> DataFrame:
    """Learns from the rows of ``docs`` where ``learn_from`` holds and lang is not null, then scores every row.

    * Null text, or one without a letter: ``und`` with score 0.
    * No labelled row: ``und`` throughout.  Repeated rows get equal answers.
    * Very long texts are read whole, in slices of rows of bounded size.
    * An empty table gives an empty result; other columns are not read.
    """
    use = F.lit(True) if learn_from is None else learn_from
    labelled = docs.filter(use & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    return predict(docs, fit(labelled), id_col, text_col)
