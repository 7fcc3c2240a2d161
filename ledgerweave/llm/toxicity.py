"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (beginnings of words that stand in toxic rows far more often than in
others), the trees and the calibration are learned from a bounded sample of
labelled rows.  The features of a text: how dense lexicon words are, plainly and
after common disguises are undone, how many stand near a second-person word, the
shares of capitals and punctuation, and the rates of exclamation marks, stretched
letters and disguised words.  Scoring reads every text whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.llm.common import slices, text_buffers, written
from ledgerweave.llm.langid import row_sums
from ledgerweave.llm.wordhash import BLANK, words

#: At most about so many labelled rows are learned from (chosen by a hash of the id).
TRAIN_ROWS = 8000
#: At most so many beginnings of words in the lexicon.
LEXICON_SIZE = 3000
#: Characters of a word's beginning that the lexicon knows, besides the whole word.
STEMS = (4, 5, 6)
#: Characters on either side in which a second-person word counts as near.
NEAR = 40

# Second-person words of the languages in use.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()
# Characters that commonly stand for a letter.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "-": "", "_": "", ".": "", "'": ""}

FEATURES = ("lexicon_density", "lexicon_count", "strongest", "disguised_density", "near_second_person", "capitals", "punctuation", "exclamations", "stretched", "disguised_words")

_WORD = re.compile(r"[^\s]+")
_EDGE = " .,;:!?\"'()[]{}<>#%&*$|-_"
_PERSON = re.compile(r"(?<!\w)(?:" + "|".join(SECOND_PERSON) + r")(?!\w)")
_HIDDEN = re.compile(r"(?<=[^\W\d_])[0134578@$!*._'-]+(?=[^\W\d_])")
_UNDO = str.maketrans(DISGUISES)
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def stems(text: str) -> set[str]:
    """Beginnings and whole forms of a text's words; a whole form ends with a space."""
    out: set[str] = set()
    for word in set(text.lower().split()):
        word = word.strip(_EDGE)
        if word:
            out.add(word + " ")
            out.update(word[:k] for k in STEMS if len(word) >= k)
    return out


class Lexicon:
    """Weights of word beginnings; finds them in a text in one pass."""

    def __init__(self, weights: dict[str, float]) -> None:
        import ahocorasick

        self.weights = weights
        self.automaton = ahocorasick.Automaton()
        for stem, weight in weights.items():
            self.automaton.add_word(" " + stem, (len(stem), weight))
        if weights:
            self.automaton.make_automaton()

    def hits(self, spaced: str) -> dict[int, float]:
        """The largest weight at each word that the lexicon knows, by the word's place in ``spaced``."""
        found: dict[int, float] = {}
        if self.weights:
            for end, (length, weight) in self.automaton.iter(spaced):
                at = end - length + 1
                if weight > found.get(at, 0.0):
                    found[at] = weight
        return found


_BLANKS_AND_MARKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r.,;:?\"()[]{}<>"})


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of :data:`FEATURES` for each text (no nulls); an empty text has zeros."""
    buf, off = text_buffers(texts)
    size = np.maximum(np.diff(off), 1)
    row = words(buf, off)[2]
    n_words = np.maximum(np.diff(row), 1)
    upper, alpha, punct = (row_sums(t[buf].astype(np.uint8), off) for t in (_UPPER, _ALPHA, _PUNCT))
    bang = row_sums((buf == ord("!")).astype(np.uint8), off)
    same = np.zeros(len(buf), np.uint8)
    if len(buf) > 2:
        same[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _ALPHA[buf[2:]]
    same[off[:-1][off[:-1] < len(buf)]] = 0
    out = np.zeros((len(texts), len(FEATURES)))
    inner = np.zeros(len(buf), bool)  # a mark or digit between letters within a word
    mark = ~_ALPHA[buf] & (buf < 128) & ~BLANK[buf]
    if len(buf) > 2:
        inner[1:-1] = mark[1:-1] & _ALPHA[buf[:-2]] & _ALPHA[buf[2:]]
    maybe = row_sums(inner.astype(np.uint8), off) > 0
    for i, text in enumerate(texts.to_pylist()):
        spaced = " " + text.lower().translate(_BLANKS_AND_MARKS) + " "
        found = lexicon.hits(spaced)
        if found:
            out[i, 0] = sum(found.values())
            out[i, 1] = len(found)
            out[i, 2] = max(found.values())
            out[i, 4] = sum(_PERSON.search(spaced, max(0, at - NEAR), at + NEAR) is not None for at in found)
        if maybe[i]:
            hidden = [w for w in _WORD.findall(text.lower()) if _HIDDEN.search(w)]
            out[i, 9] = len(hidden)
            if hidden:
                out[i, 3] = sum(lexicon.hits(" " + "  ".join(w.strip(_EDGE).translate(_UNDO) for w in hidden) + " ").values())
    for k in (0, 3, 4, 9):
        out[:, k] *= 100 / n_words
    out[:, 1] = np.log1p(out[:, 1])
    out[:, 5] = upper / np.maximum(alpha, 1)
    out[:, 6] = punct / size
    out[:, 7] = 100 * bang / n_words
    out[:, 8] = 100 * row_sums(same, off) / n_words
    return out


class Trees:
    """Gradient-boosted regression trees on binned features, log loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, smallest: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.smallest = rounds, depth, rate, bins, smallest

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c[c != 0] if (c != 0).any() else c, np.linspace(0, 1, self.bins))) for c in x.T]
        self.cuts = [np.unique(np.concatenate([[0.0], (c[1:] + c[:-1]) / 2 if len(c) > 1 else c])) for c in self.cuts]
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = math.log(rate / (1 - rate))
        raw, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._one(tree, binned)
        return self

    def _grow(self, x, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum() + 1.0
        best = (1e-6, None, None)
        if depth and len(rows) >= 2 * self.smallest:
            for f in range(x.shape[1]):
                v = x[rows, f]
                n = len(self.cuts[f]) + 1
                gs, hs, ns = (np.cumsum(np.bincount(v, w, n))[:-1] for w in (grad[rows], hess[rows], None))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs) - g**2 / h
                gain[(ns < self.smallest) | (len(rows) - ns < self.smallest)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return self.rate * g / h
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, grad, hess, rows[left], depth - 1), self._grow(x, grad, hess, rows[~left], depth - 1)

    def _one(self, tree, x) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        left = x[:, f] <= cut
        out = np.empty(len(x))
        out[left], out[~left] = self._one(low, x[left]), self._one(high, x[~left])
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        return self.start + sum((self._one(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a), float(a)])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            m, w, _, last = blocks.pop()
            p = blocks[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + m * w) / (p[1] + w), p[1] + w, last
    return np.array([v for b in blocks for v in b[2:]]), np.array([b[0] for b in blocks for _ in (0, 1)])


class Model:
    def __init__(self, weights: dict[str, float], trees: Trees | None, points: tuple[np.ndarray, np.ndarray] | None, rate: float) -> None:
        self.weights, self.trees, self.points, self.rate = weights, trees, points, rate

    def score(self, texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        return np.clip(np.interp(self.trees.raw(features(texts, lexicon)), *self.points), 0.0, 1.0)


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = [Counter(), Counter()]
    for batch in batches:
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            seen[toxic].update(stems(text))
    keys = list(seen[0] | seen[1])
    yield pa.record_batch([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["stem", "toxic", "clean"])


def _describe(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(weights)
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index("text")):
                x = features(part["text"], lexicon)
                yield pa.record_batch([part["doc_id"], part["toxic"], pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from (doc_id, toxic) and texts: columns doc_id, text, toxic (0 or 1), of at most about ``train_rows`` rows.

    Rows of equal label whose whole texts are equal but for case and blanks are
    learned from once, so that copies of one text do not fill the lexicon.
    """
    whole = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    rows = labelled.withColumn("family", F.sha2(whole, 256))
    rows = rows.groupBy("family", "toxic").agg(F.expr("min_by(struct(doc_id, text), doc_id)").alias("one"))
    rows = written(rows.select("one.doc_id", "one.text", "toxic"), "toxic-sample")
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, None, None, 1.0 if n1 else 0.0)
    counts = rows.mapInArrow(_count_stems, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(n0 + 1.0))
    chosen = counts.filter(F.col("t") >= max(3, round(0.004 * n1))).withColumn("w", weight).filter("w > 2.3")
    chosen = chosen.orderBy(F.desc(F.col("w") * F.sqrt("t")), "stem").limit(LEXICON_SIZE).collect()
    weights = {r.stem: float(r.w) for r in chosen}
    got = rows.mapInArrow(_describe(weights), "doc_id long, toxic int, x array<double>").orderBy("doc_id").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    held = np.arange(len(y)) % 4 == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    trees = Trees().fit(x[~held], y[~held])
    use = held if held.any() else ~held
    return Model(weights, trees, isotonic(trees.raw(x[use]), y[use]), float(y.mean()))


def sampled_labels(labels: DataFrame, id_col: str, toxic_col: str, learn_from: Column | None, train_rows: int) -> DataFrame:
    """At most about ``train_rows`` ids with their label, the smallest by a hash; rows with a null go."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull())
    if learn_from is not None:
        known = known.filter(learn_from)
    known = known.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(toxic_col).cast("int")).alias("toxic"))
    return known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(train_rows)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", learn_from: Column | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows of ``docs``; ``learn_from`` is a condition on ``labels``."""
    chosen = sampled_labels(labels, id_col, toxic_col, learn_from, train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return fit(texts.join(F.broadcast(chosen), "doc_id"), train_rows)


def _scored(model: Model, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.weights)
        for batch in batches:
            filled = batch.set_column(text_at, batch.schema.names[text_at], batch.column(text_at).fill_null(""))
            at = 0
            for part in slices(filled, text_at):
                score = model.score(part.column(text_at), lexicon)
                rows = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.record_batch([*rows.columns, pa.array(score, pa.float64())], names=[*rows.schema.names, "score"])

    return run


def _with_scores(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ... (their own names may clash with anything) and ``score``."""
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return named.mapInArrow(_scored(model, docs.columns.index(text_col)), T.StructType([*named.schema.fields, T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", learn_from: Column | None = None) -> DataFrame:
    """doc_id, score and predicted (1 where score >= 0.5) for each row of ``docs``.

    * Null text counts as empty; an empty text has a score too.
    * Without labels of both kinds every score is the one label's value, or 0.
    * A label row without an id or value is not used; of several for an id the
      largest counts.  Repeated rows get equal scores.
    * Very long texts are read whole, in slices of rows of bounded size.
    * An empty table gives an empty result; other columns are not read.
    """
    model = learn(docs, labels, id_col, text_col, toxic_col, learn_from)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _with_scores(rows, model, "text").select(F.col("c0").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all their columns; cases as in :func:`toxicity`."""
    scored = _with_scores(docs, learn(docs, labels, **how), how.get("text_col", "text"))
    return scored.filter(F.col("score") < limit).drop("score").toDF(*docs.columns)
