"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are lower-cased and ASCII punctuation is a blank.  Templates of like size
share a window size: twice the class's shingles, at steps of half a window, so
that each occurrence lies whole in some window.  Shingles that no template has
add to no containment and are left out of the windows before they are hashed, so
most windows are empty.  With class sizes 1, 2, 3, 4, 6, 8, 12, ... a template that
is contained in a window with 0.8 has a Jaccard similarity of at least 0.25 with
it, and with one hash a band, 48 bands miss it with probability
(1 - 0.25) ** 48 < 1.1e-6.  A window's band value is looked up among the sorted
values of its class's templates.  Windows that share a band with a template are
then compared shingle by shingle.

The templates are whole license texts, the headers that their publishers ask
for, and one-line notices made from names by rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.common import id_and_text, slices, text_buffers
from ledgerweave.llm.wordhash import LOWER, mix, shingle_hashes, word_hashes

BANDS, WIDTH, CONTAINED = 48, 5, 0.8

# Names of licenses, and the forms of one-line notices.
NAMES = {
    "MIT": "MIT License",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
}
NOTICES = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.")
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_NOTICES = ("Licensed under CC {short} {version}.", "This work is licensed under a Creative Commons {long} {version} International License.")
GNU = {"GPL-2.0": ("GNU General Public License", "2"), "GPL-3.0": ("GNU General Public License", "3"), "LGPL-2.1": ("GNU Lesser General Public License", "2.1"), "LGPL-3.0": ("GNU Lesser General Public License", "3"), "AGPL-3.0": ("GNU Affero General Public License", "3")}
GNU_HEADER = (
    "is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details."
)


def _templates() -> dict[str, str]:
    """Texts by name: files of ``licenses/`` (about 130 KB), and notices by rule."""
    folder = resources.files("ledgerweave.llm") / "licenses"
    out = {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
    out |= {f"{k} header": GNU_HEADER.format(*v) for k, v in GNU.items()}
    for k, name in NAMES.items():
        out |= {f"{k} notice {i + 1}": form.format(name) for i, form in enumerate(NOTICES)}
    for k, name in COMMONS.items():
        for version in ("3.0", "4.0"):
            out |= {f"CC-{k}-{version} notice {i + 1}": form.format(short=k, long=name, version=version) for i, form in enumerate(COMMONS_NOTICES)}
    return out


TEMPLATES = _templates()

_FOLD = LOWER.copy()
_FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    buf, off = text_buffers(texts)
    return shingle_hashes(*word_hashes(_FOLD[buf], off), width)


def _permuted(h: np.ndarray, band: int) -> np.ndarray:
    x = (h ^ _SALT[band]) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def class_size(n: int) -> int:
    """The smallest of 1, 2, 3, 4, 6, 8, 12, ... that is at least ``n``."""
    two = 1 << max(0, n - 1).bit_length()
    return 3 * two // 4 if two >= 4 and 3 * two // 4 >= n else two


class Templates:
    """Shingle sets of the templates by class of window size, and their sorted band values."""

    def __init__(self, texts: Sequence[str], width: int) -> None:
        every, off = shingles(pa.array(list(texts), pa.string()), width)
        self.sets = [np.unique(every[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
        classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            if len(s):
                classes.setdefault(class_size(len(s)), []).append(t)
        self.shingles = np.unique(np.concatenate([*self.sets, np.empty(0, np.uint64)]))
        self.seen = np.zeros(1 << 20, bool)  # which leading 20 bits occur, for a first look
        self.seen[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        # Per class and band: sorted values, and their templates
        self.bands: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size, members in sorted(classes.items()):
            low = [np.array([_permuted(self.sets[t], band).min() for t in members]) for band in range(BANDS)]
            self.bands[size] = [(x[order := np.argsort(x, kind="stable")], np.array(members)[order]) for x in low]

    def known(self, every: np.ndarray) -> np.ndarray:
        """Places of the shingles that some template has."""
        at = np.flatnonzero(self.seen[(every >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.shingles, every[at]), len(self.shingles) - 1)
        return at[self.shingles[k] == every[at]]


def scan(texts: pa.Array, templates: Templates, width: int, contained: float) -> list[tuple[int, int, float, int]]:
    """(row, template, containment, first shingle of the window) of the best window for each row and template found."""
    every, off = shingles(texts, width)
    known = templates.known(every)
    if not len(known):
        return []
    row = np.searchsorted(off, known, "right") - 1
    hashes = [_permuted(every[known], band) for band in range(BANDS)]
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for size, bands in templates.bands.items():
        # A shingle of block b is in the windows of blocks b and b + 1, and b - 1 and b
        block = (known - off[row]) // size
        second = np.flatnonzero(block)
        whose, window, place = np.concatenate([row, row[second]]), np.concatenate([block, block[second] - 1]), np.concatenate([np.arange(len(known)), second])
        order = np.lexsort((window, whose))
        whose, window, place = whose[order], window[order], place[order]
        head = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (window[1:] != window[:-1])]))
        candidates = []
        for band, (values, members) in enumerate(bands):
            low = np.minimum.reduceat(hashes[band][place], head)
            left, right = np.searchsorted(values, low, "left"), np.searchsorted(values, low, "right")
            n = right - left
            which = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            candidates.append(np.stack([np.repeat(np.arange(len(low)), n), members[which]]))
        for w, t in np.unique(np.concatenate(candidates, axis=1), axis=1).T.tolist():
            r, at = int(whose[head[w]]), int(window[head[w]]) * size
            start = int(off[r]) + at
            share = len(np.intersect1d(every[start : min(start + 2 * size, int(off[r + 1]))], templates.sets[t])) / len(templates.sets[t])
            if share >= contained:
                best[r, t] = max(best.get((r, t), (0.0, 0)), (share, -at))
    return sorted((r, t, share, -at) for (r, t), (share, at) in best.items())


def _scanned(texts: list[str], width: int, contained: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts, width)
        for batch in batches:
            for part in slices(batch, 1):
                found = scan(part["text"], templates, width, contained)
                ids = part["doc_id"].take(pa.array([f[0] for f in found], pa.int64()))
                cols = [pa.array([f[k] for f in found], kind) for k, kind in ((1, pa.int32()), (2, pa.float64()), (3, pa.int64()))]
                yield pa.record_batch([ids, *cols], names=["doc_id", "template", "containment", "window_start"])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, contained: float = CONTAINED) -> DataFrame:
    """One row for each text and template that one of its windows contains: doc_id, license, containment, window_start.

    ``containment`` is the share of the template's shingles in its best window
    (of several, the first), ``window_start`` that window's first word.

    * Null or empty text, or one without words, gives no row; so does a template
      without words.  A text or template shorter than a shingle is one shingle.
    * Texts are scanned whole, in slices of rows of bounded size.  Repeated rows
      give repeated results.  An empty table gives an empty result; other columns
      are not read.
    """
    templates = TEMPLATES if templates is None else templates
    names = list(templates)
    rows = id_and_text(docs, id_col, text_col)
    found = rows.mapInArrow(_scanned(list(templates.values()), width, contained), "doc_id long, template int, containment double, window_start long")
    named = F.element_at(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("template") + 1)
    return found.select("doc_id", named.alias("license"), "containment", "window_start")
