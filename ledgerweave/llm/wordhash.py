"""Vectorised word and shingle hashes over UTF-8 buffers.

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``.  Its hash is a
polynomial over its bytes modulo 2**64, read off one running sum over the whole
buffer, and then mixed; a shingle's hash combines the hashes of its words in
order.  The same text gives the same hash wherever it stands.

Polynomials modulo a power of two have known collisions among long texts that
swap two parts in the Thue-Morse pattern.  Where long spans are told apart, the
second hash below stands beside the first: polynomials modulo two primes, with
62 bits that share nothing with the first.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 1 << 64)

BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 (public domain), which spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, factor in enumerate((_BASE, _UNDO)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def running(buf: np.ndarray) -> np.ndarray:
    """n + 1 running sums, from which :func:`span_hash` reads the hash of any span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


#: Two primes, and a base for each.
_PRIMES = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 1_664_525_077))
#: Powers that a worker keeps for the next text; longer texts make the rest anew.
_POWERS_KEPT = (1 << 20) + (1 << 17)
_prime_powers = [[np.ones(1, np.uint32), np.ones(1, np.uint32)] for _ in _PRIMES]


def _powers_modulo(k: int, which: int, n: int) -> np.ndarray:
    """Powers 0 .. n - 1 of the base of prime ``k`` (``which`` 0) or of its inverse (1)."""
    prime, base = _PRIMES[k]
    factor = base if which == 0 else pow(base, -1, prime)
    have = _prime_powers[k][which]
    while len(have) < n:
        more = have[: -(-n // 65536) * 65536 - len(have)].astype(np.uint64)
        more *= np.uint64(pow(factor, len(have), prime))
        more %= np.uint64(prime)
        have = np.concatenate([have, more.astype(np.uint32)])
    if len(have) <= _POWERS_KEPT:
        _prime_powers[k][which] = have
    return have


def second_running(values: np.ndarray) -> list[np.ndarray]:
    """Running sums for :func:`second_hash` over bytes, or over second hashes of words."""
    out = []
    for k, (prime, _) in enumerate(_PRIMES):
        reduced = values.astype(np.uint64)
        if values.dtype != np.uint8:
            reduced %= np.uint64(prime - 1)
        reduced += np.uint64(1)
        reduced *= _powers_modulo(k, 0, len(values))[: len(values)]
        reduced %= np.uint64(prime)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(reduced, out=sums[1:])
        out.append(sums)
    return out


def second_hash(sums: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62 bits of each span, mixed, which share nothing with :func:`span_hash`."""
    halves = []
    for k, (prime, _) in enumerate(_PRIMES):
        part = (sums[k][end] - sums[k][start]) % np.uint64(prime)
        part *= _powers_modulo(k, 1, len(sums[k]))[start]
        part %= np.uint64(prime)
        halves.append(part)
    return mix((halves[0] << np.uint64(31)) | halves[1])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) the index of its first word."""
    n = len(buf)
    full = ~BLANK[buf]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    at = off[:-1][off[:-1] < n]
    first[at] = full[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = full[at]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the row offsets into them."""
    start, end, row = words(buf, off)
    return span_hash(running(buf), start, end), row


def strong_word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, from both hashes: 64 bits without the collisions that the first has."""
    start, end, row = words(buf, off)
    return mix(span_hash(running(buf), start, end) + second_hash(second_running(buf), start, end) * np.uint64(_BASE)), row


def shingle_hashes(word: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words of each row, repeats included, and their row offsets.

    A row with fewer words gives one shingle of all of them; without words, none.
    """
    n = np.diff(row)
    if len(word) >= width:
        every = np.zeros(len(word) - width + 1, np.uint64)
        for k in range(width):
            every = every * np.uint64(_BASE) + word[k : len(word) - width + 1 + k]
        every = mix(every ^ np.uint64(width))
    else:
        every = np.empty(0, np.uint64)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    offsets = np.concatenate([[0], np.cumsum(count)])
    source = np.repeat(row[:-1] - offsets[:-1], count) + np.arange(offsets[-1])
    out = np.zeros(offsets[-1], np.uint64)
    whole = np.repeat(n >= width, count)
    out[whole] = every[source[whole]]
    for r in np.flatnonzero((n > 0) & (n < width)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in word[row[r] : row[r + 1]]:
                h = h * np.uint64(_BASE) + w
            out[offsets[r]] = mix(np.array([h ^ np.uint64(int(n[r]))]))[0]
    return out, offsets
