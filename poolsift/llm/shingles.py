"""Hashed word shingles and similarity sketches of whole texts, many texts per numpy pass."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import whitespace_table

COORDS = 200
K = np.uint64
_M1, _M2, _M3 = K(0x9E3779B97F4A7C15), K(0xC2B2AE3D27D4EB4F), K(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> K(32))
    x = x * _M3
    x = x ^ (x >> K(29))
    x = x * _M2
    return x ^ (x >> K(32))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of concatenated texts: maximal runs of bytes other than 0x20 and 0x09-0x0D."""
    inside = ~whitespace_table()[data]
    edge = np.zeros(len(data) + 1, bool)        # a text's end parts words too
    edge[off] = True
    start = np.nonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))[0]
    end = np.nonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]])))[0] + 1
    return start, end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def first_bytes(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))[start].copy().view("<u8").ravel()


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, eight bytes a step, and its length."""
    h = np.zeros(len(start), np.uint64)
    if not len(start):
        return h
    length = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live = np.nonzero(length > 0)[0]
    at, left = start.copy(), length.copy()
    while len(live):
        eight = words[at[live]].copy().view(np.uint64).ravel()
        short = left[live] < 8
        keep = (K(1) << (K(8) * np.minimum(left[live], 7).astype(np.uint64))) - K(1)
        h[live] = mix((h[live] ^ np.where(short, eight & keep, eight)) + _M1)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return mix(h + length.astype(np.uint64) * _M1)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of concatenated texts (A-Z lower-cased), and words per text."""
    start, end = word_spans(data, off)
    counts = np.searchsorted(start, off[1:]) - np.searchsorted(start, off[:-1])
    return span_hashes(lower_ascii(data), start, end), counts


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, concatenated, and their bounds.

    A text with fewer words has the whole sequence as its one shingle; without words it has none.
    """
    w, counts = word_hashes(data, off)
    first = np.concatenate([[0], np.cumsum(counts)])
    n_docs, total = len(counts), len(w)
    g = w.copy()
    for k in range(1, width):
        g[:total - k] = mix(g[:total - k] * _M1 + w[k:]) if k < total else g[:0]
    doc = np.repeat(np.arange(n_docs), counts)
    place = np.arange(total) - first[doc]
    whole = place + width <= counts[doc]
    g, d = g[whole], doc[whole]
    short = np.nonzero((counts > 0) & (counts < width))[0]
    if len(short):
        x, left = w[first[short]], counts[short]
        for k in range(1, width - 1):
            more = left > k
            x = np.where(more, mix(x * _M1 + w[np.where(more, first[short] + k, 0)]), x)
        # salted with the number of words: no text of full width shares the hash
        g, d = np.concatenate([g, mix(x + left.astype(np.uint64))]), np.concatenate([d, short])
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    g, d = g[new], d[new]
    return g, np.searchsorted(d, np.arange(n_docs + 1))


def digests(g: np.ndarray, bounds: np.ndarray) -> list:
    return [hashlib.blake2b(g[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]


def sketches(g: np.ndarray, bounds: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketches, (texts, t) of 64-bit values; rows of empty sets are all ones.

    In round i < t every element falls into one hashed bin with a hashed value,
    and a bin keeps the smallest (round, value); a text is done when its bins are
    full, after about t ln t placements in all.  In round t + i all elements fall into
    bin i, which fills whatever is left.
    """
    n = len(bounds) - 1
    size = np.diff(bounds)
    full = np.iinfo(np.uint64).max
    out = np.full(n * t, full, np.uint64)
    live = np.nonzero(size > 0)[0]
    step = 0
    while len(live) and step < 2 * t:
        reps = size[live]
        total = int(reps.sum())
        x = g[np.repeat(bounds[live], reps) + (np.arange(total) - np.repeat(np.cumsum(reps) - reps, reps))]
        owner = np.repeat(live, reps)
        h = mix(x + K(((step + 1) * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> K(40)) * K(t) >> K(24)).astype(np.int64) if step < t else np.full(total, step - t)
        value = (K(step) << K(40)) | (h & K((1 << 40) - 1))
        np.minimum.at(out, owner * t + bins, value)
        step += 1
        live = live[(out.reshape(n, t)[live] == full).any(1)]
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """(texts, bands) of signed 64-bit keys; the band's number is mixed in."""
    n, t = sketch.shape
    parts = sketch.reshape(n, t // rows, rows)
    key = np.arange(1, t // rows + 1, dtype=np.uint64)[None, :] * _M1
    for r in range(rows):
        key = mix(key + parts[:, :, r])
    return key.view(np.int64)
