"""Words and word shingles of whole batches of texts, as 64-bit hashes.

A word is a maximal run of ASCII letters, digits, underscores or non-ASCII bytes of the
lower-cased UTF-8 text. Documents with one to four words have one shingle: all their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from marginmart.llm._common import worker_cache

WORDS = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, byte classes, powers of an odd base and of its inverse, for texts up to n bytes."""
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[2]) < n:
        size = max(1 << 21, n) + 1
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        values = mix(np.arange(1, 257, dtype=np.uint64) * base)
        word = np.zeros(256, bool)
        word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
        with np.errstate(over="ignore"):
            up = np.concatenate([[np.uint64(1)], np.full(size - 1, base)]).cumprod(dtype=np.uint64)
            down = np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]).cumprod(dtype=np.uint64)
        have = cache["powers"] = (values, word, up, down)
    return have


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array (null: empty) and the offsets of its rows."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts, texts.slice(0, 0)])
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the batch, in order, and the offsets of the rows among them."""
    raw, offsets = utf8(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    values, is_word, up, down = _powers(len(raw))
    inside = is_word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    total = values[raw]
    total *= up[: len(raw)]
    np.cumsum(total, out=total)
    h = total[end]
    h[start > 0] -= total[start[start > 0] - 1]
    return mix(h * down[start]), np.searchsorted(start, offsets).astype(np.int64)


def shingles(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle of ``size`` words of the batch, in order, and the offsets of the rows."""
    h, at = words(texts)
    return shingle_words(h, at, size)


def shingle_words(h: np.ndarray, at: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    factor = np.uint64(0xD1342543DE82EF95)
    n = np.diff(at)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), out_at
    wide = np.concatenate([h, np.zeros(size, np.uint64)])
    rolled = wide[: len(h)].copy()
    for j in range(1, size):
        rolled = rolled * factor + wide[j : len(h) + j]
    rolled = mix(rolled)
    for row in np.flatnonzero((n > 0) & (n < size)):
        short = int(n[row])
        for x in h[at[row] : at[row + 1]].tolist():
            short = (short * int(factor) + x) % (1 << 64)
        rolled[at[row]] = mix(np.array([short], np.uint64))[0]
    rows = np.repeat(np.arange(len(n)), counts)
    return rolled[np.arange(out_at[-1]) - out_at[rows] + at[rows]], out_at


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; no row bounds."""
    n = len(words) - size + 1
    out = np.full(max(0, n), size, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + words[j : n + j]
    return mix(out)
