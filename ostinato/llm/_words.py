"""Words of whole texts as NumPy arrays over the bytes of an Arrow batch: no Python object for a word.

Texts are cut into chunks of whole documents, so memory follows the chunk, or the longest single
document, and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_U = np.uint64
_ODD_BYTE, _ODD_WORD = _U(0x9E3779B97F4A7C15 | 1), _U(0xD6E8FEB86659FD93 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=_U) + _U(salt * 1_000_003 + 17)) | _U(1)


def _inverse(a: np.uint64) -> np.uint64:
    x = int(a)
    return _U(pow(x, -1, 1 << 64))


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as long as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inv, self.n = base, _inverse(base), 0
        self.up = self.down = np.ones(0, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16, min(2 * self.n, CHUNK))
            one = np.ones(1, _U)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([one, np.cumprod(np.full(self.n - 1, self.base, _U), dtype=_U)])
                self.down = np.concatenate([one, np.cumprod(np.full(self.n - 1, self.inv, _U), dtype=_U)])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = Powers(_ODD_BYTE), Powers(_ODD_WORD)


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER, SAME = _lower(), np.arange(256, dtype=np.uint8)
#: Bytes of words: all but space and the five control characters of white space.
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: Bytes of words: letters, digits and whatever is beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE_VALUE = mix(np.arange(256, dtype=_U) + _U(0x5851F42D4C957F2D))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and of the end in the bytes); nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if big else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of a chunk: starts and ends in the bytes, and the first word of each document with the end of the last."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, is_word: np.ndarray, fold: np.ndarray = SAME):
        self.data, self.offs, self.fold = data, offs, fold
        n = len(data)
        isw = is_word[data]
        first, last = isw.copy(), isw.copy()
        first[1:] &= ~isw[:-1]
        last[:-1] &= ~isw[1:]
        if n:
            edge = offs[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            first[edge] = isw[edge]
            last[edge - 1] = isw[edge - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.docs = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit fingerprint of each word."""
        up, down = _BYTES(len(self.data) + 1)
        value = _BYTE_VALUE[self.fold][self.data]
        with np.errstate(over="ignore"):
            value *= up[: len(value)]
            total = np.zeros(len(value) + 1, _U)
            np.cumsum(value, out=total[1:])
            return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k consecutive hashes (across documents too: the caller masks those)."""
    n = len(h)
    if n < k:
        return np.zeros(0, _U)
    up, down = _WORDS(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum(h * up[:n], out=total[1:])
        return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def runs(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the sequences h[start:end], their length included."""
    up, down = _WORDS(len(h) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, _U)
        np.cumsum(h * up[: len(h)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def spaced(w: Words, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of sequences of words, those of each joined by one space, and the first byte of each with the end of the last;
    first: the first of the words of each with the end of the last. No sequence is empty."""
    lens = w.ends[words] - w.starts[words]
    place = np.concatenate([[0], np.cumsum(lens + 1)])
    src = np.repeat(w.starts[words] - place[:-1], lens + 1) + np.arange(place[-1])
    out = w.data[np.minimum(src, len(w.data) - 1)] if len(src) else np.zeros(0, np.uint8)
    out[place[1:] - 1] = 32
    keep = np.ones(len(out), bool)
    keep[place[first[1:]] - 1] = False  # no space after the last word
    return out[keep], place[first] - np.arange(len(first))


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words joined by one space, by two gathers instead of a Python object for each word."""
    n = len(starts)
    if not n:
        return b""
    lens = ends - starts
    out_at = np.concatenate([[0], np.cumsum(lens + 1)])
    src = np.repeat(starts - out_at[:-1], lens + 1) + np.arange(out_at[-1])
    out = data[np.minimum(src, len(data) - 1)]
    out[out_at[1:] - 1] = 32
    return out[:-1].tobytes()
