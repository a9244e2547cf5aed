"""Words and hashes of whole texts, straight from Arrow's UTF-8 buffers.

A batch is cut into chunks of documents of a few MB (a longer document is a chunk of its own), and
every step is one numpy operation over a chunk. Word classes are byte classes: bytes of multi-byte
characters always count as word bytes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
CHUNK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1


def byte_mask(separators) -> np.ndarray:
    mask = np.ones(256, dtype=bool)
    mask[list(separators)] = False
    return mask


def space_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    return byte_mask([0x20, *range(0x09, 0x0E)])


def alnum_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z were lower-cased."""
    mask = byte_mask([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
    mask[0x41:0x5B] = True
    return mask


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(BASE) + _U(seed))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=_U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES)
            inverse = pow(BASE, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.up = np.concatenate(([_U(1)], np.full(size - 1, BASE, dtype=_U))).cumprod(dtype=_U)
                self.down = np.concatenate(([_U(1)], np.full(size - 1, inverse, dtype=_U))).cumprod(dtype=_U)
        return self.up, self.down


def chunks(column, max_bytes: int = CHUNK_BYTES):
    """``(first row, data, offsets)`` for runs of rows; ``offsets`` has one entry more than rows."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def pieces(column, word_bytes, max_bytes: int = CHUNK_BYTES):
    """``(first row, data, offsets)`` as ``chunks`` gives them, but a longer document comes in several
    pieces of one row each, cut between words (a single word is never cut). For what adds up over words."""
    for lo, data, offs in chunks(column, max_bytes):
        n = len(data)
        if len(offs) > 2 or n <= max_bytes:
            yield lo, data, offs
            continue
        a = 0
        while a < n:
            b = min(a + max_bytes, n)
            if b < n:
                gaps = np.flatnonzero(~word_bytes[data[a:b]])
                if len(gaps):
                    b = a + int(gaps[-1]) + 1
                else:
                    while b < n and word_bytes[data[b]]:
                        ahead = np.flatnonzero(~word_bytes[data[b : b + max_bytes]])
                        b = b + int(ahead[0]) + 1 if len(ahead) else min(b + max_bytes, n)
            yield lo, data[a:b], np.array([0, b - a], dtype=np.int64)
            a = b


class Words:
    """Word starts, ends, hashes and per-document word offsets of a chunk."""

    def __init__(self, data, offs, word_bytes, powers: Powers, lower: bool = True):
        n = len(data)
        is_word = word_bytes[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = True, ~is_word[:-1]
            after[-1], after[:-1] = True, ~is_word[1:]
        self.starts = np.flatnonzero(is_word & (before | edge[:n]))
        self.ends = np.flatnonzero(is_word & (after | edge[1:])) + 1
        self.offs = np.searchsorted(self.starts, offs)
        values = stream(7, 256)
        if lower:
            values[0x41:0x5B] = values[0x61:0x7B]
        up, down = powers.upto(n + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, dtype=_U)
            np.cumsum(values[data] * up[:n], out=total[1:])
            raw = (total[self.ends] - total[self.starts]) * down[self.starts]
            self.hashes = mix(raw + (self.ends - self.starts).astype(_U))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``k`` words and per-document offsets; a document of fewer words has its
        whole sequence as one, a document without words none."""
        h, offs = self.hashes, self.offs
        counts = np.diff(offs)
        factors = stream(11, k)
        with np.errstate(over="ignore"):
            n = max(len(h) - k + 1, 0)
            run = np.zeros(n, dtype=_U)
            for j in range(k):
                run += h[j : j + n] * (factors[j] | _U(1))
            run = mix(run)
        doc = np.repeat(np.arange(len(counts)), counts)
        whole = run[doc[:n] == doc[k - 1 : k - 1 + n]] if n else run
        sizes = np.maximum(counts - k + 1, 0)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if not len(short):
            return whole, np.concatenate(([0], np.cumsum(sizes)))
        out_sizes = sizes.copy()
        out_sizes[short] = 1
        out_offs = np.concatenate(([0], np.cumsum(out_sizes)))
        out = np.empty(out_offs[-1], dtype=_U)
        mask = np.ones(len(out), dtype=bool)
        mask[out_offs[short]] = False
        out[mask] = whole
        for d in short:
            words = h[offs[d] : offs[d + 1]]
            with np.errstate(over="ignore"):
                out[out_offs[d]] = mix(np.array([(words * (factors[: len(words)] | _U(1))).sum(dtype=_U) + _U(0xA5A5 + len(words))], dtype=_U))[0]
        return out, out_offs


def unsigned_to_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
