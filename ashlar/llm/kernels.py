"""Vectorised text kernels over Arrow string buffers.

Words are hashed straight from the UTF-8 bytes, A-Z lower-cased, eight bytes at
a time: each lane goes through a bijective mixer before the next one is added,
so no two words collide by their structure, as they do under polynomials mod
2**64.  Words of more than ``LANES`` lanes are hashed by xxh3.  All temporaries
are bounded by ``BLOCK`` bytes of text, whatever a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_Q = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xCA5A826395121157)
    x ^= x >> U(29)
    return x


LANES = 16
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: by the bytes that are left in a word: what of a lane belongs to it
_MASK = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], U)
_powers: dict[str, np.ndarray] = {}


def powers() -> tuple[np.ndarray, np.ndarray]:
    """``P**i`` and ``P**-i`` for i below BLOCK, made once per process."""
    if not _powers:
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(BLOCK, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def separators(*parts: int | tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true for separator bytes."""
    table = np.zeros(256, bool)
    for p in parts:
        lo, hi = p if isinstance(p, tuple) else (p, p)
        table[lo : hi + 1] = True
    return table


#: white space of [\x20\x09-\x0D]
SPACES = separators(0x20, (0x09, 0x0D))
#: everything below 0x80 that is neither a digit nor a letter (letters after lower-casing)
NON_WORDS = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _word_block(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in at most BLOCK bytes."""
    inside = ~table[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(edge) % 2:
        edge = np.concatenate((edge, [len(raw)]))
    starts, ends = edge[::2], edge[1::2]
    return _hashes(LOWER[raw], starts, ends - starts), starts, ends


def _hashes(low: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``starts`` of lower-cased bytes."""
    padded = np.concatenate((low, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(low) + 1, "<u8", padded.data, 0, (1,))  # the eight bytes from every place on
    h = mix(sizes.astype(U) * _Q + U(1))
    at, left, own = starts, sizes, slice(None)
    for k in range(LANES):
        h[own] = mix((h[own] * _Q) ^ (lanes[at] & _MASK[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        own = more if k == 0 else own[more]
        at, left = at[more] + 8, left[more] - 8
    for w in own.tolist():
        h[w] = xxhash.xxh3_64_intdigest(low[starts[w] : starts[w] + sizes[w]])
    return h


def words(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one byte string, in order.

    Works in blocks that end at a separator; a word longer than a block is
    hashed on its own.
    """
    if len(raw) <= BLOCK:
        return _word_block(raw, table)
    out, at = [], 0
    while at < len(raw):
        end = min(at + BLOCK, len(raw))
        if end < len(raw):
            breaks = np.flatnonzero(table[raw[at:end]])
            if len(breaks):
                end = at + int(breaks[-1]) + 1
            else:
                end, h = _long_word(raw, at, table)
                out.append((np.array([h], U), np.array([at]), np.array([end])))
                at = end
                continue
        h, s, e = _word_block(raw[at:end], table)
        out.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _long_word(raw: np.ndarray, at: int, table: np.ndarray) -> tuple[int, int]:
    end = at
    while end < len(raw):
        breaks = np.flatnonzero(table[raw[end : end + BLOCK]])
        if len(breaks):
            end += int(breaks[0])
            break
        end = min(end + BLOCK, len(raw))
    if end - at <= 8 * LANES:
        return end, int(_hashes(LOWER[raw[at:end]], np.zeros(1, np.int64), np.array([end - at]))[0])
    h = xxhash.xxh3_64()
    for k in range(at, end, BLOCK):
        h.update(LOWER[raw[k : min(k + BLOCK, end)]])
    return end, h.intdigest()


def groups(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) whose bytes are together at most ``most``; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words_of_rows(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows [i, j): hashes, starts, ends of all words and the first word of each row (j - i + 1).

    Rows of one run lie next to each other, so a separator is put between them.
    """
    for i, j in groups(offsets):
        if j == i + 1:
            h, s, e = words(raw[offsets[i] : offsets[j]], table)
            yield i, j, h, s, e, np.array([0, len(h)])
            continue
        size = int(offsets[j] - offsets[i])
        at = offsets[i : j + 1] - offsets[i]
        spaced = np.full(size + (j - i), _separator(table), np.uint8)
        place = np.ones(len(spaced), bool)
        place[at[1:] + np.arange(j - i)] = False
        spaced[place] = raw[offsets[i] : offsets[j]]
        if len(spaced) > BLOCK:
            h, s, e = words(spaced, table)
        else:
            h, s, e = _word_block(spaced, table)
        first = np.searchsorted(s, at + np.arange(j - i + 1))
        yield i, j, h, s, e, first


def _separator(table: np.ndarray) -> int:
    return int(np.flatnonzero(table)[0])


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words (len - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _Q
        out += h[j : j + n]
    return mix(out + U(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, by doubling."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out[:n]


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.maximum(out[:-step], out[step:])
        have += step
    return out[:n]


def winnow(x: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the minimum of some window of w values (all ties; the least value if there are fewer)."""
    if not len(x):
        return np.zeros(0, np.int64)
    if len(x) <= w:
        return np.flatnonzero(x == x.min())
    low = sliding_min(x, w)
    edge = np.zeros(w - 1, x.dtype)
    high = sliding_max(np.concatenate((edge, low, edge)), w)
    return np.flatnonzero(x == high)
