"""Word hashes and word shingles of whole batches of texts, in numpy on Arrow's own buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 18
_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240501))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = _U(0x9E3779B97F4A7C15)  # 5 modulo 8, so its powers have full period
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, at least, of the base and of its inverse; for pieces of common size they are kept."""
    if len(_powers) == 2 and len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, PIECE + 4096), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= PIECE + 4096:
        _powers[:] = made
    return made


def drop_powers() -> None:
    _powers.clear()


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 places where its texts begin and end; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[places[0] : places[-1]], places - places[0]


def _hash_piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, and per text where its words begin in them (n + 1 places)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    found, begins, at = [], [], 0
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    while at < n:
        end = min(n, at + PIECE)
        while end < n:  # to the next blank or beginning of a text
            stop = _BLANK[data[end : end + PIECE]] | first[end : end + len(data[end : end + PIECE])]
            hit = int(stop.argmax())
            if stop[hit]:
                end += hit
                break
            end += len(stop)
        piece, own = data[at:end], first[at : end + 1]
        word = ~_BLANK[piece]
        starts = word.copy()
        starts[1:] &= ~word[:-1] | own[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | own[1:-1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        found.append(_hash_piece(piece, s, e))
        begins.append(s + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(begins), offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; a text with fewer words is one shingle, without words none."""
    hashes, begins = word_hashes(data, offsets)
    n = len(hashes)
    joined = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        joined += hashes[j : n - k + 1 + j] * _PLACE[j] if len(joined) else joined
    joined = mix(joined)
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _U(b - a)], np.uint64))
        else:
            yield hashes[:0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
