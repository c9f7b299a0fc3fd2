"""Vectorised word and shingle hashes over Arrow string arrays.

Texts are hashed as UTF-8 bytes in groups of a few hundred KB, so memory does not
follow the size of a batch. A word's hash is a polynomial in its bytes modulo
2**64, read off prefix sums, so no Python object is made for any word. A text
longer than a group is hashed slice by slice, cut between words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)
    return mix(x) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class WordRule:
    """Which bytes form words, and how they are folded before hashing."""

    def __init__(self, separators: bytes | None = None):
        byte = np.arange(256)
        if separators is None:  # runs of ASCII letters, digits and anything beyond ASCII
            word = (byte >= 128) | ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122))
        else:
            word = ~np.isin(byte, np.frombuffer(separators, np.uint8))
        fold = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.word = word
        self.value = np.where(word, mix(fold.astype(np.uint64) + np.uint64(0x5BD1E995)), np.uint64(0))


#: Words are maximal runs without ASCII white space.
SPACED = WordRule(b" \t\n\x0b\x0c\r")
#: Words are maximal runs of letters and digits.
ALNUM = WordRule()

_TABLES: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES or len(_TABLES[0]) < n:
        size = max(n, 2 * GROUP_BYTES) + 1
        _TABLES[:] = [_powers(_BASE, size), _powers(_INV, size)]
    return _TABLES[0], _TABLES[1]


def _slice_words(data: np.ndarray, rule: WordRule, starts_at: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of the words of data; a word never crosses a position of starts_at.

    With prefix lengths, hashes has a row for each, of the words' first bytes, below that of the words.
    """
    n = len(data)
    word = rule.word[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    before[starts_at[starts_at < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[starts_at[(starts_at > 0) & (starts_at <= n)] - 1] = False
    first = np.flatnonzero(word & ~before)
    last = np.flatnonzero(word & ~after)
    power, inverse = _tables(n)
    total = np.cumsum(rule.value[data] * power[:n], dtype=np.uint64)
    head = np.where(first > 0, total[first - 1], np.uint64(0))
    value = (total[last] - head) * inverse[first]
    length = last - first + 1
    value = mix(value + length.astype(np.uint64))
    if prefixes:
        starts = [(total[np.minimum(last, first + n - 1)] - head) * inverse[first] for n in prefixes]
        value = np.stack([value, *(mix(s + np.uint64(n)) for s, n in zip(starts, prefixes))])
    return value, first


def _long_words(data: np.ndarray, rule: WordRule, prefixes: tuple[int, ...]) -> np.ndarray:
    """Word hashes of one text of any length."""
    out, at, n, zero = [], 0, len(data), np.zeros(1, np.int64)
    while at < n:
        end = min(at + GROUP_BYTES, n)
        step = GROUP_BYTES
        while end < n and rule.word[data[end - 1]] and rule.word[data[end]]:
            # back to the last separator of the slice; a word longer than a slice widens it
            gaps = np.flatnonzero(~rule.word[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                step *= 2
                end = min(at + step, n)
        out.append(_slice_words(data[at:end], rule, zero, prefixes)[0])
        at = end
    return np.concatenate(out, axis=-1) if out else np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Column as one Arrow string array with 64-bit offsets; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column, and the offsets of its rows in them."""
    column = as_strings(column)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8, int(off[-1] - off[0]), int(off[0])), off - off[0]


def words(column: pa.Array, rule: WordRule, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Groups of rows: (first row, word hashes, number of words of each row).

    With prefix lengths, the hashes are rows: of whole words, and of the prefixes of each length.
    """
    data, off = text_bytes(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + GROUP_BYTES, side="right")) - 1)
        to = min(to, n)
        part = data[off[at] : off[to]]
        if len(part) > 2 * GROUP_BYTES:
            hashes = _long_words(part, rule, prefixes)
            yield at, hashes, np.array([hashes.shape[-1]])
        else:
            hashes, first = _slice_words(part, rule, off[at : to + 1] - off[at], prefixes)
            edges = np.searchsorted(first, off[at : to + 1] - off[at])
            yield at, hashes, np.diff(edges)
        at = to


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles, and how many each row has (repeats included).

    A row of one to n - 1 words has one shingle, its whole sequence.
    """
    c = constants(n, 17)
    total = len(hashes)
    begin = np.concatenate([[0], np.cumsum(counts)])
    if total >= n:
        full = hashes[: total - n + 1] * c[0]
        for j in range(1, n):
            full = full + hashes[j : total - n + 1 + j] * c[j]
        value = mix(full)
        if len(counts) > 1:
            row = np.repeat(np.arange(len(counts)), counts)
            value = value[row[: total - n + 1] == row[n - 1 :]]
    else:
        value = np.zeros(0, np.uint64)
    number = np.maximum(counts - n + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = []
        for r in short:
            w = hashes[begin[r] : begin[r + 1]]
            extra.append(np.bitwise_xor.reduce(mix(np.array([np.sum(w * c[: len(w)], dtype=np.uint64) + np.uint64(len(w))]))))
        at = np.concatenate([[0], np.cumsum(number)])[short]
        value = np.insert(value, at, np.array(extra, np.uint64))
        number = number.copy()
        number[short] = 1
    return value, number


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def shingle_sets(column: pa.Array, rule: WordRule, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for at, hashes, counts in words(column, rule):
        value, number = shingles(hashes, counts, n)
        edge = np.concatenate([[0], np.cumsum(number)])
        for r in range(len(counts)):
            yield at + r, distinct(value[edge[r] : edge[r + 1]])
