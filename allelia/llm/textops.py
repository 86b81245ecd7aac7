"""Vectorised text helpers for Arrow batches inside Spark tasks.

A word is a maximal run of UTF-8 bytes outside 00-2F, 3A-60 and 7B-7F after A-Z have been lower-cased, which is
the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over characters. Work goes in blocks of a few hundred
kilobytes, so memory is bounded by a block or by one long text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 1 << 19

_codes = np.arange(256)
LOWER = np.where((_codes >= 65) & (_codes <= 90), _codes + 32, _codes).astype(np.uint8)
IS_WORD = (_codes >= 0x80) | ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, U64), np.ones(1, U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(salt))


_BYTE = seeds(256, 7)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least. Those for a block stay; longer ones, for a long text, do not."""
    global _powers
    if n <= len(_powers[0]):
        return _powers
    n = max(n, 2 * BLOCK_BYTES)
    inverse = pow(_BASE, -1, 1 << 64)
    made = tuple(np.concatenate([np.ones(1, U64), np.cumprod(np.full(n - 1, b, U64))]) for b in (_BASE, inverse))
    if n == 2 * BLOCK_BYTES:
        _powers = made
    return made


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary Arrow array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(first item, item after the last) of pieces of neighbouring items, each of limit bytes or one item; offs: where items start, and the end."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b
        a = b


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a column, each of limit bytes or one row."""
    data, offs = binary_column(column)
    for a, b in pieces(offs, limit):
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def flat_list(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets of a list column without nulls inside; a null list counts as empty."""
    size = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))


class Words:
    """The words of a block: start and end byte, hash, and first[i]:first[i+1] for the words of row i."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = LOWER[data]
        word = IS_WORD[low]
        fresh = np.zeros(len(data) + 1, bool)
        fresh[offs] = True
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data):
            before[1:] = word[:-1] & ~fresh[1:-1]
            after[:-1] = word[1:] & ~fresh[1:-1]
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offs)
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[low] * up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes that Words gives to these words."""
    found = Words(*binary_column(pa.array(words, pa.string())))
    assert len(found.hash) == len(words), "each entry must be one word"
    return found.hash


def shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of k consecutive words for each row; a row of fewer words, but not none, has one shingle of all."""
    h, first = words.hash, words.first
    weight = seeds(k, 11) | U64(1)
    n = len(h) - k + 1
    rolled = np.zeros(max(n, 0), U64)
    for j in range(k if n > 0 else 0):
        rolled += h[j : j + n] * weight[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.array([(h[a:b] * weight[: b - a]).sum(dtype=U64) + U64(b - a)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def set_id(tokens: np.ndarray, raw: bytes) -> bytes:
    """16 bytes that equal sets share; for a row without words, 16 bytes of its text."""
    import xxhash

    if not len(tokens):
        return xxhash.xxh3_128_digest(raw)
    return xxhash.xxh3_128_digest(tokens.tobytes())


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from batches that are sorted by the keys, and where each group starts (and the end).

    Holds the rows of the groups that are not ended, and hands on groups together once there are ``least`` rows.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            c = t.column(k).combine_chunks()
            if pa.types.is_binary(c.type) or pa.types.is_string(c.type):
                v = np.array(c.to_pylist(), object)
            else:
                v = c.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        cut = edges(table)
        if len(cut) > 2:
            last = int(cut[-2])
            yield table.slice(0, last), cut[:-1]
            rest = table.slice(last)
            held, rows = rest.combine_chunks().to_batches(), rest.num_rows
    if held:
        table = pa.Table.from_batches(held)
        yield table, edges(table)
