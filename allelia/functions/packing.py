"""Genotypes of a site as bit planes, and allele counts of populations by ``bit_count``.

A site has an array ``bits`` of 63-bit words and its number ``top`` of alternate alleles. Word ``(h * (1 + top) + k) * W + w`` belongs to the h-th
haplotype of samples 63 * w and on, W = ceil(samples / 63); bit i of it is sample 63 * w + i. Plane k = 0 has the called alleles, plane k the calls
of allele k. Words past the end count as zero, so null bits are a site without any call, and haplotypes beyond a row's own are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 63
#: Words that are written out in an expression; more are summed by a higher-order function.
WRITTEN_OUT = 96
#: Largest allele index that is read; beyond it an allele is missing (VCF numbers alleles by their place in ALT).
MOST_ALLELES = 10_000


def words_of(samples: int) -> int:
    return -(-samples // WORD)


def mask_of(indices: list[int], samples: int) -> list[int]:
    """The words that have the bits of some samples."""
    out = [0] * words_of(samples)
    for i in indices:
        out[i // WORD] |= 1 << i % WORD
    return out


class Counter:
    """Counts over the samples of one mask: SQL expressions on ``bits``, ``top`` and, if ploidy differs between rows, ``ploidy``."""

    def __init__(self, mask: list[int], haplotypes: int, by_row: bool):
        self.mask, self.width, self.haplotypes, self.by_row = mask, len(mask), haplotypes, by_row
        self.some = [w for w, m in enumerate(mask) if m]

    def _sum(self, term, haplotypes: int | None = None) -> str:
        """The sum of term(haplotype, word, mask) over haplotypes and words, as SQL."""
        many = self.haplotypes if haplotypes is None else haplotypes
        if not self.some or not many:
            return "0L"
        if len(self.some) * many <= WRITTEN_OUT:
            parts = []
            for h in range(many):
                own = " + ".join(f"coalesce(bit_count({term(str(h), str(w))} & {self.mask[w]}L), 0)" for w in self.some)
                parts.append(f"if({h} < ploidy, {own}, 0)" if self.by_row and h else f"({own})")
            return f"cast({' + '.join(parts)} as bigint)"
        masks = f"array({', '.join(f'{m}L' for m in self.mask)})"
        last = f"least({many}, ploidy)" if self.by_row and haplotypes is None else str(many)
        return f"aggregate(sequence(0, {last} * {self.width} - 1), 0L, (s, i) -> s + coalesce(bit_count({term(f'(i div {self.width})', f'(i % {self.width})')} & get({masks}, cast(i % {self.width} as int))), 0))"

    def word(self, h: str, plane: str, w: str) -> str:
        return f"get(bits, cast(({h} * (1 + top) + {plane}) * {self.width} + {w} as int))"

    def called(self) -> str:
        return self._sum(lambda h, w: self.word(h, "0", w))

    def allele(self, a: str) -> str:
        return self._sum(lambda h, w: self.word(h, a, w))

    def counts(self, called: str = "", first: str = "") -> str:
        """array<bigint> of all alleles; ``called`` and ``first``: columns that have these counts already."""
        called, first = called or self.called(), first or self.allele("1")
        more = f"transform(sequence(1, top), a -> {self.allele('a')})"
        second = self.allele("2")
        # up to three alleles are written out, more go through higher-order functions
        return f"if(top = 1, array({called} - {first}, {first}), if(top = 2, array({called} - {first} - {second}, {first}, {second}), concat(array({called} - aggregate({more}, 0L, (s, x) -> s + x)), {more})))"

    def heterozygotes(self) -> str:
        """array<bigint>: for each allele, the diploid genotypes with both alleles called that carry it once."""
        both = lambda w: f"{self.word('0', '0', w)} & {self.word('1', '0', w)}"
        one = lambda a: self._sum(lambda _, w: f"({both(w)}) & ({self.word('0', a, w)} ^ {self.word('1', a, w)})", 1)
        plain = one("1")
        other = lambda h, w: f"aggregate(sequence(1, top), 0L, (s, a) -> s | {self.word(h, 'a', w)})"
        reference = self._sum(lambda _, w: f"({both(w)}) & ({other('0', w)} ^ {other('1', w)})", 1)
        return f"if(top = 1, array({plain}, {plain}), concat(array({reference}), transform(sequence(1, top), a -> {one('a')})))"


def pack(gt: Column, samples: int, ploidy: int) -> tuple[Column, Column]:
    """(bits, top) of genotypes array<array<int>>; for VCF text, ``pack_calls`` is much faster."""
    top = F.greatest(F.coalesce(F.array_max(F.flatten(gt)), F.lit(0)), F.lit(1))
    w = words_of(samples)

    def word(i: Column) -> Column:
        h, k, s0 = F.floor(i / ((1 + top) * w)).cast("int"), (F.floor(i / w) % (1 + top)).cast("int"), (i % w * WORD).cast("int")
        own = lambda j: F.get(F.get(gt, s0 + j), h)
        on = lambda j: F.when(k == 0, own(j) >= 0).otherwise(own(j) == k)
        return F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("long"), lambda s, j: s + F.when(on(j), F.call_function("shiftleft", F.lit(1).cast("long"), j)).otherwise(0))

    return F.transform(F.sequence(F.lit(0), ploidy * (1 + top) * w - 1), word), top


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array, null as empty; a tab follows the last byte."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data else np.zeros(0, np.uint8)
    return np.append(raw, np.uint8(9)), offs - offs[0]


def alleles_of_calls(data: np.ndarray, offs: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(alleles[row, sample, haplotype] with -1 for missing, ploidy[row, sample] with 0 for no field) of tab-separated sample fields ``GT:...``.

    The ploidy of a genotype is its number of alleles, but 1 where exactly one is called.
    """
    rows = len(offs) - 1
    tab = np.flatnonzero(data[:-1] == 9)
    of_tab = np.searchsorted(offs, tab, "right") - 1
    full = np.flatnonzero(np.diff(offs) > 0)
    # the first field of each row, and those behind a tab
    start, row = np.append(offs[:-1][full], tab + 1), np.append(full, of_tab)
    column = np.append(np.zeros(len(full), np.int64), np.arange(len(tab)) - np.searchsorted(tab, offs[of_tab]) + 1)
    end_of_row = offs[row + 1]
    keep = column < samples
    at, row, column, last = start[keep], row[keep], column[keep], end_of_row[keep]
    ploidy = np.zeros((rows, samples), np.int32)
    called = np.zeros(len(at), np.int32)
    tokens = np.zeros(len(at), np.int32)
    look = lambda p, e: np.where(p < e, data[np.minimum(p, len(data) - 1)], 9)
    ends = lambda c: (c == 9) | (c == 58)
    # most genotypes are two characters with a separator between
    one, by, two = (data[np.minimum(at + k, len(data) - 1)] for k in range(3))
    simple = (at + 3 <= last) & ends(look(at + 3, last)) & ((by == 47) | (by == 124))
    for c in (one, two):
        simple &= ((c >= 48) & (c <= 57)) | (c == 46)
    found: list[np.ndarray] = []
    if simple.any():
        for c in (one, two):
            layer = np.full((rows, samples), -1, np.int32)
            layer[row[simple], column[simple]] = np.where(c[simple] == 46, -1, c[simple].astype(np.int32) - 48)
            found.append(layer)
            called[simple] += c[simple] != 46
        tokens[simple] = 2
    on, h = np.flatnonzero(~simple), 0
    while len(on):
        value, digits, begin = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64), at[on].copy()
        c = look(at[on], last[on])
        while (digit := (c >= 48) & (c <= 57)).any():
            value = np.where(digit, np.minimum(value * 10 + c - 48, MOST_ALLELES + 1), value)
            digits += digit
            at[on] += digit
            c = look(at[on], last[on])
        odd = ~(ends(c) | (c == 47) | (c == 124))
        dot = odd & (c == 46) & (digits == 0)
        while (skip := ~(ends(c) | (c == 47) | (c == 124))).any():
            at[on] += skip
            c = look(at[on], last[on])
        lone_dot = dot & (at[on] == begin + 1)
        if h == len(found):
            found.append(np.full((rows, samples), -1, np.int32))
        found[h][row[on], column[on]] = np.where(odd | (digits == 0) | (value > MOST_ALLELES), -1, value)
        h += 1
        tokens[on] += 1
        called[on] += ~lone_dot
        more = ~ends(c)
        on = on[more]
        at[on] += 1
    ploidy[row, column] = np.where((tokens == 1) | (called == 1), 1, tokens)
    if not found:
        return np.full((rows, samples, 1), -1, np.int32), ploidy
    return np.stack(found, axis=2), ploidy


def planes(alleles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat words, row offsets and ``top`` of alleles[row, sample, haplotype]."""
    rows, samples, haplotypes = alleles.shape
    w = words_of(samples)
    top = np.maximum(alleles.reshape(rows, -1).max(axis=1, initial=0), 1)
    first = np.append(0, np.cumsum(haplotypes * (1 + top) * w))
    flat = np.zeros(first[-1], np.int64)
    for t in np.unique(top).tolist():
        own = np.flatnonzero(top == t)
        some = alleles[own]
        out = np.zeros((len(own), haplotypes, 1 + t, w), np.int64)
        for k in range(1 + t):
            on = some >= 0 if k == 0 else some == k
            padded = np.zeros((len(own), haplotypes, w * WORD), bool)
            padded[:, :, :samples] = on.transpose(0, 2, 1)
            eight = np.zeros((len(own), haplotypes, w, 64), bool)
            eight[..., :WORD] = padded.reshape(len(own), haplotypes, w, WORD)
            out[:, :, k] = np.packbits(eight, axis=-1, bitorder="little").view("<i8")[..., 0]
        size = haplotypes * (1 + t) * w
        flat[first[own][:, None] + np.arange(size)] = out.reshape(len(own), size)
    return flat, first, top


#: Genotypes that are unpacked at once in a task.
CELLS = 2_000_000


def pack_calls(samples: int):
    """A function for ``mapInArrow`` that replaces the last column, ``calls``, by bits, top and site_ploidy: the first ploidy over 1 of the row's genotypes, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CELLS // max(samples, 1))
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                alleles, ploidy = alleles_of_calls(*_bytes(batch.column(batch.num_columns - 1)), samples)
                flat, first, top = planes(alleles)
                over = ploidy > 1
                own = ploidy[np.arange(len(ploidy)), over.argmax(axis=1)] if samples else np.zeros(len(ploidy), np.int32)
                site = pa.array(own, pa.int32(), mask=~over.any(axis=1)) if samples else pa.nulls(len(ploidy), pa.int32())
                new = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat)), pa.array(top, pa.int32()), site]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*batch.schema.names[:-1], "bits", "top", "site_ploidy"])

    return run
