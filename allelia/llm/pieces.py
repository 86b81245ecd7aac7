"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The vocabulary (pieces, scores, kinds) is read from a model file whose path is a parameter; merging, byte fallback and
decoding are done here. A text gets the dummy prefix, spaces become U+2581, and it falls into segments before each
run of U+2581, which no merge crosses when no piece holds U+2581 after another character (checked on loading).
Each distinct segment of a block is merged once; equal hashes only propose equal segments, which are then compared.

One round over all open segments: look up the rank of each adjacent pair, take the minimum per segment, merge its
occurrences leftmost first without overlap, compact, and close the segments without a pair. Merging all occurrences
at once equals the library's order unless a merge makes a new pair that ranks as high as the pair itself; such
segments are rare and go through a small heap, one merge at a time.

Null and empty texts have no ids and decode to "". Repeated rows are kept as they are, an empty table gives an empty one. Other columns
stay; one that is called like an added column is replaced. A long text is one block. On loading, probe texts are compared with
the library, so a model with other normaliser options or pieces of users is refused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import blocks, flat_list, mix, powers, seeds

SPACE = 0x2581
NONE = np.int64(1 << 40)
CACHED_CHARACTERS = 2_500_000  # of a worker and partition, to save work; some 30 MB with their ids
#: Texts on which the library and this module must agree when a model is loaded.
PROBES = ("", " ", "  two  spaces ", "a\u00a0b\u3000c", "\u2460 \ufb01 \u00c5 A\u030a \u1e9b\u0323", "tab\tline\n\r\nend", "\u200b\ufeff\u00ad", "UPPER lower", "<s> </s> <unk> <0x41>", "12345 1,000.5", "\u6f22\u5b57 \U0001f600")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(chr(SPACE) in text[i].lstrip(chr(SPACE)) for i in plain) or any(sp.is_unused(i) for i in plain):
            raise ValueError("this vocabulary has pieces that cross words, or unused pieces")
        byte = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_id = np.array([byte[b] for b in range(256)])
        ranks = np.unique([-sp.get_score(i) for i in plain], return_inverse=True)[1]
        symbol = {text[i]: i for i in plain}
        lone = sorted({c for i in plain for c in text[i]} - symbol.keys())  # characters of pieces that are no pieces
        symbol |= {c: n + k for k, c in enumerate(lone)}
        self.lone = np.array([ord(c) for c in lone], np.int64)
        self.base = n + len(lone)  # any other character c is the symbol base + c
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.base
        for c, s in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        self.width = self.base + 0x110000
        pairs = {}
        for i, r in zip(plain, ranks.tolist()):
            for cut in range(1, len(text[i])):
                a, b = symbol.get(text[i][:cut]), symbol.get(text[i][cut:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (r, i)
        self.pair = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.pair.tolist()] or [0], np.int64)
        self.made = np.array([pairs[k][1] for k in self.pair.tolist()] or [0], np.int64)
        out = [b"" if sp.is_control(i) else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else " ⁇ ".encode() if sp.is_unknown(i) else text[i].replace(chr(SPACE), " ").encode() for i in range(n)]
        self.is_byte = np.array([sp.is_byte(i) for i in range(n)])
        self.leads = np.array([t.startswith(chr(SPACE)) for t in text])
        self.out_len = np.array([len(x) for x in out])
        self.out_at = np.append(0, np.cumsum(self.out_len))
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.forget()
        for probe in PROBES:
            raw = probe.encode()
            if self.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() != sp.encode(probe):
                raise ValueError(f"this vocabulary treats {probe!r} in another way")

    def forget(self) -> None:
        """Drop what was kept of earlier blocks."""
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.codes, self.code_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self._table = None

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and merged symbol of pairs."""
        key = a * self.width + b
        k = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        hit = self.pair[k] == key if len(self.pair) else np.zeros(len(key), bool)
        return np.where(hit, self.rank[k], NONE), self.made[k]

    def merged(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge segments sym[first[i]:first[i+1]] to the end; the same layout comes back."""
        n = len(first) - 1
        given, word = sym.copy(), np.repeat(np.arange(n), np.diff(first))
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:  # of the pair that begins at each symbol
            rank[:-1], made[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = NONE
        closed: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(sym))))
            if (over := low == NONE).any():
                closed.append((word[over], sym[over]))
                keep = ~over
                sym, word, rank, made, low = sym[keep], word[keep], rank[keep], made[keep], low[keep]
                if not len(sym):
                    break
            here = rank == low
            # leftmost without overlap: every other place of a run of adjacent places
            if (here[1:] & here[:-1]).any():
                begins = here & ~np.append(False, here[:-1] & (word[1:] == word[:-1]))
                index = np.arange(len(sym))
                here &= (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            at = np.flatnonzero(here)
            least, merged = low[at], made[at]
            nxt = np.minimum(at + 2, len(sym) - 1)
            beside = (at + 2 < len(sym)) & (word[nxt] == word[at])
            passing = np.where(beside, self.look_up(merged, sym[nxt])[0], NONE)  # with the next symbol as it is now
            sym[at] = merged
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            rank[at] = NONE
            keep = ~gone
            place = at - np.arange(len(at))
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            right = np.minimum(place + 1, len(sym) - 1)
            fit = (place + 1 < len(sym)) & (word[right] == word[place])
            r, m = self.look_up(sym[place], sym[right])
            rank[place], made[place] = np.where(fit, r, NONE), m
            left = np.maximum(place - 1, 0)
            fit = (place > 0) & (word[left] == word[place])
            r, m = self.look_up(sym[left], sym[place])
            rank[left[fit]], made[left[fit]] = r[fit], m[fit]
            odd = (np.minimum(passing, rank[place]) <= least) | (fit & (r <= least))
            if odd.any():
                odd = np.unique(word[place[odd]])
                for w in odd.tolist():
                    done = self.one_by_one(given[first[w] : first[w + 1]].tolist())
                    closed.append((np.full(len(done), w), np.array(done, np.int64)))
                keep = ~np.isin(word, odd)
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        if not closed:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        word, sym = np.concatenate([c[0] for c in closed]), np.concatenate([c[1] for c in closed])
        order = np.argsort(word, kind="stable")
        return sym[order], np.append(0, np.cumsum(np.bincount(word, minlength=n)))

    def one_by_one(self, sym: list[int]) -> list[int]:
        """The best pair first, the leftmost of equals."""
        table = self._table
        if table is None:
            table = self._table = {int(k): (int(r), int(m)) for k, r, m in zip(self.pair, self.rank, self.made)}
        n = len(sym)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if found := table.get(sym[i] * self.width + sym[j]):
                heapq.heappush(heap, (found[0], i, j, sym[i], sym[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], sym[j] = table[a * self.width + b][1], -1
            after[i] = k = after[j]
            if k < n:
                prior[k] = i
                offer(i, k)
            if prior[i] >= 0:
                offer(prior[i], i)
        return [s for s in sym if s >= 0]

    def symbols_to_ids(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; a symbol outside the vocabulary becomes its UTF-8 bytes."""
        if (sym < self.size).all():
            return sym.astype(np.int32), first
        other = np.flatnonzero(sym >= self.size)
        code = sym[other] - self.base
        if len(self.lone):
            code = np.where(code < 0, self.lone[np.clip(sym[other] - self.size, 0, len(self.lone) - 1)], code)
        size = np.ones(len(sym), np.int64)
        size[other] = width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        at = np.append(0, np.cumsum(size))
        flat = np.zeros(at[-1], np.int32)
        flat[at[:-1]] = sym
        for k in range(4):  # the k-th byte of UTF-8
            on = width > k
            tail = 0x80 | (code[on] >> (6 * (width[on] - 1 - k)) & 0x3F)
            head = np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[on]] | code[on] >> (6 * (width[on] - 1))
            flat[at[other[on]] + k] = self.byte_id[tail if k else head]
        return flat, at[first]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets for the UTF-8 texts data[offs[i]:offs[i+1]]."""
        rows = [bytes(data[a:b]).decode("utf-8", "surrogatepass") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
        rows = [chr(SPACE) + r.replace(" ", chr(SPACE)) if r else "" for r in rows]
        at = np.append(0, np.cumsum([len(r) for r in rows]))
        code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64)
        space = code == SPACE
        begins = space & ~np.append(False, space[:-1])
        begins[at[:-1][np.diff(at) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(code))
        size = end - start
        up, down = powers(len(code) + 1)
        total = np.append(np.uint64(0), np.cumsum(mix(code.astype(np.uint64) + seeds(1, 5)) * up[: len(code)]))
        key, pick, inverse = np.unique(mix((total[end] - total[start]) * down[start]), return_index=True, return_inverse=True)
        del total
        if len(self.codes) > CACHED_CHARACTERS:
            self.forget()
        place = np.searchsorted(self.known, key)
        near = np.minimum(place, max(len(self.known) - 1, 0))
        slot = np.where(self.known[near] == key, self.slot[near], -1) if len(self.known) else np.full(len(key), -1)
        old = np.flatnonzero(slot >= 0)
        if not (_equal(code, start, size, code, start[pick][inverse], size[pick][inverse]) and _equal(self.codes, self.code_at[slot[old]], np.diff(self.code_at)[slot[old]], code, start[pick[old]], size[pick[old]])):
            # unlike segments with one hash: this block goes without
            ids, first = self.symbols_to_ids(*self.merged(self.of_char[code], np.append(start, len(code))))
            return ids, first[np.searchsorted(start, at)]
        if len(new := np.flatnonzero(slot < 0)):
            a, wide = start[pick[new]], size[pick[new]]
            first = np.append(0, np.cumsum(wide))
            taken = code[np.repeat(a - first[:-1], wide) + np.arange(first[-1])]
            self.codes, self.code_at = np.append(self.codes, taken.astype(np.uint32)), np.append(self.code_at, self.code_at[-1] + first[1:])
            ids, first = self.symbols_to_ids(*self.merged(self.of_char[taken], first))
            slot[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known, self.slot = np.insert(self.known, place[new], key[new]), np.insert(self.slot, place[new], slot[new])
            self.at = np.append(self.at, self.at[-1] + first[1:])
            self.ids = np.append(self.ids, ids)
        used = slot[inverse]
        many = (self.at[1:] - self.at[:-1])[used]
        out = np.append(0, np.cumsum(many))
        ids = self.ids[np.repeat(self.at[used] - out[:-1], many) + np.arange(out[-1])]
        return ids, out[np.searchsorted(start, at)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 texts of flat ids; bytes that form no character become U+FFFD each."""
        size = self.out_len[ids]
        at = np.append(0, np.cumsum(size))
        flat = self.out[np.repeat(self.out_at[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
        loose = np.append(0, np.cumsum(self.is_byte[ids]))
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            row = flat[at[a] + bool(b > a and self.leads[ids[a]]) : at[b]]
            if loose[b] > loose[a] or b > a and not size[a]:
                try:
                    if not size[a:b].all():  # a piece without text parts runs of bytes, or comes first
                        raise UnicodeDecodeError("utf-8", row, 0, 0, "parted")
                    row.decode()
                except UnicodeDecodeError:
                    row = self.patched(ids[a:b])
            out.append(row)
        return out

    def patched(self, ids: np.ndarray) -> bytes:
        """Decode runs of byte ids on their own, as some hold no whole characters."""
        out, i, led = bytearray(), 0, False
        while i < len(ids):
            j = i
            while j < len(ids) and self.is_byte[ids[j]]:
                j += 1
            if j > i:
                run = bytes(int(x) for x in self.out[self.out_at[ids[i:j]]])
                k = 0
                while k < len(run):
                    for width in (1, 2, 3, 4):
                        try:
                            run[k : k + width].decode()
                        except UnicodeDecodeError:
                            continue
                        out += run[k : k + width]
                        k += width
                        break
                    else:
                        out += "�".encode()
                        k += 1
                i = j
            else:
                piece = self.out[self.out_at[ids[i]] : self.out_at[ids[i] + 1]].tobytes()
                cut = self.leads[ids[i]] and not out and not led
                out += piece[1:] if cut else piece
                led |= bool(cut)
                i += 1
        return bytes(out)


def _equal(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> bool:
    """Whether the slices of a are those of b."""
    if not (a_size == b_size).all():
        return False
    first = np.append(0, np.cumsum(a_size))
    inside = np.arange(first[-1])
    return bool((a[np.repeat(a_at - first[:-1], a_size) + inside] == b[np.repeat(b_at - first[:-1], a_size) + inside]).all())


@lru_cache(maxsize=1)
def model(path: str | None) -> PieceModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceModel(path)


def _lists(flat: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat, pa.int32()))


def _mapped(df: DataFrame, added: list[T.StructField], others: list[str], read: str, model_path: str | None, made) -> DataFrame:
    """Add fields to the columns ``others``; ``made`` yields (rows from, to, new columns) for a batch's column ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, new in made(m, get(read)):
                yield pa.RecordBatch.from_arrays([get(c).slice(a, b - a) for c in others] + new, names=[*others, *(f.name for f in added)])
        m.forget()

    return df.select(*others, *([] if read in others else [read])).mapInArrow(run, T.StructType([df.schema[c] for c in others] + added))


IDS = T.ArrayType(T.IntegerType(), False)


def encode(df: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by ``ids`` array<int>. model_path None takes the installed public vocabulary."""

    def made(m: PieceModel, column: pa.Array):
        for a, b, data, offs in blocks(column):
            yield a, b, [_lists(*m.encode(data, offs))]

    return _mapped(df, [T.StructField(ids, IDS)], [c for c in df.columns if c not in (text, ids)], text, model_path, made)


def decode(df: DataFrame, model_path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the column ``text`` that the array column ``ids`` stands for; null ids decode to an empty text."""

    def made(m: PieceModel, column: pa.Array):
        for a in range(0, len(column), 256):
            part = column.slice(a, 256)
            flat, first = flat_list(part)
            yield a, a + len(part), [pa.array(m.decode(flat.astype(np.int64), first), pa.binary()).cast(pa.string())]

    return _mapped(df, [T.StructField(text, T.StringType())], [c for c in df.columns if c != text], ids, model_path, made)


def round_trip(df: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one step, which needs one Python process for a task instead of two."""

    def made(m: PieceModel, column: pa.Array):
        for a, b, data, offs in blocks(column):
            flat, first = m.encode(data, offs)
            yield a, b, [_lists(flat, first), pa.array(m.decode(flat.astype(np.int64), first), pa.binary()).cast(pa.string())]

    others = [c for c in df.columns if c not in (text, ids, decoded)]
    return _mapped(df, [T.StructField(ids, IDS), T.StructField(decoded, T.StringType())], others, text, model_path, made)


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts."""
    both = round_trip(docs.select("doc_id", "text"), model_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
