"""Byte-level BPE encoding and decoding: speculate and verify.

A text is cut into words by the character classes of the tokenizer's pre-tokenizer (letters, digits, white space, others), in numpy over
whole blocks; added tokens in a text stand for themselves. For each distinct word of a chunk, greedy longest match over a trie of the
vocabulary proposes tokens. A proposal is the BPE encoding exactly if each two neighbours are compatible, which means that merging their
concatenation gives these two tokens again; so one vectorised test of all neighbours decides. It undoes the merges of both tokens from
their common border inwards, the later one first, and looks whether a pair across the border would have been merged before. Words that
fail the test, and only these, are merged exactly, in rounds of the best pair for each word (a heap for very long words).

What makes the test exact is checked on loading: each token is made by one merge, of tokens made before it. Tokens that do not encode to
themselves fail every test. Equal hashes only propose equal words, whose bytes are then compared.

Null and empty texts have no ids and decode to "". Repeated rows are kept as they are, an empty table gives an empty one. Other columns stay;
one that is called like an added column is replaced. A long text is cut into words as one block (some 30 bytes for each of its bytes) and
encoded in chunks of words. Invalid UTF-8 counts as U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pieces import IDS, NONE, PieceModel, _equal, _lists
from .textops import _BYTE, BLOCK_BYTES, blocks, flat_list, mix, powers

LETTER, DIGIT, OTHER, SPACE, UNKNOWN = range(5)
#: Words of more bytes are followed through all their positions at once, and merged by a heap where they fail.
LONG = 256


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable Latin-1 characters are themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Places:
    """Where each of some distinct keys (0 or more) stands: a hash table with linear probing, as arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key, self.place = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = self.key[slot] < 0
            slots, one = np.unique(slot[free], return_index=True)
            one = np.flatnonzero(free)[one]
            self.key[slots], self.place[slots] = keys[left[one]], left[one]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, slot = left[rest], (slot[rest] + 1) & (len(self.key) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Their places; -1 for other keys."""
        slot = self._home(keys)
        seen = self.key[slot]
        out = np.where(seen == keys, self.place[slot], -1)
        on = np.flatnonzero((seen != keys) & (seen >= 0))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & (len(self.key) - 1)
            seen = self.key[slot]
            out[on] = np.where(seen == keys[on], self.place[slot], -1)
            more = (seen != keys[on]) & (seen >= 0)
            on, slot = on[more], slot[more]
        return out


class ByteModel:
    """A vocabulary file of the tokenizers library whose model is BPE on bytes, without normalizer."""

    # the exact way is that of the other tokenizer: rounds of leftmost merges, or a heap
    merged, one_by_one = PieceModel.merged, PieceModel.one_by_one

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m, pre = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if m.get(k)]
        if m["type"] != "BPE" or odd or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE without normalizer, prefix space and word ends is read here")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take part of their surroundings are not read here")
        alphabet, vocab = byte_alphabet(), m["vocab"]
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.find_added = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.width = n = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * n
        for t, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in t)
        for t, i in self.added.items():
            self.bytes_of[i] = t
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [x.split(" ") if isinstance(x, str) else x for x in m["merges"]]
        a, b, c = (np.array([vocab[x[0]] for x in merges], np.int64), np.array([vocab[x[1]] for x in merges], np.int64), np.array([vocab[x[0] + x[1]] for x in merges], np.int64))
        self.born = np.full(n, -1, np.int64)  # the rank of the merge that makes a token; -1 for bytes
        self.born[c] = np.arange(len(c))
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[c], self.right[c] = a, b
        if len(np.unique(c)) < len(c) or (np.maximum(self.born[a], self.born[b]) >= self.born[c]).any() or (self.born[self.byte_id] >= 0).any():
            raise ValueError("this vocabulary has tokens that are made twice or before their parts")
        self.pair, self.rank, self.made = a * n + b, np.append(np.arange(len(c)), NONE), np.append(c, 0)  # behind the last: of no pair
        self.pair_at = Places(self.pair)
        self._table: dict[int, tuple[int, int]] | None = None
        # a token encodes to itself if both parts do and nothing across their border is merged before them
        self.sound = np.ones(n, bool)
        self.sound[c] = self._undone(a, b, self.born[c], self.born[c] - 1)
        for r in np.flatnonzero(~(self.sound[a] & self.sound[b])).tolist():
            self.sound[c[r]] &= self.sound[a[r]] and self.sound[b[r]]
        self._plant({t: i for t, i in zip(self.bytes_of, range(n)) if t and i not in set(self.added.values())})
        size = np.array([len(t) for t in self.bytes_of])
        self.out_at, self.out_len, self.out = np.append(0, np.cumsum(size)), size, np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.kind = np.full(0x110000, UNKNOWN, np.int8)
        import tokenizers

        self.pre = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

    def _plant(self, tokens: dict[bytes, int]) -> None:
        """A trie as a table of (node, byte) and the node below; token of each node or -1."""
        below: dict[int, int] = {}
        token = [-1]
        for t, i in tokens.items():
            at = 0
            for x in t:
                k = at << 8 | x
                if (nxt := below.get(k)) is None:
                    below[k] = nxt = len(token)
                    token.append(-1)
                at = nxt
            token[at] = i
        self.step_at = Places(np.fromiter(below, np.int64, len(below)))
        self.below, self.token = np.fromiter(below.values(), np.int64, len(below)), np.array(token, np.int64)
        self.deepest = max(map(len, tokens))

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and merged token of pairs."""
        k = self.pair_at.find(a * self.width + b)
        return self.rank[k], self.made[k]

    def kinds(self, code: np.ndarray) -> np.ndarray:
        """Character classes; a character that was not seen before is asked of the library's pre-tokenizer."""
        found = self.kind[code]
        if (found == UNKNOWN).any():
            for c in np.unique(code[found == UNKNOWN]).tolist():
                joins = [len(self.pre.pre_tokenize_str(x + chr(c))) == 1 for x in ("a", "1", "!")]
                self.kind[c] = joins.index(True) if any(joins) else SPACE
            found = self.kind[code]
        return found

    def words(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Byte offsets at which words begin, for valid UTF-8; and the added tokens among them by offset."""
        fixed: dict[int, int] = {}
        edges = [offs]
        raw = data.tobytes()
        if self.find_added and self.find_added.search(raw):
            for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
                for found in self.find_added.finditer(raw, lo, hi):
                    fixed[found.start()] = self.added[found[0]]
                    edges.append(np.array([found.start(), found.end()]))
        code = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        if not len(code):
            return np.zeros(0, np.int64), fixed
        place = np.append(0, np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), dtype=np.int64))
        kind = self.kinds(code)
        fresh = np.zeros(len(code) + 1, bool)  # a section begins: a row, an added token, or what follows one
        fresh[np.searchsorted(place, np.concatenate(edges))] = True
        fresh[[0, -1]] = True
        space = kind == SPACE
        begins = fresh[:-1].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # the last of some white space before other characters stands apart, and a blank joins what follows
        inner = space[:-1] & ~space[1:] & ~fresh[1:-1]
        begins[:-1] |= inner
        begins[1:] &= ~(inner & (code[:-1] == 32))
        self._contractions(code, kind, fresh, begins)
        for at in fixed:  # one word, whatever it is made of
            lo = np.searchsorted(place, at)
            hi = np.searchsorted(place, at + self.out_len[fixed[at]])
            begins[lo + 1 : hi] = False
        return place[:-1][begins], fixed

    @staticmethod
    def _contractions(code: np.ndarray, kind: np.ndarray, fresh: np.ndarray, begins: np.ndarray) -> None:
        """An apostrophe that begins a word takes s, t, m, d, re, ve or ll along; letters after these begin a word. Changes begins."""
        n = len(code)
        at = np.flatnonzero((code == 39) & begins)
        at = at[at + 1 < n]
        at = at[~fresh[at + 1] & (kind[at + 1] == LETTER)]
        one = code[at + 1]
        two = np.where((at + 2 < n) & ~fresh[np.minimum(at + 2, n)], code[np.minimum(at + 2, n - 1)], 0)
        takes = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            takes[(one == ord(x)) & (two == ord(y))] = 2
        at, takes = at[takes > 0], takes[takes > 0]
        begins[at + 1] = False
        after = at + 1 + takes
        begins[after[after < n]] = True

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token that begins at each place and ends by ``end``."""
        best = np.zeros(len(at), np.int64)
        on, node = np.arange(len(at)), np.zeros(len(at), np.int64)
        for depth in range(self.deepest):
            more = at[on] + depth < end[on]
            on, node = on[more], node[more]
            if not len(on):
                break
            key = node << 8 | data[at[on] + depth]
            k = self.step_at.find(key)
            hit = k >= 0
            on, node = on[hit], self.below[k[hit]]
            token = self.token[node]
            best[on[token >= 0]] = token[token >= 0]
        return best

    def proposed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) of the greedy longest matches, in order."""
        words, tokens, places = [], [], []
        long = end - start > LONG
        now, at = np.flatnonzero(~long), start[~long]
        while len(now):
            token = self.longest(data, at, end[now])
            words.append(now)
            tokens.append(token)
            places.append(at)
            at = at + self.out_len[token]
            more = at < end[now]
            now, at = now[more], at[more]
        for w in np.flatnonzero(long).tolist():
            token = self.longest(data, np.arange(start[w], end[w]), np.full(end[w] - start[w], end[w]))
            size, i, chain = self.out_len[token].tolist(), 0, []
            while i < len(size):
                chain.append(i)
                i += size[i]
            words.append(np.full(len(chain), w))
            tokens.append(token[chain])
            places.append(start[w] + np.array(chain))
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate(places), kind="stable")
        return np.concatenate(words)[order], np.concatenate(tokens)[order]

    def _undone(self, a: np.ndarray, b: np.ndarray, until_a: np.ndarray, until_b: np.ndarray) -> np.ndarray:
        """Whether no pair across the border of a and b is merged before one of its sides goes into a larger token.

        until_a, until_b: the ranks at which a and b themselves do. Of equal merges the leftmost comes first, so one on the right
        side must be earlier than the pair, and one on the left side may have its rank."""
        good = np.ones(len(a), bool)
        on, u, v, du, dv = np.arange(len(a)), a.copy(), b.copy(), until_a.copy(), until_b.copy()
        while len(on):
            rank, _ = self.look_up(u, v)
            bad = (rank < du) & (rank <= dv)
            good[on[bad]] = False
            ru, rv = self.born[u], self.born[v]
            go = ~bad & ((ru >= 0) | (rv >= 0))
            on, u, v, du, dv, ru, rv = (x[go] for x in (on, u, v, du, dv, ru, rv))
            second = rv >= ru  # the later merge goes first; of equal ones that on the right
            du, dv = np.where(second, du, ru), np.where(second, rv, dv)
            u, v = np.where(second, u, self.right[u]), np.where(second, self.left[v], v)
        return good

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the text of tokens a and b encodes to just these two."""
        return self._undone(a, b, np.full(len(a), NONE - 1), np.full(len(a), NONE - 1)) & self.sound[a] & self.sound[b]

    def encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and where those of each begin (and the end)."""
        n = len(start)
        word, token = self.proposed(data, start, end)
        same = word[1:] == word[:-1]
        a, b = token[:-1][same], token[1:][same]
        failed = np.zeros(n, bool)
        failed[word[1:][same][~self.compatible(a, b)]] = True
        failed[word[~self.sound[token]]] = True
        if not failed.any():
            return token, np.append(0, np.cumsum(np.bincount(word, minlength=n)))
        keep = ~failed[word]
        words, tokens = [word[keep]], [token[keep]]
        short = np.flatnonzero(failed & (end - start <= LONG))
        if len(short):
            size = (end - start)[short]
            first = np.append(0, np.cumsum(size))
            sym = self.byte_id[data[np.repeat(start[short] - first[:-1], size) + np.arange(first[-1])]]
            sym, first = self.merged(sym, first)
            words.append(np.repeat(short, np.diff(first)))
            tokens.append(sym)
        for w in np.flatnonzero(failed & (end - start > LONG)).tolist():
            done = self.one_by_one(self.byte_id[data[start[w] : end[w]]].tolist())
            words.append(np.full(len(done), w))
            tokens.append(np.array(done, np.int64))
        word, token = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(word, kind="stable")
        return token[order], np.append(0, np.cumsum(np.bincount(word, minlength=n)))

    def _chunk(self, data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each of the words that begin at ``start`` and fill data; each distinct word is encoded once."""
        end = np.append(start[1:], len(data))
        up, down = powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        _, pick, inverse = np.unique(mix((total[end] - total[start]) * down[start]), return_index=True, return_inverse=True)
        if not _equal(data, start, end - start, data, start[pick][inverse], (end - start)[pick][inverse]):
            pick = inverse = np.arange(len(start))  # unlike words with one hash
        # in order of place, which is the order that the proposals come in
        order = np.argsort(pick)
        rank = np.empty(len(pick), np.int64)
        rank[order] = np.arange(len(pick))
        pick, inverse = pick[order], rank[inverse]
        ids, first = self.encoded(data, start[pick], end[pick])
        many = np.diff(first)[inverse]
        out = np.append(0, np.cumsum(many))
        return ids[np.repeat(first[inverse] - out[:-1], many) + np.arange(out[-1])], many

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets for the UTF-8 texts data[offs[i]:offs[i+1]]."""
        try:
            start, fixed = self.words(data, offs)
        except UnicodeDecodeError:
            rows = [data[a:b].tobytes().decode(errors="replace").encode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            data, offs = np.frombuffer(b"".join(rows), np.uint8), np.append(0, np.cumsum([len(r) for r in rows]))
            start, fixed = self.words(data, offs)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        ids, many, at = [], [], 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(start, start[at] + BLOCK_BYTES)))
            lo, hi = start[at], start[to] if to < len(start) else len(data)
            found, size = self._chunk(data[lo:hi], start[at:to] - lo)
            ids.append(found)
            many.append(size)
            at = to
        flat, many = np.concatenate(ids), np.concatenate(many)
        first = np.append(0, np.cumsum(many))
        if fixed:
            w = np.searchsorted(start, sorted(fixed))
            keep = np.ones(len(flat), bool)
            for x, at in zip(w.tolist(), sorted(fixed)):
                flat[first[x]] = fixed[at]
                keep[first[x] + 1 : first[x + 1]] = False
            many[w] = 1
            flat, first = flat[keep], np.append(0, np.cumsum(many))
        return flat.astype(np.int32), first[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """UTF-8 texts of flat ids; ids outside the vocabulary are skipped, bytes that form no character become U+FFFD."""
        known = (ids >= 0) & (ids < self.width)
        if not known.all():
            ids, first = ids[known], np.append(0, np.cumsum(known))[first]
        size = self.out_len[ids]
        at = np.append(0, np.cumsum(size))
        flat = self.out[np.repeat(self.out_at[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
        rows = [flat[a:b] for a, b in zip(at[first[:-1]].tolist(), at[first[1:]].tolist())]
        return [r if r.isascii() else r.decode(errors="replace").encode() for r in rows]


@lru_cache(maxsize=1)
def model(path: str | None) -> ByteModel:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return ByteModel(path)


def _added(df: DataFrame, fields: list[T.StructField], others: list[str], read: str, model_path: str | None, made: Callable[[ByteModel, pa.Array], Iterator[tuple[int, int, list[pa.Array]]]]) -> DataFrame:
    """The columns ``others`` and new fields; ``made`` yields (rows from, to, new columns) for a batch's column ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            for a, b, new in made(model(model_path), get(read)):
                yield pa.RecordBatch.from_arrays([get(c).slice(a, b - a) for c in others] + new, names=[*others, *(f.name for f in fields)])

    return df.select(*others, *([] if read in others else [read])).mapInArrow(run, T.StructType([df.schema[c] for c in others] + fields))


def _texts(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary()).cast(pa.string())


def encode(df: DataFrame, model_path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by ``ids`` array<int>. model_path None takes the installed public vocabulary."""

    def made(m: ByteModel, column: pa.Array):
        for a, b, data, offs in blocks(column):
            yield a, b, [_lists(*m.encode(data, offs))]

    return _added(df, [T.StructField(ids, IDS)], [c for c in df.columns if c not in (text, ids)], text, model_path, made)


def decode(df: DataFrame, model_path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the column ``text`` that the array column ``ids`` stands for; null ids decode to an empty text."""

    def made(m: ByteModel, column: pa.Array):
        for a in range(0, len(column), 256):
            part = column.slice(a, 256)
            flat, first = flat_list(part)
            yield a, a + len(part), [_texts(m.decode(flat.astype(np.int64), first))]

    return _added(df, [T.StructField(text, T.StringType())], [c for c in df.columns if c != text], ids, model_path, made)


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 of whole texts, encoded and decoded in one step."""

    def made(m: ByteModel, column: pa.Array):
        for a, b, data, offs in blocks(column):
            ids, first = m.encode(data, offs)
            rows = m.decode(ids.astype(np.int64), first)
            raw = ids.astype("<u4")
            hashes = [hashlib.sha256(raw[x:y].tobytes()).hexdigest() for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            yield a, b, [pa.array(np.diff(first), pa.int64()), pa.array(hashes), pa.array([hashlib.sha256(r).hexdigest() for r in rows])]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _added(docs, fields, ["doc_id"], "text", model_path, made)
