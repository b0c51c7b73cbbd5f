"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

A pattern splits the text; each piece that is not a token itself is merged with a
segment tree over its byte positions. A leaf holds the rank of the pair that
starts at a live position, an inner node the least (rank, position) below it, so
the root is the leftmost pair of least rank; a merge updates the leaves of the
merged position, of the position it swallowed and of the live neighbour before it,
each in logarithmic time.

Defined results: null text is empty and has no tokens; equal texts have equal ids;
extra columns pass through. The vocabulary's size is checked before it is sent to
the executors (a fixed file, not data that grows).
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES

#: Most bytes of a vocabulary file that are sent to executors.
MAX_VOCABULARY = 64 << 20
#: Pieces whose ids a worker keeps; when full it starts anew.
KEPT_PIECES = 400_000

_NONE = 1 << 62
_POS_BITS = 32
_POS_MASK = (1 << _POS_BITS) - 1


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    tree = [_NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << _POS_BITS | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n - 1))
    while (top := tree[1]) != _NONE:
        i = top & _POS_MASK
        j = after[i]
        end = after[j]
        after[i] = end
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
            here = _NONE if r is None else r << _POS_BITS | i
        else:
            here = _NONE
        changes = [(i, here), (j, _NONE)]
        p = before[i]
        if p >= 0:
            r = get(piece[p:end])
            changes.append((p, _NONE if r is None else r << _POS_BITS | p))
        for at, value in changes:
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1
    ids, i = [], 0
    while i < n:
        j = after[i]
        ids.append(ranks[piece[i:j]])
        i = j
    return ids


@cache
def _classes(limit: int) -> tuple[str, str, str]:
    """Character classes for letters, numbers and blanks below ``limit``, from the Unicode tables of this Python."""
    runs: dict[str, list[list[int]]] = {"L": [], "N": [], "S": []}
    blank = {*range(9, 14), 0x20, 0x85, 0xA0}
    for c in range(limit):
        kind = "S" if c in blank else unicodedata.category(chr(c))[0]
        if (own := runs.get(kind if kind != "S" or c in blank else "")) is not None:
            if own and own[-1][1] == c - 1:
                own[-1][1] = c
            else:
                own.append([c, c])
    text = {k: "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in v) for k, v in runs.items()}
    return text["L"], text["N"], text["S"]


#: Texts whose characters all lie below this (before the first other blank) are split by ``re`` with spelt-out classes.
_PLAIN = 0x250
_beyond = re.compile(f"[^\\x00-\\u{_PLAIN - 1:04x}]").search


@cache
def splitter(pattern: str):
    r"""A function that splits text by ``pattern``. Texts of common Latin letters take a faster, equal path."""
    general = regex.compile(pattern).findall
    letters, numbers, blanks = _classes(_PLAIN)
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    plain = plain.replace(r"\S", f"[^{blanks}]").replace(r"\s", f"[{blanks}]")
    if r"\p" in plain:
        return general
    parts = plain.split("|")
    # alternatives that begin with different characters may be tried in any order: letters are the most frequent
    first = f" ?[{letters}]+"
    if first in parts and not any(c in "()[]" for p in parts if p.startswith("'") for c in p):
        parts.remove(first)
        plain = "|".join([first + "+", *parts])  # possessive: a run of letters is never given back
    quick = re.compile(plain).findall
    return lambda text: general(text) if _beyond(text) else quick(text)


class Pairs:
    """Rank of the token that two tokens (by id) join to, for arrays of pairs: an open-addressed table."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, joined = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    joined.append(rank)
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.joined = np.full(1 << bits, -1, np.int32)
        todo_k, todo_v = np.array(keys, np.int64), np.array(joined, np.int32)
        at = self._slot(todo_k)
        while len(todo_k):
            free = self.keys[at] == -1
            self.keys[at[free]] = todo_k[free]
            won = self.keys[at] == todo_k
            self.joined[at[won]] = todo_v[won]
            todo_k, todo_v, at = todo_k[~won], todo_v[~won], (at[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = (a.astype(np.int64) << 32) | b
        at = self._slot(want)
        seen = self.keys.take(at)
        out = np.where(seen == want, self.joined.take(at), np.int32(-1))
        rest = np.flatnonzero((seen != want) & (seen != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            seen = self.keys.take(at[rest])
            hit = seen == want[rest]
            out[rest[hit]] = self.joined.take(at[rest[hit]])
            rest = rest[~hit & (seen != -1)]
        return out


#: Pieces up to this many bytes are merged many at a time, each in a segment tree of its own.
_SHORT = 64


def merge_pieces(pieces: list[bytes], ranks: dict[bytes, int], pairs: Pairs, single: np.ndarray) -> list[list[int]]:
    """Ids of each piece: the trees of all pieces of about one length are rows of an array and take their merges in step."""
    out: list[list[int]] = [[]] * len(pieces)
    by_size: dict[int, list[int]] = {}
    none = np.int32(2**31 - 1)
    for k, p in enumerate(pieces):
        whole = ranks.get(p)
        if whole is not None:
            out[k] = [whole]
        elif len(p) > _SHORT or len(p) < 2 or single is None:
            out[k] = merge_piece(p, ranks)
        else:
            by_size.setdefault(1 << (len(p) - 1).bit_length(), []).append(k)
    for size, own in by_size.items():
        m, levels = len(own), size.bit_length() - 1
        lengths = np.array([len(pieces[k]) for k in own])
        data = np.frombuffer(b"".join([pieces[k].ljust(size, b"\0") for k in own]), np.uint8).reshape(m, size)
        live = np.arange(size) < lengths[:, None]
        token = single[data]
        after = np.tile(np.arange(1, size + 1, dtype=np.int32), (m, 1))
        before = np.tile(np.arange(-1, size, dtype=np.int32), (m, 1))
        # a tree holds rank * size + position, so that the least is the leftmost of least rank
        tree = np.full((m, 2 * size), none, np.int32)
        r, c = np.nonzero(live[:, 1:])
        first = pairs.rank(token[r, c], token[r, c + 1])
        tree[r, size + c] = np.where(first >= 0, first << levels | c, none)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        t_tree, t_tok, t_after, t_before, t_live = (x.ravel() for x in (tree, token, after, before, live))
        rows = np.flatnonzero(tree[:, 1] != none)
        top = tree[rows, 1]
        while len(rows):
            base = rows * size
            i = top & (size - 1)
            at_i = base + i
            j = t_after.take(at_i)
            end = t_after.take(base + j)
            t_tok[at_i] = top >> levels
            t_live[base + j] = False
            t_after[at_i] = end
            t_before[base + rows + end] = i
            p = t_before.take(at_i + rows)
            # the merged position, the swallowed one, and the live neighbour before
            has, old = end < lengths.take(rows), p >= 0
            left = np.concatenate([i[has], p[old]])
            right = np.concatenate([end[has], i[old]])
            own_base = np.concatenate([base[has], base[old]])
            here = pairs.rank(t_tok.take(own_base + left), t_tok.take(own_base + right))
            leaf = 2 * base + size
            t_tree[leaf + i] = none
            t_tree[leaf + j] = none
            t_tree[2 * own_base + size + left] = np.where(here >= 0, here << levels | left, none)
            trees = 2 * np.concatenate([base, base, base[old]])
            k = size + np.concatenate([i, j, p[old]])
            for _ in range(levels):
                k >>= 1
                child = trees + 2 * k
                t_tree[trees + k] = np.minimum(t_tree.take(child), t_tree.take(child + 1))
            top = t_tree.take(2 * base + 1)
            on = top != none
            rows, top = rows[on], top[on]
        flat, stops = token[live].tolist(), np.cumsum(live.sum(1)).tolist()
        at = 0
        for k, stop in zip(own, stops):
            out[k] = tuple(flat[at:stop])  # tuples of numbers cost the garbage collector nothing
            at = stop
    return out


class Codec:
    """Ranks, their inverse and a bounded memory of pieces, one for each worker process."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = parse_ranks(raw)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            self.tokens[i] = t
        self.names = [str(i) for i in range(len(self.tokens))]
        self.pairs = Pairs(self.ranks)
        # ranks and positions share 31 bits in the arrays; a larger vocabulary takes one tree at a time
        fits = len(self.tokens) * _SHORT < 2**31 - 1
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32) if fits else None
        self.split = splitter(pattern)
        self.known: dict[str, list[int]] = {}

    def encode_some(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; texts of about 2 MB together at most, or one longer text."""
        known = self.known
        split = [self.split(t) for t in texts]
        fresh = list(set().union(*split).difference(known))
        if len(known) + len(fresh) > KEPT_PIECES:
            known.clear()
            fresh = list(set().union(*split))
        known.update(zip(fresh, merge_pieces([p.encode() for p in fresh], self.ranks, self.pairs, self.single)))
        return [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        some, size = [], 0
        for t in texts:
            if some and size + len(t) > STEP_BYTES:
                yield from self.encode_some(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        yield from self.encode_some(some)

    def encode(self, text: str) -> list[int]:
        return self.encode_some([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_codecs: dict[tuple, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(raw)


def encoder(spark: SparkSession, path: str, pattern: str):
    """Column function: text -> array of ids."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        c = codec(shared.value, pattern)
        return pa.array(c.encode_all(t.as_py() or "" for t in texts), pa.list_(pa.int32()))

    return encode


def decoder(spark: SparkSession, path: str, pattern: str):
    """Column function: array of ids -> bytes. Unknown ids raise."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        c = codec(shared.value, pattern)
        return pa.array([c.decode(x or []) for x in ids.to_pylist()], pa.binary())

    return decode


def digests(spark: SparkSession, text: Column, path: str, pattern: str) -> Column:
    """struct of n_tokens, ids_sha256 and decoded_sha256 for each text: encoded, then decoded from the ids, in one pass."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def both(texts: pa.Array) -> pa.Array:
        c = codec(shared.value, pattern)
        n, a, b = [], [], []
        for ids in c.encode_all(t.as_py() or "" for t in texts):
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)


def encode_documents(df: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    return df.withColumn(ids, encoder(df.sparkSession, path, pattern)(F.col(text)))
