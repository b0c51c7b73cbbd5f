"""Katz backoff language model, order two, over every word and every pair of the training texts.

Tokens are words of A-Z-lowered text and one end per text; the end also stands before a text's first word. Words are
told apart by a 64-bit hash. There is no vocabulary and no count below which a pair is left out.

* unigrams: (h, c); P1 with Good-Turing discounts, what they free is the probability of words never seen.
* pairs: (w1, w2, n) with n >= 1. P(w2|w1) = d(n) n / u(w1) for a pair of the table, a(w1) P1(w2) for others;
  a(w1) makes each context sum to one.

A text's score is the sum of log10 probabilities, put together from three kinds of keys:

* the ``head`` most frequent words are sent to all tasks, with their values; the rest are keys of a table;
* pairs are keys of a table, split into parts of a bounded number of tokens; frequent first words are dealt to many
  parts by their second. The pairs that make up more than one in ``HOT_PAIRS`` tokens (so no more than that) are sent
  to all tasks as well;
* texts ask the table in blocks, by (key, text) with counts. A task holds one part's keys and streams the asks.
  Answers name only texts that were hit.

How many words are in the head decides what travels how, and no result. A pair of two head words is one number of 40
bits, with its text 64, so blocks sort and pack well; pairs with another word go by a 64-bit hash.

In a training text every pair is in the table and what remains is sum(log d(n) n) - sum(log u(w)); another text is
scored as if all were backed off, and gets what each pair of the table gains over that.

Defined results: null text is empty and has the end token only; equal rows have equal scores; an empty training set
gives every word the probability of an unseen one (1). A text of any length is one text of one block. Ties of counts
at the end of the head are all left out of it. Other columns pass through; those with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_bytes, byte_steps, materialize
from .decontam import _LOWER, word_hashes

#: Words sent to all tasks (24 bytes each with their values; their codes have 20 bits), tokens of one part of the table of pairs,
#: and pairs sent to all tasks; tokens that one emission of counts and one block of asks hold, about, and other keys packed at once.
HEAD = 1 << 20
PART_TOKENS = 4_000_000
HOT_PAIRS = 1 << 16
COUNT_TOKENS = 1_000_000
BLOCK_TOKENS = 600_000
PACK_ROWS = 200_000
#: Bytes of text hashed at once, and of one Arrow batch; words looked up in the head at once.
STEP = 1 << 19
BATCH_BYTES = 1 << 22
LOOKUP = 1 << 16
#: Katz's k: counts above it are not discounted.
KATZ = 5

_CODE = np.uint64(20)
_CODES = np.uint64((1 << 20) - 1)
_TEXT = np.uint64(24)
_TAIL = np.uint64(1 << 63)
_END = np.uint64(0x9AE16A3B2F90404F)
_ROWS = "part int, kind int, block long, a binary, b binary, c binary, d binary, e binary, f binary"
_ANSWERS = "block long, a binary, b binary, c binary, d binary, e binary, f binary"
_MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pack(x: np.ndarray) -> bytes:
    """All lowest bytes of the numbers first and so on, compressed: sorted numbers get small so."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if x.dtype.kind != "f" else x
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    if np.dtype(kind).kind == "f":
        return raw.view(kind)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _firsts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(first, n))


def token_steps(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts): word hashes of consecutive texts, and how many words each text has."""
    for raw, offsets in byte_steps(texts, STEP):
        data = _LOWER[raw]
        edge = np.diff(np.concatenate([[0], _WORD[data].view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = np.unique(offsets[1:-1])
        inner = inner[(inner > 0) & (inner < len(data))]
        inner = inner[_WORD[data[inner]] & _WORD[data[inner - 1]]]
        if len(inner):  # words of two texts that touch
            starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        yield word_hashes(data, starts, ends), np.diff(np.searchsorted(starts, offsets))


def tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(tokens, text of each, words per text without the end) of consecutive texts; what stands before the first is an end."""
    for h, words in token_steps(texts):
        n = len(words)
        t = np.full(len(h) + n, _END)
        t[np.arange(len(h)) + np.repeat(np.arange(n), words)] = _mix(h)
        yield t, np.repeat(np.arange(n), words + 1), words


def discounts(n: np.ndarray) -> np.ndarray:
    """Katz's d(0..KATZ) from the numbers n[r] of types seen r times; where Good-Turing gives none, half a count is taken."""
    d = np.ones(KATZ + 1)
    d[0] = 0
    top = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    for r in range(1, KATZ + 1):
        new = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        v = (new / r - top) / (1 - top) if top < 1 else 0.0
        d[r] = v if 0 < v < 1 else (r - 0.5) / r
    return d


def _kept(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return np.where(n <= KATZ, d[np.minimum(n, KATZ)], 1.0) * n


def _kept_column(n: str, d: np.ndarray) -> Column:
    few = F.element_at(F.array(*[F.lit(float(x)) for x in d]), F.least(F.col(n), F.lit(KATZ)).cast("int") + 1)
    return F.when(F.col(n) <= KATZ, few).otherwise(1.0) * F.col(n)


class Head:
    """The most frequent words by code, which is the rank: hashes, and counts as (count, how many words), falling."""

    def __init__(self, hashes: np.ndarray, levels: list[tuple[int, int]], total: int, parts: int):
        self.hashes, self.levels, self.total, self.parts, self.slots = hashes, levels, total, parts, None

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("hashes", "levels", "total", "parts")} | {"slots": None}

    @cached_property
    def counts(self) -> np.ndarray:
        return np.repeat(*np.array(self.levels, np.int64).reshape(-1, 2).T)

    @cached_property
    def spread(self) -> np.ndarray:
        """Over how many parts a word's pairs are dealt."""
        return np.minimum(self.parts, 1 + self.counts * self.parts * 2 // max(self.total, 1)).astype(np.uint32)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Code of each word, -1 for words outside; by open addressing, some words in step."""
        code = np.full(len(h), -1, np.int32)
        if len(self.hashes):
            for i in range(0, len(h), LOOKUP):
                code[i : i + LOOKUP] = self._look_up(h[i : i + LOOKUP])
        return code

    def _look_up(self, h: np.ndarray) -> np.ndarray:
        bits = (2 * len(self.hashes)).bit_length()
        if self.slots is None:
            self.slots = np.zeros(1 << bits, np.int32)
            left, at = np.arange(len(self.hashes), dtype=np.int32), (self.hashes >> np.uint64(64 - bits)).astype(np.int32)
            while len(left):
                free = self.slots[at] == 0
                self.slots[at[free]] = left[free] + 1
                lost = self.slots[at] != left + 1
                left, at = left[lost], (at[lost] + 1) & ((1 << bits) - 1)
        at = (h >> np.uint64(64 - bits)).astype(np.int64)
        code = self.slots[at] - 1
        other = np.flatnonzero((code >= 0) & (self.hashes[code] != h))
        while len(other):
            at[other] = (at[other] + 1) & ((1 << bits) - 1)
            code[other] = self.slots[at[other]] - 1
            other = other[(code[other] >= 0) & (self.hashes[code[other]] != h[other])]
        return code

    def pairs(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(codes, positions of pairs in the head, their keys, positions of the other pairs) of tokens; pair i ends at i."""
        c = self.codes(t)
        before = np.concatenate([self.codes(np.array([_END])), c[:-1]])
        both = (c >= 0) & (before >= 0)
        at = np.flatnonzero(both)
        return c, at, before[at].astype(np.uint64) << _CODE | c[at].astype(np.uint64), np.flatnonzero(~both)

    def part(self, keys: np.ndarray) -> np.ndarray:
        """Part of sorted keys: by the first word and, as far as that is frequent, by the second."""
        out = _mix(keys) % np.uint64(self.parts)
        own = int(np.searchsorted(keys, _TAIL))
        first, second = keys[:own] >> _CODE, keys[:own] & _CODES
        out[:own] = (_mix(first + np.uint64(1)) + _mix(second) % self.spread[first]) % np.uint64(self.parts)
        return out.astype(np.int64)


def tail_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of pairs with a word outside the head."""
    return _mix(a ^ (b << np.uint64(23) | b >> np.uint64(41))) | _TAIL


def _before(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.where(at > 0, t[at - 1], _END)


def count_words(texts: DataFrame) -> DataFrame:
    """(h, c) of all tokens, the end too; tasks sum what they read before the shuffle."""

    def count(batches):
        held, size = [], 0

        def flush():
            keys, n = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = _firsts(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(np.add.reduceat(n[order], first))], ["h", "c"])

        for b in batches:
            for t, _, _ in tokens(b.column(0)):
                t = np.sort(t)
                first = _firsts(t)
                held.append((t[first], _lengths(first, len(t))))
                size += len(first)
                if size > 2 * COUNT_TOKENS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return texts.mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    first = _firsts(part[order])
    for i, n in zip(first.tolist(), _lengths(first, len(part)).tolist()):
        yield int(part[order[i]]), order[i : i + n]


def count_pairs(texts: DataFrame, shared) -> DataFrame:
    """A row (part, keys, counts) for a part's pairs in the head, and rows (w1, w2, n, c2) for its others; c2 is null outside the head."""

    def emit(batches):
        held, size = [], 0

        def flush():
            head: Head = shared.value
            near, far = [], []
            while held:
                t = held.pop()
                _, _, keys, other = head.pairs(t)
                near.append(keys)
                far.append((_before(t, other), t[other]))
            keys = np.concatenate(near)
            keys.sort()
            del near, t
            first = _firsts(keys)
            keys, n = keys[first], _lengths(first, len(keys)).astype(np.uint32)
            a, b = (np.concatenate(x) for x in zip(*far))
            del far
            far_keys = tail_keys(a, b)
            order = np.argsort(far_keys)
            far_keys = far_keys[order]
            first = _firsts(far_keys)
            far_n, far_keys, a, b = _lengths(first, len(far_keys)), far_keys[first], a[order[first]], b[order[first]]
            empty = _pack(np.zeros(0, np.uint64))
            rows = [(p, _pack(keys[i]), _pack(n[i]), empty, empty, empty) for p, i in _by_part(head.part(keys))]
            rows += [(p, empty, empty, _pack(a[i]), _pack(b[i]), _pack(far_n[i].astype(np.uint32))) for p, i in _by_part(head.part(far_keys))]
            kinds = [pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["part", "keys", "n", "a", "b", "m"])

        for b in batches:
            for t, _, _ in tokens(b.column(0)):
                held.append(t)
                size += len(t)
                if size > COUNT_TOKENS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        column = lambda k, kind: np.concatenate([_unpack(x.as_py(), kind) for x in table.column(k)])
        keys, n = column("keys", np.uint64), column("n", np.uint32)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        del order
        first = _firsts(keys)
        near = (keys[first], np.add.reduceat(n, first, dtype=np.uint64) if len(first) else np.zeros(0, np.uint64))
        near = [_pack(x) for x in near]
        del keys, n, first
        a, b, m = column("a", np.uint64), column("b", np.uint64), column("m", np.uint32).astype(np.int64)
        keys = tail_keys(a, b)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = _firsts(keys)
        a, b = a[order[first]], b[order[first]]
        sums = np.add.reduceat(m[order], first) if len(first) else np.zeros(0, np.int64)
        k, head = len(first), shared.value
        code = head.codes(b)
        c2 = pa.array(np.append(head.counts, 0)[code], mask=code < 0)
        cols = [pa.array([part] + [None] * k, pa.int32()), *(pa.array([x, *[None] * k], pa.binary()) for x in near)]
        none = pa.nulls(1, pa.int64())
        cols += [pa.concat_arrays([none, x]) for x in (pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sums), c2)]
        return pa.table(cols, ["part", "keys", "counts", "w1", "w2", "n", "c2"])

    kind = "part int, keys binary, counts binary, w1 long, w2 long, n long, c2 long"
    return texts.mapInArrow(emit, "part int, keys binary, n binary, a binary, b binary, m binary").groupBy("part").applyInArrow(total, kind)


def _head_pairs(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for k, n in zip(b.column("keys"), b.column("counts")):
            yield _unpack(k.as_py(), np.uint64), _unpack(n.as_py(), np.uint64).astype(np.int64)


def pair_types(pairs: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n[r] for r to KATZ + 1; keys and counts of the pairs in the head that are seen ``hot`` times or more."""

    def count(batches):
        types, keys, often = np.zeros(KATZ + 2, np.int64), [], []
        for k, n in _head_pairs(batches):
            types += np.bincount(n[n <= KATZ + 1], minlength=KATZ + 2)
            keys += k[n >= hot].astype(np.int64).tolist()
            often += n[n >= hot].tolist()
        rows = [(None, r, int(x)) for r, x in enumerate(types)] + list(zip(keys, often, [1] * len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["key", "n", "k"])

    near = pairs.where("keys is not null").select("keys", "counts").mapInArrow(count, "key long, n long, k long")
    far = pairs.where("keys is null")
    far_few = far.where(F.col("n") <= KATZ + 1).select(F.lit(None).cast("long").alias("key"), "n", F.lit(1).cast("long").alias("k"))
    rows = near.unionByName(far_few).groupBy("key", "n").agg(F.sum("k").alias("k")).collect()
    types = np.array([sum(r["k"] for r in rows if r["key"] is None and r["n"] == x) for x in range(KATZ + 2)], float)
    often = sorted((r["key"], r["n"]) for r in rows if r["key"] is not None)
    return types, np.array([k for k, _ in often], np.uint64), np.array([n for _, n in often], np.int64)


def context_sums(pairs: DataFrame, shared, d1: np.ndarray, d2: np.ndarray, total: int) -> DataFrame:
    """(h, used, p): what a context's pairs in the head keep of its count, and P1 of their second words; partial sums."""

    def sums(batches):
        head: Head = shared.value
        p1 = _kept(head.counts, d1) / max(total, 1)
        for k, n in _head_pairs(batches):
            first = _firsts(k >> _CODE)
            if len(first):
                used, p = np.add.reduceat(_kept(n, d2), first), np.add.reduceat(p1[(k & _CODES).astype(np.int64)], first)
                yield pa.RecordBatch.from_arrays([pa.array(head.hashes[k[first] >> _CODE].view(np.int64)), pa.array(used), pa.array(p)], ["h", "used", "p"])

    return pairs.where("keys is not null").select("keys", "counts").mapInArrow(sums, "h long, used double, p double")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = schema.split(", ")
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    cols = [pa.array([r[j] for r in rows], kinds[x.split()[1]]) for j, x in enumerate(names)]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in names])


def far_rows(df: DataFrame, columns: list[str], shared, values) -> DataFrame:
    """Table rows (kind 0) of (key, value in training texts, value in others, a word's count or -1); ``values`` makes them of columns."""

    def pack(batches):
        held, size = [], 0

        def flush():
            key, vt, vh, c = values(*(np.concatenate(x) for x in zip(*held)))
            order = np.argsort(key)
            key, vt, vh, c = key[order], vt[order], vh[order], c[order]
            return _batch([(p, 0, 0, None, None, _pack(key[i]), _pack(vt[i]), _pack(vh[i]), _pack(c[i])) for p, i in _by_part(shared.value.part(key))], _ROWS)

        for b in batches:
            held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))])
            size += b.num_rows
            if size > PACK_ROWS:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return df.select(*columns).mapInArrow(pack, _ROWS)


class Model:
    """Log u and log a of the head's words, discounts, tokens (one more if no word's discount frees anything) and hot pairs."""

    def __init__(self, log_u, log_a, d1, d2, total: int, unseen: float, hot, hot_n):
        self.log_u, self.log_a, self.d1, self.d2, self.total, self.unseen, self.hot, self.hot_n = log_u, log_a, d1, d2, total, unseen, hot, hot_n

    def log_p1(self, c: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(_kept(c, self.d1), 1e-300) / max(self.total, 1))

    def values(self, head: Head, code: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Of words of the head, as context and as token at once: in a training text or in another."""
        v = -self.log_u[code]
        rest = np.flatnonzero(~train)
        code = code[rest]
        v[rest] = self.log_a[code] + self.log_p1(head.counts[code])
        return v

    def gains(self, head: Head, keys: np.ndarray, n: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Value of pairs in the head with counts n: in a training text, and over backing off in another."""
        v = np.log10(_kept(n, self.d2))
        rest = np.flatnonzero(~train)
        a, b = (keys[rest] >> _CODE).astype(np.int64), (keys[rest] & _CODES).astype(np.int64)
        v[rest] -= self.log_u[a] + self.log_a[a] + self.log_p1(head.counts[b])
        return v

    def far_pairs(self, head: Head, w1, w2, n, c2, off) -> tuple:
        """Values of other pairs; ``off`` is log u + log a of the first word, nan for words of the head."""
        w1, w2 = w1.view(np.uint64), w2.view(np.uint64)
        code = head.codes(w1)
        if len(self.log_u):
            off = np.where(code >= 0, self.log_u[code] + self.log_a[code], off)
        v = np.log10(_kept(n, self.d2))
        return tail_keys(w1, w2), v, v - off - self.log_p1(c2), np.full(len(n), -1)

    def far_words(self, h, c, u, a) -> tuple:
        return h.view(np.uint64) | _TAIL, -u, a + self.log_p1(c) - self.unseen, c


def asks(docs: DataFrame, shared, model) -> DataFrame:
    """Rows of kind 1, (key, text) with counts, and one row of kind 2 a block: its texts and what is known of them at once."""

    def ask(batches):
        task, blocks, held, size, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush():
            head, know, block = shared.value, model.value, task << 32 | blocks
            t, of, words, train, *rids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            n = len(words)
            c, at, keys, other = head.pairs(t)
            inside = np.flatnonzero(c >= 0)
            own, text = c[inside], of[inside]
            del inside
            add = lambda i, v: np.bincount(i, v, n)
            known, base = add(text, None), add(text, np.log10(head.counts[own] + 1.0))
            rest = add(of, None) - known
            s = add(text, know.values(head, own, train[text])) + np.where(train, 0, rest * know.unseen)
            del own, text
            # a text's number and whether it is one to learn from
            tag = of.astype(np.uint32) << np.uint32(1) | train[of]
            x = keys << _TEXT | tag[at]
            del of, keys, at
            far = np.flatnonzero(c < 0)
            fk, fd = np.concatenate([t[far] | _TAIL, tail_keys(_before(t, other), t[other])]), np.concatenate([tag[far], tag[other]])
            del t, c, tag, far, other
            x.sort()
            first = _firsts(x)
            k, d, m = x[first] >> _TEXT, (x[first] & np.uint64((1 << 24) - 1)).astype(np.uint32), _lengths(first, len(x)).astype(np.uint32)
            del x
            hit, at = _find(know.hot, k)
            s += add(d[hit] >> np.uint32(1), m[hit] * know.gains(head, k[hit], know.hot_n[at], (d[hit] & np.uint32(1)).astype(bool)))
            order = np.lexsort((fd, fk))
            fk, fd = fk[order], fd[order]
            del order
            first = _firsts(fk, fd)
            k, d, m = (np.concatenate([np.delete(x, hit), y]) for x, y in ((k, fk[first]), (d, fd[first]), (m, _lengths(first, len(fk)).astype(np.uint32))))
            del fk, fd
            first = _firsts(k)
            times = _lengths(first, len(k))
            out = [(block % head.parts, 2, block, *map(_pack, (*rids, words.astype(np.int64), s, base, known.astype(np.int64))))]
            for p, u in _by_part(head.part(k[first])):
                each = times[u]
                i = np.repeat(first[u] - np.cumsum(each) + each, each) + np.arange(each.sum())
                out.append((p, 1, block, _pack(k[first[u]]), _pack(each.astype(np.uint32)), _pack(d[i]), _pack(m[i]), None, None))
            return _batch(out, _ROWS)

        for b in batches:
            rids, row = [b.column(k).to_numpy(zero_copy_only=False) for k in ("r1", "r2")], 0
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for t, of, words in tokens(b.column("text")):
                to = row + len(words)
                held.append((t, (of + rows).astype(np.int32), words, train[row:to], *(r[row:to] for r in rids)))
                row, rows, size = to, rows + len(words), size + len(t)
                if size > BLOCK_TOKENS:
                    yield flush()
                    blocks, size, rows = blocks + 1, 0, 0
        if held:
            yield flush()

    return docs.select("r1", "r2", "train", "text").mapInArrow(ask, _ROWS)


def answers(rows: DataFrame, shared, model) -> DataFrame:
    """Of rows in order of (part, kind, block): a part's table is held, its asks pass by."""

    def answer(batches):
        part, near, far, table = None, [], [], None
        for b in batches:
            out = []
            for p, kind, block, *data in zip(*(b.column(i).to_pylist() for i in range(9))):
                if p != part:
                    part, near, far, table = p, [], [], None
                if kind == 0 and data[0] is not None:
                    near.append((_unpack(data[0], np.uint64), _unpack(data[1], np.uint64)))
                elif kind == 0:
                    far.append((_unpack(data[2], np.uint64), _unpack(data[3], float), _unpack(data[4], float), _unpack(data[5], np.int64)))
                elif kind == 2:
                    out.append((block, *data))
                else:
                    if table is None:
                        table = [_sorted(near, 2)]
                        near = []
                        table.append(_sorted(far, 4))
                        far = []
                    k, times, d, m = _unpack(data[0], np.uint64), *(_unpack(x, np.uint32) for x in data[1:4])
                    out += _found(shared.value, model.value, table, block, k, times.astype(np.int64), d.astype(np.int64), m.astype(np.int64))
            if out:
                yield _batch(out, _ANSWERS)

    return rows.mapInArrow(answer, _ANSWERS)


def _sorted(rows: list[tuple], width: int) -> list[np.ndarray]:
    if not rows:
        return [np.zeros(0, np.uint64)] * width
    cols = [np.concatenate(x) for x in zip(*rows)]
    order = np.argsort(cols[0], kind="stable")
    return [x[order] for x in cols]


def _find(table: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in k that the table has, where)."""
    if not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(table, k), len(table) - 1)
    hit = np.flatnonzero(table[i] == k)
    return hit, i[hit]


def _found(head: Head, model: Model, table, block: int, k, times, d, m) -> list[tuple]:
    """One answer, for one block: texts that were hit, and their sums."""
    (keys, n), (far_keys, vt, vh, c) = table
    start = np.cumsum(times) - times
    own = int(np.searchsorted(k, _TAIL))
    hit, at = _find(keys, k[:own])
    far, to = _find(far_keys, k[own:])
    far += own
    u = np.concatenate([hit, far])
    each = times[u]
    i = np.repeat(start[u] - np.cumsum(each) + each, each) + np.arange(each.sum())  # entries of the keys found
    if not len(i):
        return []
    text, train, m, cut = d[i] >> 1, (d[i] & 1).astype(bool), m[i], int(times[hit].sum())
    s = np.empty(len(i))
    count = np.repeat(n[at].astype(np.int64), times[hit])
    s[:cut] = model.gains(head, np.repeat(k[hit], times[hit]), count, train[:cut])
    to = np.repeat(to, times[far])
    s[cut:] = np.where(train[cut:], vt[to], vh[to])
    word = m[cut:] * (c[to] >= 0)
    names, back = np.unique(text, return_inverse=True)
    base = np.bincount(back[cut:], word * np.log10(np.maximum(c[to], 0) + 1.0), len(names))
    known = np.bincount(back[cut:], word, len(names)).astype(np.int64)
    return [(block, _pack(names.astype(np.uint32)), _pack(np.bincount(back, m * s, len(names))), _pack(base), _pack(known), None, None)]


def _gather(table: pa.Table) -> pa.Table:
    """The sums of one block's texts."""
    texts, found = None, []
    for row in zip(*(table.column(i).to_pylist() for i in range(1, 7))):
        if row[4] is not None:
            texts = [_unpack(x, k) for x, k in zip(row, (np.int64, np.int64, np.int64, float, float, np.int64))]
        else:
            found.append([_unpack(x, k) for x, k in zip(row, (np.uint32, float, float, np.int64))])
    r1, r2, words, s, base, known = (np.array(x) for x in texts)
    for at, *values in found:
        for total, v in zip((s, base, known), values):
            total[at] += v  # a text is named once in an answer
    return pa.table([r1, r2, words, s, base, known], ["r1", "r2", "n_words", "s", "base", "known"])


def _types(counts: DataFrame, n: str) -> np.ndarray:
    """How many types are seen 1 .. KATZ + 1 times."""
    few = {r[n]: r["k"] for r in counts.where(F.col(n) <= KATZ + 1).groupBy(n).agg(F.count(F.lit(1)).alias("k")).collect()}
    return np.array([0] + [few.get(r, 0) for r in range(1, KATZ + 2)], float)


def _levels(unigrams: DataFrame, head: int) -> list[tuple[int, int]]:
    """(count, words) of the head, falling; a level is in it as a whole. There are few levels: their counts add up to the tokens."""
    level = unigrams.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).limit(head).toPandas()
    fits = level["k"].cumsum() <= head
    return list(zip(level["c"][fits].tolist(), level["k"][fits].tolist()))


def _by_rank(words: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of the head's words, the most frequent first."""
    got = words.orderBy(F.desc("c"), "h").select(*columns).toArrow()
    return [got.column(k).to_numpy() for k in columns]


def _sums(docs: DataFrame, head: int, part_tokens: int) -> tuple[DataFrame, int, int]:
    """(r1, r2, n_words, s, base, known) of each row, written; tokens and different words of the training texts."""
    spark = docs.sparkSession
    own = docs.where("train").select("text")
    unigrams = materialize(count_words(own), "unigrams")
    total, types = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    seen = _types(unigrams, "c")
    d1 = discounts(seen)
    spare = 0 if any(seen[1 : KATZ + 1]) else 1
    freed = float(sum(seen[r] * r * (1 - d1[r]) for r in range(1, KATZ + 1))) + spare
    unseen = float(np.log10(max(freed / max(total + spare, 1), 1e-300))) if total else 0.0
    p1 = lambda c: _kept_column(c, d1) / max(total + spare, 1)

    levels = _levels(unigrams, head)
    least = levels[-1][0] if levels else total + 1
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_tokens))
    shared = spark.sparkContext.broadcast(Head(_by_rank(unigrams.where(F.col("c") >= least), "h")[0].view(np.uint64), levels, total, parts))
    pairs = materialize(count_pairs(own, shared), "pairs")
    seen2, hot, hot_n = pair_types(pairs, max(total // HOT_PAIRS, 2))
    d2 = discounts(seen2)

    far = pairs.where("keys is null").select("w1", "w2", "n", "c2")
    rare = unigrams.where(F.col("c") < least).select(F.col("h").alias("w2"), F.col("c").alias("c2"))
    far = far.where("c2 is not null").unionByName(far.where("c2 is null").drop("c2").join(rare, "w2"))
    near_sums = context_sums(pairs, shared, d1, d2, total + spare)
    far_sums = far.select(F.col("w1").alias("h"), _kept_column("n", d2).alias("used"), p1("c2").alias("p"))
    sums = near_sums.unionByName(far_sums).groupBy("h").agg(F.sum("used").alias("used"), F.sum("p").alias("p"))
    # a context whose pairs leave nothing free has one more count for what it did not see; one that saw every word has nothing to free
    under = F.when(F.col("p") > 1 - 1e-9, F.col("used")).otherwise(F.col("c") + (F.col("used") >= F.col("c") * (1 - 1e-12)).cast("int"))
    free = F.greatest(1 - F.col("used") / F.col("under"), F.lit(1e-300)) / F.greatest(1 - F.col("p"), F.lit(1e-12))
    words = unigrams.join(sums, "h").withColumn("under", under).select("h", "c", F.log10("under").alias("u"), F.log10(free).alias("a"))
    words = materialize(words, "words")
    log_u, log_a = _by_rank(words.where(F.col("c") >= least), "u", "a")
    know = Model(log_u, log_a, d1, d2, total + spare, unseen, hot, hot_n)
    model = spark.sparkContext.broadcast(know)

    rare_words = words.where(F.col("c") < least)
    # words of the head are looked up where pairs are packed
    left = rare_words.select(F.col("h").alias("w1"), (F.col("u") + F.col("a")).alias("off"))
    far_pairs = far.join(left, "w1", "left").withColumn("off", F.coalesce("off", F.lit(float("nan"))))
    far_pair_rows = far_rows(far_pairs, ["w1", "w2", "n", "c2", "off"], shared, lambda *x: model.value.far_pairs(shared.value, *x))
    far_word_rows = far_rows(rare_words, ["h", "c", "u", "a"], shared, lambda *x: model.value.far_words(*x))
    none = [F.lit(None).cast("binary").alias(x) for x in "cdef"]
    near_pairs = pairs.where("keys is not null").select("part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("keys").alias("a"), F.col("counts").alias("b"), *none)
    rows = near_pairs.unionByName(far_pair_rows).unionByName(far_word_rows).unionByName(asks(docs, shared, model))
    got = answers(rows.repartition(parts, "part").sortWithinPartitions("part", "kind", "block"), shared, model)
    sums = got.groupBy("block").applyInArrow(_gather, "r1 long, r2 long, n_words long, s double, base double, known long")
    return materialize(sums, "sums"), total, types


def score(df: DataFrame, train: Column, *, text: str = "text", head: int = HEAD, part_tokens: int = PART_TOKENS) -> DataFrame:
    """``df`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score. ``train``: which rows to learn from.

    The model's jobs run within the call, with small Arrow batches; the join of its sums with the rows is left to the caller.
    """
    if not 0 <= head <= HEAD:
        raise ValueError(f"a head of up to {HEAD} words")
    keep = [c for c in df.columns if c != text and c not in _MADE]
    t = F.coalesce(F.col(text), F.lit(""))
    # two hashes of the whole row name it
    row = F.struct(*keep) if keep else F.struct(F.lit(1).alias("_none"))
    docs = df.select(row.alias("row"), t.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    docs = docs.select("row", "text", "train", F.xxhash64("row", "text").alias("r1"), F.xxhash64("text", F.lit("second"), "row").alias("r2"))
    with batch_bytes(df.sparkSession, BATCH_BYTES):
        sums, total, types = _sums(docs, head, part_tokens)
    # rows that are equal in all share their sums, and divide them
    same = sums.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("times"), *[F.sum(k).alias(k) for k in ("n_words", "s", "base", "known")])
    each = lambda k: F.col(k) / F.col("times")
    bottom = float(np.log10(max(total + types + 1, 1)))
    out = docs.select("r1", "r2", "row").join(same, ["r1", "r2"]).withColumn("n", (each("n_words") + 1).cast("long"))
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep],
        F.col("n").alias("n_tokens"),
        F.round(each("known")).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (each("base") - F.col("n") * bottom).alias("base_score"),
        each("s").alias("score"),
    )
