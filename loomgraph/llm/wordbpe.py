r"""BPE with word ends, encoding and decoding by a public tokenizer file, in batched numpy merge rounds.

A text is cut at the file's special tokens; what lies between is normalised (NFC, lower case) and split into words by
the file's pattern. The symbols of all words that are new in a batch lie in one flat array. A round finds the rank of
each changed neighbouring pair by binary search over the sorted pair keys, takes the least rank of each word, and merges
its places from left to right; words without a mergeable pair leave the array. All places of a pair may be merged in one
round only if no pair that holds the merged symbol comes before it; the file is asked for that, and other pairs are merged
at their leftmost place alone. So the ids are those of one merge at a time, leftmost of least rank first.

Characters that this Python does not know yet go through the tokenizers library's own normaliser and splitter, since their
case and class depend on its version of Unicode.

Defined results: null and empty text have no tokens and decode to empty text; equal texts have equal ids, repeated rows
stay; an empty table gives an empty table; a text of any length is one row's work, its words and one number a byte at a
time; extra columns pass through, whatever their names, since these are column functions. A file whose parts are not the
ones above raises ``ValueError``. The file is fixed and its size checked; it does not grow with the data.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .bpe import _vocabulary, splitter
from .common import STEP_BYTES

#: Words, and bytes of words, whose ids a worker keeps; beyond either it starts anew.
KEPT_WORDS = 400_000
KEPT_BYTES = 16 << 20
#: Longer words are merged one at a time, so that their rounds do not copy others.
LONG = 256

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(hidden)) for b in range(256)]


@cache
def _unknown():
    """Search for a character that this Python's Unicode tables leave unassigned."""
    runs, start = [], None
    for c in range(sys.maxunicode + 2):
        free = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            runs.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(runs)}]").search


_wide = re.compile("[^\x00-ɏ]").search


class WordCodec:
    """Merges, names and a bounded memory of words, one for each worker process."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in steps]
        plain = not model["unk_token"] and not model["continuing_subword_prefix"] and not model.get("ignore_merges") and spec["decoder"] is None
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or model["type"] != "BPE" or not plain:
            raise ValueError("not a lower-case BPE file with word ends")
        self.raw = raw
        ids, end = model["vocab"], model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special, self.specials = special, regex.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.names = [""] * (1 + max([*ids.values(), *special.values()]))
        for name, i in [*ids.items(), *special.items()]:
            self.names[i] = name
        pattern = steps[0]["pattern"]["Regex"].replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
        self.split = splitter(pattern)
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int32)
        self.last = np.array([ids[c + end] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranked = {(ids[a] << 32) | ids[b]: (k, ids[a + b]) for k, (a, b) in enumerate(pairs)}
        self.keys = np.array(sorted(ranked), np.int64)
        self.ranks = np.array([ranked[k][0] for k in self.keys.tolist()], np.int32)
        self.joined = np.zeros(len(pairs) + 1, np.int32)
        earliest = np.full(len(self.names), _NONE, np.int32)
        for key, (rank, made) in ranked.items():
            self.joined[rank] = made
            for part in (key >> 32, key & 0xFFFFFFFF):
                earliest[part] = min(earliest[part], rank)
        #: ranks whose places are merged one at a time, as a pair with the merged symbol has a lower rank
        self.single = earliest[self.joined] < np.arange(len(self.joined))
        self.known: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, tuple[str, str]] = {}
        self.kept = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = (a.astype(np.int64) << 32) | b
        if not len(self.keys):
            return np.full(len(want), _NONE)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def _places(self, p: np.ndarray, follows: np.ndarray, group: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which of the places ``p`` are merged: every second one of a run of overlapping ones, the first of a group for single ranks."""
        k = np.arange(len(p))
        start = np.maximum.accumulate(np.where(follows, 0, k))
        taken = (k - start) % 2 == 0
        if self.single[rank].any():
            first = np.ones(len(p), bool)
            first[1:] = group[1:] != group[:-1]
            taken &= first | ~self.single[rank]
        return taken

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word (none is empty)."""
        out: list[tuple[int, ...]] = [()] * len(words)
        some = []
        for k, w in enumerate(words):
            if len(w) > LONG:
                out[k] = tuple(self._merge_long(w).tolist())
            else:
                some.append(k)
        if not some:
            return out
        sizes = np.array([len(words[k]) for k in some])
        data = np.frombuffer(b"".join([words[k] for k in some]), np.uint8)
        sym, ends = self.inner[data], np.cumsum(sizes) - 1
        sym[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(some), dtype=np.int32), sizes)
        rank = np.full(len(sym), _NONE)
        rank[:-1] = np.where(word[1:] == word[:-1], self._rank(sym[:-1], sym[1:]), _NONE)
        done_w, done_s = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            on = least != _NONE
            if not on.all():
                keep = np.repeat(on, lengths)
                done_w.append(word[~keep])
                done_s.append(sym[~keep])
                sym, word, rank, least, lengths = sym[keep], word[keep], rank[keep], least[on], lengths[on]
                if not len(sym):
                    break
            p = np.flatnonzero(rank == np.repeat(least, lengths))
            follows = np.concatenate([[False], p[1:] == p[:-1] + 1])
            p = p[self._places(p, follows, word[p], rank[p])]
            sym[p] = self.joined[rank[p]]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            q = (np.cumsum(keep) - 1)[p]
            sym, word, rank = sym[keep], word[keep], rank[keep]
            changed = np.concatenate([q, q[q > 0] - 1])
            after = np.minimum(changed + 1, len(sym) - 1)
            inside = (after > changed) & (word[after] == word[changed])
            rank[changed] = np.where(inside, self._rank(sym[changed], sym[after]), _NONE)
        all_w, all_s = np.concatenate(done_w), np.concatenate(done_s)
        order = np.argsort(all_w, kind="stable")
        flat = all_s[order].tolist()
        stops = np.cumsum(np.bincount(all_w, minlength=len(some))).tolist()
        at = 0
        for k, stop in zip(some, stops):
            out[k] = tuple(flat[at:stop])
            at = stop
        return out

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One word: symbols stay in place with links to their live neighbours, closed up when half of them are gone."""
        data = np.frombuffer(piece, np.uint8)
        sym = self.inner[data]
        sym[-1] = self.last[data[-1]]
        rank = np.append(self._rank(sym[:-1], sym[1:]), _NONE)
        while True:
            n = len(sym)
            after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
            alive, live = np.ones(n, bool), n
            while live > n // 2 and (low := rank.min()) != _NONE:
                p = np.flatnonzero(rank == low)
                follows = np.concatenate([[False], after[p[:-1]] == p[1:]])
                p = p[self._places(p, follows, np.zeros(len(p), np.int8), np.full(len(p), low))]
                gone = after[p]
                nxt = after[gone]
                sym[p] = self.joined[low]
                alive[gone] = False
                rank[gone] = _NONE
                after[p] = nxt
                before[nxt[nxt < n]] = p[nxt < n]
                live -= len(p)
                changed = np.concatenate([p, before[p][before[p] >= 0]])
                right = after[changed]
                inside = right < n
                rank[changed] = _NONE
                rank[changed[inside]] = self._rank(sym[changed[inside]], sym[right[inside]])
            sym, rank = sym[alive], rank[alive]
            if live > n // 2 or rank.min() == _NONE:
                return sym

    def _words(self, text: str) -> list[str]:
        if not _wide(text):
            return self.split(text.lower())
        if _unknown()(text):
            return self._by_library(text)
        # one letter at a time: a sigma at the end of a word is no special case
        return self.split(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _by_library(self, text: str) -> list[str]:
        from tokenizers import Tokenizer

        if not hasattr(self, "library"):
            self.library = Tokenizer.from_str(self.raw.decode())
            self.bytes_of = {c: b for b, c in enumerate(byte_letters())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, p)).decode() for p, _ in pieces]

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text in order."""
        if self.specials is None or not self.specials.search(text):
            return self._words(text)
        out: list[str] = []
        for k, part in enumerate(self.specials.split(text)):
            out.extend([part] if k % 2 else self._words(part))
        return out

    def _learn(self, split: list[list[str]]) -> None:
        fresh = [w for w in set().union(*split).difference(self.known)]
        size = sum(map(len, fresh))
        if self.known and (len(self.known) + len(fresh) > KEPT_WORDS or self.kept + size > KEPT_BYTES):
            self.known.clear()
            self.shown.clear()
            self.kept = 0
            fresh = list(set().union(*split))
            size = sum(map(len, fresh))
        words = [w for w in fresh if w not in self.special]
        self.known.update(zip(words, self.merge([w.encode() for w in words])))
        # a special token's text is never a word: the pattern cuts it
        self.known.update((w, (self.special[w],)) for w in fresh if w in self.special)
        self.kept += size

    def steps(self, texts: Iterable[str]) -> Iterator[list[list[str]]]:
        """Pieces of each text, about two megabytes of text at a time, all known afterwards."""
        some: list[list[str]] = []
        size = 0
        for t in texts:
            if some and size + len(t) > STEP_BYTES:
                self._learn(some)
                yield some
                some, size = [], 0
            some.append(self.pieces(t))
            size += len(t)
        if some:
            self._learn(some)
            yield some

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        for some in self.steps(texts):
            for pieces in some:
                yield [i for w in pieces for i in self.known[w]]

    def show_all(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of its ids, the ids as text, and what they decode to; both are put together word by word."""
        for some in self.steps(texts):
            for w in set().union(*some).difference(self.shown):
                ids = self.known[w]
                self.shown[w] = " ".join(map(str, ids)), self.decode(ids)
            for pieces in some:
                both = [self.shown[w] for w in pieces]
                ids = " ".join([x for x, _ in both])
                yield ids.count(" ") + 1 if ids else 0, ids, " ".join([y for _, y in both])

    def decode(self, ids: Iterable[int]) -> str:
        """As the file has no decoder: names of the tokens, one blank between them."""
        return " ".join(map(self.names.__getitem__, ids))


_codecs: dict[bytes, WordCodec] = {}


def word_codec(raw: bytes) -> WordCodec:
    key = hashlib.sha256(raw).digest()
    if key not in _codecs:
        _codecs[key] = WordCodec(raw)
    return _codecs[key]


def encoder(spark: SparkSession, path: str):
    """Column function: text -> array of ids."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(word_codec(shared.value).encode_all(t.as_py() or "" for t in texts), pa.list_(pa.int32()))

    return encode


def decoder(spark: SparkSession, path: str):
    """Column function: array of ids -> text; null is empty. Unknown ids raise."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        c = word_codec(shared.value)
        return pa.array([c.decode(x or []) for x in ids.to_pylist()], pa.string())

    return decode


def digests(spark: SparkSession, text: Column, path: str) -> Column:
    """struct of n_tokens, ids_sha256 and decoded_sha256 for each text: encoded, then decoded from the ids, in one pass."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")
    def both(texts: pa.Array) -> pa.Array:
        c = word_codec(shared.value)
        n, a, b = [], [], []
        for k, ids, decoded in c.show_all(t.as_py() or "" for t in texts):
            n.append(k)
            a.append(hashlib.sha256(ids.encode()).hexdigest())
            b.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return both(text)
