"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows (13 consecutive words) of the benchmark items; a shorter
item is one window. Texts and windows become sequences of vocabulary ids. For each
window length a shift table over hashed blocks of two words says how far the
search may skip; where it says zero, the buckets of the block's hash give the
windows that may end there, and a direct comparison of all their words confirms
an occurrence. Many stretches of text are searched in step with numpy.

Tasks cut the items into overlapping pieces, deal these to chunks of bounded size
and build the tables; the driver passes on one chunk at a time, so any size of
benchmark is searched whole. With one chunk nothing of the documents is shuffled;
with several, each further one reads the texts again and writes only marks of the
rows it hits, which are put together by row at the end.

Defined results: null or empty text, and text without a word, has no words and no
hits; a null or wordless item has no window; an item without an id hits words but
is no item of a document's list; an item id that repeats counts once;
equal texts have equal results, and texts of any length are searched whole; an empty
table has no rows, an empty benchmark no windows; extra columns pass through whatever
their names, but those with a result's name are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_steps, materialize

WINDOW = 13
#: Most window words that one pass sends to the executors (8 bytes each).
MAX_PASS_WORDS = 4_000_000
_STRETCH = 256
_TABLE_BITS = 16

_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[ord("A") : ord("Z") + 1] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased UTF-8 bytes."""
    edge = np.diff(np.concatenate([[0], _WORD[data].view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_TABLE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each word, from one running sum over the bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_TABLE[data] * _powers(len(data), _BASE))])
    return (total[ends] - total[starts]) * _powers(len(data) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64)


class Windows:
    """Shift tables and buckets for a set of (item id, text); at most MAX_PASS_WORDS words of windows."""

    def __init__(self, items: list[tuple[str | None, str]]):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
            s, e = words_of(data)
            raw = data.tobytes()
            ids = [vocabulary.setdefault(raw[a:b], len(vocabulary) + 1) for a, b in zip(s.tolist(), e.tolist())]
            for k in range(max(1, len(ids) - WINDOW + 1)) if ids else ():
                found.setdefault(tuple(ids[k : k + WINDOW]), set()).add(item)
        self.vocabulary = sorted(vocabulary, key=vocabulary.get)
        self.items = [sorted(v - {None}) for v in found.values()]
        joined = b"".join(self.vocabulary)
        lengths = np.array([len(w) for w in self.vocabulary], np.int64)
        ends = np.cumsum(lengths)
        hashes = word_hashes(np.frombuffer(joined, np.uint8), ends - lengths, ends)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)
        # the first byte offsets of the words, to confirm a hash by its bytes
        self.bytes, self.begin, self.length = np.frombuffer(joined, np.uint8), np.concatenate([[0], ends - lengths]), np.concatenate([[0], lengths])
        self.groups = []
        by_length: dict[int, list[int]] = {}
        keys = list(found)
        for k, w in enumerate(keys):
            by_length.setdefault(len(w), []).append(k)
        for n, own in sorted(by_length.items()):
            block = min(2, n)
            pattern = np.array([keys[k] for k in own], np.int32)
            shift = np.full(1 << _TABLE_BITS, n - block + 1, np.int32)
            for j in range(block - 1, n):
                np.minimum.at(shift, self._block(pattern[:, j - block + 1 : j + 1]), n - 1 - j)
            last = self._block(pattern[:, n - block :])
            order = np.argsort(last, kind="stable")
            first = np.searchsorted(last[order], np.arange((1 << _TABLE_BITS) + 1))
            self.groups.append((n, block, pattern[order], np.array(own)[order], shift, first))

    @staticmethod
    def _block(ids: np.ndarray) -> np.ndarray:
        h = ids[:, 0].astype(np.uint32)
        if ids.shape[1] == 2:
            h = h * np.uint32(0x85EBCA6B) ^ ids[:, 1].astype(np.uint32)
        return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - _TABLE_BITS)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vocabulary id of each word, 0 if it is in no window; a hash that agrees is confirmed by the word's bytes."""
        if not len(self.hashes):
            return np.zeros(len(starts), np.int32)
        h = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == h)
        ids = self.ids[at[hit]]
        good = self.length[ids] == (ends - starts)[hit]
        hit, ids = hit[good], ids[good]
        same = np.ones(len(hit), bool)
        live, k = np.arange(len(hit)), 0
        while len(live):
            live = live[self.length[ids[live]] > k]
            same[live] &= data[starts[hit[live]] + k] == self.bytes[self.begin[ids[live]] + k]
            k += 1
        out = np.zeros(len(starts), np.int32)
        out[hit[same]] = ids[same]
        return out

    def search(self, ids: np.ndarray, first_word: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, word positions, window numbers) of all occurrences; ``first_word``: rows' boundaries in ``ids``."""
        known = ids > 0
        for n, block, pattern, number, shift, first in self.groups:
            # stretches of last-word positions, searched in step
            at, stop = [], []
            for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist()):
                if b - a >= n:
                    cut = np.arange(a + n - 1, b, _STRETCH)
                    at.append(cut)
                    stop.append(np.minimum(cut + _STRETCH, b))
            if not at:
                continue
            pos, end = np.concatenate(at), np.concatenate(stop)
            while len(pos):
                h = self._block(ids[pos[:, None] + np.arange(1 - block, 1)])
                skip = shift[h]
                here = (skip == 0) & known[pos]
                if here.any():
                    p, hh = pos[here], h[here]
                    count = first[hh + 1] - first[hh]
                    step = 0
                    live = np.flatnonzero(count > 0)
                    while len(live):
                        w = first[hh[live]] + step
                        same = (ids[p[live][:, None] + np.arange(1 - n, 1)] == pattern[w]).all(1)
                        if same.any():
                            yield n, p[live][same] - n + 1, number[w[same]]
                        step += 1
                        live = live[count[live] > step]
                pos = pos + np.maximum(skip, 1)
                on = pos < end
                pos, end = pos[on], end[on]


def _mark(windows: Windows, texts: pa.Array):
    """Per text: number of words, marks of hit words and the item ids with an occurrence."""
    for raw, offsets in byte_steps(texts):
        data = _LOWER[raw]
        # a word never spans two texts: split what the joined bytes run together
        starts, ends = words_of(data)
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        inner = inner[_WORD[data[inner]] & _WORD[data[inner - 1]]] if len(inner) else inner
        if len(inner):
            inner = np.unique(inner)
            starts = np.sort(np.concatenate([starts, inner]))
            ends = np.sort(np.concatenate([ends, inner]))
        first_word = np.searchsorted(starts, offsets)
        ids = windows.encode(data, starts, ends)
        delta = np.zeros(len(ids) + 1, np.int64)
        rows_of, items_of = [], []
        for n, at, number in windows.search(ids, first_word):
            np.add.at(delta, at, 1)
            np.add.at(delta, at + n, -1)
            rows_of.append(np.searchsorted(first_word, at, side="right") - 1)
            items_of.append(number)
        hit = np.cumsum(delta[:-1]) > 0
        found: dict[int, set[str]] = {}
        if rows_of:
            pairs = np.unique(np.stack([np.concatenate(rows_of), np.concatenate(items_of)]), axis=1)
            for r, w in pairs.T.tolist():
                found.setdefault(r, set()).update(windows.items[w])
        for k in range(len(offsets) - 1):
            marks = hit[first_word[k] : first_word[k + 1]]
            yield len(marks), marks, sorted(found.get(k, set()))


_OUT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("marks", pa.binary()), ("items", pa.list_(pa.string()))])
_KIND = "struct<n_words: bigint, n_hit: bigint, marks: binary, items: array<string>>"


def _search(windows: Windows, text: Column, marks: bool) -> Column:
    """Struct of the words of a text, those hit, their packed marks (if asked for) and the items found."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [{"n_words": n, "n_hit": int(m.sum()), "marks": np.packbits(m).tobytes() if marks else None, "items": i} for n, m, i in _mark(windows, texts)]
        return pa.array(rows, _OUT)

    return F.arrow_udf(run, _KIND)(text)


def _count(marks: Column) -> Column:
    """Words that any of a text's packed marks hit."""

    def run(found: pa.Array) -> pa.Array:
        every = ([np.frombuffer(x, np.uint8) for x in row] for row in found.to_pylist())
        return pa.array([int(np.unpackbits(np.bitwise_or.reduce(row)).sum()) for row in every], pa.int64())

    return F.arrow_udf(run, "bigint")(marks)


def item_pieces(benchmark: DataFrame, item: str, text: str, windows: int) -> DataFrame:
    """(i, t, size): items cut into pieces of up to ``windows`` windows, which overlap so that none is lost; words they take in a table."""

    def cut(batches):
        for b in batches:
            out = []
            for i, t in zip(b.column("i").to_pylist(), b.column("t").to_pylist()):
                data = _LOWER[np.frombuffer(t.encode(), np.uint8)]
                s, e = words_of(data)
                for a in range(0, max(1, len(s) - WINDOW + 1), windows) if len(s) else ():
                    own = min(windows, max(1, len(s) - WINDOW + 1 - a))
                    piece = data[s[a] : e[min(a + windows + WINDOW - 1, len(s)) - 1]].tobytes()
                    out.append((i, piece.decode(), own * WINDOW + len(piece) // 8))
            kinds = {"i": pa.string(), "t": pa.string(), "size": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(cut, "i string, t string, size long").dropDuplicates(["i", "t"])


def window_chunks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[Windows]:
    """The windows of all items in chunks of about ``limit`` words at most, which tasks build; the driver holds one at a time."""
    pieces = materialize(item_pieces(benchmark, item, text, max(1, min(1 << 14, limit // (4 * WINDOW)))), "pieces")
    total = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # dealt by hash: half full on average, so that none is much over the limit
    dealt = -(-2 * total // limit) if total > limit else 1

    def build(table: pa.Table) -> pa.Table:
        made = Windows(list(zip(table.column("i").to_pylist(), table.column("t").to_pylist())))
        return pa.table([table.column("chunk")[:1], pa.array([pickle.dumps(made)], pa.binary())], ["chunk", "made"])

    chunk = F.pmod(F.xxhash64("i", "t"), F.lit(dealt)).alias("chunk")
    built = materialize(pieces.select(chunk, "i", "t").groupBy("chunk").applyInArrow(build, "chunk long, made binary"), "windows")
    for (k,) in sorted(built.select("chunk").collect()):
        yield pickle.loads(built.where(F.col("chunk") == k).first()["made"])


def contamination(df: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", pass_words: int = MAX_PASS_WORDS) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``items`` (sorted ids of items with an occurring window) and ``contaminated``."""
    chunks = window_chunks(benchmark, item, item_text, pass_words)
    first, following = next(chunks, None) or Windows([]), next(chunks, None)
    keep = [c for c in df.columns if c not in ("n_words", "n_hit", "items", "contaminated")]
    # the caller's columns wait in one struct, so none of their names meets one of ours
    rows = df.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    if following is None:
        got = rows.withColumn("hit", _search(first, F.col("t"), False))
    else:
        # texts are written once, with a number; the other chunks write only marks of the rows they hit
        docs = materialize(rows.withColumn("no", F.monotonically_increasing_id()).withColumn("hit", _search(first, F.col("t"), True)), "searched")
        marks = docs.where("hit.n_hit > 0").select("no", "hit.marks", "hit.items")
        while following is not None:
            found = docs.select("no", _search(following, F.col("t"), True).alias("hit")).where("hit.n_hit > 0")
            marks = marks.unionByName(materialize(found.select("no", "hit.marks", "hit.items"), "marks"))
            following = next(chunks, None)
        # a text has at most one row for each chunk
        every = marks.groupBy("no").agg(F.collect_list("marks").alias("marks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        every = every.select("no", _count(F.col("marks")).alias("n_hit"), "items")
        n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
        got = docs.select("no", "row", F.col("hit.n_words").alias("n")).join(every, "no", "left")
        got = got.withColumn("hit", F.struct(F.col("n").alias("n_words"), n_hit.alias("n_hit"), items.alias("items")))
    n, hit = F.col("hit.n_words"), F.col("hit.n_hit")
    made = (n.alias("n_words"), hit.alias("n_hit"), F.col("hit.items").alias("items"), ((hit > 0) & (20 * hit >= n)).alias("contaminated"))
    return got.select(*[F.col("row")[c].alias(c) for c in keep], *made)
