r"""Source divergence audit: how far the words of each source are from those of the other sources of its language.

Two passes over the texts. The first counts, for each language, in how many documents a term occurs, exactly; terms of at
least ``min_docs`` documents are the vocabulary. The second builds an Aho-Corasick automaton (pyahocorasick) of the kept
terms, each between two blanks, and runs it over the texts with all other characters made blank: every hit is one whole
word. Counts are summed in the tasks and become sparse postings (term, source, count). Tasks read small batches and hand on
what they hold by its size, so a worker's memory is its chunk's automata and a bounded rest, but for one very long text.

Vocabularies of any size: terms are cut into chunks of ``CHUNK_BYTES`` by falling document frequency, and one chunk at a
time goes to the tasks. If there are more, a pass also writes the words it did not know, joined by blanks, and the next
chunk reads only these: after the first chunk a few hundredths of the text.

With c occurrences of a term in a group, N in all and V terms, p = 1 + floor(10^9 (c + 1) / (N + V)), and the divergence
of p from q is floor((p - q)^2 / q). The sum over all terms, met or not, comes from postings alone: every term adds what
two absent ones do, then the terms of either source add what changes there (from a histogram of its p), and terms of both,
which one join of the postings finds, correct for what was then counted twice.

Defined results: null text, language and source are read as empty; a group without terms counts as one of no occurrences;
without a vocabulary all sums are 0 and no term is listed; ties go to the smaller name by UTF-8 bytes; repeated rows count
each time; an empty table has no rows; very long texts are one step of a task; only the three named columns are read, so
others may have any name. Sums of squares stay below 2^63 up to a billion kept terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import batched
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_bytes, materialize, ordered_partitions

#: Bytes of kept terms (with OVERHEAD each) in one automaton.
CHUNK_BYTES = 24 << 20
OVERHEAD = 16
#: Counts that a task holds before it hands them on, and bytes of text after which it does so at the latest.
HELD, HELD_BYTES = 400_000, 128 << 20
#: Hits of an automaton (8 bytes each) before they become counts, and counts kept as arrays (16 bytes each); bytes of one Arrow batch
#: of texts, rows of one of counts.
HITS, SUMS = 1 << 19, 1 << 20
BATCH_BYTES, BATCH_ROWS = 1 << 22, 1 << 16
SCALE = 1_000_000_000

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_second = itemgetter(1)


def blanked(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and every other ASCII character but a-z made a blank."""
    return (text or "").encode().translate(_TABLE)


def _doc_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # workers outlive a query: a new one needs no automata of the last
    _built.clear()
    held: dict[str, Counter] = {}
    size = terms_held = 0

    def flush():
        for lang, counter in held.items():
            for part in batched(counter.items(), BATCH_ROWS):
                terms, ns = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(ns, pa.int64())], ["lang", "term", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            words = blanked(text.as_py())
            size += len(words)
            terms = set(words.split(b" "))
            terms.discard(b"")
            counter = held.setdefault(lang, Counter())
            terms_held -= len(counter)
            counter.update(terms)
            terms_held += len(counter)
            if terms_held > HELD or size > HELD_BYTES:
                yield from flush()
                held, size, terms_held = {}, 0, 0
    yield from flush()


def vocabulary(docs: DataFrame, min_docs: int = 3, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, term, tid, chunk): the terms of at least ``min_docs`` documents of their language, as a written table."""
    counts = docs.select("lang", "text").mapInArrow(_doc_counts, "lang string, term string, n long")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
    with batch_bytes(docs.sparkSession, BATCH_BYTES):
        cut = ordered_partitions(kept.withColumn("_last", -F.col("n")), "_last", "lang", "term")
    size = (F.octet_length("term") + OVERHEAD).cast("long")
    parts = cut.groupBy("_part").agg(F.sum(size).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy("_last", "lang", "term")
    # one row for each partition
    sized = cut.withColumn("_sum", F.sum(size).over(inside)).join(F.broadcast(starts), "_part")
    chunk = F.expr(f"cast((_start + _sum) div {int(chunk_bytes)} as int)")
    return materialize(sized.select("lang", "term", F.monotonically_increasing_id().alias("tid"), chunk.alias("chunk")), "vocabulary")


_built: dict[tuple, tuple] = {}


def _automaton(key: tuple[str, int], chunk: bytes, lang: str):
    """Automaton of one language's terms in a chunk (None if it has none), which finds their places, and the ids by place; a worker holds those of one chunk."""
    import ahocorasick

    if _built and next(iter(_built))[0] != key:
        _built.clear()
    if (key, lang) not in _built:
        table = pa.ipc.open_stream(chunk).read_all()
        own = table.filter(pa.compute.equal(table["lang"], lang))
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        terms = (term for batch in own.to_batches(max_chunksize=BATCH_ROWS) for term in batch["term"].to_pylist())
        for place, term in enumerate(terms):
            auto.add_word(f" {term.encode().decode('latin-1')} ", place)  # one character a byte
        auto.make_automaton()
        _built[key, lang] = (auto if len(own) else None), own["tid"].to_numpy()
    return _built[key, lang]


def _without(words: bytes, ends: np.ndarray) -> bytes:
    """Words between blanks of which none ends before one of the blanks at ``ends``."""
    edges = np.flatnonzero(np.diff(np.frombuffer(words, np.uint8) != 32)) + 1
    first, last = edges[::2], edges[1::2]
    met = np.zeros(len(words), bool)
    met[ends] = True
    left = np.flatnonzero(~met[last])
    return b" ".join([words[a:b] for a, b in zip(first[left].tolist(), last[left].tolist())])


def _added(keys: np.ndarray, n: np.ndarray, hits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``keys`` and their counts, with what ``hits`` add; empties these."""
    new = np.concatenate(hits) if hits else keys[:0]
    hits.clear()
    new, more = np.unique(new, return_counts=True)
    at = np.searchsorted(keys, new)
    old = np.append(keys, -1)[at] == new
    n[at[old]] += more[old]
    at, new, more = at[~old], new[~old], more[~old]
    return np.insert(keys, at, new), np.insert(n, at, more)


def _recounter(key: tuple[str, int], shared, more: bool):
    """Of (lang, source, text or words already blanked): counts by (lang, source, tid), and with ``more`` the words the chunk lacks."""
    names = ["lang", "source", "tid", "n", "text"]

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a group's number and a term's place in one key
        numbers: dict[tuple[str, str], int] = {}
        none = np.zeros(0, np.int64)
        keys, counts, hits, waiting = none, none, [], 0

        def flush():
            groups = list(numbers)
            lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for i in range(0, len(keys), BATCH_ROWS):
                part, n = keys[i : i + BATCH_ROWS], pa.array(counts[i : i + BATCH_ROWS])
                group, tids = part >> 32, part & 0xFFFFFFFF
                for g in np.unique(group).tolist():
                    own = slice(*np.searchsorted(group, [g, g + 1]))
                    tids[own] = _automaton(key, shared.value, groups[g][0])[1][tids[own]]
                yield pa.RecordBatch.from_arrays([lang.take(pa.array(group)), source.take(pa.array(group)), pa.array(tids), n, pa.nulls(len(n), pa.string())], names)

        for batch in batches:
            groups: dict[tuple[str, str], list[bytes]] = {}
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
                groups.setdefault((lang, source), []).append(blanked(text.as_py()))
            for (lang, source), texts in groups.items():
                auto, _ = _automaton(key, shared.value, lang)
                words = b" ".join([b"", *texts, b""])
                ends = none
                if auto is not None:
                    found = auto.iter(words.decode("latin-1"))
                    if more:
                        ends, places = np.fromiter(found, np.dtype((np.int64, 2))).reshape(-1, 2).T
                    else:
                        places = np.fromiter(map(_second, found), np.int64)
                    hits.append(places | numbers.setdefault((lang, source), len(numbers)) << 32)
                    waiting += len(places)
                if more and (rest := _without(words, ends)):
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((lang, pa.string()), (source, pa.string()), (None, pa.int64()), (None, pa.int64()), (rest.decode(), pa.string()))], names)
                if waiting > HITS:
                    keys, counts = _added(keys, counts, hits)
                    waiting = 0
                if len(keys) > SUMS:
                    yield from flush()
                    keys, counts = none, none
        keys, counts = _added(keys, counts, hits)
        yield from flush()

    return recount


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, tid, n) with n > 0: occurrences of kept terms, as a written table."""
    spark = docs.sparkSession
    chunks = sorted(r[0] for r in terms.select("chunk").distinct().collect())
    schema = "lang string, source string, tid long, n long, text string"
    left, found = docs.select("lang", "source", "text"), None
    # workers outlive a query: what they keep is named by the call and the chunk
    call = uuid.uuid4().hex
    for chunk in chunks:
        table = terms.where(F.col("chunk") == chunk).select("lang", "term", "tid").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        more = chunk != chunks[-1]
        counted = left.mapInArrow(_recounter((call, chunk), spark.sparkContext.broadcast(sink.getvalue().to_pybytes()), more), schema)
        if more:
            with batch_bytes(spark, BATCH_BYTES):
                counted = materialize(counted, "counted")
            left = counted.where("tid is null").select("lang", "source", "text")
        part = counted.where("tid is not null").select("lang", "source", "tid", "n")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "lang string, source string, tid long, n long")
    with batch_bytes(spark, BATCH_BYTES):
        return materialize(found.groupBy("lang", "source", "tid").agg(F.sum("n").alias("n")), "postings")


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term with ``n`` of ``total`` occurrences among ``terms`` terms; null if there are no terms."""
    near = F.call_function("div", F.lit(SCALE) * (n + 1), total + terms)
    far = F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (n.cast("decimal(20,0)") + 1), (total + terms).cast("decimal(20,0)"))
    return F.when(terms > 0, F.lit(1) + F.when(n < 9_000_000_000, near).otherwise(far))


def apart(p: Column, q: Column) -> Column:
    """Divergence of ``p`` from ``q``."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(df: DataFrame, *, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = 3, top: int = 200, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources, part ``term`` the ``top`` terms that are more frequent than in the language."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(full(lang).alias("lang"), full(source).alias("source"), F.col(text).alias("text"))
    terms = vocabulary(docs, min_docs, chunk_bytes=chunk_bytes)
    post = postings(docs, terms)
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = post.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("v", zero).alias("v"))
    groups = groups.withColumn("p0", share(zero, F.col("total"), F.col("v"))).withColumn("gid", F.monotonically_increasing_id())
    groups = materialize(groups, "groups")
    post = post.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("v")))
    return _pairs(post, groups).unionByName(_terms(post, groups, terms, top))


def _pairs(post: DataFrame, groups: DataFrame) -> DataFrame:
    a, b = F.col("p0"), F.col("q0")
    # what terms of one source change against any other: its own p against the other's p of absent terms, and the reverse
    shape = post.groupBy("lang", "gid", "p0", "p").agg(F.count(F.lit(1)).alias("k"))
    others = groups.select("lang", F.col("gid").alias("other"), F.col("p0").alias("q0"))
    own = F.sum(F.col("k") * (apart(F.col("p"), b) - apart(a, b)))
    back = F.sum(F.col("k") * (apart(b, F.col("p")) - apart(b, a)))
    single = shape.join(others, "lang").where("gid <> other").groupBy("gid", "other").agg(own.alias("own"), back.alias("back"))
    one_way = single.select("gid", "other", F.col("own").alias("d")).unionByName(single.select(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("d")))
    # terms of both, each pair of sources once
    x = post.select("tid", "gid", "p", "p0")
    y = post.select("tid", F.col("gid").alias("other"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, q = F.col("p"), F.col("q")
    there = F.sum(apart(p, q) - apart(p, b) - apart(a, q) + apart(a, b))
    back = F.sum(apart(q, p) - apart(q, a) - apart(b, p) + apart(b, a))
    both = x.join(y, "tid").where("gid < other").groupBy("gid", "other").agg(there.alias("there"), back.alias("back"))
    two_way = both.select("gid", "other", F.col("there").alias("d")).unionByName(both.select(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("d")))
    change = one_way.unionByName(two_way).groupBy("gid", "other").agg(F.sum("d").alias("d"))
    pairs = groups.select("lang", "source", "gid", "v", "p0").join(groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("other"), F.col("p0").alias("q0")), "lang").where("gid <> other")
    none = F.lit(0).cast("long")
    value = F.when(F.col("v") > 0, F.col("v") * apart(a, b) + F.coalesce("d", none)).otherwise(none)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.join(change, ["gid", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", rank)


def _terms(post: DataFrame, groups: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    named = post.withColumn("lang_n", F.sum("n").over(Window.partitionBy("tid"))).join(terms.select("tid", F.col("term").alias("item")), "tid").join(whole, "lang")
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    listed = named.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return listed.withColumn("rank", rank).where(F.col("rank") <= top)
