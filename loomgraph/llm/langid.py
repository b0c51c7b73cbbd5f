"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (byte 3- and 4-grams of
words with their boundary blanks, hashed to buckets); a linear softmax over that
average gives the language. Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled rows. The
softmax has one class more, for text in no language that was learned: its rows are
sampled texts read backwards or with their letters exchanged. A temperature fitted on
rows the training did not see makes the scores probabilities, and the scores of those
rows give the threshold below which a text is rejected: the share ``false_reject`` of
them lies below it, one of them at least.

Defined results: a null text or one without a letter is ``und`` with score 0 and
rejected. With no labelled row at all every text is ``und``. Equal texts have
equal results; ties go to the label that sorts first. Texts of any length are read
whole. An empty table has no rows. Extra columns pass through whatever their names,
but those with a result's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_steps

BUCKET_BITS = 13
SIZES = (3, 4)
_MIX = np.uint32(2654435761)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _grams(data: np.ndarray):
    """For each gram size: bucket of the gram that starts at each byte, and whether it lies within one word."""
    wide = data.astype(np.uint32)
    blank = _SPACE[data]
    for n in SIZES:
        if len(data) < n:
            continue
        m = len(data) - n + 1
        value = wide[:m].copy()
        inside = np.ones(m, bool)
        for k in range(1, n):
            value += wide[k : m + k] << np.uint32(8 * k)
            if k < n - 1:
                inside &= ~blank[k : m + k]
        value ^= np.uint32(n * 0x9E37)
        yield (value * _MIX) >> np.uint32(32 - BUCKET_BITS), inside


def _sums(buckets: np.ndarray, inside: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Per row of the step, the sum of ``table`` over its grams (columns) ."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    padded = np.vstack([table, np.zeros((1, table.shape[1]), table.dtype)])
    ids = np.where(inside, buckets, len(table)).astype(np.int64)
    starts = np.minimum(offsets[:-1], len(ids))
    full = np.flatnonzero((offsets[1:] > offsets[:-1]) & (starts < len(ids)))
    if len(full):
        for c in range(table.shape[1]):
            out[full, c] = np.add.reduceat(padded[ids, c], starts[full])
    return out


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # bucket x (labels and none): embeddings times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best label and its probability for each text (padded by blanks)."""
        best, prob = [], []
        table = np.hstack([self.weights, np.ones((len(self.weights), 1))]).astype(np.float64)
        for data, offsets in byte_steps(texts):
            total = np.zeros((len(offsets) - 1, table.shape[1]))
            for buckets, inside in _grams(data):
                total += _sums(buckets, inside, offsets, table)
            logits = total[:, :-1] / np.maximum(total[:, -1:], 1) + self.bias
            p = _softmax(logits / self.temperature)[:, : len(self.labels)]  # the last class is no language
            best.append(p.argmax(1))
            prob.append(p.max(1))
        return (np.concatenate(best), np.concatenate(prob)) if best else (np.zeros(0, int), np.zeros(0))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))


def bucket_counts(text: Column) -> Column:
    """Whole-text gram counts per bucket, as a bounded sparse pair of arrays."""

    @F.arrow_udf("struct<bucket: array<int>, n: array<int>>")
    def count(texts: pa.Array) -> pa.Array:
        out = []
        for data, offsets in byte_steps(texts):
            grams = list(_grams(data))
            for a, b in zip(offsets[:-1], offsets[1:]):
                total = np.zeros(1 << BUCKET_BITS, np.int64)
                for buckets, inside in grams:
                    total += np.bincount(buckets[a:b][inside[a:b]], minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(total)
                out.append({"bucket": at.tolist(), "n": total[at].tolist()})
        return pa.array(out, pa.struct([("bucket", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))]))

    return count(_padded(text))


#: Letters exchanged in texts of the class for no language.
_LETTERS, _EXCHANGED = "aeiounrstlmdcphgbvfyzqwjkxAEIOUNRSTLM", "qzxjkwvbhgpfyaceimnoudrltsQZXJKWVBHGP"


def _shares(counts: dict[str, int], rows: int) -> dict[str, int]:
    """How many of ``rows`` rows each label gets: all of a rare one's, equal numbers of the others."""
    out: dict[str, int] = {}
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, (rows - sum(out.values())) // (len(counts) - k))
    return out


def _sample(labelled: DataFrame, text: str, label: str, rows: int, most_labels: int) -> DataFrame:
    """(label, text, pick): of each label the rows with the least content hashes, copies once; the labels' counts come from one aggregation."""
    known = labelled.select(F.col(label).alias("label"), F.col(text).alias("text")).where("label is not null")
    frequent = known.where(F.col("text").rlike(r"\p{L}")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(most_labels).collect()
    counts = {r.label: r.n for r in frequent}
    shares = _shares(counts, rows)
    # a filter on the hash passes about twice a label's share, so what meets in the last step does not grow with the table
    top = lambda v: min(2**63 - 1, -(2**63) + int(min(1.0, 2 * shares[v] / counts[v]) * 2**64)) if shares[v] < counts[v] else 2**63 - 1
    wanted = known.sparkSession.createDataFrame([(v, top(v), shares[v]) for v in shares], "label string, top long, share long")
    picked = known.where(F.col("text").rlike(r"\p{L}")).withColumn("pick", F.xxhash64("text", "label")).join(F.broadcast(wanted), "label").where("pick <= top")
    first = F.row_number().over(Window.partitionBy("label").orderBy("pick"))
    return picked.dropDuplicates(["label", "pick"]).withColumn("_i", first).where(F.col("_i") <= F.col("share")).select("label", "text", "pick")


class _Sparse:
    """Gram counts of rows, each row scaled to sum one."""

    def __init__(self, buckets: pa.ListArray, counts: pa.ListArray):
        self.ends = buckets.offsets.to_numpy().astype(np.int64)
        first = self.ends[0]
        self.ends = self.ends - first
        self.at = buckets.values.to_numpy()[first:]
        self.n = counts.values.to_numpy()[first:]

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.ends[k], self.ends[k + 1])
        n = self.n[part].astype(np.float32)
        return self.at[part], n / max(n.sum(), 1)

    def block(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that some of the rows have, and the rows over these."""
        parts = [self.row(k) for k in rows.tolist()]
        used = np.unique(np.concatenate([at for at, _ in parts]))
        x = np.zeros((len(parts), len(used)), np.float32)
        for i, (at, n) in enumerate(parts):
            x[i, np.searchsorted(used, at)] = n
        return used, x


def train(
    labelled: DataFrame, *, text: str = "text", label: str = "lang", sample_rows: int = 1800, calibration_rows: int = 1200, most_labels: int = 1000, dim: int = 16, epochs: int = 12, false_reject: float = 0.001, seed: int = 7
) -> LanguageModel:
    """Fit on at most ``sample_rows`` rows and calibrate on at most ``calibration_rows`` others.

    The rows are dealt by label (all of a rare one's, equal numbers of the others), within a label by least content hash, so
    that a language of a few documents in millions is learned; in the fit, rows of rare labels come up to twenty times.
    Only the ``most_labels`` most frequent labels are learned. These numbers and the number of buckets bound what the driver
    gets, whatever the size of the table. ``false_reject`` is the share of calibration rows that the threshold may lose.
    """
    picked = _sample(labelled, text, label, sample_rows + calibration_rows, most_labels).repartition(12)
    # half of the rows stand a second time for no language
    odd = F.when(F.col("pick") % 4 == 0, F.reverse("text")).otherwise(F.translate("text", _LETTERS, _EXCHANGED))
    both = F.array(F.struct("label", "text"), F.struct(F.lit(None).cast("string").alias("label"), F.when(F.col("pick") % 2 == 0, odd).alias("text")))
    rows = picked.select("pick", F.explode(F.filter(both, lambda x: x["text"].isNotNull())).alias("x")).select("x.label", "pick", bucket_counts(F.col("x.text")).alias("f"))
    got = rows.select("label", "pick", "f.*").toArrow().combine_chunks().sort_by([("pick", "ascending"), ("label", "ascending")])
    label_of, pick_of = got.column("label").to_pylist(), got.column("pick").to_numpy()
    labels = tuple(sorted({v for v in label_of if v is not None}))
    if not labels:
        return LanguageModel((), np.zeros((1 << BUCKET_BITS, 0)), np.zeros(0), 1.0, 0.0)
    code = {v: k for k, v in enumerate(labels)}
    y = np.array([code.get(v, len(labels)) for v in label_of])
    # of each label the same share is held back; a text read backwards goes with its text
    held_picks = []
    for k in range(len(labels)):
        own = np.unique(pick_of[y == k])
        some = np.random.default_rng(seed + k).permutation(len(own))[: len(own) * calibration_rows // (sample_rows + calibration_rows)]
        held_picks.append(own[some])
    picks = np.unique(pick_of)
    held = np.isin(pick_of, np.concatenate(held_picks)) if len(picks) >= 50 else np.zeros(len(pick_of), bool)
    x = _Sparse(*(got.column(k).combine_chunks() for k in ("bucket", "n")))
    own = np.flatnonzero(~held)
    sizes = np.bincount(y[own], minlength=len(labels) + 1)
    often = np.clip(-(-sizes.max() // (10 * np.maximum(sizes, 1))), 1, 20)
    fit = np.repeat(own, often[y[own]])
    target = np.eye(len(labels) + 1, dtype=np.float32)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.5, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out = np.zeros((dim, len(labels) + 1), np.float32)
    bias = np.zeros(len(labels) + 1, np.float32)
    for epoch in range(epochs):
        rate = 8.0 * (1 - epoch / epochs)
        order = rng.permutation(fit)
        for k in range(0, len(order), 32):
            at = order[k : k + 32]
            used, part = x.block(at)
            hidden = part @ emb[used]
            grad = (_softmax(hidden @ out + bias) - target[y[at]]) / len(at)
            emb[used] -= rate * 20 * (part.T @ (grad @ out.T))
            out -= rate * hidden.T @ grad
            bias -= rate * 0.1 * grad.sum(0)
    weights = (emb @ out).astype(np.float64)
    check = np.flatnonzero(held) if held.any() else own
    logits = np.array([n @ weights[at] for at, n in map(x.row, check.tolist())]) + bias
    truth = y[check]
    temps = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in temps]
    temperature = float(temps[int(np.argmin(loss))])
    sure = np.sort(_softmax(logits / temperature)[truth < len(labels), :-1].max(1))
    # the least score alone may be that of a row with a wrong label
    threshold = float(sure[min(len(sure) - 1, max(1, int(false_reject * len(sure))))]) if len(sure) else 0.0
    return LanguageModel(labels, weights, bias.astype(np.float64), temperature, threshold)


def identify(df: DataFrame, model: LanguageModel, *, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``df`` with ``<prefix>pred``, ``<prefix>score`` and ``<prefix>rejected``; no shuffle, whole texts."""
    labels = model.labels

    @F.arrow_udf("struct<best: int, p: double>")
    def predict(texts: pa.Array) -> pa.Array:
        best, p = model.scores(texts)
        return pa.StructArray.from_arrays([pa.array(best.astype(np.int32)), pa.array(p.astype(np.float64))], ["best", "p"])

    made = [f"{prefix}{k}" for k in ("pred", "score", "rejected")]
    keep = [c for c in df.columns if c not in made]
    # the caller's columns wait in one struct, so none of their names meets one of ours
    rows = df.select(F.struct(*keep).alias("row"), F.col(text).alias("t"))
    if labels:
        letters = F.coalesce(F.col("t").rlike(r"\p{L}"), F.lit(False))
        rows = rows.withColumn("out", predict(_padded(F.col("t"))))
        name = F.element_at(F.array(*map(F.lit, labels)), F.col("out.best") + 1)
        results = F.when(letters, name).otherwise("und"), F.when(letters, F.col("out.p")).otherwise(0.0), ~letters | (F.col("out.p") < model.threshold)
    else:
        results = F.lit("und"), F.lit(0.0), F.lit(True)
    return rows.select(*[F.col("row")[c].alias(c) for c in keep], *[r.alias(c) for r, c in zip(results, made)])
