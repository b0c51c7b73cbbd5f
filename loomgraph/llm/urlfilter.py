"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Trees learn from labelled URLs, by default those that a rule decides. Labels from
rules say nothing of the URLs that no rule covers, most of which a filter should
leave alone, so these join the fit as weak examples, blocked with a probability of
``background`` only: what the trees block is what looks like a blocked URL and not
like the rest. Features: lengths, depth, digit ratio, entropy, parameter counts and
the smoothed share of blocked labels of the host's suffix (counted over every
labelled URL). A fifth of the sample is held out; the score above which an URL is
blocked is the one with the least error there. The trees are small and become one
Spark column expression, so judging needs no Python.

Defined results: a null url or one without ``://`` has empty host and path and no
rule; rules that tie in length go by name; without labels of both kinds the trees
are a constant. Equal URLs have equal verdicts. URLs of any length are read whole.
An empty table has no rows. Extra columns pass through whatever their names, but
those with a result's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, least_picks, materialize, spread_join

FEATURES = ("url_len", "host_len", "path_len", "depth", "labels", "digit_ratio", "entropy", "params", "hyphens", "suffix_rate")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    chars = F.array_distinct(F.split(text, ""))
    n = F.greatest(F.length(text), F.lit(1)).cast("double")

    def part(c: Column) -> Column:
        share = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when((c != "") & (share > 0), -share * F.log2(share)).otherwise(0.0)

    return F.aggregate(F.transform(chars, part), F.lit(0.0), lambda a, b: a + b)


def lexical(df: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """``df`` with the lexical feature columns and ``_suffix`` (the host's last label)."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    count = lambda c, s: (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))).cast("double")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    return df.select(
        "*",
        n.cast("double").alias("url_len"),
        F.length(host).cast("double").alias("host_len"),
        F.length(path).cast("double").alias("path_len"),
        count(F.col(path), "/").alias("depth"),
        (count(F.col(host), ".") + 1).alias("labels"),
        ((n - F.length(F.translate(text, "0123456789", ""))) / F.greatest(n, F.lit(1))).alias("digit_ratio"),
        _entropy(text).alias("entropy"),
        F.when(query == "", 0.0).otherwise(count(query, "&") + 1).alias("params"),
        count(text, "-").alias("hyphens"),
        F.substring_index(F.col(host), ".", -1).alias("_suffix"),
    )


@dataclass(frozen=True)
class Trees:
    base: float
    trees: tuple  # nested (feature, cut, left, right) or a leaf value
    threshold: float = 0.5
    error: float = 0.0  # share of held-out labelled rows on the wrong side of the threshold

    def logit(self) -> Column:
        def grow(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, cut, left, right = node
            return F.when(F.col(feature) <= cut, grow(left)).otherwise(grow(right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + grow(t)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(node, row):
            while not isinstance(node, float):
                node = node[2] if row[FEATURES.index(node[0])] <= node[1] else node[3]
            return node

        return np.array([self.base + sum(one(t, r) for t in self.trees) for r in x])


def fit_trees(x: np.ndarray, y: np.ndarray, *, rounds: int = 24, depth: int = 3, rate: float = 0.3, bins: int = 32, leaf: int = 8) -> Trees:
    """Logistic boosting with Newton leaves and quantile cuts."""
    if not len(y) or y.min() == y.max():
        return Trees(-4.0 if not len(y) or y[0] < 0.5 else 4.0, ())
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    base = float(np.log(y.mean() / (1 - y.mean())))
    f, trees = np.full(len(y), base), []

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-6, None)
        if left:
            for j, cs in enumerate(cuts):
                slot = np.searchsorted(cs, x[at, j], side="left")  # value <= cut k exactly when slot <= k
                sg, sh, sn = (np.bincount(slot, w, len(cs) + 1).cumsum()[:-1] for w in (g[at], h[at], None))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain = np.where((sn >= leaf) & (len(at) - sn >= leaf), gain, 0)
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (gain.max(), (j, float(cs[k])))
        if best[1] is None:
            value = float(-rate * total_g / (total_h + 1))
            f[at] += value
            return value
        j, cut = best[1]
        low = x[at, j] <= cut
        return (FEATURES[j], cut, grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(grow(np.arange(len(y)), p - y, p * (1 - p) + 1e-9, depth))
    return Trees(base, tuple(trees))


def fit(x: np.ndarray, y: np.ndarray, sure: np.ndarray) -> Trees:
    """Trees of four fifths of the rows, with the threshold that is best on the fifth; ``sure`` rows are labelled, others weak examples."""
    held = np.arange(len(y)) % 5 == 4
    trees = fit_trees(x[~held], y[~held])
    check = held & sure
    if not check.any() or not trees.trees:
        return trees
    score, blocked = 1 / (1 + np.exp(-trees.predict(x[check]))), y[check] > 0.5
    cuts = np.linspace(0.05, 0.95, 91)
    wrong = np.array([((score > c) != blocked).mean() for c in cuts])
    best = np.flatnonzero(wrong == wrong.min())
    at = best[np.abs(cuts[best] - 0.5).argmin()]
    return Trees(trees.base, trees.trees, float(cuts[at]), float(wrong[at]))


def with_features(df: DataFrame, labelled: DataFrame, smooth: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Both tables with FEATURES; ``labelled`` has ``blocked`` (0 to 1) and ``sure``. Suffix counts cover all sure rows of it.

    A labelled row's own label is left out of its suffix share.
    """
    lab, rows = lexical(labelled), lexical(df)
    sure = F.col("sure")
    stats = lab.groupBy("_suffix").agg(F.count(F.lit(1)).alias("_times"), F.count(F.when(sure, True)).alias("_sn"), F.coalesce(F.sum(F.when(sure, F.col("blocked"))), F.lit(0.0)).alias("_sb"))
    stats = materialize(stats, "suffixes")
    asked = rows.groupBy("_suffix").agg(F.count(F.lit(1)).alias("_times")).join(stats.drop("_times"), "_suffix", "left")
    asked = materialize(asked, "asked")
    prior = 0.5
    rate = lambda n, b: ((b + smooth * prior) / (n + smooth)).alias("suffix_rate")
    n, b = F.coalesce("_sn", F.lit(0)), F.coalesce("_sb", F.lit(0.0))
    own = sure.cast("int")
    drop = ("_suffix", "_sn", "_sb")
    # a suffix may make up a third of all rows: frequent ones are sent to the rows, the others meet by a shuffle
    fit = spread_join(lab, stats, "_suffix", "_times").select("*", rate(n - own, b - own * F.col("blocked"))).drop(*drop)
    use = spread_join(rows, asked, "_suffix", "_times").select("*", rate(n, b)).drop(*drop)
    return fit, use


def learn(labelled: DataFrame, sample_rows: int) -> Trees:
    """Trees of at most ``sample_rows`` rows, those with the smallest hashes, of a table with FEATURES, ``url``, ``blocked`` and ``sure``."""
    picked = labelled.select(F.xxhash64("url").alias("pick"), "blocked", "sure", *FEATURES)
    got = least_picks(picked, labelled.count(), sample_rows).toPandas().sort_values("pick")
    return fit(got[list(FEATURES)].to_numpy(np.float64), got["blocked"].to_numpy(np.float64), got["sure"].to_numpy(bool))


def judge(df: DataFrame, rules: Sequence[Rule], *, url: str = "url", sample_rows: int = 20_000, labelled: DataFrame | None = None, background: float = 0.1) -> DataFrame:
    """``df`` with host, path, rule, verdict and ``block_score`` (of the trees).

    ``labelled`` (columns ``url``, ``blocked``) trains the trees; by default the URLs of ``df`` that a rule decides do, and
    the others as weak examples. The fit takes at most ``sample_rows`` of them. Columns of ``df`` with these names are replaced.
    """
    made = ("host", "path", "rule", "verdict", "block_score")
    own = [c for c in df.columns if c not in made]
    names = {r.name: r.verdict for r in rules}
    text = F.col(url).cast("string")

    def split(t: DataFrame, u: Column) -> DataFrame:
        return t.select("*", host_of(u).alias("host"), path_of(u).alias("path"))

    rows = split(df.select(F.struct(*own).alias("_row"), text.alias("url")), F.col("url"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])[F.col("rule")] if names else F.lit(None).cast("string")
    if labelled is None:
        blocked = F.coalesce((by_rule == "block").cast("double"), F.lit(background))
        labelled = rows.select("url", "host", "path", blocked.alias("blocked"), by_rule.isNotNull().alias("sure"))
    else:
        labelled = split(labelled.select(F.col("url"), F.col("blocked").cast("double"), F.lit(True).alias("sure")).where("blocked is not null"), F.col("url"))
    fitted, use = with_features(rows, labelled)
    trees = learn(fitted, sample_rows)
    score = 1 / (1 + F.exp(-trees.logit()))
    verdict = F.coalesce(by_rule, F.when(score > trees.threshold, "block").otherwise("allow"))
    return use.select(*[F.col("_row")[c].alias(c) for c in own], "host", "path", "rule", verdict.alias("verdict"), score.alias("block_score"))
