"""Secret scans with multipart credential linking, in Spark expressions only.

Strong spans come from three patterns (an assignment, an access id, a hex run).
Weak candidates -- random-looking tokens, account names, endpoints -- are common
in clean text, so they count only when complementary parts lie within ``reach``
code points of them in the same document: a token needs an id, an account name a
secret, an endpoint both. An endpoint alone completes nothing, and a part never
completes one it overlaps: weak candidates that overlap a strong span, or an
earlier weak one, are left out first, so that a token within an URL is part of the
URL. The interval join is a merge: the parts of a document are ordered by position,
one scan carries the furthest end of each role seen so far, a second scan from the
back the nearest start to come, so no pairs are made. Every document is one row
throughout; nothing is shuffled.

Defined results: null text is empty text and has no spans; positions are code
points, ends exclusive; spans that start together are listed in the order of
KINDS; equal texts have equal spans; texts of any length are scanned whole, in time
that grows with text and matches; an empty table has no rows; extra columns pass
through whatever their names, but those named ``base_spans`` and ``spans`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, group whose length counts, least length); in the order of the listing.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 3, 8),
    "access": (r"AKIA[A-Z0-9]+", 2, 16),
    "hex": (r"[0-9a-f]{32,}", 2, 32),
}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}", 2, 20),
    "user": (r"""(?i:user(?:name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+_.-]+)""", 3, 3),
    "endpoint": (r"""(?:(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x00-\x20"'<>]+|[a-z0-9][a-z0-9-]{0,62}\.[a-z0-9.-]{0,100}amazonaws\.com)""", 2, 8),
}
KINDS = (*STRONG, *WEAK)
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "key": "secret", "user": "id", "endpoint": "endpoint"}
#: weak kind -> roles that must all be near it
NEEDS = {"key": ("id",), "user": ("secret",), "endpoint": ("id", "secret")}

_SPAN = "struct<start: int, ord: int, end: int>"
_NEAR = "struct<start: int, ord: int, end: int, id: boolean, secret: boolean, endpoint: boolean>"
_FAR = 2**30
_CHUNK = 64


def _scanned(items: Column, state: dict[str, Column], step, kind: str) -> Column:
    """What ``step(state, item)`` emits for the items in order: it returns the next state and an array of at most one.

    Emitted items are gathered in chunks, so a step copies at most a chunk and not all before it.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def merge(acc: Column, x: Column) -> Column:
        after, out = step(acc, x)
        full = F.size(acc["_chunk"]) >= _CHUNK
        rest = F.when(full, F.concat(acc["_done"], F.array(acc["_chunk"]))).otherwise(acc["_done"])
        return F.struct(*[after[k].alias(k) for k in state], F.when(full, out).otherwise(F.concat(acc["_chunk"], out)).alias("_chunk"), rest.alias("_done"))

    first = F.struct(*[v.alias(k) for k, v in state.items()], none.alias("_chunk"), nones.alias("_done"))
    return F.aggregate(items, first, merge, lambda acc: F.concat(F.flatten(acc["_done"]), acc["_chunk"]))


def _span(start: Column, order: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), order.alias("ord"), end.alias("end"))


def _maybe(ok: Column, x: Column, kind: str) -> Column:
    return F.when(ok, F.array(x).cast(f"array<{kind}>")).otherwise(F.array().cast(f"array<{kind}>"))


def _matches(text: Column, kind: str) -> Column:
    """Spans of a kind, in order: the gaps before matches and the matches, added up."""
    pattern, group, least = {**STRONG, **WEAK}[kind]
    # \G ties each match to the end of the one before, so the rest after the last match is read once
    scan = rf"(?s)\G(.*?)({pattern})"
    find = lambda g: F.regexp_extract_all(text, F.lit(scan), F.lit(g))
    zipped = F.arrays_zip(find(1).alias("gap"), find(2).alias("hit"), *([find(3).alias("value")] if group == 3 else []))

    def step(acc: Column, x: Column):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        ok = F.length(x["value"] if group == 3 else x["hit"]) >= least
        if kind == "key":  # letters of both cases and a digit: not a word, path or number
            ok = ok & x["hit"].rlike("[a-z]") & x["hit"].rlike("[A-Z]") & x["hit"].rlike("[0-9]")
        return {"pos": end}, _maybe(ok, _span(start, F.lit(KINDS.index(kind)), end), _SPAN)

    found = _scanned(zipped, {"pos": F.lit(0)}, step, _SPAN)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _role(x: Column, role: str) -> Column:
    return x["ord"].isin([i for i, k in enumerate(KINDS) if ROLE[k] == role])


def _apart(parts: Column) -> Column:
    """Sorted parts without the weak ones that overlap a strong one or a weak one before them."""
    strong = lambda x: x["ord"] < len(STRONG)

    def backward(acc: Column, x: Column):
        return {"next": F.when(strong(x), x["start"]).otherwise(acc["next"])}, _maybe(strong(x) | (x["end"] <= acc["next"]), x, _SPAN)

    def forward(acc: Column, x: Column):
        ok = strong(x) | (x["start"] >= acc["end"])
        return {"end": F.when(ok, F.greatest(acc["end"], x["end"])).otherwise(acc["end"])}, _maybe(ok, x, _SPAN)

    clear = _scanned(F.reverse(parts), {"next": F.lit(_FAR)}, backward, _SPAN)
    return _scanned(F.reverse(clear), {"end": F.lit(0)}, forward, _SPAN)


def _linked(parts: Column, reach: int) -> Column:
    """Weak parts with what they need within ``reach``; ``parts`` are sorted by start and no weak one overlaps another."""
    roles = ("id", "secret", "endpoint")

    def forward(acc: Column, x: Column):
        near = F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), *[(acc[r] + reach >= x["start"]).alias(r) for r in roles])
        return {r: F.when(_role(x, r), F.greatest(acc[r], x["end"])).otherwise(acc[r]) for r in roles}, F.array(near).cast(f"array<{_NEAR}>")

    def backward(acc: Column, x: Column):
        near = {r: x[r] | (acc[r] - reach <= x["end"]) for r in roles}
        ok = F.lit(False)
        for kind, needs in NEEDS.items():
            this = x["ord"] == KINDS.index(kind)
            for r in needs:
                this = this & near[r]
            ok = ok | this
        after = {r: F.when(_role(x, r), F.least(acc[r], x["start"])).otherwise(acc[r]) for r in roles}
        return after, _maybe(ok, _span(x["start"], x["ord"], x["end"]), _SPAN)

    seen = _scanned(parts, {r: F.lit(-_FAR) for r in roles}, forward, _NEAR)
    return _scanned(F.reverse(seen), {r: F.lit(_FAR) for r in roles}, backward, _SPAN)


def listing(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["ord"] + 1), x["start"], x["end"])), ",")


def scan(df: DataFrame, *, text: str = "text", reach: int = 300) -> DataFrame:
    """``df`` with ``base_spans`` and ``spans``: arrays of (start, ord in KINDS, end), sorted."""
    keep = [c for c in df.columns if c not in ("base_spans", "spans")]
    # the caller's columns wait in one struct, so none of their names meets one of ours
    out = df.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    out = out.select("*", *[_matches(F.col("t"), k).alias(k) for k in (*STRONG, "user", "endpoint")])
    out = out.withColumn("base_spans", F.sort_array(F.concat(*STRONG)))
    # tokens are searched only where there is something they could complete
    empty = F.array().cast(f"array<{_SPAN}>")
    others = F.size("access") + F.size("user") > 0
    out = out.withColumn("key", F.when(others, _matches(F.col("t"), "key")).otherwise(empty))
    out = out.withColumn("weak", F.when(others, F.concat(*WEAK)).otherwise(empty))
    out = out.withColumn("parts", F.when(F.size("weak") > 0, _apart(F.sort_array(F.concat("base_spans", "weak")))).otherwise(empty))
    out = out.withColumn("spans", F.when(F.size("parts") > F.size("base_spans"), F.sort_array(F.concat("base_spans", _linked(F.col("parts"), reach)))).otherwise(F.col("base_spans")))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], "base_spans", "spans")


def redact(df: DataFrame, *, text: str = "text", mark: str = "[secret]", reach: int = 300) -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark``; overlapping spans become one mark. Null text stays null."""
    found = scan(df.select(F.struct(*df.columns).alias("all"), F.col(text).alias("body")), text="body", reach=reach)
    t = F.col("body")

    def step(acc: Column, s: Column):
        piece = F.concat(F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mark))
        return {"pos": F.greatest(acc["pos"], s["end"])}, _maybe(s["start"] >= acc["pos"], piece, "string")

    done = F.aggregate("spans", F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
    pieces = F.concat(F.array_join(_scanned(F.col("spans"), {"pos": F.lit(0)}, step, "string"), ""), F.substring(t, done + 1, 2**31 - 1))
    clean = F.when(t.isNotNull() & (F.size("spans") > 0), pieces).otherwise(t)
    found = found.select("all", clean.alias("clean"))
    return found.select(*[F.col("clean").alias(c) if c == text else F.col("all")[c].alias(c) for c in df.columns])
