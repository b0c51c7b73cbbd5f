"""Text as column expressions: javadoc cleaning, search terms, query sanitising."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a column used n times in an expression is n copies of its tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_javadoc(doc: Column, limit: int = 500) -> Column:
    bare = F.regexp_replace(F.coalesce(doc, F.lit("")), r"/\*\*|\*/", "")
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+", "")))
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), " "), 1, limit)


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def strip(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", "")


#: Fixed values of the sanitiser: what passes as it is, the least and the most that is kept.
SAFE, LEAST, MOST = 200, 10, 250


def _unquoted(text: Column) -> Column:
    """Without pairs of equal quotes around it, then without a single one at either end."""

    def pair(x: Column) -> Column:
        around = (F.length(x) >= 2) & F.substring(x, 1, 1).isin("'", '"') & (F.substring(x, 1, 1) == F.substring(x, -1, 1))
        return F.when(around, strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x)

    # no more pairs than there are quotes and blanks at the front
    front = F.sequence(F.lit(0), F.length(F.regexp_extract(text, r"^[\s\p{Z}'\"]*", 0)))
    inner = F.aggregate(front, strip(text), lambda x, _: pair(x))
    left = let(inner, lambda x: F.when(F.substring(x, 1, 1).isin("'", '"'), strip(F.substring(x, F.lit(2), F.length(x)))).otherwise(x))
    return let(left, lambda x: F.when(F.substring(x, -1, 1).isin("'", '"'), strip(F.substring(x, F.lit(1), F.length(x) - 1))).otherwise(x))


def _trimmed(text: Column) -> Column:
    """Unquoted text of up to MOST characters; of a longer one its last sentence of a fitting length, else its end."""

    def cut(x: Column) -> Column:
        pieces = F.transform(F.filter(F.split(x, r"[.!?。！？\n]+"), lambda f: strip(f) != ""), _unquoted)
        fit = F.filter(pieces, lambda f: F.length(f).between(LEAST, MOST))
        short = let(fit, lambda f: F.coalesce(F.get(f, F.size(f) - 1), strip(F.substring(x, -MOST, MOST))))
        return F.when(F.length(x) <= MOST, x).otherwise(short)

    return let(_unquoted(text), cut)


def sanitize(query: Column) -> Column:
    """struct(query, method, was_sanitized, original_length, clean_length).

    Text of up to SAFE characters passes. Of a longer one: its last line that ends in a question mark, if that has
    LEAST characters (cut only if over MOST); else the last line that has as many after cutting; else the text's end.
    """

    def choose(text: Column) -> Column:
        lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
        said = lambda method, clean: F.struct(clean.alias("query"), F.lit(method).alias("method"))

        def by_line(a: Column) -> Column:
            asked = F.filter(a, lambda x: x.rlike(r"""[?？]\s*["']?\s*$"""))
            question = let(asked, lambda q: F.get(q, F.size(q) - 1))
            cut = F.filter(F.transform(F.filter(a, lambda x: F.length(x) >= LEAST), _trimmed), lambda x: F.length(x) >= LEAST)
            tail = let(cut, lambda c: F.when(F.size(c) > 0, said("tail_sentence", F.get(c, F.size(c) - 1))).otherwise(said("tail_truncation", strip(F.substring(text, -MOST, MOST)))))
            whole = lambda q: F.when(F.length(q) > MOST, _trimmed(q)).otherwise(q)
            return let(question, lambda q: F.when(F.coalesce(F.length(q) >= LEAST, F.lit(False)), said("question_extraction", whole(q))).otherwise(tail))

        return F.when(F.length(text) <= SAFE, said("passthrough", text)).otherwise(let(lines, by_line))

    def whole(raw: Column) -> Column:
        text = let(strip(raw), lambda t: F.when(t == "", raw).otherwise(t))  # what is blank passes as it came
        return let(text, lambda t: let(F.when(strip(t) == "", F.struct(t.alias("query"), F.lit("passthrough").alias("method"))).otherwise(choose(t)), lambda c: F.struct(
            c["query"].alias("query"), c["method"].alias("method"), (c["method"] != "passthrough").alias("was_sanitized"), F.length(t).alias("original_length"), F.length(c["query"]).alias("clean_length")
        )))

    return let(F.coalesce(query, F.lit("")), whole)


#: The longest name and the longest content that are taken.
MOST_NAME, MOST_CONTENT = 128, 100_000


def name_error(value: Column) -> Column:
    """Why a name is not taken, or null."""
    text = strip(value)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.length(text) > MOST_NAME, "too long")
        .when(text.contains("..") | text.contains("/") | text.contains("\\"), "path characters").when(text.contains("\x00"), "null bytes")
    )


def content_error(value: Column) -> Column:
    """Why a content is not taken, or null."""
    return F.when(F.coalesce(strip(value), F.lit("")) == "", "empty").when(F.length(value) > MOST_CONTENT, "too long").when(value.contains("\x00"), "null bytes")
