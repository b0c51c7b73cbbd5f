"""Fuzzy terms match whatever is that many edits away, at the first letter too."""

import random

from loomgraph.operators import search


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_first_letter(spark):
    d = spark.createDataFrame([("class", x, x) for x in ("auth", "outh", "uth", "user", "oauth", "other")], "type string, key string, name string")
    q = spark.createDataFrame([(1, "%auth%1"), (2, "%ser%1"), (3, "oth*")], "query_id long, query string")
    got = {}
    for r in search.fts_search(search.postings(d, {"name": 10.0}), q).collect():
        got.setdefault(r.query_id, set()).add(r.key)
    assert got == {1: {"auth", "outh", "uth", "oauth"}, 2: {"user"}, 3: {"other"}}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9)))
    terms = sorted({word() for _ in range(300)})
    asked = [(i, word(), rnd.randint(0, 4)) for i in range(80)]
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    q = spark.createDataFrame(asked, "query_id long, q string, edits int")
    got = {(r.query_id, r.term) for r in search.within_edits(t, q).collect()}
    assert got == {(i, x) for i, w, k in asked for x in terms if edits(w, x) <= k}
