"""The Merkle manifest against trees built one level at a time, with small units so that every kind of edge occurs."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from loomgraph.llm import merkle, queries

H = lambda *s: sha256("".join(s).encode()).hexdigest()


def framed(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def climb(nodes):
    """Root, and of each leaf its siblings."""
    where, paths = [[k] for k in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        for k, own in enumerate(where):
            if k ^ 1 < len(nodes):
                for leaf in own:
                    paths[leaf].append((k & 1, nodes[k ^ 1]))
            else:
                for leaf in own:
                    paths[leaf].append((0, ""))
        nodes = [H(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        where = [sum(where[k : k + 2], []) for k in range(0, len(where), 2)]
    return nodes[0], paths


def fold(leaf, path):
    for side, s in path:
        leaf = H(s, leaf) if side else H(leaf, s)
    return leaf


def brute(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for i, t, g, s, n in rows:
        groups[g].append((i is not None, i or 0, H(framed(i, s, g, n, t)), (i, t, g, s, n)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {}
    for g in names:
        groups[g].sort(key=lambda r: r[:3])
        own[g] = climb([r[2] for r in groups[g]])
    root, over = climb([own[g][0] for g in names]) if names else (None, [])
    out = []
    for k, g in enumerate(names):
        for (_, _, leaf, (i, t, _, s, n)), path in zip(groups[g], own[g][1]):
            path = path + over[k]
            bad = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 0
            folded = fold(H(framed(i, s, g, None if n is None else n + 1, t)) if bad else leaf, path)
            out.append((i, leaf, own[g][0], root, H(*[x for _, x in path]), folded, folded == root))
    return sorted(out, key=str)


def check(spark, folder, rows):
    got = queries.op11_merkle_manifest(spark, folder)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("unit,step", [(13, 12), (2, 2)])
def test_given_documents(spark, sf_dir, monkeypatch, unit, step):
    monkeypatch.setattr(merkle.manifest, "__kwdefaults__", merkle.manifest.__kwdefaults__ | {"unit": unit, "step": step})
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(spark, sf_dir, rows)


def test_odd_rows(spark, tmp_path):
    rows = [
        (None, None, None, None, None), (7, "a", None, "s", 1), (7, "a", None, "s", 1), (7, "b", None, "s", None), (2**62, "x" * 100_000, "", "", 2**63 - 1),
        (-5, "é😀", "zz", "s:1", 0), (0, "", "é", None, -1), *[(k, "same", "hot", "s", k) for k in range(70)],
    ]
    spark.createDataFrame([(*r, "root", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, root string, _h int").write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), rows)


def test_empty_and_single(spark, tmp_path):
    for name, rows in (("none", []), ("one", [(1, "t", "en", "s", 1)])):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        check(spark, f"{tmp_path}/{name}", rows)


def test_offsets_of_groups_over_partitions():
    """a a | a b c | c c | c: c has four leaves in three partitions."""
    parts = {0: "aa", 1: "abc", 3: "cc", 4: "c"}
    counts = [x for p, s in parts.items() for x in merkle._counted(p, [(g, "", None) for g in s])]
    assert merkle._offsets(counts) == {0: (0, 3, 3), 1: (2, 3, 4), 3: (1, 4, 4), 4: (3, 4, 4)}


def test_caller_columns(spark):
    df = spark.createDataFrame([(k, f"g{k % 3}", H(str(k)), {"a": k}) for k in range(20)], "proof int, _row string, leaf string, m map<string,int>")
    got = merkle.manifest(df, group="_row", order=["leaf"])
    assert got.columns == ["_row", "leaf", "m", "subroot", "root", "proof"]
    rows = got.select("m", merkle.fold(got.leaf, got.proof).alias("f"), "root").collect()
    assert len(rows) == 20 and all(r.f == r.root for r in rows) and sorted(r.m["a"] for r in rows) == list(range(20))
