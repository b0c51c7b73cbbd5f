"""Each stage of the pipeline, and the whole of it, against brute force on rows with planted copies, windows and secrets."""

import base64
import re
from collections import defaultdict

import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from loomgraph.llm import langid, queries
from loomgraph.llm.common import crc_mod

from .test_contracts import ASSIGN, LOWER, SHA, fingerprint

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SECRET = "password = hunter2hunter2 and AKIA" + "A1B2C3D4E5F6G7H8 then " + "0123456789abcdef" * 2


@pytest.fixture(scope="module")
def folder(spark, sf_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text", "lang", "source", "n_chars").collect()
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"
    text = {r.doc_id: r.text for r in docs}
    rows = [tuple(r) for r in docs] + [
        (1000, text[1], "en", "s", 1), (1001, text[2], "en", "s", None), (1002, "so " + bench + " it is", "en", "s", 1), (1003, "here is " + SECRET + " for all of us to see", "en", "s", 1),
        (1004, None, None, None, 7), (1005, "", "en", "s", 0), (1006, "the last of the plain texts, with nothing in it", "en", "s", 1),
    ]
    # names that stages use for themselves
    rows = [(*r, "k", "f", 1, "b") for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, _hit int, spans string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("i", bench), (None, "never there")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def near_copies(rows):
    """Ids to keep: the least of each component."""
    fp, root = {i: fingerprint(r.text) for i, r in rows.items()}, {i: i for i in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for x in fp:
        for y in fp:
            if x < y and (fp[x] ^ fp[y]).bit_count() <= 3:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i for i in rows if find(i) == i}


def contaminated(rows, bench):
    windows = defaultdict(set)
    for r in bench:
        w = WORD.findall((r.text or "").translate(LOWER))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(r.item_id)
    out = set()
    for i, r in rows.items():
        w, hit = WORD.findall((r.text or "").translate(LOWER)), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def strong(t):
    return [m for m in ASSIGN.finditer(t) if len(m[2]) >= 8] + [m for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16] + [m for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given, bench = rows_of(docs), spark.read.parquet(f"{folder}/benchmark.parquet").collect()
    # language: what the model of the training rows rejects goes, rows stay as they are
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    fits = {r.doc_id for r in langid.identify(docs, model).collect() if not r.lang_rejected}
    assert rows_of(cp.identify_language(spark, docs, folder)) == {i: given[i] for i in fits}
    # near copies
    once = near_copies(given)
    assert not {1000, 1001} & once
    assert rows_of(cp.drop_near_copies(spark, docs, folder)) == {i: given[i] for i in once}
    # windows
    bad = contaminated(given, bench)
    assert 1002 in bad and 1006 not in bad
    assert rows_of(cp.drop_contaminated(spark, docs, folder)) == {i: r for i, r in given.items() if i not in bad}
    # secrets
    clean = rows_of(cp.redact_secrets(spark, docs, folder))
    assert set(clean) == set(given) and strong(given[1003].text) and clean[1004] == given[1004]
    assert clean[1006].text == given[1006].text and clean[1003].text.startswith("here is ") and clean[1003].text.endswith(" for all of us to see")
    for i, r in clean.items():
        assert r.text is None or (r.n_chars == len(r.text) and not strong(r.text)), i
        assert {k: v for k, v in r.asDict().items() if k not in ("text", "n_chars")} == {k: v for k, v in given[i].asDict().items() if k not in ("text", "n_chars")}
    # tokens
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    # all of them: each stage on what the one before has kept
    left = {i: given[i] for i in fits}
    left = {i: left[i] for i in near_copies(left)}
    left = set(left) - contaminated(left, bench)
    got = rows_of(cp.run(spark, folder))
    assert set(got) == left
    for i, r in got.items():
        ids = enc.encode_ordinary(clean[i].text or "")
        assert (r.lang, r.source, r.n_tokens, r.ids_sha256, r.decoded_sha256) == (given[i].lang, given[i].source, len(ids), SHA(" ".join(map(str, ids))), SHA(clean[i].text or "")), i


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
