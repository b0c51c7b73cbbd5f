"""The word-end BPE against the tokenizers library: given documents, odd characters, long words, special tokens."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import queries, wordbpe

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def both():
    path = queries.word_vocabulary()
    with open(path, "rb") as f:
        return wordbpe.WordCodec(f.read()), Tokenizer.from_file(path)


def agree(both, texts):
    own, library = both
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert list(own.encode_all(texts)) == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_odd_characters(both):
    draw = random.Random(7)
    some = [0x41, 0x61, 0x20, 0x27, 0x73, 0x130, 0x3A3, 0x3C2, 0x300, 0x301, 0xE9, 0x1F600, 0x4E00, 0xAC00, 0x1100, 0x1161, 0x11A8, 0x1C89, 0xA7CB, 9, 0x1C, 0x85, 0xA0, 0x1E9E, 0x212B, 0x31, 0x661, 0x2F, 0xDF, 0]
    anything = lambda: next(c for c in iter(lambda: draw.randrange(0x110000), None) if not 0xD800 <= c < 0xE000)
    agree(both, ["".join(chr(draw.choice(some) if draw.random() < 0.8 else anything()) for _ in range(draw.randrange(60))) for _ in range(3000)])


def test_long_words_and_special_tokens(both):
    draw = random.Random(3)
    letters = "".join(draw.choice("abcdefghijklmnop") for _ in range(20_000))
    agree(both, ["a" * 5001, "ab" * 4000, letters, "日本語" * 1000, "!" * 3000, "x<|startoftext|><|endoftext|>Y <|Endoftext|> <|endoftext", "", "aaa" * 100 + "<|endoftext|>"])


def test_memory_starts_anew(both, monkeypatch):
    monkeypatch.setattr(wordbpe, "KEPT_BYTES", 40)
    own, library = both
    texts = ["some words here", "and others there", "some words again", "<|endoftext|> words"]
    one_by_one = [next(iter(own.encode_all([t]))) for t in texts]
    assert one_by_one == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x[0] for x in own.show_all(texts)] == [len(x) for x in one_by_one]


def test_a_pair_before_its_own_symbol():
    """The merged symbol ``ab`` also arises from an earlier pair, and takes part in a pair of lower rank than (a, b): one place at a time."""
    letters = wordbpe.byte_letters()
    vocab = {s: i for i, s in enumerate([*letters, *[c + "</w>" for c in letters]])}
    merges = []
    for a, b in (("ab", "a"), ("a", "b")):
        merges.append([a, b])
        for s in (a, b, a + b):
            vocab.setdefault(s, len(vocab))
    spec = json.load(open(queries.word_vocabulary()))
    spec["model"] |= {"vocab": vocab, "merges": merges}
    spec["added_tokens"] = []
    raw = json.dumps(spec)
    own, library = wordbpe.WordCodec(raw.encode()), Tokenizer.from_str(raw)
    assert own.single.any()
    texts = ["ababab", "aabab", "abab" * 200, "ab" * 129]
    assert list(own.encode_all(texts)) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_files_are_refused():
    with pytest.raises((ValueError, KeyError, TypeError)):
        wordbpe.WordCodec(b'{"model": {"type": "Unigram", "unk_token": null, "continuing_subword_prefix": null}, "normalizer": {"normalizers": []}, "pre_tokenizer": {"pretokenizers": []}, "decoder": null}')


def test_query(spark, sf_dir, tmp_path, both):
    library = both[1]
    odd = [(1, None), (2, ""), (3, "Same text"), (3, "Same text"), (4, "long " * 30_000), (None, "no id")]
    spark.createDataFrame([(d, t, "k", 1) for d, t in odd], "doc_id long, text string, ids string, _b int").write.parquet(f"{tmp_path}/documents.parquet")
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for d, rows in ((sf_dir, given), (str(tmp_path), odd)):
        want = []
        for i, t in rows:
            e = library.encode(t or "", add_special_tokens=False).ids
            want.append((i, len(e), SHA(" ".join(map(str, e))), SHA(library.decode(e, skip_special_tokens=False))))
        got = [tuple(r) for r in queries.op12_word_bpe(spark, d).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_round_trip_of_columns(spark):
    df = spark.createDataFrame([("Hello World",), (None,)], "text string")
    path = queries.word_vocabulary()
    got = df.select(wordbpe.encoder(spark, path)(F.col("text")).alias("ids")).select("ids", wordbpe.decoder(spark, path)(F.col("ids")).alias("back")).collect()
    assert sorted(r.back for r in got) == ["", "hello</w> world</w>"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string")
    assert df.select(wordbpe.digests(spark, F.col("text"), queries.word_vocabulary())).collect() == []
