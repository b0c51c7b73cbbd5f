"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, katz, langid, merkle, rollup, secrets, sharding, simhash, sketch, urlfilter, wordbpe
from .common import crc_mod, documents, materialize, scratch_path, spread_join

#: The rules of the URL contract (host, path, verdict).
URL_RULES = (
    urlfilter.Rule("net", "/", "block"),
    urlfilter.Rule("example.net", "/en/", "allow"),
    urlfilter.Rule("example.com", "/de/", "block"),
    urlfilter.Rule("org", "/fr/", "allow"),
)


def tokenizer() -> tuple[str, str]:
    """Vocabulary file and pattern of the byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held))
    out = langid.identify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("base_spans", lambda x: x["ord"] == secrets.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{k}") for k in secrets.STRONG],
        F.sha2(secrets.listing(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.listing(F.col("spans")).alias("spans"),
    )


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.classes(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sketch.with_edits(documents(spark, sf_dir).select("doc_id", "text"))
    got = got.withColumn("edited_sk", sketch.sketch(F.col("edited")))
    return got.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(F.col("sk")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        sketch.resemblance(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents; count them with a second tokenizer version; revise the first version's counts (two
    tokens a document more, for its begin and end); delete later copies of equal texts; commit one batch again.
    """
    t = F.coalesce("text", F.lit(""))
    counted = documents(spark, sf_dir).select("doc_id", "source", "lang", rollup.word_count(F.col("text")).alias("w"), F.ceil(F.octet_length(t) / 4).alias("q"), F.sha2(t, 256).alias("d"))
    docs = materialize(counted, "counted")  # texts are read once
    words, quarter = F.col("w"), F.col("q")
    table = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    table.commit("b1", rollup.inserts(docs, "words-1", words))
    second = rollup.inserts(docs, "bytes4-1", quarter)
    table.commit("b2", second)
    table.commit("b3", rollup.revisions(docs, "words-1", words, words + 2))
    first = materialize(docs.groupBy("d").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")), "first")
    copies = spread_join(docs, first.where("times > 1"), "d", "times").where("doc_id > first")
    gone = rollup.deletes(copies, "words-1", words + 2).unionByName(rollup.deletes(copies, "bytes4-1", quarter))
    table.commit("b4", gone)
    table.commit("b2", second)
    return table.totals()


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard_documents(documents(spark, sf_dir).select("doc_id", "text"), 40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_no")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.withColumn("_b", bpe.digests(spark, F.col("text"), *tokenizer())).select("doc_id", "_b.*")


def op9_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    got = katz.score(docs, crc_mod(F.col("doc_id"), 7) != 2)
    return got.select("doc_id", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontam.contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark)
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 7 divides the id's crc32, the leaf is folded with one more in n_chars, and the proof fails."""
    fields = lambda n_chars: [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    tampered = merkle.leaf(*fields((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")))
    rows = documents(spark, sf_dir).select(
        "doc_id", "lang", merkle.leaf(*fields(F.col("n_chars"))).alias("leaf"), F.when(crc_mod(F.col("doc_id"), 7) == 0, tampered).alias("other")
    )
    got = merkle.manifest(rows, group="lang", order=["doc_id"])
    folded = merkle.fold(F.coalesce("other", "leaf"), F.col("proof"))
    return got.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def word_vocabulary() -> str:
    """Tokenizer file of the BPE with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return docs.withColumn("_b", wordbpe.digests(spark, F.col("text"), word_vocabulary())).select("doc_id", "_b.*")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def queries() -> dict:
    ops = (
        op1_language_id, op2_url_filter, op3_secret_scan, op4_simhash_dedup, op5_document_fingerprints, op6_token_rollup, op7_feistel_shards,
        op8_byte_bpe, op9_katz_scores, op10_decontamination, op11_merkle_manifest, op12_word_bpe, op13_source_divergence,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op6_token_rollup": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op13_source_divergence": OP13_SQL}


OP6_SQL = r"""
with d as (
  select doc_id, source, lang, coalesce(text, '') as t from documents
), c as (
  select doc_id, source, lang,
         case when trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')) = '' then 0
              else len(string_split(trim(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g')), ' ')) end as w,
         cast(ceil(octet_length(encode(t)) / 4.0) as bigint) as q,
         min(doc_id) over (partition by t) as keep
  from d
)
select source, lang, tokenizer, cast(count(*) as bigint) as n_docs, cast(sum(n) as bigint) as n_tokens
from (select source, lang, 'words-1' as tokenizer, w + 2 as n from c where doc_id = keep
      union all
      select source, lang, 'bytes4-1', q from c where doc_id = keep)
group by all
"""

#: FRAME is written out below; the crc goes over the bits of the decimal id.
OP11_SQL = r"""
with recursive f as (
  select doc_id, lang,
         FRAME(doc_id) || FRAME(source) || FRAME(lang) as a, FRAME(n_chars) as n, FRAME((n_chars::hugeint + 1)) as n1, FRAME(text) as z,
         coalesce(doc_id::varchar, '') as s
  from documents
), bits as (
  select *, list_prepend(4294967295::bigint, [((ascii(s[k // 8 + 1]) >> (k % 8)) & 1)::bigint for k in range(8 * length(s))]) as b from f
), leaves as (
  select doc_id, lang, sha256(a || n || z) as leaf, sha256(a || n1 || z) as other,
         xor(list_reduce(b, lambda c, x: xor(c >> 1, case when xor(c, x) & 1 = 1 then 3988292384 else 0 end)), 4294967295) % 7 = 0 as tampered,
         coalesce('l' || lang, '') as g
  from bits
), l as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by g) as m from leaves
), t as (
  select g, 0 as level, i, m, leaf as h from l
  union all
  select g, level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' order by i)) from t where m > 1 group by g, level, i // 2, m
), r as (
  select g, h, row_number() over (order by g) - 1 as i, count(*) over () as m from t where m = 1
), u as (
  select 0 as level, i, m, h from r
  union all
  select level + 1, i // 2, (m + 1) // 2, sha256(string_agg(h, '' order by i)) from u where m > 1 group by level, i // 2, m
), near as (
  select l.g, l.i, t.level, t.h from l join t on t.g = l.g and t.i = xor(l.i >> t.level, 1)
  union all
  select l.g, l.i, 100 + u.level, u.h from l join r on r.g = l.g join u on u.i = xor(r.i >> u.level, 1)
), proofs as (
  select g, i, string_agg(h, '' order by level) as p from near group by g, i
), fold as (
  select g, i as leaf_no, 0 as level, i, m, case when tampered then coalesce(other, leaf) else leaf end as h from l
  union all
  select f.g, leaf_no, f.level + 1, f.i // 2, (f.m + 1) // 2,
         sha256(case when f.i % 2 = 1 then t.h || f.h else f.h || coalesce(t.h, '') end)
  from fold f left join t on t.g = f.g and t.level = f.level and t.i = xor(f.i, 1)
  where f.m > 1
), fold_top as (
  select f.g, f.leaf_no, 0 as level, r.i, r.m, f.h from fold f join r on r.g = f.g where f.m = 1
  union all
  select f.g, leaf_no, f.level + 1, f.i // 2, (f.m + 1) // 2,
         sha256(case when f.i % 2 = 1 then u.h || f.h else f.h || coalesce(u.h, '') end)
  from fold_top f left join u on u.level = f.level and u.i = xor(f.i, 1)
  where f.m > 1
)
select l.doc_id, l.leaf, r.h as subroot, root.h as root, sha256(coalesce(p, '')) as proof_sha256, e.h as folded_root, e.h = root.h as verified
from l join r on r.g = l.g
join (select h from u where m = 1) root on true
join (select g, leaf_no, h from fold_top where m = 1) e on e.g = l.g and e.leaf_no = l.i
left join proofs on proofs.g = l.g and proofs.i = l.i
"""
OP11_SQL = re.sub(r"FRAME(\((?:[^()]|\([^()]*\))*\))", r"case when \1 is null then '-' else strlen(\1::varchar) || ':' || \1 end", OP11_SQL)

#: Every pair of sources over every kept term, absent ones too.
OP13_SQL = r"""
with d as (
  select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
), t as (
  select id, lang, source, unnest(w) as term from d
), kept as (
  select lang, term from t group by lang, term having count(distinct id) >= 3
), v as (
  select lang, count(*) as v from kept group by lang
), n as (
  select lang, source, term, count(*) as c from t join kept using (lang, term) group by lang, source, term
), g as (
  select distinct lang, source from d
), gt as (
  select g.lang, g.source, coalesce(sum(n.c), 0)::hugeint as total from g left join n using (lang, source) group by g.lang, g.source
), p as (
  select gt.lang, gt.source, kept.term, coalesce(n.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(n.c, 0) + 1)) // (total + v.v) as p
  from gt join kept using (lang) join v using (lang) left join n using (lang, source, term)
), lt as (
  select lang, sum(total)::hugeint as total from gt group by lang
), q as (
  select n.lang, n.term, 1 + (1000000000::hugeint * (sum(n.c) + 1)::hugeint) // (any_value(lt.total) + any_value(v.v)) as q
  from n join lt using (lang) join v using (lang) group by n.lang, n.term
), sums as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sums.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join sums on sums.lang = a.lang and sums.source = a.source and sums.item = b.source
), terms as (
  select p.lang, p.source, 'term' as part, p.term as item, ((p.p - q.q) * (p.p - q.q) // q.q)::bigint as value
  from p join q using (lang, term) where p.c > 0 and p.p > q.q
)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from (select * from pairs union all select * from terms)
qualify part = 'pair' or rank <= 200
"""
