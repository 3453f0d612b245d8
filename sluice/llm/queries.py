"""The queries of the training-text operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import ann, chat, fingerprints, language_id, mixing, ngram_join, packing, substring_dedup, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def remainder(column: str, n: int):
    return F.crc32(F.col(column).cast("string")) % n


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(remainder("doc_id", 3) != 1)
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), n=3, threshold=Fraction(90, 100))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = language_id.identify(docs.drop("lang"), docs.where(remainder("doc_id", 5) != 0))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest(chat.expand(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    mixed = mixing.mix(docs, target_entropy_share=0.97, most_repeats=4.0)
    return mixed.select("doc_id", "source", "mix_tokens", "mix_epoch", "mix_block", "mix_order")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), window=35)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


_WORD = r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op4_ngram_jaccard_join": f"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents
), s as (
  select distinct doc_id, case when len(w) >= 3 then w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] else array_to_string(w, ' ') end as g
  from d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as u(i) where len(w) > 0
), n as (select doc_id, count(*) as n from s group by 1
), p as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id < y.doc_id group by all
), l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 90 * (x.n + y.n - o)
), e as (select a, b from l union all select b, a from l
), r as (select doc_id, doc_id as reached from documents union select r.doc_id, e.b from r join e on e.a = r.reached)
select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(reached) as component_id from r left join n using (doc_id) group by r.doc_id""",
    "op7_chat_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, row_number() over w as n, count(*) over (partition by conv_id) as turns,
    20 + length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) as written
  from t window w as (partition by conv_id order by turn, role, text)
), c as (select *, sum(written) over (partition by conv_id order by n) as upto from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  (coalesce(sum(upto) filter (role = 'assistant'), 0) + coalesce(sum(upto) filter (n = turns and role <> 'assistant'), 0))::bigint as formatted_chars
from c group by conv_id""",
    "op10_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents
), s as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) as h from d, unnest(range(1, greatest(len(w) - 34, 0) + 1)) as u(i)
), r as (select doc_id, i from s where h in (select h from s group by h having count(*) > 1)
), p as (select doc_id, i, w[i] as word, r.i is not null as starts from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d) left join r using (doc_id, i)
), c as (select *, coalesce(max(case when starts then i end) over (partition by doc_id order by i rows between 34 preceding and current row), 0) > 0 as gone from p
), k as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from c group by doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents left join k using (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
