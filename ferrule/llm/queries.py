"""The operators of this subpackage as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import bpe, decontaminate, embedding_dedup, fill_middle, html_text, lexical_search, licenses, ngram_join, quality, sentencepiece_bpe, substring_dedup, toxicity, warc
from ferrule.llm._common import read_table


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(
        read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.jaccard_groups(read_table(spark, sf_dir, "documents"), n=3, percent=90)
    return groups.select("doc_id", "n_shingles", "component_id")


OP4_SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
g as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) s
  from w),
n as (select doc_id, count(*) n from g group by 1),
o as (select a.doc_id x, b.doc_id y, count(*) c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as materialized (
  select x, y from o join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
r(id, c) as (select doc_id, doc_id from w union select e.y, r.c from r join e on e.x = r.id)
select r.id doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(r.c) component_id
from r left join n on n.doc_id = r.id group by r.id
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = warc.capture_history(read_table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32_SQL = " || ".join(
    f"substr('{warc.BASE32}', (((('0x' || substr(d, {5 * g + 1}, 5))::int) >> {15 - 5 * j}) & 31) + 1, 1)" for g in range(8) for j in range(4)
)

OP5_SQL = f"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d from pages),
q as (select page_id, strlen(h) n, {_BASE32_SQL} digest, min(page_id) over (partition by h) first from p)
select page_id, n::bigint payload_bytes, digest payload_digest,
       case when page_id = first then 'response' else 'revisit' end record_type,
       case when page_id <> first then first end refers_to
from q
"""


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), cosine=0.9)


OP1_SQL = """
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, len(e) d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) e from v where list_dot_product(e, e) > 0),
l as materialized (select a.vec_id x, b.vec_id y from u a join u b on a.vec_id <> b.vec_id and a.d = b.d where list_dot_product(a.e, b.e) >= 0.9),
r(id, c) as (select vec_id, vec_id from embeddings union select l.y, r.c from r join l on l.x = r.id),
n as (select x, count(*) n from l group by 1)
select id vec_id, coalesce(any_value(n.n), 0)::bigint n_links, min(c) component_id, id = min(c) kept
from r left join n on n.x = r.id group by id
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(read_table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP12_SQL = """
with t as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) t from documents where text is not null),
q as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) t from benchmark where text is not null),
d as (select doc_id, count(*) n from t group by 1),
c as (select count(*) docs, sum(n)::bigint words from d),
m as (select doc_id, 25 + (75 * n * docs) // words m from d, c),
p as (select t, doc_id, count(*) tf from t where t in (select t from q) group by 1, 2),
w as (select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint w from p, c group by 1),
s as (select item_id, doc_id, sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
      from (select item_id, t, count(*) r from q group by 1, 2) join p using (t) join w using (t) join m using (doc_id) group by 1, 2),
k as (select *, row_number() over (partition by item_id order by score desc, doc_id) "rank" from s where score > 0)
select item_id, "rank"::int "rank", doc_id, score from k where "rank" <= 10
"""


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read_table(spark, sf_dir, "documents"))


OP13_SQL = """
with t as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u, sha256('1:' || doc_id) h from documents),
d as (select *, len(u) n, list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(h, 8 * k + 1, 8))::bigint) r from t),
c as (select *, case when t = '' or regexp_matches(t, '<[PSM]>') or r[3] % 100 >= 90 then 'plain' when r[4] % 100 < 20 then 'spm' else 'psm' end form,
    least(r[1] % (n + 1), r[2] % (n + 1)) a, greatest(r[1] % (n + 1), r[2] % (n + 1)) b from d),
x as (select *, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(p) end::bigint prefix_chars, case when form <> 'plain' then length(m) end::bigint middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256, sha256(t) restored_sha256
from x
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_html_text": op3_html_text,
    "op4_ngram_join": op4_ngram_join,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_licenses": op9_licenses,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_lexical_search": op12_lexical_search,
    "op13_fill_middle": op13_fill_middle,
}

ORACLES: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op4_ngram_join": OP4_SQL, "op5_warc": OP5_SQL, "op12_lexical_search": OP12_SQL, "op13_fill_middle": OP13_SQL}
