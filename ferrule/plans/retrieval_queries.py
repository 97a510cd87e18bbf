"""Queries on retrieval: vec_ids divisible by 20 are query tokens, their label the question, five rows a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import vectors
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t

_Q = "q as (select label q, vec_id t, embedding::double[] qv from embeddings where vec_id % 20 = 0), r as (select vec_id id, vec_id // 5 page, embedding::double[] v from embeddings)"
_K = "s as (select q, t, id, page, list_dot_product(qv, v) score from q, r), k as (select *, row_number() over (partition by q, t order by score desc, id) rank from s)"


def _tokens(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("label").alias("q"), F.col("vec_id").alias("t"), F.col("embedding").alias("qv"))
    return q, e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 5).alias("page"), F.col("embedding").alias("v"))


@query(f"with {_Q}, {_K} select q, t, id, page, rank, round(score, 6) score from k where rank <= 4")
def token_knn(spark, d):
    """Exact k-NN of query tokens by inner product."""
    return vectors.knn(*_tokens(spark, d), 4).select("q", "t", "id", "page", "rank", F.round("score", 6).alias("score"))


@query(f"with {_Q}, {_K}, m as (select q, t, page, max(score) s from k where rank <= 4 group by 1, 2, 3) select q, page, round(sum(s), 6) score from m group by 1, 2")
def indexed_maxsim(spark, d):
    """H2: MaxSim over the hits of each token."""
    return vectors.indexed_maxsim(vectors.knn(*_tokens(spark, d), 4)).select("q", "page", F.round("score", 6).alias("score"))


@query(f"""with {_Q}, {_K}, m as (select q, t, page, max(score) s from k where rank <= 4 group by 1, 2, 3), p as (select q, page, round(sum(s), 6) score from m group by 1, 2)
select q, page, score, n page_rank from (select *, row_number() over (partition by q order by score desc, page) - 1 n, count(*) over (partition by q) c from p) where n < 2""")
def retrieved_pages(spark, d):
    """The best pages of each question; too few are an error."""
    p = vectors.indexed_maxsim(vectors.knn(*_tokens(spark, d), 4)).withColumn("score", F.round("score", 6))
    return vectors.top_pages(p, 2).select("q", "page", "score", "page_rank")


@query(f"with {_Q}, m as (select q, t, page, max(list_dot_product(qv, v)) s, max(list_dot_product(qv, v)) filter (id % 5 < 3) i from q, r group by 1, 2, 3) select q, page, round(sum(s), 6) score, round(sum(i), 6) image_score from m group by 1, 2")
def full_maxsim(spark, d):
    """H3: MaxSim over all rows, and over image tokens (the first three of a page) only."""
    q, r = _tokens(spark, d)
    whole, image = vectors.full_maxsim(q, r), vectors.full_maxsim(q, r, F.col("id") % 5 < 3)
    return whole.join(image.withColumnRenamed("score", "image_score"), ["q", "page"], "left").select("q", "page", F.round("score", 6).alias("score"), F.round("image_score", 6).alias("image_score"))


@query("""with q as (select embedding::double[] qv from embeddings where vec_id % 20 = 0)
select vec_id, round(sum(case when sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(qv, qv)) = 0 then 0 else list_dot_product(embedding::double[], qv) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(qv, qv))) end), 6) relevance
from embeddings, q group by 1""")
def cosine_relevance(spark, d):
    """H5: summed cosine with the query tokens."""
    return vectors.cosine_relevance(*_tokens(spark, d)).select(F.col("id").alias("vec_id"), F.round("relevance", 6).alias("relevance"))


@query(f"with {_Q}, {_K}, h as (select q, page, min(t * 10 + rank) f from k where rank <= 4 group by 1, 2) select q, page, row_number() over (partition by q order by f, page) - 1 place from h")
def unique_pages(spark, d):
    """H4: pages once each, in the order of their first hit."""
    hits = vectors.knn(*_tokens(spark, d), 4).withColumn("o", F.col("t") * 10 + F.col("rank"))
    return vectors.unique_pages(hits, ["q"], "page", "o").select("q", "page", "place")


_PROFILE = """pro as (select l_suppkey page, l_linenumber region, l_orderkey % 6 q, case l_orderkey % 6 when 0 then 'lexical' when 1 then 'lexical' when 2 then 'augmentation' else 'focus' end kind, max(l_discount * 10 + l_tax) score from lineitem group by 1, 2, 3, 4),
prc as (select *, region + 1.0 cost from pro)"""


def _profiles(spark, d):
    kind = F.when(F.col("q") < 2, "lexical").when(F.col("q") == 2, "augmentation").otherwise("focus")
    p = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("page"), F.col("l_linenumber").alias("region"), (F.col("l_orderkey") % 6).alias("q")).agg(F.max(F.col("l_discount") * 10 + F.col("l_tax")).alias("score"))
    return p.withColumn("kind", kind).withColumn("cost", F.col("region") + 1.0)


@query(f"""with {_PROFILE}, w as (select *, row_number() over (partition by page, region order by score desc, q) n, case when row_number() over b = 1 then score - coalesce(lead(score) over b, 0) else 0 end l from prc window b as (partition by page, q order by score desc, region))
select page, region, round(sum(score), 6) "all", round(coalesce(sum(score) filter (kind = 'lexical'), 0), 6) lexical, round(coalesce(sum(score) filter (kind = 'augmentation'), 0), 6) augmentation, round(coalesce(sum(score) filter (kind = 'focus'), 0), 6) focus,
round(avg(score), 6) mean, round(avg(score) filter (n <= 3), 6) top_three, round(sum(score) / max(cost), 6) per_cost, round(sum(l), 6) exclusive from w group by 1, 2""")
def region_priorities(spark, d):
    """The family of region priorities."""
    p = vectors.priorities(_profiles(spark, d))
    return p.select("page", "region", *[F.round(c, 6).alias(c) for c in p.columns[2:]])


@query(f"""with {_PROFILE}, m as (select page, mask, region, (page + mask + region) % 3 > 0 kept from (select distinct page, region from pro), range(4) r(mask)), k as (select m.page, mask, q, max(score) s from m join pro using (page, region) where kept group by 1, 2, 3),
n as (select page, count(distinct q) n from pro group by 1) select m.page, m.mask::int mask, round(coalesce(s, 0) / n, 6) coverage from (select distinct page, mask from m) m join n using (page) left join (select page, mask, sum(s) s from k group by 1, 2) k using (page, mask)""")
def bank_coverage(spark, d):
    """Coverage of masks over a fixed bank of query tokens."""
    p = _profiles(spark, d)
    m = p.select("page", "region").distinct().withColumn("mask", F.explode(F.array(*[F.lit(i) for i in range(4)]))).withColumn("kept", (F.col("page") + F.col("mask") + F.col("region")) % 3 > 0)
    return vectors.mask_coverage(p, m).select("page", "mask", F.round("coverage", 6).alias("coverage"))


@query("""with a as (select vec_id k, embedding::double[] v from embeddings), b as (select vec_id k, list_transform(embedding::double[], lambda x: round(x, 2)) v from embeddings where vec_id % 100 > 0),
j as (select a.v x, b.v y from a full join b using (k)), g as (select x, y, list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2])) g from j where x is not null and y is not null)
select round(max(list_max(g)), 9) most, round(sum(list_sum(g)) / sum(len(g)), 9) mean, round(min(list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y))), 9) least_cosine, round(avg(list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y))), 9) mean_cosine, (select count(*) from j where x is null or y is null) unmatched from g""")
def vector_parity(spark, d):
    """How far two tables of vectors differ."""
    a = _t(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = a.where("k % 100 > 0").withColumn("v", F.transform("v", lambda x: F.round(x, 2)))
    p = vectors.parity(a, b, "k", "v")
    return p.select(*[F.round(c, 9).alias(c) for c in p.columns[:4]], "unmatched")
