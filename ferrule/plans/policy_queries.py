"""Queries on token policies, eligibility, evidence and banks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import banks, evidence, policies
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t

_TOKENS = "tok as (select p_partkey // 20 q, p_partkey % 4 page, p_partkey token, (p_size * 7 % 50) / 50.0::double literal, p_size / 50.0::double aggregate from part)"


@query(f"""with {_TOKENS}, n as (select *, aggregate >= 0.6 nat, aggregate = 0.6 tie, count(*) filter (aggregate >= 0.6) over (partition by q) b, row_number() over (partition by q order by aggregate desc, token) ra, row_number() over (partition by q order by literal desc, token) rl,
row_number() over (partition by q order by sha256('s|global-uniform-random|' || q || '|' || token), token) rr from tok), g as (select *, count(*) filter (ra <= b) over (partition by q, page) pb, row_number() over (partition by q, page order by sha256('s|page-stratified-random|' || q || '|' || token), token) rp from n),
k as (select q, token, nat, tie, unnest([{{'p': 'no-ctp', 'k': true}}, {{'p': 'literal-threshold', 'k': literal >= 0.6}}, {{'p': 'aggregate-threshold', 'k': nat}}, {{'p': 'literal-score-top-m', 'k': rl <= b}}, {{'p': 'aggregate-score-top-m', 'k': ra <= b}}, {{'p': 'global-uniform-random', 'k': rr <= b}}, {{'p': 'page-stratified-random', 'k': rp <= pb}}]) x from g)
select q, x.p "policy", count(*) population, count(*) filter (x.k) kept, count(*) filter (tie) tied, list_sort(coalesce(list(token) filter (x.k <> nat), [])) difference from k group by 1, 2""")
def policy_selections(spark, d):
    """Every policy at one boundary, ties with the threshold, and differences from the native selection."""
    p = _t(spark, d, "part")
    t = p.select(F.floor(F.col("p_partkey") / 20).alias("q"), (F.col("p_partkey") % 4).alias("page"), F.col("p_partkey").alias("token"), (F.col("p_size") * 7 % 50 / 50.0).alias("literal"), (F.col("p_size") / 50.0).alias("aggregate"))
    return policies.selection_records(policies.selected(t, ["q"], [x.value for x in policies.Policy], 0.6, "s"), ["q"])


@query("""with l as (select l_orderkey q, list(l_partkey order by l_linenumber, l_partkey, l_suppkey) p, list(l_partkey * 10 + l_suppkey % 10 order by l_linenumber, l_partkey, l_suppkey) pp, list(l_suppkey % 50) s from lineitem group by 1),
r as (select q, list_sort(list_filter([case when len(p) <> 4 then 'four pages' end, case when len(list_distinct(pp)) <> len(pp) then 'different pages' end, case when q % 11 = 0 then 'features in line' end, case when len(list_distinct(s)) <> len(s) then 'distinct supports' end, case when q % 5 = 0 then 'one hop' end, case when q % 7 = 0 then 'not in development' end], lambda x: x is not null)) f from l)
select q qid, f failures, len(f) = 0 eligible from r""")
def eligibility(spark, d):
    """Which questions are eligible, and what the others fail."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    page = lambda shift: F.transform("x", lambda i: F.struct(i["l_partkey"].cast("string").alias("document"), (i["l_suppkey"] % 10 + shift).alias("page")))
    q = g.select("qid", F.when(F.col("qid") % 5 == 0, "multi_hop").otherwise("single_hop").alias("type"), F.transform("x", lambda i: (i["l_suppkey"] % 50).cast("string")).alias("supports"), page(F.lit(0)).alias("pages"), page(F.when(F.col("qid") % 11 == 0, 1).otherwise(0)).alias("features"))
    return policies.eligible(q, g.where("qid % 7 = 0").select("qid"))


@query()
def evidence_places(spark, d):
    """Where turns of conversations stand among their pages, preferring pages already retrieved; checked by tests."""
    c = _t(spark, d, "conversations").where("text is not null")
    pages = c.select(F.col("conv_id").alias("document"), F.col("turn").alias("page"), "text")
    first = c.where("turn = 0").select("conv_id", F.regexp_extract("text", r"^[^.!?\n]*", 0).alias("title"))
    passages = c.join(first, "conv_id").select(F.concat_ws("-", "conv_id", "turn").alias("question"), F.col("conv_id").alias("document"), "title", "text")
    retrieved = c.where("turn = 1").select(F.concat_ws("-", "conv_id", "turn").alias("question"), F.col("conv_id").alias("document"), F.col("turn").alias("page"))
    return evidence.located(passages, pages, retrieved)


@query()
def mask_banks(spark, d):
    """Banks of masks of equal cost by question; checked by tests."""
    p = _t(spark, d, "part")
    return banks.banks(p.select(F.floor(F.col("p_partkey") / 20).alias("question"), F.col("p_partkey").alias("region"), (F.col("p_size") % 9 + 1).alias("cost"), F.col("p_retailprice").alias("priority")))


@query("""select c_nationkey document, arg_max(height, [n, -f]) height, arg_max(width, [n, -f]) width from (select c_nationkey, c_custkey % 3 + 10 height, c_custkey % 2 + 20 width, count(*) n, min(c_custkey) f from customer group by 1, 2, 3) group by 1""")
def modal_page_sizes(spark, d):
    """The commonest page size of each document."""
    k = F.col("c_custkey")
    return evidence.modal_sizes(_t(spark, d, "customer").select(F.col("c_nationkey").alias("document"), k.alias("page"), (k % 3 + 10).alias("height"), (k % 2 + 20).alias("width")))


def _pictures(spark, d):
    """Pictures of 8 x 8 or 4 x 16 pixels from vectors, every fourth one turned."""
    e = _t(spark, d, "embeddings").where("embedding is not null and size(embedding) >= 64")
    grey = F.transform(F.slice("embedding", 1, 64), lambda x: F.least(F.greatest(F.round(127 + 400 * F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0))), F.lit(0.0)), F.lit(255.0)).cast("int"))
    # A quarter turn of 8 x 8 pixels: the pixel at (y, x) comes from (x, 7 - y).
    turned = F.transform("grey", lambda _, i: F.get(F.col("grey"), ((i % 8) * 8 + 7 - F.floor(i / 8)).cast("int")))
    k = F.col("vec_id")
    rows = e.select(k, grey.alias("grey")).select(k, F.when(k % 4 == 1, turned).otherwise(F.col("grey")).alias("grey"))
    rgb = F.unhex(F.array_join(F.transform("grey", lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3))), ""))
    flat = k % 5 == 4
    return rows.select(k.alias("picture"), F.when(flat, 4).otherwise(8).alias("height"), F.when(flat, 16).otherwise(8).alias("width"), rgb.alias("rgb"))


@query()
def picture_matches(spark, d):
    """C20: pictures of every 20th vector found among all pictures, whatever way they are turned; checked by tests against all pairs."""
    p = _pictures(spark, d)
    return evidence.picture_pairs(p.where("picture % 20 = 0"), p)
