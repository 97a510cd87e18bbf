"""Queries on budgeted selection, samples, masks, cohorts and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import labels
from ferrule.operators import cohorts, graph, selection
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t


def _items(spark, d):
    """Orders' lines as arrays: costs are quantities, scores prices in whole units."""
    item = F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("c"), F.round("l_extendedprice").alias("s"), "l_partkey")
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i")).select("l_orderkey", F.col("i.c").alias("costs"), F.col("i.s").alias("scores"), F.sequence(F.lit(1).cast("long"), F.size("i").cast("long")).alias("ids"))


_REACH = """i as (select l_orderkey k, l_quantity::bigint cost, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity::bigint, round(l_extendedprice), l_partkey) n, round(l_extendedprice) s from lineitem),
m as (select k, max(n) m from i group by 1), r(k, n, spent, score, ids) as (select k, 0::bigint, 0::bigint, 0.0::double, []::bigint[] from m union all
select r.k, r.n + 1, r.spent + t.take * i.cost, r.score + t.take * i.s, case when t.take = 1 then list_append(r.ids, r.n + 1) else r.ids end from r join i on i.k = r.k and i.n = r.n + 1, (values (0), (1)) t(take) where r.spent + t.take * i.cost <= 60),
f as (select r.* from r join m on m.k = r.k and m.m = r.n)"""


@query(f"with recursive {_REACH} select k l_orderkey, max(spent) spent from f group by 1")
def achievable_budgets(spark, d):
    """The largest cost within a budget."""
    return _items(spark, d).select("l_orderkey", selection.achievable_budget("costs", F.lit(60)).alias("spent"))


@query(f"""with recursive {_REACH}, g as (select *, max(spent) over (partition by k) goal from f), b as (select *, row_number() over (partition by k order by score desc, ids) best, row_number() over (partition by k order by score, ids) worst from g where spent = goal)
select k l_orderkey, any_value(ids) filter (best = 1) best, any_value(ids) filter (worst = 1) worst from b group by 1""")
def extreme_subsets(spark, d):
    """The best and the worst set at the achievable cost, ties by ids."""
    x = selection.extremes("ids", "costs", "scores", F.lit(60))
    return _items(spark, d).withColumn("x", x).select("l_orderkey", F.col("x.best").alias("best"), F.col("x.worst").alias("worst"))


@query()
def sampled_subsets(spark, d):
    """Random subsets of the achievable cost, uniform and tilted by score; their costs and laws are checked by tests."""
    i = _items(spark, d).withColumn("seed", F.concat(F.lit("v1|"), "l_orderkey")).withColumn("tilts", F.transform("scores", lambda s: s / 50_000))
    total = lambda m: F.aggregate(F.zip_with(m, "costs", lambda k, c: F.when(k, c).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    i = i.withColumn("u", selection.sampled("costs", F.lit(60), "seed", F.lit(None).cast("array<double>"))).withColumn("t", selection.sampled("costs", F.lit(60), "seed", "tilts"))
    return i.select("l_orderkey", total(F.col("u")).alias("uniform_cost"), total(F.col("t")).alias("tilted_cost"), F.col("u").alias("uniform"), F.col("t").alias("tilted"))


@query("""with q as (select p_partkey % 10 page, count(*) filter (p_size > 40) n from part group by 1), r as (select p_partkey, p_partkey % 10 page, row_number() over (partition by p_partkey % 10 order by sha256('page|' || p_partkey), p_partkey) k from part) select page, p_partkey from r join q using (page) where k <= n""")
def page_stratified(spark, d):
    """A sample with the reference's counts by page."""
    p = _t(spark, d, "part").withColumn("page", F.col("p_partkey") % 10)
    return selection.like_reference(p, ["page"], "p_partkey", F.col("p_size") > 40, "page").select("page", "p_partkey")


@query("""with p as (select p_partkey, p_partkey % 10 page, (p_partkey // 10) % 16 cell, p_size from part), q as (select page, cell, count(*) n from p where p_size > 40 group by 1, 2), r as (select *, row_number() over (partition by page, cell order by sha256('cover|' || p_partkey), p_partkey) k from p) select page, cell, p_partkey from r join q using (page, cell) where k <= n""")
def coverage_matched(spark, d):
    """A sample with the reference's counts by page and cell."""
    p = _t(spark, d, "part").withColumn("page", F.col("p_partkey") % 10).withColumn("cell", F.floor(F.col("p_partkey") / 10) % 16)
    return selection.like_reference(p, ["page", "cell"], "p_partkey", F.col("p_size") > 40, "cover").select("page", "cell", "p_partkey")


@query("""with c as (select p_partkey % 37 g, count(*) c from part group by 1), k as (select *, sha256('grid|' || g) tie, count(*) over () k, 101 - count(*) over () rest, sum(c - 1) over () room from c), q as (select *, coalesce(rest * (c - 1) / nullif(room, 0)::double, 0) q from k),
n as (select g, case when rest < 0 then (row_number() over (order by tie) <= 101)::int else 1 + floor(q) + (row_number() over (order by round(q - floor(q), 9) desc, tie) <= rest - sum(floor(q)) over ())::int end n from q) select g, n::bigint n from n where n > 0""")
def grid_quotas(spark, d):
    """Quotas by cell, one each and the rest by largest remainders."""
    return selection.spread_quotas(_t(spark, d, "part").select((F.col("p_partkey") % 37).alias("g")), ["g"], 101, "grid")


@query()
def whole_pages(spark, d):
    """The best pages within a budget of tokens; checked by tests through the same knapsack."""
    p = _t(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("doc"), (F.col("p_partkey") % 7).alias("page")).agg(F.count("*").alias("c"), F.sum("p_size").cast("double").alias("s"))
    g = p.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "c", "s"))).alias("i"))
    x = selection.knapsack(F.col("i.c"), F.col("i.s"), F.greatest(F.lit(1), F.floor(F.aggregate("i", F.lit(0).cast("long"), lambda a, x: a + x["c"]) / 2)))
    return g.withColumn("x", x).select("doc", F.col("x.spent").alias("spent"), F.transform("x.places", lambda k: F.get("i.page", k)).alias("pages"))


@query()
def baseline_arms(spark, d):
    """The whole set, best and random arms at three quarters and half of the cost; checked by tests."""
    return selection.arms(_t(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("long")), "l_orderkey", "l_linenumber", "q", "l_extendedprice", (0.75, 0.5), "arms")


@query("""with t as (select p_partkey // 10 page, p_partkey token, p_partkey % 5 "owner" from part), r as (select distinct page, "owner" region, (page + "owner") % 2 = 0 kept from t where "owner" < 4), m as (select t.page, token, coalesce(kept, true) kept from t left join r on r.page = t.page and r.region = t."owner")
select page, sha256(string_agg(case when kept then '1' else '0' end, '' order by token)) digest from m group by 1""")
def token_masks(spark, d):
    """Token masks from region masks, and their digests."""
    t = _t(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("page"), F.col("p_partkey").alias("token"), (F.col("p_partkey") % 5).alias("owner"))
    r = t.where("owner < 4").select("page", F.col("owner").alias("region")).distinct().withColumn("kept", (F.col("page") + F.col("region")) % 2 == 0)
    return selection.mask_digest(selection.token_mask(t, r))


@query()
def exchange_units(spark, d):
    """Units for exchange moves; checked by tests."""
    r = _t(spark, d, "part").select(F.floor(F.col("p_partkey") / 20).alias("page"), (F.col("p_partkey") % 4).alias("tile"), F.col("p_type").alias("kind"), F.col("p_partkey").alias("region"), F.col("p_size").cast("long").alias("cost"), F.col("p_retailprice").alias("priority"))
    return selection.exchange_groups(r)


_BANK = "b as (select o_orderkey % 50 mask, p region, (('0x' || substr(sha256('bank|' || (o_orderkey % 50) || '|' || p), 1, 1))::int) % 2 = 1 or p = 3 kept from (select distinct o_orderkey % 50 o_orderkey from orders), range(12) r(p))"


@query(f"""with {_BANK}, f as (select region, avg(kept::int) f, list(kept order by mask) s from b group by 1), m as (select mask, list(kept order by region) s from b group by 1)
select f.region::int region, round(f, 9) frequency, f = 1 always_kept, f = 0 always_removed, (select count(*) from f g where g.s = f.s) alike, (select count(distinct s) from m) masks from f""")
def bank_diagnostics(spark, d):
    """Retention frequencies, regions that never change or are alike, and distinct masks."""
    o = _t(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("mask")).distinct()
    b = o.withColumn("region", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("kept", (selection.hash_bit("bank", F.col("mask"), F.col("region")) == 1) | (F.col("region") == 3))
    signature = lambda key, by: b.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "kept"))), lambda x: x["kept"].cast("string")), ",").alias("s"), F.avg(F.col("kept").cast("int")).alias("f"))
    regions = signature("region", "mask")
    alike = regions.groupBy("s").agg(F.count("*").alias("alike"))
    masks = signature("mask", "region").agg(F.count_distinct("s").alias("masks"))
    return regions.join(alike, "s").join(F.broadcast(masks)).select("region", F.round("f", 9).alias("frequency"), (F.col("f") == 1).alias("always_kept"), (F.col("f") == 0).alias("always_removed"), "alike", "masks")


@query("""with i as (select l_orderkey k, l_linenumber n, l_quantity c, l_extendedprice s, l_partkey p from lineitem), g as (select k, sum(c) c from i group by 1) select k, abs(c - 150) <= 0.05 * 150 near from g""")
def near_budget(spark, d):
    """Sets within a twentieth of the budget."""
    g = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("c"))
    return g.select("k", labels.near_budget(F.col("c"), F.lit(150)).alias("near"))


@query("""with recursive e as (select distinct c_custkey x, c_custkey % 211 + c_nationkey % 3 y from customer), m as (select y, min(x) b from e group by 1), l as (select distinct x a, b from e join m using (y)), b as (select a, b from l union select b, a from l),
r(id, c) as (select a, a from b union select b.b, r.c from r join b on b.a = r.id), f as (select id, min(c) component from r group by 1)
select component, sha256(string_agg(id::varchar, chr(10) order by id::varchar)) name, count(*) size from f group by 1""")
def named_components(spark, d):
    """L3: components of questions that share documents, named by their members' digest, single ones too."""
    doc = F.col("c_custkey") % 211 + F.col("c_nationkey") % 3
    return graph.named_components(graph.shared_by(_t(spark, d, "customer"), "c_custkey", doc))


@query("""with c as (select o_orderpriority n, count(*) c from orders group by 1), e as (select *, 256 * c / (select sum(c) from c) q from c), s as (select n, floor(q) + (row_number() over (order by round(q - floor(q), 9) desc, n) <= 256 - (select sum(floor(q)) from e))::int seats from e),
r as (select o_orderkey k, o_orderpriority n, row_number() over (partition by o_orderpriority order by sha256('plan' || chr(1) || o_orderpriority || chr(1) || o_orderkey), o_orderkey) h from orders), x as (select k, h <= seats ck from r join s using (n)), p as (select k, ck, row_number() over (order by (not ck)::int, k) - 1 place from x)
select k, ck checkpoint_row, place::bigint place, (place // 64)::bigint shard, place // 64 < 4 checkpoint from p""")
def shard_plan(spark, d):
    """L1, L2: a stratified checkpoint by hash at the head of the order, and consecutive shards."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("n"))
    return cohorts.shard_plan(o, "k", "n", ["k"], 256, 64, "plan").select("k", "checkpoint_row", "place", "shard", "checkpoint")


@query("""with o as (select c_custkey k, c_nationkey % 5 comp, c_acctbal < 3000 wrong, c_mktsegment s from customer), h as (select *, sha256('wrong|' || k) h from o where wrong), f as (select *, row_number() over (partition by comp order by h, k) n from h), r as (select *, row_number() over (order by (n > 1)::int, h, k) p from f)
select k, comp, p::bigint place from r where p <= 40""")
def wrong_cohort(spark, d):
    """Wrong answers only, one of each component first."""
    o = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 5).alias("comp")).where(F.col("c_acctbal") < 3000)
    return cohorts.one_each_first(o, "k", "comp", 40, "wrong|").select("k", "comp", "place")


@query("""with r as (select c_custkey k, c_mktsegment s, c_acctbal < 3000 wrong, row_number() over (partition by c_mktsegment, c_acctbal < 3000 order by sha256('cw|' || c_custkey), c_custkey) n, count(*) over (partition by c_mktsegment, c_acctbal < 3000) c, count(*) over () t from customer) select k, s, wrong, round(c / t::double, 9) weight from r where n <= 7""")
def weighted_cohort(spark, d):
    """L4: so many of each stratum by hash, with the strata's natural weights."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), (F.col("c_acctbal") < 3000).alias("wrong"))
    return cohorts.weighted(c, ["s", "wrong"], "k", 7, "cw|").select("k", "s", "wrong", F.round("weight", 9).alias("weight"))


@query("""select o_orderkey k, o_orderkey // 100 task, o_orderkey % 100 first, least(100, (select count(*) from orders) - (o_orderkey // 100) * 100) size from orders""")
def task_batches(spark, d):
    """Which batch of an array of tasks a row is in."""
    return cohorts.batches(_t(spark, d, "orders").select(F.col("o_orderkey").alias("k")), "k", 100)


@query("""with e as (select l_orderkey k from lineitem where l_returnflag = 'R'), h as (select o_orderkey k, o_custkey comp, sha256('seal|' || o_orderkey) h from orders where o_orderkey not in (select k from e)), r as (select *, row_number() over (order by h, k) p from h) select k, comp, p::bigint place from r where p <= 30""")
def sealed_holdout(spark, d):
    """A holdout by hash from what no earlier cohort has."""
    seen = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("comp"))
    return cohorts.sealed(o, seen, "k", "comp", 30, "seal|").select("k", "comp", "place")


@query("""with c as (select c_nationkey comp, count(*) n, count(distinct c_mktsegment) m from customer group by 1), r as (select *, case when m = 1 then 'pure' else 'mixed' end kind, sum(n) over (partition by m = 1 order by sha256('split|' || comp), comp) - n b from c),
s as (select *, sum(n) over (partition by kind) t from r) select comp, kind, n, case when b * 10 < 7 * t then 'train' when b * 10 < 8 * t then 'dev' else 'test' end split from s""")
def disjoint_splits(spark, d):
    """Splits that share no component, balanced over pure and mixed ones."""
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("comp"), F.col("c_mktsegment").alias("s"))
    return cohorts.disjoint_splits(c, "comp", "s", {"train": 7, "dev": 1, "test": 2}, "split|")


@query()
def quota_pool(spark, d):
    """Quotas by kind, rows of fresh families first; checked by tests."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind"), (F.col("c_custkey") % 90).alias("family"))
    return cohorts.quota_pool(c, "k", "kind", "family", 60, "pool|")


@query()
def balanced_split(spark, d):
    """A split balanced over kind and verdict with distinct texts; checked by tests."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("kind"), (F.col("c_acctbal") < 3000).alias("verdict"), (F.col("c_custkey") % 9).alias("contexts"), (F.col("c_custkey") % 700).cast("string").alias("text"))
    return cohorts.balanced_split(c, "k", ["kind", "verdict"], "contexts", "text", 8, "even|")
