"""Queries on orders, ranks, sets and shards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ferrule.operators import sets, windows
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t


@query("""select p_partkey, (row_number() over (order by p_retailprice / p_size desc, p_partkey) - 1)::bigint place, ((row_number() over (order by p_retailprice / p_size desc, p_partkey) - 1) % 7)::bigint shard from part""")
def strided_shards(spark, d):
    """Every seventh row of an order."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / F.col("p_size")).alias("aspect"))
    return windows.strided(p, [F.desc("aspect"), "p_partkey"], 7).select("p_partkey", "place", "shard")


@query("""select o_orderkey, ((row_number() over (order by o_orderdate, o_orderkey) - 1) // 64)::bigint shard from orders""")
def consecutive_shards(spark, d):
    """Shards of 64 rows in order."""
    return windows.shards(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 64).select("o_orderkey", "shard")


@query("""select o_orderpriority, o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderpriority, o_orderstatus order by o_totalprice desc, o_orderkey) n from orders) where n = 1""")
def longest_of_stratum(spark, d):
    """The greatest row of each group by a composite key."""
    return windows.best_of(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderpriority", "o_orderstatus", "o_orderkey")


@query("""select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by sha256('one:' || c_custkey), c_custkey) n from customer) where n = 1""")
def one_of_each_family(spark, d):
    """A representative of each group by hash."""
    return windows.best_of(_t(spark, d, "customer"), ["c_nationkey"], [F.sha2(F.concat(F.lit("one:"), "c_custkey"), 256), "c_custkey"]).select("c_nationkey", "c_custkey")


_BY_LINE = "select l_suppkey s, l_linenumber i, avg(l_discount) v from lineitem group by 1, 2"


@query(f"""with m as ({_BY_LINE}), p as (select s, lag(i) over w earlier, i later, v - lag(v) over w change from m window w as (partition by s order by i)) select s, earlier, later, round(change, 9) change from p where change < -0.000000001""")
def falling_pairs(spark, d):
    """Adjacent places of an order at which a mean falls."""
    m = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("i")).agg(F.avg("l_discount").alias("v"))
    return windows.falls(m, ["s"], "i", "v").where("change < -0.000000001").select("s", "earlier", "later", F.round("change", 9).alias("change"))


@query(f"""with m as (select s, i, round(v, 9) > 0.045 ok from ({_BY_LINE})), l as (select s, i, bool_and(ok) over (partition by s order by i rows between current row and unbounded following) k from m)
select s, min(case when k then i end) "first" from l group by 1""")
def lasting_boundary(spark, d):
    """The first place from which all later means pass."""
    m = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("i")).agg(F.avg("l_discount").alias("v"))
    return windows.first_lasting(m, ["s"], "i", F.round("v", 9) > 0.045)


@query("""with z as (select l_suppkey, (l_quantity - avg(l_quantity) over w) / case when stddev_pop(l_quantity) over w = 0 then 1 else stddev_pop(l_quantity) over w end z from lineitem window w as (partition by l_linenumber)) select l_suppkey, round(max(z), 6) peak from z group by 1""")
def query_peaks(spark, d):
    """Greatest z-score of each row."""
    return windows.peaks(_t(spark, d, "lineitem"), "l_suppkey", "l_linenumber", "l_quantity").select("l_suppkey", F.round("peak", 6).alias("peak"))


@query("""with m as (select l_suppkey s, l_partkey c, max(l_discount) v from lineitem group by 1, 2), r as (select *, row_number() over w n, lead(v) over w nx from m window w as (partition by c order by v desc, s)),
l as (select s, sum(v - coalesce(nx, 0)) x from r where n = 1 group by 1) select s, round(coalesce(x, 0) / (select count(distinct c) from m), 9) loss from (select distinct s from m) left join l using (s)""")
def leave_one_out(spark, d):
    """What the mean of the best loses without each row."""
    m = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("c")).agg(F.max("l_discount").alias("v"))
    return windows.loss_without(m, "s", "c", "v").select("s", F.round("loss", 9).alias("loss"))


@query("""select l_orderkey, round(avg(l_extendedprice), 4) top_mean from (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc) n from lineitem) where n <= 3 group by 1""")
def top_three_mean(spark, d):
    """Mean of the three greatest values."""
    return windows.top_mean(_t(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice").select("l_orderkey", F.round("top_mean", 4).alias("top_mean"))


@query("""with s as (select o_orderkey k, row_number() over (order by o_orderkey) - 1 p from orders), n as (select k, p from s where p < 500 and p <> 77 union all select k, p + 1 from s where p = 600)
select k, p::bigint p from n where p >= (select count(*) from n) or k not in (select s.k from s where s.p = n.p)""")
def prefix_breaks(spark, d):
    """Rows done that break the source's order."""
    s = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    s = windows.numbered(s, "k", name="p")
    done = s.where("p < 500 and p <> 77").union(s.where("p = 600").select("k", F.col("p") + 1))
    return windows.prefix_violations(done, s, "k", "p")


@query("""with r as (select c_custkey, c_mktsegment, (row_number() over (partition by c_mktsegment order by c_custkey) > 2)::int late from customer) select c_custkey, c_mktsegment from r order by late, c_custkey limit 12""")
def review_packets(spark, d):
    """Two of each kind, then filled to twelve."""
    return windows.filled(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"], 2, 12)


@query("""with l as (select l_suppkey, list_sort(list(l_extendedprice)) v from lineitem group by 1) select l_suppkey, v[(round_even((len(v) - 1) * 0.975, 0))::int + 1] nearest, v[floor((len(v) - 1) * 0.025)::int + 1] low from l""")
def index_quantiles(spark, d):
    """E19 (b, c): quantiles at the nearest and at the floor index."""
    g = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_extendedprice").alias("v"))
    return g.select("l_suppkey", windows.nearest_quantile(F.col("v"), 0.975).alias("nearest"), windows.floor_quantile(F.col("v"), 0.025).alias("low"))


@query("""with b as (select l_orderkey g, l_linenumber i, max(l_quantity) a, max(l_extendedprice) b from lineitem group by 1, 2), r as (select *, row_number() over (partition by g order by a desc, i) ra, row_number() over (partition by g order by b desc, i) rb from b),
s as (select g, count(*) filter (ra <= 1 and rb <= 1) shared_1, count(*) filter (ra <= 3 and rb <= 3) shared_3, count(*) filter (ra <= 5 and rb <= 5) shared_5 from r group by 1),
t as (select x.g, count(*) filter ((x.a - y.a) * (x.b - y.b) < 0) reversals from r x join r y on x.g = y.g and x.i < y.i group by 1) select s.*, coalesce(reversals, 0) reversals from s left join t using (g)""")
def ranking_comparison(spark, d):
    """Shared tops and reversed pairs of two rankings."""
    b = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("i")).agg(F.max("l_quantity").alias("a"), F.max("l_extendedprice").alias("b"))
    return windows.compared_rankings(b, ["g"], "i", "a", "b")


@query("""with s as (select o_orderkey k, o_orderkey % 5 shard from orders where o_orderkey % 97 <> 0 union all select o_orderkey, 9 from orders where o_orderkey % 101 = 0)
select 'missing' kind, o_orderkey k from orders where o_orderkey not in (select k from s) union all select 'repeated', k from s group by 2 having count(*) > 1""")
def partition_check(spark, d):
    """whether shards are a disjoint union of the source, as violation rows."""
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    s = o.where("k % 97 <> 0").union(o.where("k % 101 = 0"))
    return sets.partition_violations(o, s, "k")


@query("""select o_orderkey k, (row_number() over (order by o_orderdate, o_orderkey) - 1)::bigint place, o_orderkey % 3 shard from orders""")
def merged_shards(spark, d):
    """shards put together in the source's order, without the columns of one run's hardware."""
    o = _t(spark, d, "orders")
    source = windows.numbered(o.select(F.col("o_orderkey").alias("k"), "o_orderdate"), "o_orderdate", "k")
    parts = [o.where(F.col("o_orderkey") % 3 == i).select(F.col("o_orderkey").alias("k"), F.lit(i).cast("long").alias("shard"), F.lit("a100").alias("hardware")) for i in range(3)]
    return sets.merged(parts, source, "k", "place", drop=["hardware"]).select("k", "place", "shard")


@query("""with s as (select 'A' l, l_orderkey k from lineitem where l_returnflag = 'A' union select 'R', l_orderkey from lineitem where l_returnflag = 'R' union select 'F', o_orderkey from orders where o_orderstatus = 'F'),
n as (select l, count(*) n from s group by 1), b as (select x.l a, y.l b, count(z.k) "both" from (select distinct l from s) x join (select distinct l from s) y on x.l < y.l left join (select p.l pl, q.l ql, p.k from s p join s q using (k)) z on z.pl = x.l and z.ql = y.l group by 1, 2)
select a, b, "both", case when "both" = p.n and "both" = q.n then 'equal' when "both" = p.n then 'subset' when "both" = q.n then 'superset' when "both" = 0 then 'disjoint' else 'overlap' end relation from b join n p on p.l = a join n q on q.l = b""")
def exclusion_registry(spark, d):
    """how labelled sets of ids relate."""
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    s = li.where("l_returnflag in ('A', 'R')").select(F.col("l_returnflag").alias("label"), F.col("l_orderkey").alias("k")).union(o.where("o_orderstatus = 'F'").select(F.lit("F"), "o_orderkey"))
    return sets.relations(s, "label", "k")


@query("""with s as (select l_suppkey, list_sort(list_distinct(list(l_linenumber) filter (l_returnflag = 'A'))) a, list_sort(list_distinct(list(l_linenumber) filter (l_returnflag <> 'A' and l_discount > 0.04))) b from lineitem group by 1),
t as (select l_suppkey, coalesce(a, []) a, coalesce(b, []) b from s)
select l_suppkey, list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))) difference, case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end jaccard,
case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else coalesce(list_sum(list_intersect(a, b)), 0) / list_sum(list_distinct(list_concat(a, b))) end weighted from t""")
def set_overlaps(spark, d):
    """Jaccard, weighted Jaccard and symmetric difference of id sets."""
    g = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("l_linenumber"))).alias("a"), F.collect_set(F.when((F.col("l_returnflag") != "A") & (F.col("l_discount") > 0.04), F.col("l_linenumber"))).alias("b"))
    return g.select("l_suppkey", sets.symmetric_difference(F.col("a"), F.col("b")).alias("difference"), sets.jaccard(F.col("a"), F.col("b")).alias("jaccard"), sets.weighted_jaccard(F.col("a"), F.col("b")).alias("weighted"))


@query("""with t as (select distinct event_id, unnest(regexp_extract_all(props || ' q' || user_id || ' q' || event_id, '[A-Za-z0-9]+')) t from events)
select event_id, coalesce(list_sort(list(t) filter (c_custkey is not null)), []) ids from t left join customer on t = 'q' || c_custkey group by 1""")
def harvested_ids(spark, d):
    """F8: known ids anywhere in a JSON text."""
    known = _t(spark, d, "customer").select(F.concat(F.lit("q"), "c_custkey").alias("id"))
    e = _t(spark, d, "events").select("event_id", F.concat("props", F.lit(" q"), "user_id", F.lit(" q"), "event_id").alias("json"))
    return sets.harvested(e, "event_id", "json", known, "id")


@query("""select c_nationkey family, list_sort(list(c_custkey)) members, count(*) n from customer group by 1""")
def inverted_membership(spark, d):
    """Members of each family."""
    return _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("family")).agg(F.array_sort(F.collect_list("c_custkey")).alias("members"), F.count("*").alias("n"))


@query("""select n size, count(*) groups from (select l_orderkey, count(*) n from lineitem group by 1) group by 1""")
def size_counts(spark, d):
    """How many groups there are of each size."""
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


@query("""select l_orderkey, l_linenumber, l_suppkey, rn - 1 place from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_suppkey, l_partkey, l_extendedprice) rn from lineitem) where rn <= 4""")
def first_seen_top(spark, d):
    """Top four by score, ties in first-seen order."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return _t(spark, d, "lineitem").withColumn("place", F.row_number().over(w) - 1).where("place < 4").select("l_orderkey", "l_linenumber", "l_suppkey", "place")
