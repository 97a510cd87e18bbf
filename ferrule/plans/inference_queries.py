"""Queries on paired statistics, bootstraps, preferences and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import labels, numbers
from ferrule.operators import inference, ranking, resampling, windows
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t


def _drawn(seed: str, tops: str, key: str = "key", name: str = "t") -> str:
    """Recursive tables in SQL that split each top (``key``, draw, n) down to single places: rows (key, draw, place, w) of ``name``."""
    u = f"('0x' || substr(sha256({seed} || '|' || lo || '|' || hi || '|' || (draw // 4)), 16 * (draw % 4) + 1, 13))::bigint / 4503599627370496.0"
    mass = "exp(lgamma(c + 1) - lgamma(j + 1) - lgamma(c - j + 1) + j * ln(p) + (c - j) * ln(1 - p))"
    left = f"len(list_filter(range(0, c), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: {mass})) <= u))"
    return f"""{name}_ as (select {key}, draw, 0::bigint lo, n::bigint hi, n::bigint c from {tops}
  union all select {key}, draw, unnest([lo, mid]), unnest([mid, hi]), unnest([l, c - l]) from (
    select *, case when c = 0 then 0 else {left} end l from (select *, (lo + hi) // 2 mid, ((lo + hi) // 2 - lo)::double / (hi - lo) p, {u} u from {name}_ where hi - lo > 1))),
{name} as (select {key}, draw, lo place, c w from {name}_ where hi - lo = 1)"""


@query(f"""with recursive x as (select s_acctbal v, row_number() over (order by s_suppkey) - 1 place from supplier), n as (select 0 key, draw, (select count(*) from x) n from range(200) r(draw)), {_drawn("'boot'", "n")},
m as (select draw, sum(w * v) / sum(w) m from t join x using (place) group by 1)
select count(m) draws, round(quantile_cont(m, 0.025), 8) low, round(quantile_cont(m, 0.975), 8) high, round(quantile_cont(m, 0.05), 8) "lower" from m""")
def paired_bootstrap(spark, d):
    """K1: interval and one-sided bound of a mean of paired deltas."""
    b = inference.paired_bootstrap(_t(spark, d, "supplier"), "s_suppkey", "s_acctbal", 200, "boot")
    return b.select("draws", *[F.round(c, 8).alias(c) for c in ("low", "high", "lower")])


@query(f"""with recursive c as (select c_nationkey g, sum(c_acctbal) t, count(*) n, row_number() over (order by c_nationkey) - 1 place from customer group by 1), n as (select 0 key, draw, (select count(*) from c) n from range(200) r(draw)), {_drawn("'fam'", "n", name="d")},
m as (select draw, sum(w * t) / sum(w * n) m from d join c using (place) group by 1) select count(m) draws, round(quantile_cont(m, 0.025), 6) low, round(quantile_cont(m, 0.975), 6) high from m""")
def family_bootstrap(spark, d):
    """K2: families are drawn, and their questions pooled."""
    c = inference.clustered(_t(spark, d, "customer"), "c_nationkey", "c_acctbal")
    b = inference.bootstrap(c, F.col("c_nationkey"), F.col("total"), 200, "fam", F.col("size"))
    return inference.interval(b, 0.025, 0.975).select("draws", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query(f"""with recursive q as (select l_suppkey u, l_suppkey % 7 g, max(l_discount) v, list(l_discount order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) r from lineitem where l_linenumber = 1 group by 1),
i as (select u key, draw, len(r) n from q, range(20) d(draw)), {_drawn("'nest|inner|' || key", "i", name="x")},
e as (select draw, g, sum(d) d, count(*) k from (select draw, u, any_value(g) g, any_value(v) - sum(w * r[place + 1]) / sum(w) d from x join q on u = key group by 1, 2) group by 1, 2),
g as (select g, row_number() over (order by g) - 1 place from (select distinct g from q)), n as (select 0 key, draw, (select count(*) from g) n from range(20) r(draw)), {_drawn("'nest|outer'", "n", name="o")},
f as (select draw, sum(w * d) / sum(w * k) m from o join g using (place) join e using (draw, g) group by 1)
select count(m) draws, round(quantile_cont(m, 0.05), 9) low, round(quantile_cont(m, 0.95), 9) high from f""")
def nested_inference(spark, d):
    """K3: components are drawn, and masks within each question; the interval of two one-sided tests."""
    item = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    q = _t(spark, d, "lineitem").where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("u")).agg(F.max("l_discount").alias("v"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["l_discount"]).alias("r"))
    b = inference.nested_bootstrap(q.withColumn("g", F.col("u") % 7), "u", "g", "v", "r", 20, "nest")
    return inference.interval(b, 0.05, 0.95).select("draws", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


_CURVE = "select l_partkey % 50 g, l_discount - 0.05 b0, l_tax - 0.04 b1, l_quantity / 1000 - 0.02 b2 from lineitem"


@query(f"""with recursive x as ({_CURVE}), c as (select g, count(*) n, sum(b0) b0, sum(b1) b1, sum(b2) b2, row_number() over (order by g) - 1 place from x group by 1), p as (select sum(b0) / sum(n) p0, sum(b1) / sum(n) p1, sum(b2) / sum(n) p2 from c),
m as (select 0 key, draw, (select count(*) from c) n from range(100) r(draw)), {_drawn("'curve'", "m")}, w as (select draw, c.*, w from t join c using (place)),
e as (select draw, greatest(sum(w * b0) / sum(w * n) - any_value(p0), sum(w * b1) / sum(w * n) - any_value(p1), sum(w * b2) / sum(w * n) - any_value(p2)) e from w, p group by 1), k as (select quantile_cont(e, 0.95) k from e),
f as (select 'b0' boundary, 0 place, p0 est, p0 - k lo from p, k union all select 'b1', 1, p1, p1 - k from p, k union all select 'b2', 2, p2, p2 - k from p, k)
select boundary, place, round(est, 9) estimate, round(lo, 9) "lower", (select min(place) from f a where not exists (select 1 from f b where b.place >= a.place and b.lo <= -0.001)) persistent from f""")
def removal_curve(spark, d):
    """Lower bounds that hold together over ordered boundaries, and the boundary from which all are above the margin."""
    x = _t(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("g"), (F.col("l_discount") - 0.05).alias("b0"), (F.col("l_tax") - 0.04).alias("b1"), (F.col("l_quantity") / 1000 - 0.02).alias("b2"))
    bounds = inference.simultaneous_bounds(x, "g", ["b0", "b1", "b2"], 100, "curve").withColumn("one", F.lit(1))
    lasting = windows.first_lasting(bounds, ["one"], "place", F.col("lower") > -0.001).select(F.col("first").alias("persistent"))
    return bounds.join(F.broadcast(lasting)).select("boundary", "place", F.round("estimate", 9).alias("estimate"), F.round("lower", 9).alias("lower"), "persistent")


@query(f"""with recursive x as (select o_orderstatus s, o_totalprice v, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 place from orders where o_custkey % 10 = o_orderkey % 10),
n as (select s key, draw, count(*) n from x, range(20) r(draw) group by 1, 2), {_drawn("'strata|' || key", "n")}, m as (select draw, s, sum(w * v) / sum(w) m from t join x on s = key and t.place = x.place group by 1, 2),
e as (select draw, sum(m * case s when 'F' then 0.5 when 'O' then 0.3 else 0.2 end) / sum(case s when 'F' then 0.5 when 'O' then 0.3 else 0.2 end) e from m group by 1)
select count(e) draws, round(quantile_cont(e, 0.025), 4) low, round(quantile_cont(e, 0.975), 4) high from e""")
def stratified_interval(spark, d):
    """K5: strata are resampled each, and put together by weights."""
    o = _t(spark, d, "orders").where("o_custkey % 10 = o_orderkey % 10")
    b = inference.stratified_bootstrap(o, "o_orderkey", "o_orderstatus", "o_totalprice", {"F": 0.5, "O": 0.3, "P": 0.2}, 20, "strata")
    return inference.interval(b, 0.025, 0.975).select("draws", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query("""with g as (select l_suppkey s, avg(l_discount) - 0.05 m, stddev_samp(l_discount) / sqrt(count(*)) e from lineitem group by 1), i as (select s, m - 1.645 * e l9, m + 1.645 * e h9, m - 1.96 * e l5, m + 1.96 * e h5 from g)
select s, case when l5 > 0 then 'superior' when h5 < 0 then 'inferior' when l9 >= -0.002 and h9 <= 0.002 then 'equivalent' else 'unresolved' end label from i""")
def interval_labels(spark, d):
    """Superior, inferior, equivalent or unresolved."""
    g = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg((F.avg("l_discount") - 0.05).alias("m"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("e"))
    m, e = F.col("m"), F.col("e")
    return g.select("s", labels.interval_label(m - 1.645 * e, m + 1.645 * e, m - 1.96 * e, m + 1.96 * e, 0.002).alias("label"))


@query("""with u as (select l_suppkey u, avg(l_discount) v, list(l_discount) r from lineitem group by 1) select round(avg(v + 0.01 - list_avg(r)), 9) estimand, count(u) units from u""")
def primary_estimand(spark, d):
    """Mean over units of the value less the mean of its repetitions."""
    u = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("u")).agg((F.avg("l_discount") + 0.01).alias("v"), F.collect_list("l_discount").alias("r"))
    return inference.estimand(u, "u", "v", "r").select(F.round("estimand", 9).alias("estimand"), "units")


@query("""select round(m, 9) mcse, case when m > 0.0005 then 20 else 10 end repetitions from (select sqrt(sum(v)) / count(*) m from (select l_suppkey, var_samp(l_discount) / count(l_discount) v from lineitem group by 1))""")
def repetition_decision(spark, d):
    """20 repetitions if the Monte-Carlo error is above a threshold."""
    m = inference.mcse(_t(spark, d, "lineitem"), ["l_suppkey"], "l_discount")
    return m.select(F.round("mcse", 9).alias("mcse"), inference.repetitions(F.col("mcse"), 0.0005).alias("repetitions"))


@query("""with r as (select l_linenumber rep, avg((l_quantity > 25)::int) a, avg((l_extendedprice > 30000)::int) b from lineitem group by 1) select count(*) repetitions, round(avg(a), 9) "before", round(avg(b), 9) "after" from r""")
def repetition_means(spark, d):
    """Mean of the repetitions' summaries."""
    s = inference.outcome_summary(_t(spark, d, "lineitem"), ["l_linenumber"], F.col("l_quantity") > 25, F.col("l_extendedprice") > 30000)
    return s.agg(F.count("*").alias("repetitions"), F.round(F.avg("before"), 9).alias("before"), F.round(F.avg("after"), 9).alias("after"))


@query("""select l_linestatus boundary, l_returnflag arm, count(*) n, count(*) filter (l_discount > 0.05) corrected, count(*) filter (l_discount > 0.05) / count(*) share, count(*) filter (l_discount > 0.05 and l_tax > 2) / nullif(count(*) filter (l_tax > 2), 0) none from lineitem group by 1, 2""")
def correction_counts(spark, d):
    """Counts and null-safe shares by boundary and arm."""
    won, rare = F.col("l_discount") > 0.05, F.col("l_tax") > 2
    g = _t(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("boundary"), F.col("l_returnflag").alias("arm"))
    return g.agg(F.count("*").alias("n"), F.count_if(won).alias("corrected"), F.try_divide(F.count_if(won), F.count("*")).alias("share"), F.try_divide(F.count_if(won & rare), F.count_if(rare)).alias("none"))


@query("""with s as (select l_returnflag st, count(*) n, avg(l_discount) m1, avg(l_tax) m2, count(*) filter (l_tax > l_discount) wins, count(*) filter (l_tax = l_discount) ties, count(*) filter (l_tax < l_discount) losses, count(*) filter (l_discount = 0 and l_tax > 0) rescues, count(*) filter (l_discount > 0 and l_tax = 0) harms from lineitem group by 1)
select st, n, round(m1, 9) mean_first, round(m2, 9) mean_second, wins, ties, losses, rescues, harms, round((select sum(m2 * case st when 'A' then 0.6 when 'N' then 0.3 else 0.1 end) from s), 9) weighted from s""")
def arm_contrast(spark, d):
    """Wins, ties and losses by stratum, and strata put together by weights."""
    s = inference.contrast(_t(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax").withColumnRenamed("l_returnflag", "st")
    w = spark.createDataFrame([("A", 0.6), ("N", 0.3), ("R", 0.1)], "st string, w double")
    whole = inference.recombined(s, w, "st", "mean_second", "w").select(F.round("value", 9).alias("weighted"))
    return s.join(F.broadcast(whole)).withColumn("mean_first", F.round("mean_first", 9)).withColumn("mean_second", F.round("mean_second", 9))


@query("""with b as (select l_orderkey k, l_linenumber i, max(l_extendedprice) a, max(l_quantity) b from lineitem group by 1, 2), p as (select * from b, (values (2), (4), (8)) w(p) where i <= p),
x as (select k, p, arg_max(i, [a, -i]) ia, arg_max(i, [b, -i]) ib from p group by 1, 2) select p::int prefix, count(*) n, count(*) filter (ia <> ib) disagree, sum(ia)::bigint sum_a, sum(ib)::bigint sum_b from x group by 1""")
def prefix_winners(spark, d):
    """Winners of the first observations by two criteria, and how often they differ."""
    b = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i")).agg(F.max("l_extendedprice").alias("a"), F.max("l_quantity").alias("b"))
    p = b.withColumn("prefix", F.explode(F.array(*[F.lit(x) for x in (2, 4, 8)]))).where("i <= prefix")
    x = p.groupBy("k", "prefix").agg(F.max_by("i", F.struct("a", -F.col("i"))).alias("ia"), F.max_by("i", F.struct("b", -F.col("i"))).alias("ib"))
    return x.groupBy("prefix").agg(F.count("*").alias("n"), F.count_if(F.col("ia") != F.col("ib")).alias("disagree"), F.sum("ia").alias("sum_a"), F.sum("ib").alias("sum_b"))


@query("""with m as (select l_orderkey g, l_linenumber n, l_discount s from lineitem), t as (select * from (values (0.0::double), (0.02::double)) e(eps), (values (0.01::double), (0.03::double)) q(mar)),
p as (select eps, mar, case when (i.s >= 0.06::double - eps) = (j.s >= 0.06::double - eps) then 0 when abs(i.s - (0.06::double - eps)) < mar or abs(j.s - (0.06::double - eps)) < mar then 0 when i.s >= 0.06::double - eps then 1 else -1 end v from m i join m j on i.g = j.g and i.n > j.n, t)
select eps::double eps, mar::double mar, count(*) filter (v <> 0) decided, count(*) pairs from p group by 1, 2""")
def yield_grid(spark, d):
    """Preference yields over a grid of tolerances and margins, counted in one pass over the pairs."""
    p = inference.pairs_in_group(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount")
    grid = [(e, m) for e in (0.0, 0.02) for m in (0.01, 0.03)]
    counts = p.agg(F.count("*").alias("pairs"), *[F.count_if(inference.preference(F.col("i_value"), F.col("j_value"), 0.06 - e, m, False) != 0).alias(f"c{k}") for k, (e, m) in enumerate(grid)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(e).alias("eps"), F.lit(m).alias("mar"), F.col(f"c{k}").alias("decided"), "pairs") for k, (e, m) in enumerate(grid)])).alias("x")).select("x.*")


_OUTCOMES = "select l_orderkey q, l_linenumber i, l_discount g, l_tax s, l_returnflag = 'R' base from lineitem"
_DIRECTION = "case when {0} > 0.01 then 1 when {0} < -0.01 then -1 else 0 end"


@query(f"""with o as ({_OUTCOMES}), p as (select a.base, a.g ag, a.s sa, b.g bg, b.s sb from o a join o b on a.q = b.q and a.i > b.i),
v as (select base, {_DIRECTION.format('(ag - bg)')} g_only, case when base then {_DIRECTION.format('(sa - sb)')} else {_DIRECTION.format('((ag - sa) - (bg - sb))')} end pure,
case when base then {_DIRECTION.format('(ag - bg)')} when (ag >= 0.045) <> (bg >= 0.045) then case when least(abs(ag - 0.045), abs(bg - 0.045)) <= 0.01 then 0 when ag >= 0.045 then 1 else -1 end when ag >= 0.045 then {_DIRECTION.format('((ag - sa) - (bg - sb))')} else {_DIRECTION.format('(ag - bg)')} end aware from p)
select base, g_only, pure, aware, count(*) n from v group by 1, 2, 3, 4""")
def supervised_preferences(spark, d):
    """Preferences in three modes and both preservation channels."""
    o = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i"), F.col("l_discount").alias("g"), F.col("l_tax").alias("s"), (F.col("l_returnflag") == "R").alias("base"))
    b = o.select("q", F.col("i").alias("j"), F.col("g").alias("bg"), F.col("s").alias("bs"))
    p = o.join(b, "q").where("i > j")
    f = lambda mode, keep: inference.supervised_preference((F.col("g"), F.col("s")), (F.col("bg"), F.col("bs")), F.lit(0.055), F.col("base"), mode, 0.01, 0.01, keep)
    return p.groupBy("base", f("g_only", "g").alias("g_only"), f("pure_contrast", "s").alias("pure"), f("gold_aware", "g").alias("aware")).agg(F.count("*").alias("n"))


_MASKS = "select l_orderkey q, l_linenumber i, (l_partkey % 16)::bigint m, l_discount v from lineitem"


@query(f"""with o as ({_MASKS}), p as (select a.q, a.q % 5 fam, bit_count(xor(a.m, b.m)) dist, a.v va, b.v vb from o a join o b on a.q = b.q and a.i > b.i where a.m <> b.m),
r as (select q, fam, case when dist = 1 then 'one' when dist = 2 then 'two' else 'more' end f, case when va > vb then 1.0 when va < vb then 0 else 0.5 end c, ln(1 + exp(-(va - vb) / 0.05)) l from p),
a as (select q, fam, f, avg(c) c, avg(l) l from r group by 1, 2, 3), b as (select q, fam, avg(c) c, avg(l) l from a group by 1, 2), e as (select fam, avg(c) c, avg(l) l from b group by 1)
select round((select avg(c) from b), 9) by_question, round((select avg(l) from b), 9) loss_by_question, round((select avg(l) from e), 9) loss_by_family, round((select avg(c) from r), 9) pooled, (select count(*) from b) questions""")
def balanced_pairs(spark, d):
    """Pair credit and logistic loss, balanced by Hamming family, question and family."""
    o = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 16).alias("m"), F.col("l_discount").alias("v"))
    p = o.join(o.select("q", F.col("i").alias("j"), F.col("m").alias("m2"), F.col("v").alias("v2")), "q").where("i > j and m <> m2")
    r = p.select("q", (F.col("q") % 5).alias("fam"), inference.pair_families(numbers.hamming(F.col("m"), F.col("m2"))).alias("f"), numbers.tie_credit(F.col("v"), F.col("v2")).alias("c"), numbers.pair_loss(F.col("v"), F.col("v2"), 0.05).alias("l"))
    levels = [["q", "fam", "f"], ["q", "fam"]]
    credit = inference.balanced(r, levels, "c", "by_question").withColumnRenamed("groups", "questions")
    loss = inference.balanced(r, levels, "l", "loss_by_question").drop("groups")
    family = inference.balanced(r, [*levels, ["fam"]], "l", "loss_by_family").drop("groups")
    out = credit.join(loss).join(family).join(r.agg(F.avg("c").alias("pooled")))
    return out.select(*[F.round(c, 9).alias(c) for c in ("by_question", "loss_by_question", "loss_by_family", "pooled")], "questions")


@query("""with f as (select l_suppkey s, nullif(l_linenumber, 7) x from lineitem) select s, count(x) defined, count(*) - count(x) undefined, min(x) least, round(avg(x), 9) mean, round(median(x), 6) median, max(x) most, count(*) filter (x >= 5) at_least_5 from f group by 1""")
def defined_only(spark, d):
    """Summaries of defined values only, with threshold counts."""
    f = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.nullif("l_linenumber", F.lit(7)).alias("x"))
    return f.groupBy("s").agg(F.count("x").alias("defined"), F.count_if(F.col("x").isNull()).alias("undefined"), F.min("x").alias("least"), F.round(F.avg("x"), 9).alias("mean"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"), F.max("x").alias("most"), F.count_if(F.col("x") >= 5).alias("at_least_5"))


@query("""select l_suppkey s, round(sqrt(avg((l_discount - l_tax) ** 2)), 9) rmse, round(sqrt(avg((m - l_tax) ** 2)), 9) constant_rmse from (select *, avg(l_tax) over (partition by l_suppkey) m from lineitem) group by 1""")
def fit_errors(spark, d):
    """K9: errors of a fit and of the constant."""
    r = inference.rmse(_t(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_tax")
    return r.select(F.col("l_suppkey").alias("s"), F.round("rmse", 9).alias("rmse"), F.round("constant_rmse", 9).alias("constant_rmse"))


@query("""with g as (select l_suppkey s, sqrt(avg((l_discount - l_tax) ** 2)) e, sqrt(avg((m - l_tax) ** 2)) c from (select *, avg(l_tax) over (partition by l_suppkey) m from lineitem) group by 1)
select s, e < 0.05 fit, e / c < 1.8 held, e - c < 0.0195 small, case when not e < 0.05 then 'unfit' when not e / c < 1.8 then 'unreliable' when not e - c < 0.0195 then 'unstable' else 'reliable' end outcome, e < 0.05 and e / c < 1.8 and e - c < 0.0195 passed from g""")
def reliability_gate(spark, d):
    """Three criteria, whether all hold, and a diagnosis in precedence."""
    g = inference.rmse(_t(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_tax").select(F.col("l_suppkey").alias("s"), (F.col("rmse") < 0.05).alias("fit"), (F.col("rmse") / F.col("constant_rmse") < 1.8).alias("held"), (F.col("rmse") - F.col("constant_rmse") < 0.0195).alias("small"))
    return g.select("*", labels.gate_outcome(F.col("fit"), F.col("held"), F.col("small")).alias("outcome"), (F.col("fit") & F.col("held") & F.col("small")).alias("passed"))


@query("""with c as (select o_orderkey k, min(l_linenumber) filter (l_discount >= 0.09) layer, max(l_tax) f1 from orders join lineitem on l_orderkey = o_orderkey group by 1)
select layer, count(*) n, round(avg(f1), 9) mean, round((select avg(f1) from c), 9) all_mean, round((select avg(f1) from c where layer is not null), 9) crossing_mean from c group by 1""")
def native_crossings(spark, d):
    """The first layer at which a norm crosses, its histogram, and means of all and of crossing rows."""
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    c = j.groupBy(F.col("o_orderkey").alias("k")).agg(F.min(F.when(F.col("l_discount") >= 0.09, F.col("l_linenumber"))).alias("layer"), F.max("l_tax").alias("f1"))
    whole = c.agg(F.round(F.avg("f1"), 9).alias("all_mean"), F.round(F.avg(F.when(F.col("layer").isNotNull(), F.col("f1"))), 9).alias("crossing_mean"))
    return c.groupBy("layer").agg(F.count("*").alias("n"), F.round(F.avg("f1"), 9).alias("mean")).join(F.broadcast(whole))


@query("""with e as (select l_suppkey s, l_linenumber i, -l_discount - 0.01 lp from lineitem), m as (select s, min(lp) lp, [max(l_discount), max(l_tax), min(l_tax)] g from e join lineitem on l_suppkey = s and l_linenumber = i group by 1)
select s, round(lp - ln(1 - exp(lp)), 6) logit, list_max(g[1:2]) g, g[3] st, g[1] >= 0.09 ok from m""")
def likelihood_effects(spark, d):
    """Sequence logits, effects and admissibility."""
    m = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.min(-F.col("l_discount") - 0.01).alias("lp"), F.array(F.max("l_discount"), F.max("l_tax"), F.min("l_tax")).alias("e"))
    g, s = numbers.effect(F.col("e"))
    return m.select("s", F.round(numbers.sequence_logit(F.col("lp")), 6).alias("logit"), g.alias("g"), s.alias("st"), labels.admissible(F.get("e", 0), F.lit(0.1), 0.01).alias("ok"))


@query("""with u as (select l_orderkey q, l_linenumber i, l_discount g, l_tax s from lineitem), r as (select *, row_number() over (partition by q order by (g >= 0.05)::int desc, case when g >= 0.05 then round(g - s, 9) else g end desc, case when g >= 0.05 then g else round(g - s, 9) end desc, -s desc, i) n from u) select q, i from r where n = 1""")
def best_by_utility(spark, d):
    """The best outcome by the utility's order."""
    u = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i"), F.col("l_discount").alias("g"), F.col("l_tax").alias("s"))
    rank = numbers.utility(F.col("g"), F.col("s"), F.col("g") >= 0.05)
    rank = F.struct(rank["a"].alias("a"), F.round(rank["b"], 9).alias("b"), F.round(rank["c"], 9).alias("c"), rank["d"].alias("d"))
    return windows.best_of(u.withColumn("u", rank), ["q"], [F.desc("u"), "i"]).select("q", "i")


@query("""select s_name, case when s_suppkey % 3 = 0 then 'a100' when s_suppkey % 3 = 1 then 'h200' else 'other' end class from supplier""")
def hardware_labels(spark, d):
    """Hardware classes by marks in the name."""
    name = F.concat(F.lit("NVIDIA "), F.when(F.col("s_suppkey") % 3 == 0, "a100-sxm4").when(F.col("s_suppkey") % 3 == 1, "H200 NVL").otherwise("L4"))
    return _t(spark, d, "supplier").select("s_name", labels.hardware_class(name, {"A100": "a100", "H200": "h200"}).alias("class"))


@query("""with r as (select l_returnflag run, l_suppkey q, l_linestatus p, l_discount f from lineitem where l_returnflag in ('A', 'R')), s as (select q, p, count(*) n, avg(f) m, var_samp(f) v from r group by 1, 2)
select p, count(*) units, sum(n)::bigint reps, round(avg(m), 9) mean, round(sqrt(sum(v / n)) / count(*), 9) mcse, round(stddev_samp(m), 9) sd from s group by 1""")
def combined_runs(spark, d):
    """Two runs put together, with means and errors by policy and the spread of units."""
    li = _t(spark, d, "lineitem")
    runs = [li.where(F.col("l_returnflag") == x).select(F.col("l_suppkey").alias("q"), F.col("l_linestatus").alias("p"), F.col("l_discount").alias("f")) for x in "AR"]
    s = runs[0].unionByName(runs[1]).groupBy("q", "p").agg(F.count("*").alias("n"), F.avg("f").alias("m"), F.var_samp("f").alias("v"))
    return s.groupBy("p").agg(F.count("*").alias("units"), F.sum("n").alias("reps"), F.round(F.avg("m"), 9).alias("mean"), F.round(F.sqrt(F.sum(F.col("v") / F.col("n"))) / F.count("*"), 9).alias("mcse"), F.round(F.stddev_samp("m"), 9).alias("sd"))


@query()
def equivalence_power(spark, d):
    """K7: least numbers of units for two one-sided tests, from each supplier's spread; the search is arithmetic, checked by tests."""
    spread = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_quantity").alias("sd"))
    return spread.select("l_suppkey", inference.equivalence_sizes(F.col("sd"), 1.0).alias("units"))


@query("""with h as (select l_suppkey s, round(avg(l_discount), 9) d from lineitem group by 1), p as (select s, (rank() over (order by d) + (count(*) over (partition by d) - 1) / 2.0) / (select count(*) from h) p from h), r as (select s, p, row_number() over (order by p, s) - 1 k, count(*) over () n from p)
select s, round(max(least(1.0, (n - k) * p)) over (order by p, s rows unbounded preceding), 9) adjusted from r""")
def holm_family(spark, d):
    """Step-down adjustment of one family of p values."""
    h = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.round(F.avg("l_discount"), 9).alias("d")).withColumn("g", F.lit(0))
    n = h.agg(F.count("*").alias("n"))
    p = h.withColumn("r", ranking.average_rank("d", ["g"])).join(F.broadcast(n)).withColumn("p", F.col("r") / F.col("n"))
    return ranking.holm(p, ["g"], "p", "s").select("s", F.round("adjusted", 9).alias("adjusted"))


@query(f"""with recursive e as (select event_type b, event_id % 2 = 0 p, event_id % 3 = 0 q, value v, event_type || '|' || (event_id % 2 = 0)::int || '|' || (event_id % 3 = 0)::int s, event_id u from events),
x as (select *, row_number() over (partition by s order by u) - 1 place from e), n as (select s key, draw, count(*) n from x, range(12) r(draw) group by 1, 2), {_drawn("'cells|' || key", "n")},
c as (select b, draw, p, q, sum(w * v) / sum(w) m from t join x on s = key and t.place = x.place group by 1, 2, 3, 4),
k as (select b, draw, sum(case when p = q then m else -m end) i from c group by 1, 2), l as (select b, round(quantile_cont(i, 0.025), 8) low, round(quantile_cont(i, 0.975), 8) high from k group by 1),
a as (select b, p, q, count(*) n, avg(v) m from e group by 1, 2, 3)
select b event_type, sum(n) filter (not p and not q)::bigint n00, sum(n) filter (not p and q)::bigint n01, sum(n) filter (p and not q)::bigint n10, sum(n) filter (p and q)::bigint n11,
  round(sum(case when q then m else -m end) filter (p), 8) effect_present, round(sum(case when q then m else -m end) filter (not p), 8) effect_absent, round(sum(case when p = q then m else -m end), 8) interaction, any_value(low) low, any_value(high) high
from a join l using (b) group by 1""")
def interaction_cells(spark, d):
    """K6: what one mask adds with and without another, and the interval of the difference by draws within the four cells."""
    e = _t(spark, d, "events").select("event_type", "event_id", "value", (F.col("event_id") % 2 == 0).alias("p"), (F.col("event_id") % 3 == 0).alias("q"))
    out = resampling.interactions(e, "event_type", "p", "q", "value", "event_id", 12, "cells")
    return out.select("event_type", "n00", "n01", "n10", "n11", *[F.round(c, 8).alias(c) for c in ("effect_present", "effect_absent", "interaction", "low", "high")])


@query("""with e as (select user_id c, event_id i, event_type kind, event_id * 7919 % 97 cost, value s, (event_id * 31 % 101) / 100.0 m from events),
q as (select c, quantile_cont(cost, [0.2, 0.4, 0.6, 0.8]) q, (count(*) + 4) // 5 k, sum(m) total from e group by 1), f as (select e.*, len(list_filter(q, lambda x: x < cost)) bin, k, total from e join q using (c)),
b as (select *, row_number() over (partition by c, kind, bin order by i) r from f), d as (select c, i, kind, bin, m, k, total, draw, row_number() over (partition by c, kind, bin, draw order by sha256('match|' || draw || '|' || i), i) r from b, range(40) r(draw)),
p as (select d.c, draw, d.i, d.m, d.k, d.total, b.s from d join b on d.c = b.c and d.kind = b.kind and d.bin = b.bin and d.r = b.r), t as (select *, row_number() over (partition by c, draw order by s desc, i) n from p),
v as (select c, draw, sum(case when n <= k then m else 0 end) / any_value(total) v from t group by 1, 2), o as (select *, row_number() over (partition by c order by s desc, i) n from b), a as (select c, sum(case when n <= k then m else 0 end) / any_value(total) v from o group by 1)
select c user_id, round(any_value(a.v)::double, 9) actual, round(avg(v.v)::double, 9) null_mean, round(quantile_cont(v.v, 0.025)::double, 9) null_low, round(quantile_cont(v.v, 0.975)::double, 9) null_high from v join a using (c) group by 1""")
def matched_permutations(spark, d):
    """K6: mass that the best fifth holds, against scores permuted among items of one kind and cost."""
    k = F.col("event_id")
    e = _t(spark, d, "events").select("user_id", k, "event_type", (k * 7919 % 97).alias("cost"), "value", ((k * 31 % 101) / 100).alias("mass"))
    out = resampling.matched_null(e, "user_id", "event_id", "event_type", "cost", "value", "mass", 40, "match")
    return out.select("user_id", *[F.round(c, 9).alias(c) for c in ("actual", "null_mean", "null_low", "null_high")])
