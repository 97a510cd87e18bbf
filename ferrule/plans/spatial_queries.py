"""Queries on boxes, rasters and retrieval profiles. The boxes and rasters are synthetic, made from ids of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import numbers
from ferrule.operators import raster, spatial
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t

_BOXES = """tok as (select p_partkey % 40 page, p_partkey token, (p_partkey * 7) % 60 tx0, (p_partkey * 11) % 60 ty0, (p_partkey * 7) % 60 + 4 tx1, (p_partkey * 11) % 60 + 4 ty1 from part),
reg as (select s_suppkey % 40 page, s_suppkey region, (s_suppkey * 13) % 40 rx0, (s_suppkey * 17) % 40 ry0, (s_suppkey * 13) % 40 + 10 + s_suppkey % 20 rx1, (s_suppkey * 17) % 40 + 12 ry1 from supplier)"""
_AREA = "(least(tx1, rx1) - greatest(tx0, rx0)) * (least(ty1, ry1) - greatest(ty0, ry0))"
_MEET = "t.page = r.page and least(tx1, rx1) > greatest(tx0, rx0) and least(ty1, ry1) > greatest(ty0, ry0)"
_PAIRS = f"p as (select t.page, token, region, {_AREA} area, r.* exclude (page, region), t.* exclude (page, token) from tok t join reg r on {_MEET})"


def _tokens(spark, d):
    return _t(spark, d, "part").selectExpr("p_partkey % 40 page", "p_partkey token", "(p_partkey * 7) % 60 tx0", "(p_partkey * 11) % 60 ty0", "(p_partkey * 7) % 60 + 4 tx1", "(p_partkey * 11) % 60 + 4 ty1")


def _regions(spark, d):
    return _t(spark, d, "supplier").selectExpr("s_suppkey % 40 page", "s_suppkey region", "(s_suppkey * 13) % 40 rx0", "(s_suppkey * 17) % 40 ry0", "(s_suppkey * 13) % 40 + 10 + s_suppkey % 20 rx1", "(s_suppkey * 17) % 40 + 12 ry1")


@query(f"with {_BOXES}, {_PAIRS}, b as (select *, row_number() over (partition by page, token order by area desc, region) n from p) select t.page, t.token, b.region, b.area from tok t left join b on b.page = t.page and b.token = t.token and n = 1")
def region_owners(spark, d):
    """Spatial overlap join and largest-overlap ownership."""
    return spatial.owners(_tokens(spark, d), _regions(spark, d))


@query(f"""with {_BOXES}, {_PAIRS}, b as (select *, row_number() over (partition by page, token order by area desc, region % 3, region) n from p)
select t.page, t.token, coalesce('region:' || b.region, 'tile:' || least(3, floor(4 * ((ty0 + ty1) / 2.0) / 64))::int || ',' || least(3, floor(4 * ((tx0 + tx1) / 2.0) / 64))::int) source from tok t left join (select page, token, region from b where n = 1) b using (page, token)""")
def region_or_tile(spark, d):
    """Owners by area, reading order and id; tokens without one belong to a tile of the page."""
    reg = _regions(spark, d).withColumn("reading_order", F.col("region") % 3)
    return spatial.owners_or_tiles(_tokens(spark, d), reg, F.lit(64), F.lit(64), ["reading_order", "region"])


@query(f"""with {_BOXES}, {_PAIRS}, f as (select t.page, t.token, min(region) pr from tok t left join p using (page, token) group by 1, 2)
select page, token, coalesce(pr, -1 - (row_number() over (partition by page, pr is null order by token) - 1) // 8)::bigint "owner" from f""")
def priority_owners(spark, d):
    """The earliest region wins; others are dealt to buckets of eight."""
    return spatial.first_owners(_tokens(spark, d), _regions(spark, d), "region", 8)


_GRIDS = """reg as (select page, y * 10.0 ry0, x * 10.0 rx0, y * 10.0 + 10 ry1, x * 10.0 + 10 rx1, (y // 2) * 3 + x // 2 "owner" from (select distinct p_partkey % 40 page from part), range(6) a(y), range(6) b(x)),
tok as (select page, y * 7 + x token, y * 60.0 / 7 ty0, x * 60.0 / 7 tx0, y * 60.0 / 7 + 60.0 / 7 ty1, x * 60.0 / 7 + 60.0 / 7 tx1 from (select distinct p_partkey % 40 page from part), range(7) a(y), range(7) b(x))"""


@query(f"""with {_GRIDS}, s as (select t.page, token, "owner", sum({_AREA}) area from tok t join reg r on {_MEET} group by 1, 2, 3), b as (select *, row_number() over (partition by page, token order by round(area, 6) desc, "owner") n from s)
select page, token::int token, "owner"::int "owner", round(area, 6) area, (select count(*) from (select distinct page, "owner" from reg) where (page, "owner") not in (select (page, "owner") from b where n = 1)) lost from b where n = 1""")
def regridded_owners(spark, d):
    """Owners of a new grid by summed overlaps, and how many owners are lost."""
    pages = _t(spark, d, "part").select((F.col("p_partkey") % 40).alias("page"))
    box = lambda p, step: [(F.col("y") * step).alias(f"{p}y0"), (F.col("x") * step).alias(f"{p}x0"), (F.col("y") * step + step).alias(f"{p}y1"), (F.col("x") * step + step).alias(f"{p}x1")]
    coarse = raster.grid(pages, 6, 6).select("page", *box("r", F.lit(10.0)), (F.floor(F.col("y") / 2) * 3 + F.floor(F.col("x") / 2)).cast("int").alias("owner"))
    fine = raster.grid(pages, 7, 7).select("page", (F.col("y") * 7 + F.col("x")).alias("token"), *box("t", F.lit(60.0 / 7)))
    mapped = spatial.mapped_grid(fine, coarse.withColumn("owner", F.col("owner"))).withColumn("area", F.round("area", 6))
    lost = spatial.lost_owners(mapped, coarse).agg(F.count("*").alias("lost"))
    return mapped.join(F.broadcast(lost)).select("page", "token", "owner", "area", "lost")


@query(f"""with {_BOXES}, {_PAIRS}, s as (select page, token patch, q, ((token * 31 + q * 7) % 97) / 97.0 s from tok, range(3) r(q)), b as (select p.page, region, q, max(s) score from p join s on s.page = p.page and s.patch = p.token group by 1, 2, 3)
select r.page, r.region, q.q::int q, round(score, 6) score, score is not null valid from reg r join (select distinct page, q from s) q using (page) left join b on b.page = r.page and b.region = r.region and b.q = q.q""")
def region_profiles(spark, d):
    """MaxSim profiles of regions over their patches, with a validity flag."""
    tok, reg = _tokens(spark, d), _regions(spark, d)
    members = spatial.overlap_join(tok, reg).select("page", "region", F.col("token").alias("patch"))
    scores = tok.select("page", F.col("token").alias("patch"), F.explode(F.array(*[F.lit(q) for q in range(3)])).alias("q")).withColumn("s", (F.col("patch") * 31 + F.col("q") * 7) % 97 / 97.0)
    return spatial.profiles(members, scores, reg).select("page", "region", "q", F.round("score", 6).alias("score"), "valid")


@query(f"with {_BOXES}, {_PAIRS} select page, token, region, round(sum(area / 16.0), 6) fraction from p group by 1, 2, 3")
def owned_fractions(spark, d):
    """Shares of a token's box by owner."""
    return spatial.owned_fractions(_tokens(spark, d), _regions(spark, d), digits=6)


_BLOCKS = "blk as (select s_suppkey % 40 page, s_suppkey token, (s_suppkey * 13) % 40 tx0, (s_suppkey * 17) % 40 ty0, (s_suppkey * 13) % 40 + 10 + s_suppkey % 20 - s_suppkey % 4 tx1, (s_suppkey * 17) % 40 + 12 ty1 from supplier)"


@query(f"""with {_BOXES}, {_BLOCKS}, j as (select t.page, token, region, {_AREA} a, (tx1 - tx0) * (ty1 - ty0) st, (rx1 - rx0) * (ry1 - ry0) sr from blk t join reg r on {_MEET}) select page, token, region, round(a / (st + sr - a), 6) iou from j where a / (st + sr - a) > 0.85""")
def matching_blocks(spark, d):
    """Regions and text blocks that cover each other."""
    blocks = _t(spark, d, "supplier").selectExpr("s_suppkey % 40 page", "s_suppkey token", "(s_suppkey * 13) % 40 tx0", "(s_suppkey * 17) % 40 ty0", "(s_suppkey * 13) % 40 + 10 + s_suppkey % 20 - s_suppkey % 4 tx1", "(s_suppkey * 17) % 40 + 12 ty1")
    return spatial.similar_boxes(blocks, _regions(spark, d)).select("page", "token", "region", F.round("iou", 6).alias("iou"))


@query(f"""with {_BOXES}, {_PAIRS}, b as (select *, row_number() over (partition by page, token order by area desc, region) n from p), o as (select t.page, t.token, b.region from tok t left join b on b.page = t.page and b.token = t.token and n = 1),
c as (select page, region, count(*) n from o group by 1, 2) select page, sum(n)::bigint tokens, round(coalesce(sum(n) filter (region is not null), 0) / sum(n), 9) covered, round(coalesce(sum(n) filter (region is null), 0) / sum(n), 9) left_over, coalesce(max(n) filter (region is not null), 0) largest, count(*) filter (region is not null and n > 5) oversized from c group by 1""")
def layout_audit(spark, d):
    """Region costs, covered and left-over shares, the largest region and oversized ones."""
    a = spatial.audit(spatial.owners(_tokens(spark, d), _regions(spark, d)), 5)
    return a.select("page", "tokens", F.round("covered", 9).alias("covered"), F.round("left_over", 9).alias("left_over"), "largest", "oversized")


_GEOMETRY = "geo as (select p_partkey % 10 page, (p_partkey // 10) % 13 \"row\", (p_partkey * 7) % 11 \"column\", p_size > 25 k, p_size > 20 and p_partkey % 3 > 0 r from part)"


@query(f"""with {_GEOMETRY}, c as (select *, ("row" + 0.5) / 13 y, ("column" + 0.5) / 11 x, least(3, floor(4 * ("row" + 0.5) / 13)) * 4 + least(3, floor(4 * ("column" + 0.5) / 11)) cell from geo)
select page, count(*) filter (k) kept, count(distinct cell) filter (k) cells, round(avg(y) filter (k), 9) center_y, round(avg(x) filter (k), 9) center_x, round(sqrt(var_pop(y) filter (k) + var_pop(x) filter (k)), 9) spread,
case when count(*) filter (k or r) = 0 then 1.0 else round(count(*) filter (k and r) / count(*) filter (k or r), 9) end overlap from c group by 1""")
def coverage_measures(spark, d):
    """Occupancy, centre, spread and overlap of a selection by page."""
    t = _t(spark, d, "part").select((F.col("p_partkey") % 10).alias("page"), (F.floor(F.col("p_partkey") / 10) % 13).alias("row"), (F.col("p_partkey") * 7 % 11).alias("column"), F.lit(13).alias("height"), F.lit(11).alias("width"), "p_size", "p_partkey")
    c = spatial.coverage(t, F.col("p_size") > 25, (F.col("p_size") > 20) & (F.col("p_partkey") % 3 > 0))
    return c.select("page", "kept", "cells", *[F.round(x, 9).alias(x) for x in ("center_y", "center_x", "spread", "overlap")])


@query("""select p_partkey % 10 page, round(sum(p_size) filter (p_partkey % 3 = 0) / case when sum(p_size) <= 1e-12 then null else sum(p_size) end, 9) share from part group by 1""")
def mass_coverage(spark, d):
    """Share of the mass that a selection holds; null without mass."""
    held = F.sum(F.when(F.col("p_partkey") % 3 == 0, F.col("p_size")))
    return _t(spark, d, "part").groupBy((F.col("p_partkey") % 10).alias("page")).agg(F.round(held / F.when(F.sum("p_size") > 1e-12, F.sum("p_size")), 9).alias("share"))


_RASTER = "ras as (select page, y, x, ((page * 31 + y * 17 + x * 7) % 23) / 23.0 v from (select n_nationkey page from nation), range(6) a(y), range(5) b(x))"


def _raster(spark, d):
    pages = _t(spark, d, "nation").select(F.col("n_nationkey").alias("page"))
    return raster.grid(pages, 6, 5).withColumn("v", (F.col("page") * 31 + F.col("y") * 17 + F.col("x") * 7) % 23 / 23.0)


@query("""with t as (select n_nationkey page, p::int place, (p * 3 % 7) / 7.0 v from nation, range(30) r(p) where (p + n_nationkey) % 3 > 0), g as (select n_nationkey page, y::int y, x::int x from nation, range(6) a(y), range(5) b(x))
select g.page, g.y, g.x, round(v, 6) v from g left join t on t.page = g.page and t.place = g.y * 5 + g.x""")
def scattered_tokens(spark, d):
    """H6: sparse tokens on their raster, with holes."""
    p = _t(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("place")).where("(place + page) % 3 > 0")
    return raster.scattered(p.withColumn("v", F.col("place") * 3 % 7 / 7.0), 6, 5).select("page", "y", "x", F.round("v", 6).alias("v"))


def _axis(name: str, n: int, m: int) -> str:
    at = f"greatest(({name} + 0.5) * {n / m!r} - 0.5, 0)"
    low = f"least(floor({at}), {n - 1})::int"
    return f"{low} {name}0, least({low} + 1, {n - 1}) {name}1, {at} - {low} {name}p"


@query(f"""with {_RASTER}, t as (select page, y::int y, x::int x, {_axis('y', 6, 8)}, {_axis('x', 5, 9)} from (select n_nationkey page from nation), range(8) a(y), range(9) b(x)),
v as (select t.page, t.y, t.x, sum(r.v * (case when r.y = y0 then 1 - yp else 0 end + case when r.y = y1 then yp else 0 end) * (case when r.x = x0 then 1 - xp else 0 end + case when r.x = x1 then xp else 0 end)) v
from t join ras r on r.page = t.page and r.y in (y0, y1) and r.x in (x0, x1) group by 1, 2, 3) select page, y, x, round(v, 6) v from v""")
def resized_maps(spark, d):
    """H7: bilinear resize."""
    return raster.resized(_raster(spark, d), (6, 5), (8, 9)).select("page", "y", "x", F.round("v", 6).alias("v"))


@query(f"""with {_RASTER}, w as (select d, exp(-(d * d) / 2.0) / (select sum(exp(-(k * k) / 2.0)) from range(-3, 4) r(k)) w from range(-3, 4) r(d)),
s as (select r.page, r.y, r.x, sum(a.w * b.w * n.v) v from ras r, w a, w b, ras n where n.page = r.page and n.y = greatest(0, least(5, r.y + a.d)) and n.x = greatest(0, least(4, r.x + b.d)) group by 1, 2, 3) select page, y::int y, x::int x, round(v, 6) v from s""")
def smoothed_maps(spark, d):
    """H8: Gaussian smoothing with repeated borders."""
    return raster.smoothed(_raster(spark, d), 6, 5, 1.0).select("page", "y", "x", F.round("v", 6).alias("v"))


@query(f"""with t as (select n_nationkey page, p::int place, (p * 3 % 7) / 7.0 v from nation, range(30) r(p) where (p + n_nationkey) % 7 > 0),
ras as (select n_nationkey page, y::int y, x::int x, coalesce(t.v, 0)::double v, t.v is not null there from nation cross join range(6) a(y) cross join range(5) b(x) left join t on t.page = n_nationkey and t.place = y * 5 + x),
g as (select page, y::int y, x::int x, {_axis('y', 6, 8)}, {_axis('x', 5, 10)} from (select n_nationkey page from nation), range(8) a(y), range(10) b(x)),
z as (select g.page, g.y, g.x, sum(r.v * (case when r.y = y0 then 1 - yp else 0 end + case when r.y = y1 then yp else 0 end) * (case when r.x = x0 then 1 - xp else 0 end + case when r.x = x1 then xp else 0 end)) v from g join ras r on r.page = g.page and r.y in (y0, y1) and r.x in (x0, x1) group by 1, 2, 3),
w as (select d, exp(-(d * d) / 2.0) / (select sum(exp(-(k * k) / 2.0)) from range(-3, 4) r(k)) w from range(-3, 4) r(d)),
s as (select r.page, r.y, r.x, sum(a.w * b.w * n.v) v from z r, w a, w b, z n where n.page = r.page and n.y = greatest(0, least(7, r.y + a.d)) and n.x = greatest(0, least(9, r.x + b.d)) group by 1, 2, 3),
k as (select page, y // 2 gy, x // 2 gx, bool_or(v >= 0.4) keep from s group by 1, 2, 3), n as (select g.page, g.y // 2 gy, g.x // 2 gx, bool_and(there) valid from g join ras r on r.page = g.page and r.y = floor(g.y * 0.75) and r.x = floor(g.x * 0.5) group by 1, 2, 3)
select page, gy::int gy, gx::int gx, keep and valid keep from k join n using (page, gy, gx)""")
def relevant_groups(spark, d):
    """H9: the whole chain from sparse tokens to kept groups."""
    p = _t(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("place")).where("(place + page) % 7 > 0")
    return raster.relevant_groups(p.withColumn("v", F.col("place") * 3 % 7 / 7.0), (6, 5), (8, 10), 0.4, 1.0)


_PIXELS = "pix as (select n_nationkey page, y::int y, x::int x, (n_nationkey * 5 + y * 3) % 256 r, (x * y) % 50 g, (x + n_nationkey) % 7 * 30 b from nation, range(8) a(y), range(12) c(x))"


def _pixels(spark, d):
    p = raster.grid(_t(spark, d, "nation").select(F.col("n_nationkey").alias("page")), 8, 12)
    r, g, b = (F.col("page") * 5 + F.col("y") * 3) % 256, F.col("x") * F.col("y") % 50, (F.col("x") + F.col("page")) % 7 * 30
    return p.withColumn("gray", numbers.gray(r, g, b))


@query(f"""with {_PIXELS}, q as (select page, y, x, round_even(0.299::double * r + 0.587::double * g + 0.114::double * b, 0)::int gray from pix), m as (select page, arg_max(gray, [n, -gray]) mode from (select page, gray, count(*) n from q group by 1, 2) group by 1),
s as (select page, y // 4 y, x // 4 x, avg((abs(gray - mode) < 20)::int) v from q join m using (page) group by 1, 2, 3) select page, y::int y, x::int x, round(v, 9) v from s""")
def background_ratios(spark, d):
    """Grays, modes, and shares of near-modal pixels by patch."""
    return raster.backgrounds(_pixels(spark, d), 4, 20).select("page", "y", "x", F.round("v", 9).alias("v"))


@query(f"""with {_PIXELS}, q as (select page, y, x, round_even(0.299::double * r + 0.587::double * g + 0.114::double * b, 0)::int gray from pix), m as (select page, arg_max(gray, [n, -gray]) mode from (select page, gray, count(*) n from q group by 1, 2) group by 1),
s as (select page, y // 2 y, x // 2 x, avg((abs(gray - mode) < 20)::int) v from q join m using (page) group by 1, 2, 3)
select page, (y // 2)::int gy, (x // 2)::int gx, bool_or(v <= 0.25) any_kept, bool_and(v <= 0.25) all_kept, avg(v) <= 0.25 mean_kept from s group by 1, 2, 3""")
def background_groups(spark, d):
    """Threshold keeps, and decisions for merge groups by any, all and mean."""
    b = raster.backgrounds(_pixels(spark, d), 2, 20)
    keep = F.col("v") <= 0.25
    parts = [raster.group_keep(b, keep, r, keep).withColumnRenamed("keep", f"{r}_kept") for r in ("any", "all", "mean")]
    return parts[0].join(parts[1], ["page", "gy", "gx"]).join(parts[2], ["page", "gy", "gx"])


@query(f"""with {_PIXELS}, q as (select page, y // 2 gy, x // 2 gx, avg(r) > 60 a, avg(b) > 60 z from pix group by 1, 2, 3), f as (select *, row_number() over (partition by page order by gy, gx) - 1 full_ from q)
select page, gy::int gy, gx::int gx, full_::bigint "full", (row_number() over (partition by page order by gy, gx) - 1)::bigint place from f where a and z""")
def kept_geometry(spark, d):
    """Both decisions of a page's groups, and places of what is kept."""
    p = raster.grid(_t(spark, d, "nation").select(F.col("n_nationkey").alias("page")), 8, 12)
    r, b = (F.col("page") * 5 + F.col("y") * 3) % 256, (F.col("x") + F.col("page")) % 7 * 30
    one = lambda v: raster.group_keep(p.withColumn("v", v.cast("double")), F.col("v") > 60, "mean", F.col("v") > 60)
    g = raster.geometry(raster.kept_pages(one(r), one(b)))
    return g.select("page", "gy", "gx", F.col("full").cast("long").alias("full"), F.col("place").cast("long").alias("place"))


@query("""with h as (select l_suppkey k, l_linenumber token, l_orderkey % 4 head, avg(l_quantity) / 10 logit from lineitem group by 1, 2, 3), e as (select *, exp(logit) / sum(exp(logit)) over (partition by k, head) p from h), l as (select k, token, avg(p) p from e group by 1, 2),
m as (select k, token, avg(logit) a from h group by 1, 2), s as (select k, token, exp(a) / sum(exp(a)) over (partition by k) p from m)
select l.k, l.token, round(l.p * count(*) over (partition by l.k), 9) literal, round(s.p * count(*) over (partition by l.k), 9) aggregate from l join s using (k, token)""")
def head_attention(spark, d):
    """Attention over heads, literal and aggregate."""
    h = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("token"), (F.col("l_orderkey") % 4).alias("head")).agg((F.avg("l_quantity") / 10).alias("logit"))
    literal, aggregate = (raster.attention(h, ["k"], x).select("k", "token", F.round("score", 9).alias(n)) for x, n in ((True, "literal"), (False, "aggregate")))
    return literal.join(aggregate, ["k", "token"])


@query("""with g as (select n_nationkey page, n_nationkey % 5 + 3 h, n_nationkey % 7 + 2 w from nation), s as (select page, h * w fine, ceil(h / 2.0) * ceil(w / 2.0) groups from g)
select page, fine::bigint fine, groups::bigint groups, coalesce(sum(fine) over w, 0)::bigint fine_offset, coalesce(sum(groups) over w, 0)::bigint group_offset from s window w as (order by page rows between unbounded preceding and 1 preceding)""")
def layout_offsets(spark, d):
    """Fine and group counts and their offsets by page."""
    n = F.col("n_nationkey")
    g = _t(spark, d, "nation").select(n.alias("page"), (n % 5 + 3).alias("height"), (n % 7 + 2).alias("width"))
    return raster.offsets(g)


@query("""select l_orderkey, l_linenumber, l_suppkey, l_partkey from lineitem where l_linestatus <> 'O' or l_extendedprice >= 40000""")
def token_keep(spark, d):
    """Every other token, and visual ones from a threshold on."""
    li = _t(spark, d, "lineitem")
    return li.where((F.col("l_linestatus") != "O") | (F.col("l_extendedprice") >= 40000)).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


@query("""with b as (select p_partkey % 8 k, bit_or(1::bigint << (p_partkey % 60)::int) m from part group by 1) select a.k, b.k j, bit_count(xor(a.m, b.m))::int distance from b a join b on a.k < b.k""")
def mask_distances(spark, d):
    """Packed masks and their Hamming distances."""
    flags = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.array_contains("on", i))
    m = _t(spark, d, "part").groupBy((F.col("p_partkey") % 8).alias("k")).agg(F.collect_set((F.col("p_partkey") % 60).cast("int")).alias("on")).select("k", numbers.packed_bits(flags).alias("m"))
    return m.join(m.select(F.col("k").alias("j"), F.col("m").alias("m2")), F.col("k") < F.col("j")).select("k", "j", numbers.hamming(F.col("m"), F.col("m2")).alias("distance"))
