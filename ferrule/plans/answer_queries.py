"""Queries on answers: normal forms, scores, contracts, predictions and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import answers, labels, text
from ferrule.operators import contracts, scoring
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t

_WORDS = "map {" + ", ".join(f"'{w}': '{float(n)}'" for w, n in answers.NUMBER_WORDS.items() if n < 1e9) + "}"
_TOKENS = "list_transform(list_filter(string_split_regex(lower({0}), '[ -]'), lambda t: t <> ''), lambda t: case when try_cast(t as double) is not null then t else regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g') end)"


def _norm(x: str) -> str:
    """The normal form in SQL, as a list of tokens."""
    kept = f"list_filter({_TOKENS.format(x)}, lambda t: t not in ('', 'a', 'an', 'the'))"
    return f"list_transform({kept}, lambda t: case when try_cast(t as double) is not null then (t::double)::varchar else coalesce({_WORDS}[t], t) end)"


_F1 = "case when len(list_filter({g}, lambda t: try_cast(t as double) is not null)) > 0 and len(list_intersect(list_filter({g}, lambda t: try_cast(t as double) is not null), {p})) = 0 then 0.0 when len({p}) = 0 and len({g}) = 0 then 1.0 else coalesce(2 * len(list_intersect({p}, {g})) / nullif((len({p}) + len({g}))::double, 0), 0) end"
_SPOKEN = "'The ' || p_name || ' (' || case p_size % 3 when 0 then 'zero' when 1 then 'one' else 'two' end || ')'"
_GOLD = "case when p_partkey % 5 = 0 then array_to_string(list_reverse(string_split(p_name, ' ')), ' ') else p_name end || case when p_size % 4 = 0 then '' else ' ' || (p_size % 2) end"
_SCORED = f"""s as (select p_partkey, p_brand, p_type, p_size, {_norm(_SPOKEN)} p, {_norm(_GOLD)} g from part),
b as (select *, list_distinct(p) pb, list_distinct(g) gb from s), x as (select *, (p = g)::int em, round_even({_F1.format(p='pb', g='gb')}, 2) f1 from b)"""


def _parts(spark, d):
    said = F.concat(F.lit("The "), "p_name", F.lit(" ("), F.when(F.col("p_size") % 3 == 0, "zero").when(F.col("p_size") % 3 == 1, "one").otherwise("two"), F.lit(")"))
    gold = F.concat(F.when(F.col("p_partkey") % 5 == 0, F.array_join(F.reverse(F.split("p_name", " ")), " ")).otherwise(F.col("p_name")), F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit(" "), (F.col("p_size") % 2).cast("string"))))
    return scoring.scored(_t(spark, d, "part").select("*", said.alias("said"), gold.alias("gold")), "said", "gold")


@query(f"with {_SCORED} select p_brand, p_type, count(*) n, round(avg(em) * 100, 6) em, round(avg(f1) * 100, 6) f1 from x group by grouping sets ((p_brand), (p_type), ())")
def answer_report(spark, d):
    """EM and F1 overall and by slices; single answers with articles, numbers and number words."""
    r = scoring.sliced_report(_parts(spark, d), ["p_brand", "p_type"])
    return r.select("p_brand", "p_type", "n", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@query(f"""with {_SCORED}, y as (select unnest(list_filter(['all', case when p_size > 25 then 'large' end, case when p_type = 'ECONOMY' then 'economy' end, case when p_brand = 'Brand#2' then 'brand 2' end], lambda v: v is not null)) slice, em, f1 from x)
select slice, count(*) n, round(avg(em) * 100, 6) em, round(avg(f1) * 100, 6) f1 from y group by 1""")
def overlapping_slices(spark, d):
    """D3: slices that overlap."""
    slices = {"all": F.lit(True), "large": F.col("p_size") > 25, "economy": F.col("p_type") == "ECONOMY", "brand 2": F.col("p_brand") == "Brand#2"}
    return scoring.overlapping_report(_parts(spark, d), slices).select("slice", "n", F.round("em", 6).alias("em"), F.round("f1", 6).alias("f1"))


@query(f"""with n as (select l_orderkey k, p_name v, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) i from lineitem join part on p_partkey = l_partkey),
p as (select k, i, {_norm('v')} t, list_distinct({_norm('v')}) b from n where i in (2, 3)), g as (select k, i, {_norm('v')} t, list_distinct({_norm('v')}) b from n where i <= 3),
c as (select k, count(*) np, list_sort(list_distinct(list(t))) pt from p group by 1), h as (select k, count(*) ng, list_sort(list_distinct(list(t))) gt from g group by 1),
s as (select p.k, p.i pi, g.i gi, {_F1.format(p='p.b', g='g.b')} f from p join g using (k)),
o as (select k, 0 pi, 0 gi, 0.0 f from h union all select * from s),
m as (select a.k, max(a.f + b.f) t from o a join o b on a.k = b.k and (a.pi in (0, 2)) and (b.pi in (0, 3)) and (a.gi <> b.gi or a.gi = 0) group by 1)
select h.k l_orderkey, case when coalesce(np, 0) = ng and pt = gt then 1 else 0 end::double em, round_even(m.t / greatest(coalesce(np, 0), ng), 2) f1 from h join m using (k) left join c using (k)""")
def list_answers(spark, d):
    """Lists of spans under the best assignment."""
    li = _t(spark, d, "lineitem").join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "p_name"))), lambda x: x["p_name"])
    lists = li.groupBy("l_orderkey").agg(names.alias("names")).select("l_orderkey", F.slice("names", 2, 2).alias("p"), F.slice("names", 1, 3).alias("g"))
    return lists.select("l_orderkey", answers.list_scores(F.col("p"), F.col("g")).alias("s")).select("l_orderkey", "s.em", "s.f1")


@query("""select o_orderkey, coalesce(k::varchar, '') prediction, (k is not null) predicted from orders left join (select l_orderkey k, count(*) n from lineitem group by 1) on k = o_orderkey and n > 3""")
def with_predictions(spark, d):
    """Every source row with its prediction or an empty one."""
    made = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n")).where("n > 3")
    j = scoring.with_predictions(_t(spark, d, "orders").select("o_orderkey"), made.select("o_orderkey", F.col("o_orderkey").cast("string").alias("prediction")), "o_orderkey", "prediction")
    return j.select("o_orderkey", "prediction", (F.col("prediction") != "").alias("predicted"))


@query("""select 'unknown prediction' kind, l_orderkey k from (select distinct l_orderkey from lineitem) where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'F') union all
select 'repeated prediction', l_orderkey from lineitem group by 2 having count(*) > 1""")
def prediction_violations(spark, d):
    """Unknown and repeated keys as violation rows."""
    s = _t(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"))
    return scoring.prediction_violations(s, _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


_TYPES = "['TextQ', 'TableQ', 'ImageQ', 'ImageListQ', 'Compose(ImageQ,TextQ)', 'Compose(TextQ,TableQ)', 'Intersect(TableQ,TextQ)'][o_custkey % 7 + 1]"


@query(f"""with q as (select o_orderkey, {_TYPES} ty, case when o_custkey % 3 = 0 then [1] else [1, 2] end s from orders)
select ty, case when contains(ty, '(') then 'multi-hop' else 'single-hop' end hop, not contains(ty, '(') and (ty <> 'TextQ' or len(s) = 1) single, count(*) n from q group by 1, 2, 3""")
def hop_labels(spark, d):
    """Hop labels and the single-hop predicate."""
    types = F.array(*[F.lit(x) for x in ("TextQ", "TableQ", "ImageQ", "ImageListQ", "Compose(ImageQ,TextQ)", "Compose(TextQ,TableQ)", "Intersect(TableQ,TextQ)")])
    q = _t(spark, d, "orders").select(F.get(types, (F.col("o_custkey") % 7).cast("int")).alias("ty"), F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("s"))
    return q.groupBy("ty", labels.hop(F.col("ty")).alias("hop"), labels.is_single_hop(F.col("ty"), F.col("s")).alias("single")).agg(F.count("*").alias("n"))


@query("""select event_id, coalesce(props->>'$.k', nullif(event_type, 'error'), 'none') label, coalesce(props->>'$.missing', nullif(event_type, 'error'), 'none') fallback from events""")
def label_fallback(spark, d):
    """Label of the metadata, else of the row, else a default."""
    e = _t(spark, d, "events").withColumn("m", F.from_json("props", "map<string,string>")).withColumn("own", F.nullif("event_type", F.lit("error")))
    return e.select("event_id", labels.group_label(F.col("m"), "k", F.col("own"), "none").alias("label"), labels.group_label(F.col("m"), "missing", F.col("own"), "none").alias("fallback"))


@query("""select l_orderkey, case when count(distinct nullif(l_returnflag, 'N')) = 0 then 'unknown' else min(nullif(l_returnflag, 'N')) end modality from lineitem group by 1 having count(distinct nullif(l_returnflag, 'N')) <= 1""")
def one_modality(spark, d):
    """The one modality of a row; rows with several, which would be an error, are left out first."""
    g = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.nullif("l_returnflag", F.lit("N"))).alias("m")).where(F.size(F.array_distinct("m")) <= 1)
    return g.select("l_orderkey", labels.modality(F.col("m")).alias("modality"))


@query("""select event_id, 'True' yes, (props->>'$.k') number, 'None' none from events""")
def scalar_spelling(spark, d):
    """JSON scalars as text."""
    e = _t(spark, d, "events")
    return e.select("event_id", labels.scalar_text(F.lit("true")).alias("yes"), labels.scalar_text(F.get_json_object("props", "$.k")).alias("number"), labels.scalar_text(F.get_json_object("props", "$.none")).alias("none"))


@query("""with p as (select l_orderkey k, list({'doc_id': 'd' || l_partkey, 'page': l_linenumber} order by l_linenumber, l_partkey, l_suppkey) pages, list('d' || l_partkey order by l_linenumber, l_partkey, l_suppkey) flat from lineitem group by 1)
select k, list_transform(pages, lambda x: x.doc_id) docs, flat = list_transform(pages, lambda x: x.doc_id) same from p""")
def retrieved_ids(spark, d):
    """Document ids of records and of plain lists."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    g = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(item)).alias("x"))
    pages = F.transform("x", lambda x: F.struct(F.concat(F.lit("d"), x["l_partkey"].cast("string")).alias("doc_id"), x["l_linenumber"].alias("page")))
    g = g.withColumn("pages", pages).withColumn("docs", F.col("pages.doc_id"))
    return g.select("k", "docs", (F.col("docs") == F.transform("x", lambda x: F.concat(F.lit("d"), x["l_partkey"].cast("string")))).alias("same"))


@query()
def contract_scores(spark, d):
    """Answers under contracts of all four kinds; checked by tests."""
    p = _t(spark, d, "part").select("p_partkey", F.col("p_name").alias("answer"), F.element_at(F.split("p_name", " "), 1).alias("color"))
    contract = F.to_json(F.struct(F.lit("scalar").alias("kind"), F.array(F.struct(F.concat("color", F.lit(" ring")).alias("canonical"), F.array(F.lit("a ring")).alias("aliases"))).alias("items"), F.array(F.concat("color", F.lit(" widget"))).alias("closed_domain")))
    s = p.select("p_partkey", contracts.score(F.col("answer"), contract).alias("s"))
    return s.select("p_partkey", "s.status", "s.reason")


@query("""select event_id, case when event_type = 'click' then null else (['correct', 'Incorrect', 'maybe'])[event_id % 3 + 1] end raw,
case when event_type = 'click' or event_id % 11 = 0 or event_id % 3 = 2 then 'uncertain' else lower((['correct', 'Incorrect', 'maybe'])[event_id % 3 + 1]) end verdict from events""")
def judge_verdicts(spark, d):
    """Verdicts parsed from a judge's JSON; malformed or cut-off ones are uncertain."""
    raw = F.get(F.array(F.lit("correct"), F.lit("Incorrect"), F.lit("maybe")), (F.col("event_id") % 3).cast("int"))
    e = _t(spark, d, "events").withColumn("raw", F.when(F.col("event_type") != "click", raw))
    said = F.when(F.col("raw").isNull(), "{broken").otherwise(F.concat(F.lit('{"verdict": "'), "raw", F.lit('"}')))
    return e.select("event_id", "raw", labels.verdict(said, F.col("event_id") % 11 == 0).alias("verdict"))


@query("""select o_orderkey, list_filter([case when not o_totalprice > 1000 then 'worth' end, case when not o_orderstatus in ('F', 'O') then 'settled' end, case when not o_custkey % 7 <> 0 then 'known customer' end], lambda x: x is not null) failures,
o_totalprice > 1000 and o_orderstatus in ('F', 'O') and o_custkey % 7 <> 0 admitted from orders""")
def rule_failures(spark, d):
    """Names of the admission rules that fail."""
    o = _t(spark, d, "orders")
    failed = labels.failed_rules({"worth": F.col("o_totalprice") > 1000, "settled": F.col("o_orderstatus").isin("F", "O"), "known customer": F.col("o_custkey") % 7 != 0})
    return o.select("o_orderkey", failed.alias("failures"), (F.size(failed) == 0).alias("admitted"))


@query("""select p_partkey, list_sort([lower(string_split(p_name, ' ')[1]), lower(string_split(p_name, ' ')[2])]) = list_sort(['red', 'ring']) complete from part""")
def complete_answers(spark, d):
    """JSON list answers compared with alternatives as multisets."""
    w = F.split("p_name", " ")
    said = F.to_json(F.array(F.upper(F.get(w, 1)), F.concat(F.lit(" "), F.get(w, 0))))
    return _t(spark, d, "part").select("p_partkey", answers.complete_correct(said, F.array(F.array(F.lit("Red"), F.lit("ring ")))).alias("complete"))


@query("""select doc_id, regexp_replace(replace(lower(regexp_replace(text, '\\[\\d+\\]', '', 'g')), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g') letters, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_\\p{Pc}]+'), ' ') words from documents""")
def text_forms(spark, d):
    """Letters only, and words only."""
    return _t(spark, d, "documents").select("doc_id", text.letters_only(F.col("text")).alias("letters"), text.words_only(F.col("text")).alias("words"))


@query("""select o_orderkey, 'doc_' || o_custkey document, (o_orderkey % 9)::int page from orders""")
def page_ids(spark, d):
    """Document and page of an identifier."""
    p = text.page_of(F.concat(F.lit("doc_"), "o_custkey", F.lit("_page"), F.col("o_orderkey") % 9))
    return _t(spark, d, "orders").select("o_orderkey", p["document"].alias("document"), p["page"].alias("page"))


@query("""select n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '"}') digest, (('0x' || substr(sha256('v1|' || n_name), 1, 15))::bigint) seed, (('0x' || substr(sha256('u|' || n_name), 1, 13))::bigint) / 4503599627370496.0 uniform from nation""")
def digests(spark, d):
    """Canonical digests, seeds and uniform numbers by hash."""
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", text.record_digest(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("digest"), text.seed(F.lit("v1"), "n_name").alias("seed"), text.uniform(F.lit("u"), "n_name").alias("uniform"))


@query("""select c_nationkey, sha256(string_agg(c_name, chr(10) order by c_custkey)) digest, count(*) n from customer group by 1""")
def id_list_digests(spark, d):
    """Digest of an ordered list of ids."""
    g = _t(spark, d, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("ids"))
    return g.select("c_nationkey", text.list_digest(F.col("ids")).alias("digest"), F.size("ids").cast("long").alias("n"))


@query("""select conv_id, turn, regexp_replace(text, 'sk-[A-Za-z0-9_-]{8,}', '[redacted]', 'g') text from conversations""")
def redacted_texts(spark, d):
    """Secrets out of texts."""
    return _t(spark, d, "conversations").select("conv_id", "turn", text.redacted(F.col("text")).alias("text"))


@query("""select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) flat from pages""")
def flattened_markup(spark, d):
    """Markup as plain text."""
    return _t(spark, d, "pages").select("page_id", text.flattened_markup(F.col("html")).alias("flat"))
