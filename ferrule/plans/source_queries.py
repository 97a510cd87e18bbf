"""Queries through sources, stores and streams: driver tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from ferrule.operators.settle import scratch
from ferrule.plans.catalogue import query
from ferrule.plans.catalogue import table as _t
from ferrule.sources import jsonl, stores, zips
from ferrule.streaming import committed, observation, replay


@query("select c_custkey, c_name, c_acctbal from customer")
def strict_rows(spark, d):
    """A1, A2: rows of a strict JSON-lines file."""
    path = scratch(spark, "strict")
    _t(spark, d, "customer").select(F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))).write.text(path)
    return jsonl.strict(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("select c_custkey, c_name from customer where c_custkey % 3 > 0 union all select null, null from customer where c_custkey % 3 = 0 and c_custkey % 2 = 0")
def lenient_rows(spark, d):
    """A3: blank lines are passed over, what doesn't parse is null."""
    path, k = scratch(spark, "lenient"), F.col("c_custkey")
    line = F.when(k % 3 > 0, F.to_json(F.struct("c_custkey", "c_name"))).when(k % 2 == 0, "{broken").otherwise("  ")
    _t(spark, d, "customer").select(line).write.text(path)
    return jsonl.lenient(spark, path, "c_custkey long, c_name string")


@query("select 'malformed' kind, count(*) n from customer where c_custkey % 6 = 0 union all select 'blank', count(*) from customer where c_custkey % 3 = 0 and c_custkey % 2 > 0 union all select 'not an object', count(*) from customer where c_custkey % 3 = 1 and c_custkey % 7 = 0")
def line_violations(spark, d):
    """A1: lines that a strict reader refuses, by kind."""
    path, k = scratch(spark, "lines"), F.col("c_custkey")
    line = F.when(k % 6 == 0, "{broken").when(k % 3 == 0, "  ").when((k % 3 == 1) & (k % 7 == 0), "7").otherwise('{"a": 1}')
    _t(spark, d, "customer").select(line).write.text(path)
    return jsonl.violations(spark, path).groupBy("kind").agg(F.sum("n").alias("n"))


@query("select n_nationkey::varchar qid, n_name \"name\" from nation")
def keyed_rows(spark, d):
    """A4: rows of documents that are mappings, lists or single rows, keyed by themselves, an alias or the mapping."""
    n, k = _t(spark, d, "nation"), F.col("n_nationkey").cast("string")
    own = F.struct(k.alias("qid"), F.col("n_name").alias("name"))
    other = F.struct(k.alias("question_id"), F.col("n_name").alias("name"))
    text = F.when(F.col("n_nationkey") % 3 == 0, F.to_json(F.array(own))).when(F.col("n_nationkey") % 3 == 1, F.to_json(other)).otherwise(F.to_json(F.create_map(k, F.struct(F.col("n_name").alias("name")))))
    return jsonl.keyed_rows(n.select(text.alias("text")), "text", "name string").select("qid", F.col("row.name").alias("name"))


@query("""select p_partkey % 50 doc, (p_partkey // 50 % 2)::int page, (row_number() over (partition by p_partkey % 50, p_partkey // 50 % 2 order by p_partkey) - 1)::int reading_order, p_type "type", round((p_size / 100.0)::double, 9) x0, round(((p_size + 10) / 100.0)::double, 9) x1, p_name content from part""")
def layout_regions(spark, d):
    """Regions of layout documents in reading order, boxes in the unit square."""
    size = F.col("p_size").cast("double")
    block = F.struct(F.col("p_partkey").alias("k"), F.col("p_type").alias("type"), F.array(size, F.lit(0.0), size + 10, F.lit(20.0)).alias("bbox"), F.col("p_name").alias("content"))
    pages = _t(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("doc"), (F.floor(F.col("p_partkey") / 50) % 2).alias("page_idx")).agg(F.array_sort(F.collect_list(block)).alias("para_blocks"))
    docs = pages.groupBy("doc").agg(F.to_json(F.struct(F.collect_list(F.struct("page_idx", F.array(F.lit(100.0), F.lit(200.0)).alias("page_size"), "para_blocks")).alias("pdf_info"))).alias("text"))
    r = jsonl.layout_regions(docs, "doc", "text")
    return r.select("doc", "page", "reading_order", "type", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"), "content")


@query("select conv_id, turn, trim(text) plain from conversations where text is not null")
def nested_texts(spark, d):
    """Texts anywhere in nested JSON."""
    c = _t(spark, d, "conversations").where("text is not null")
    doc = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("type"), F.struct(F.trim("text").alias("content")).alias("inner"))).alias("blocks")))
    return c.select("conv_id", "turn", jsonl.nested_text(doc).alias("plain"))


@query("select c_custkey, c_mktsegment from customer")
def outcome_blind(spark, d):
    """The columns that may be seen before outcomes are."""
    return jsonl.allowed(_t(spark, d, "customer").drop("c_acctbal"), ["c_custkey", "c_mktsegment"], ["c_acctbal"])


@query("select vec_id, label, len(embedding) n from embeddings")
def resumed_index(spark, d):
    """An index built in two runs, the second with what the first left."""
    path, e = scratch(spark, "index"), _t(spark, d, "embeddings")
    stores.build_index(e.where("vec_id % 3 = 0"), "vec_id", lambda x: x, path)
    stores.build_index(e, "vec_id", lambda x: x, path)
    return stores.read_index(spark, path, "vec_id").select("vec_id", "label", F.size("embedding").alias("n"))


@query("select o_orderkey k, o_orderstatus s from orders")
def appended_results(spark, d):
    """A durable store that a resumed run adds to, each key once."""
    path, o = scratch(spark, "results"), _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    stores.append(o.where("k % 2 = 0"), path, "k", resume=False)
    stores.append(o, path, "k", resume=True)
    return spark.read.schema("k long, s string").json(path)


@query("select 'published' first, 'identical' again, 25 \"rows\"")
def published(spark, d):
    """A table published once; again is the same."""
    path, n = scratch(spark, "published"), _t(spark, d, "nation")
    first, again = stores.publish(n, path), stores.publish(n, path)
    return spark.read.parquet(path).agg(F.lit(first).alias("first"), F.lit(again).alias("again"), F.count("*").cast("int").alias("rows"))


@query("select n_nationkey, n_name from nation")
def csv_rows(spark, d):
    """A table as CSV with a header."""
    path = scratch(spark, "csv")
    stores.write_csv(_t(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.option("header", True).schema("n_nationkey int, n_name string").csv(path)


@query("select 29 \"lines\", '# Nations' title")
def markdown_report(spark, d):
    """A report in Markdown."""
    text = stores.markdown(_t(spark, d, "nation").orderBy("n_nationkey"), "Nations").rstrip("\n").split("\n")
    return spark.createDataFrame([Row(lines=len(text), title=text[0])], "lines int, title string")


@query("""with h as (select l_orderkey k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 r, l_partkey doc, l_suppkey page from lineitem), f as (select * from h where r < 4 and k in (select k from h where r = 3))
select k, r::int rank, doc document, page, sha256(doc || '/' || page) sha256 from f""")
def page_fixture(spark, d):
    """Four ordered pages of each question with their digests."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    h = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.row_number().over(w) - 1).alias("rank"), F.col("l_partkey").alias("document"), F.col("l_suppkey").alias("page")).where("rank < 4")
    full = h.groupBy("k").count().where("count = 4").select("k")
    pages = h.select("document", "page").distinct().withColumn("content", F.concat_ws("/", "document", "page"))
    return stores.page_fixture(h.join(full, "k", "left_semi"), pages, "k")


@query("select user_id, count(distinct event_id) seen, round(sum(value), 4) total, max(value) best from events group by 1")
def observed_cases(spark, d):
    """M3: a stream of observations replayed into each case's state, in a table that takes each batch once; the second half of the files repeats the first's last rows."""
    source, path, checkpoint = (scratch(spark, x) for x in ("events", "states", "checkpoint"))
    e = _t(spark, d, "events").select("user_id", "event_id", "value")
    e.repartition(2).write.parquet(source)
    e.where("event_id % 5 = 0").repartition(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("user_id long, event_id long, value double").option("maxFilesPerTrigger", 1).parquet(source)
    committed.written(observation.observed(stream, "user_id", "event_id", "value", spread=2), path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = observation.current(committed.committed(spark, path), "user_id")
    return out.select("user_id", "seen", F.round("total", 4).alias("total"), "best")


@query("""with a as (select user_id, event_type arm, event_id % 40 item, (event_id % 40 * 7919 % 1000) / 10.0 score from events), s as (select distinct user_id, arm, item, score from a)
select user_id, count(*)::bigint logical, count(distinct item)::bigint physical, count(*)::bigint - count(distinct item)::bigint known, max(score)::double best, 0::bigint drift from s group by 1""")
def observation_arms(spark, d):
    """M3: arms that share the physical scores of their case: what each sees counts, what is scored counts once."""
    source, path, checkpoint = (scratch(spark, x) for x in ("events", "states", "checkpoint"))
    item = F.col("event_id") % 40
    _t(spark, d, "events").select("user_id", "event_type", item.alias("item"), ((item * 7919) % 1000 / 10).alias("score")).repartition(2).write.parquet(source)
    stream = spark.readStream.schema("user_id long, event_type string, item long, score double").option("maxFilesPerTrigger", 1).parquet(source)
    states = observation.observed(stream, "user_id", "item", "score", arm="event_type", spread=2)
    committed.written(states, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = observation.current(committed.committed(spark, path), "user_id")
    return out.select("user_id", F.col("seen").alias("logical"), (F.col("seen") - F.col("known")).alias("physical"), "known", "best", "drift")


@query("select event_id, user_id, value from events")
def resumed_stream(spark, d):
    """A stream to a table, each key once, over three runs with one checkpoint and keys that come again."""
    source, path, checkpoint = scratch(spark, "in"), scratch(spark, "out"), scratch(spark, "cp")
    e = _t(spark, d, "events").select("event_id", "user_id", "value")
    for part in (e.where("event_id % 2 = 0"), e.where("event_id % 3 > 0"), e.where("event_id % 2 = 1 and event_id % 3 = 0")):
        part.write.mode("append").parquet(source)
        replay.resumed(spark.readStream.schema(e.schema).parquet(source), path, checkpoint, "event_id").awaitTermination()
    return committed.committed(spark, path)


@query("""with n as (select user_id, count(distinct event_id) n, arg_max(event_id, [value, -event_id]) best from events group by 1)
select user_id, case when n < 22 then 'seed' when n < 24 then 'control' when n < 28 then 'broad' when n < 32 then 'focus' else 'done' end phase, case when n < 22 then 22 - n when n < 24 then 24 - n when n < 28 then 28 - n when n < 32 then 32 - n else 0 end "left", case when n >= 28 and n < 32 then best end around from n""")
def next_probes(spark, d):
    """M4, M5: what each case is to observe next, from its history."""
    return replay.next_probes(_t(spark, d, "events"), "user_id", "event_id", "value")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id) n from events) where n > 1")
def measured_rows(spark, d):
    """M8: rows without each group's warm-up."""
    return replay.measured(_t(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id")


@query("select c_custkey k, c_nationkey n, strlen(c_name)::bigint \"size\", c_name \"name\" from customer where c_custkey % 3 = 0")
def zipped_rows(spark, d):
    """Members of archives read by ranges; those whose names don't begin with "a/" are never fetched."""
    path, k = scratch(spark, "zips"), F.col("c_custkey")
    rows = _t(spark, d, "customer").select("c_nationkey", F.concat(F.when(k % 3 == 0, "a/").otherwise("b/"), k.cast("string")).alias("member"), F.encode("c_name", "UTF-8").alias("content"))
    zips.write_archives(rows, path, "c_nationkey", "member", "content")
    m = zips.members(spark, path).where(F.col("name").startswith("a/"))
    number = F.regexp_extract("archive", r"(\d+)\.zip$", 1).cast("long")
    return m.select(F.substring("name", 3, 20).cast("long").alias("k"), number.alias("n"), "size", F.decode("content", "UTF-8").alias("name"))
