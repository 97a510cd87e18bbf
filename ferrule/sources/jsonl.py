"""JSON-lines and JSON-document sources, strict and lenient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))


def strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a blank line, one that isn't an object or one that doesn't parse is an error."""
    text = F.trim(F.regexp_replace("value", r"(?U)\s", " "))
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.left("value", F.lit(80)))).cast("string")
    checked = F.when(~(text.startswith("{") & text.endswith("}")), bad).otherwise(F.col("value"))
    return _lines(spark, path).select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are passed over, fields that don't parse are null."""
    return _lines(spark, path).where(F.col("value").rlike(r"(?U)\S")).select(F.from_json("value", schema).alias("r")).select("r.*")


def violations(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, n): lines that the strict reader refuses, counted by file and kind."""
    text = F.trim("value")
    kind = F.when(~F.col("value").rlike(r"(?U)\S"), "blank").when(~text.startswith("{"), "not an object").when(F.try_parse_json("value").isNull(), "malformed")
    return _lines(spark, path).select(F.col("_file").alias("file"), kind.alias("kind")).where("kind is not null").groupBy("file", "kind").agg(F.count("*").alias("n"))


def keyed_rows(documents: DataFrame, text: str, schema: str, key: str = "qid", alias: str = "question_id") -> DataFrame:
    """Rows of JSON documents that are {key: row}, one row, or [row, ...]; a row's key is its own, its alias, or that of the mapping.

    A row without a key is an error.
    """
    t = F.trim(F.col(text))
    listed = F.when(t.startswith("["), F.transform(F.from_json(t, "array<string>"), lambda r: F.struct(F.lit(None).cast("string").alias("k"), r.alias("r"))))
    single = F.coalesce(F.get_json_object(t, f"$.{key}"), F.get_json_object(t, f"$.{alias}")).isNotNull()
    mapped = F.transform(F.map_entries(F.from_json(t, "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("r")))
    rows = F.when(t.startswith("["), listed).when(single, F.array(F.struct(F.lit(None).cast("string").alias("k"), t.alias("r")))).otherwise(mapped)
    found = documents.select(F.posexplode(rows).alias("place", "x"))
    own = F.coalesce(F.get_json_object("x.r", f"$.{key}"), F.get_json_object("x.r", f"$.{alias}"), F.col("x.k"))
    named = F.when(own.isNull() | (own == ""), F.raise_error(F.lit(f"a row without {key}")).cast("string")).otherwise(own)
    return found.select(named.alias(key), "place", F.from_json("x.r", schema).alias("row"))


def allowed(df: DataFrame, columns: list[str], forbidden: list[str]) -> DataFrame:
    """The columns that may be seen before outcomes are known; a forbidden one that is present is an error, as is one that is missing."""
    there = set(df.columns)
    if there & set(forbidden) or not set(columns) <= there:
        raise ValueError(f"outcome columns {sorted(there & set(forbidden))}, missing columns {sorted(set(columns) - there)}")
    return df.select(*columns)


def reconciled(listed: DataFrame, key: str, spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(kind, key): listed documents without a file, and files that aren't listed; only names of files are read."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(folder).select("path")
    files = names.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).select(F.left("name", F.length("name") - len(suffix)).alias(key))
    missing = listed.select(key).join(files, key, "left_anti").select(F.lit("missing file").alias("kind"), key)
    return missing.union(files.join(listed.select(key), key, "left_anti").select(F.lit("unlisted file"), key))


_BLOCK = "struct<type:string,bbox:array<double>,content:string>"
LAYOUT = f"struct<pdf_info:array<struct<page_idx:int,page_size:array<double>,para_blocks:array<{_BLOCK}>>>>"


def layout_regions(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, reading_order, type, x0..y1 in the unit square, content) of layout documents; the order of reading is the place in the array."""
    pages = documents.select(key, F.explode(F.from_json(text, LAYOUT)["pdf_info"]).alias("p"))
    blocks = pages.select(key, F.col("p.page_idx").alias("page"), F.col("p.page_size").alias("size"), F.posexplode("p.para_blocks").alias("reading_order", "b"))
    edge = lambda i: (F.get("b.bbox", i) / F.get("size", i % 2)).alias(("x0", "y0", "x1", "y1")[i])
    return blocks.select(key, "page", "reading_order", F.col("b.type").alias("type"), *[edge(i) for i in range(4)], F.col("b.content").alias("content"))


def uncovered_pages(regions: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(kind, key, page): expected pages that the layout lacks, and layout pages that aren't expected."""
    there = regions.select(key, "page").distinct()
    missing = pages.join(there, [key, "page"], "left_anti").select(F.lit("no layout").alias("kind"), key, "page")
    return missing.union(there.join(pages, [key, "page"], "left_anti").select(F.lit("unexpected page"), key, "page"))


def nested_text(document: Column) -> Column:
    """All "content" and "html" texts anywhere in a JSON text, in order, joined by spaces."""
    found = F.regexp_extract_all(document, F.lit(r'"(?:content|html)"\s*:\s*"((?:[^"\\]|\\.)*)"'), 1)
    plain = F.transform(found, lambda x: F.coalesce(F.get(F.from_json(F.concat(F.lit('["'), x, F.lit('"]')), "array<string>"), 0), x))
    return F.array_join(plain, " ")
