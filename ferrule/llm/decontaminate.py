"""Benchmark decontamination with DataFrame functions only.

Items and documents are hashed to five-word shingles. Where a document's
shingle is one of an item's, the item-sized window that puts the two in line is
cut out; windows without an item's shingle have similarity 0 and are passed
over. Windows and items get a 64-bit SimHash over their shingles, weighted by
occurrence. Items' fingerprints are indexed by blocks of bits with all values
one bit away, so that every pair within the radius meets in a block; pairs that
do are verified by the exact weighted Jaccard similarity of their shingles.

The items' table is broadcast in blocks of at most ``MOST_SHINGLES`` shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm._common import stage, without

WORDS, SIMILARITY, RADIUS = 5, 0.8, 19
#: Blocks of the fingerprint: one more than half the radius, so one differs in one bit at most.
BLOCKS = 10
MOST_SHINGLES = 1_000_000


def shingles(table: DataFrame, text_column: str) -> DataFrame:
    """Adds ``s``, the hashes of consecutive five-word shingles of the text (fewer words: all as one; none: empty).

    Words are runs of letters and digits in lower case.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text_column).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    hashed = table.withColumn("_w", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_w")
    full = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WORDS)]))
    one = F.array(F.xxhash64(F.col("_w"), F.lit(1)))
    return hashed.withColumn("s", F.when(n >= WORDS, full).when(n > 0, one).otherwise(F.array().cast("array<bigint>"))).withColumn("_n", n).drop("_w")


def simhash(s: Column) -> Column:
    """64-bit SimHash of an array of hashes: a bit is the majority over all occurrences (a tie is 0)."""

    def bit(b: Column) -> Column:
        ones = F.aggregate(s, F.lit(0), lambda acc, x: acc + F.call_function("bit_get", x, b).cast("int"))
        return F.when(ones * 2 > F.size(s), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b)))


def _blocks() -> list[tuple[int, int]]:
    cuts = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _block_values(fingerprint: Column, probes: bool) -> Column:
    """Structs (block, value) of a fingerprint; with ``probes``, all values at one bit's distance too."""
    out = []
    for i, (at, width) in enumerate(_blocks()):
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        flips = [0, *(1 << b for b in range(width))] if probes else [0]
        out += [F.struct(F.lit(i).alias("block"), value.bitwiseXOR(F.lit(f).cast("long")).alias("value")) for f in flips]
    return F.array(*out)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser by the sum of the greater occurrences, over all shingles of two arrays."""

    def times(array: Column, x: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda acc, y: acc + F.when(y == x, 1).otherwise(0))

    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """(id, item_id, similarity, start_word, n_words): the best window of each item in each document, if similar enough.

    Items and documents without words, and rows with null ids, match nothing.
    Rows that repeat an id are one document (or item): the best of all counts;
    of equally good windows, the first. Texts are read whole; an empty table
    gives an empty one, and other columns don't matter.
    """
    items = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("long").alias("item"), F.col(item_text_column).alias("_t"))
    items = shingles(items, "_t").select("item", F.col("s").alias("si"), F.size("s").alias("m"), F.col("_n").alias("item_words"), simhash(F.col("s")).alias("fi"))
    items = stage(items, "decontaminate-items").where("m > 0")
    total = items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    parts = max(1, -(-total // MOST_SHINGLES))
    rows = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("_t"))
    rows = shingles(rows, "_t").select("id", "s")
    found = [_matches(rows, items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == p), similarity) for p in range(parts)]
    best = reduce(DataFrame.union, found).groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("lo")).alias("at"), "item_words")).alias("b"))
    return best.select(
        F.col("id").alias(id_column), F.col("item").alias(item_column), "b.similarity", (-F.col("b.at")).alias("start_word"), F.col("b.item_words").alias("n_words")
    )


def _matches(rows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    anchors = items.select("item", "m", F.posexplode("si").alias("o", "h"), F.col("si"))
    anchors = anchors.select("m", "o", "h", F.when(F.col("o") > 0, F.get("si", F.col("o") - 1)).alias("before")).distinct()
    # posexplode_outer: the filter on size(s) that posexplode would add is pushed below
    # the projections and brings their whole expressions into each other's loops.
    placed = rows.select("id", "s", F.posexplode_outer("s").alias("pos", "h")).join(F.broadcast(anchors), "h")
    # One window for each run of shingles in line, at the run's first shingle.
    placed = placed.where("before is null or pos = 0 or get(s, pos - 1) <> before")
    placed = placed.withColumn("lo", F.greatest(F.col("pos") - F.col("o"), F.lit(0))).withColumn("hi", F.least(F.col("pos") - F.col("o") + F.col("m"), F.size("s")))
    windows = placed.select("id", "m", "lo", F.slice("s", F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("win"))
    # Written tables between the steps also keep the optimiser from pushing a step's expressions into the one below.
    windows = stage(windows, "decontaminate-windows").distinct()
    windows = stage(windows.withColumn("f", simhash(F.col("win"))), "decontaminate-fingerprints")
    windows = windows.select("*", F.explode(_block_values(F.col("f"), False)).alias("b"))
    index = items.select("item", "m", "item_words", "si", "fi", F.explode(_block_values(F.col("fi"), True)).alias("b"))
    pairs = windows.join(index, ["m", "b"]).where(F.bit_count(F.col("f").bitwiseXOR(F.col("fi"))) <= RADIUS)
    pairs = pairs.groupBy("id", "lo", "item").agg(F.first("win").alias("win"), F.first("si").alias("si"), F.first("item_words").alias("item_words"))
    scored = pairs.withColumn("similarity", weighted_jaccard(F.col("win"), F.col("si")))
    return scored.where(F.col("similarity") >= similarity).select("id", "item", "similarity", "lo", "item_words")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", **columns) -> DataFrame:
    """``docs`` without the documents that hold an item; rows with null ids stay."""
    return without(docs, contaminated(docs, benchmark, similarity, id_column=id_column, **columns).select(id_column), id_column)
