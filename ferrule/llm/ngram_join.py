"""N-gram Jaccard join as a blocked sparse product of the document by n-gram matrix.

1. Rows with equal n-gram sets fall into one class, told by set size and two
   64-bit digests; only classes go on.
2. The matrix is cut by columns into blocks: a set of over ``_most_block`` n-grams
   is split by hash into a power of two of blocks. If two sets have Jaccard >= t,
   so has one of their blocks at least, as overlaps and unions add up over
   blocks. Sets near a power's limit are split both ways, so that any two that
   could link by size have one splitting in common.
3. Bounds from set sizes cut each block: two blocks of sizes x and y overlap in
   a = ceil(t (x + y) / (1 + t)) n-grams, so in any one order of all n-grams the
   first common one is among the first x - a + 1 of the one and y - a + 1 of the
   other. N-grams that are frequent in a bounded sample come last in the order
   (the order affects work only). Columns with one class go.
4. Of each column a spanning forest is kept of the pairs that sizes, places and
   the block's parity sketch leave, never the pairs themselves; the sketch's
   differing bits bound the symmetric difference from below. A task keeps one
   forest for all its columns, so that it returns fewer links than it has
   classes. Long columns are cut into square tiles.
5. Components of these forests hold every link within one component. Each
   component's rows are multiplied with themselves in tiles of bounded size:
   the product's entries are the exact overlap counts. Links are counted and
   kept as forests.
6. Components of the links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._common import complete_groups, connected_components, fixed_bytes, flat_bytes, mix64, small_enough, stage, tidied, word_blocks

SKETCH_BITS = 256
#: Bounds of the sample that finds frequent n-grams, of a column's tile, and of a component's tile.
SAMPLE_DOCS, FREQUENT_SHARE = 16_000, 0.001
COLUMN_TILE, TILE_CLASSES, TILE_GRAMS = 4_096, 256, 400_000
#: Columns of up to this many classes are compared in bulk, longer ones class by class: the same links, another loop.
BULK = 48
#: A task's forest is put out and begun anew at this many classes.
MOST_NODES = 2_000_000
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _most_block(percent: int) -> int:
    """Largest block whose pairs at the threshold differ in at most 0.29 of the sketch's bits; unlike blocks differ in about half of them."""
    return max(16, SKETCH_BITS * 29 // 100 * (100 + percent) // (2 * (100 - percent))) if percent < 100 else 1 << 40


def _splittings(n: int, percent: int) -> range:
    """Powers of two of the blocks that a set of ``n`` is split into: its own, up to that of the largest set it may link to."""
    most = _most_block(percent)
    own, largest = (max(0, (-(-x // most) - 1).bit_length()) for x in (n, n * 100 // percent))
    return range(own, largest + 1)


def _least_overlap(total, percent: int):
    return (percent * total + 99 + percent) // (100 + percent)


def _sets(column, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-gram hashes of each row."""
    for block in word_blocks(column):
        grams, off = block.grams(n)
        for a, b in zip(off[:-1], off[1:], strict=True):
            yield np.unique(grams[a:b])


def _digests(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0))
        b = np.add.reduce(mix64(s ^ np.uint64(0x14057B7EF767814F)), initial=np.uint64(0))
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))


def _sketch(s: np.ndarray) -> bytes:
    return np.packbits(np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1).tobytes()


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """N-grams in at least FREQUENT_SHARE of a sample of SAMPLE_DOCS rows; at most a few hundred a row on average."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * SAMPLE_DOCS)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), n))
            if sets:
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], names=["h", "c"])

    counts = chosen.mapInArrow(grams, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= max(10, int(FREQUENT_SHARE * SAMPLE_DOCS)))
    found = counts.select("h").limit(500_000).toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def _blocks(s: np.ndarray, last: np.ndarray, percent: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(size, sketch, first n-grams in order) of the blocks of a set, in all its splittings; n-grams are marked by their splitting."""
    for e in _splittings(len(s), percent):
        cuts = np.searchsorted(s, np.arange(1, 1 << e, dtype=np.uint64) << np.uint64(64 - e)) if e else ()
        for part in np.split(s, cuts):
            m = len(part)
            if m:
                take, first = m - (percent * m + 99) // 100 + 1, part
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, part), len(last) - 1)] == part
                    first = np.concatenate((part[~late][:take], part[late])) if late.any() else part
                yield m, _sketch(part), first[:take] + np.uint64(e) * _SALT


def _described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, n, s1, s2) of each row, and its blocks: sizes, sketches, counts of first n-grams, and these."""
    last = _frequent(docs, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, sketches, sizes, counts, firsts, blocks = [], [], [], [], [], [], [], []
            for s in _sets(batch.column(1), n):
                size.append(len(s))
                a, b = _digests(s)
                one.append(a)
                two.append(b)
                found = list(_blocks(s, last, percent))
                blocks.append(len(found))
                sketches.append(b"".join(x[1] for x in found))
                sizes += [x[0] for x in found]
                counts += [len(x[2]) for x in found]
                firsts.append(np.concatenate([x[2] for x in found]) if found else np.zeros(0, np.uint64))
            lists = lambda lengths, flat, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat, kind))
            flat = np.concatenate(firsts).view(np.int64) if firsts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sketches, pa.binary()),
                 lists(blocks, sizes, pa.int32()), lists(blocks, counts, pa.int32()), lists([len(f) for f in firsts], flat, pa.int64())],
                names=["id", "n", "s1", "s2", "sketches", "sizes", "counts", "first"],
            )

    return docs.mapInArrow(tidied(run), "id long, n int, s1 long, s2 long, sketches binary, sizes array<int>, counts array<int>, first array<long>")


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per first n-gram: (h, pos, rep, s1, block)."""
    for batch in batches:
        counts, blocks = _numbers(batch.column(3))
        h, _ = _numbers(batch.column(4))
        block = np.arange(len(counts)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        pos = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
        rep, s1 = (np.repeat(np.repeat(batch.column(c).to_numpy(), blocks), counts) for c in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(pos.astype(np.int32)), pa.array(rep), pa.array(s1), pa.array(np.repeat(block, counts).astype(np.int32))], names=["h", "pos", "rep", "s1", "block"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per block: (rep, s1, block, n, m, sketch)."""
    for batch in batches:
        sizes, blocks = _numbers(batch.column(4))
        block = np.arange(len(sizes)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        width = SKETCH_BITS // 8
        data, off = flat_bytes(batch.column(3))
        flat = data[off[0] : off[-1]]
        sketch = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((np.arange(len(sizes) + 1, dtype=np.int64) * width).tobytes()), pa.py_buffer(flat.tobytes())]).cast(pa.binary())
        rep, s1, n = (pa.array(np.repeat(batch.column(c).to_numpy(), blocks)) for c in (0, 1, 2))
        yield pa.RecordBatch.from_arrays([rep, s1, pa.array(block.astype(np.int32)), n, pa.array(sizes.astype(np.int32)), sketch], names=["rep", "s1", "block", "n", "m", "sketch"])


class _Forest:
    """Union of indexes by label, with the edges that joined something."""

    def __init__(self, m: int):
        self.label, self.edges = np.arange(m), []

    def join(self, i: int, js: np.ndarray) -> None:
        labels = self.label[js]
        roots, at = np.unique(labels, return_index=True)
        new = roots != self.label[i]
        if new.any():
            self.edges += [(i, int(j)) for j in js[at[new]]]
            self.label[np.isin(self.label, roots[new])] = self.label[i]


class _Union:
    """Classes met by a task: the least class that each is joined to."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = z = up.get(y, y)
            x = z
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def links(self) -> pa.RecordBatch:
        nodes = list(self.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.root(x) for x in nodes], pa.int64())], names=["a", "b"])


def _column_forests(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Union()
        for table, cuts in complete_groups(batches, ["h", "ti", "tj"]):
            rep, n, m, part, pos = (table.column(c).to_numpy() for c in ("rep", "n", "m", "part", "pos"))
            sketch = fixed_bytes(table.column("sketch"), SKETCH_BITS // 8).view(np.uint64)
            cross = table.column("ti").to_numpy() != table.column("tj").to_numpy()
            n, m, left = n.astype(np.int64), m.astype(np.int64), (m - pos).astype(np.int64)

            def may_link(a, b):
                """Which of the pairs (a, b) sizes, places and sketches leave."""
                total = m[a] + m[b]
                ok = (np.minimum(left[a], left[b]) >= _least_overlap(total, percent)) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
                ok = np.flatnonzero(ok & (rep[a] != rep[b]))
                a, b = (a if np.ndim(a) == 0 else a[ok]), b[ok]
                odd = np.bitwise_count(sketch[a] ^ sketch[b]).sum(-1, dtype=np.int64)
                return ok[odd * (100 + percent) <= total[ok] * (100 - percent)]

            sizes = np.diff(cuts)
            short = ~cross[cuts[:-1]] & (sizes <= BULK)
            for size in np.unique(sizes[short & (sizes > 1)]):
                i, j = np.triu_indices(size, 1)
                starts = cuts[:-1][short & (sizes == size)]
                step = max(1, 500_000 // len(i))
                for k in range(0, len(starts), step):
                    a, b = (starts[k : k + step, None] + i).ravel(), (starts[k : k + step, None] + j).ravel()
                    ok = may_link(a, b)
                    if len(ok):
                        pairs = np.stack([rep[a[ok]], rep[b[ok]]], 1)
                        pairs.sort(1)
                        for x, y in np.unique(pairs, axis=0).tolist():
                            forest.join(x, y)
            for g in np.flatnonzero(~short):
                _long_column(np.arange(cuts[g], cuts[g + 1]), rep, part, bool(cross[cuts[g]]), may_link, forest)
            if len(forest.up) > MOST_NODES:
                yield forest.links()
                forest = _Union()
        if forest.up:
            yield forest.links()

    return run


def _long_column(rows: np.ndarray, rep: np.ndarray, part: np.ndarray, cross: bool, may_link, forest: _Union) -> None:
    """Joins what may link in a column or tile; a class is compared with one class of each tree first, then with those of other trees only."""
    label = np.array([forest.root(x) for x in rep[rows].tolist()])
    side = part[rows]

    def merge(k: int, others: np.ndarray) -> None:
        for j in others.tolist():
            a, b = label[k], label[j]
            if a != b:
                forest.join(int(rep[rows[k]]), int(rep[rows[j]]))
                label[label == b] = a

    for k in range(1, len(rows)):
        others = np.flatnonzero((label[:k] != label[k]) & (side[:k] != side[k])) if cross else np.flatnonzero(label[:k] != label[k])
        if not len(others):
            continue
        heads = others[np.unique(label[others], return_index=True)[1]]
        merge(k, heads[may_link(rows[k], rows[heads])])
        others = others[label[others] != label[k]]
        if len(others):
            merge(k, others[may_link(rows[k], rows[others])])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs: the incidence matrix times its transpose, a block of columns at a time."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    _, cols, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    keep = shared[cols]
    rows, cols = rows[keep], number[cols[keep]]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((m, m), np.float64)
    width = max(1024, (1 << 21) // m)
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(cols, (at, at + width))
        block = np.zeros((m, width), np.float32)
        block[rows[a:b], cols[a:b] - at] = 1
        out += block @ block.T
    return np.rint(out).astype(np.int64)


def _tile_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in complete_groups(batches, ["cluster", "ti", "tj"]):
            rep, part, copies, s1 = (table.column(c).to_numpy() for c in ("rep", "part", "copies", "s1"))
            cross = table.column("ti").to_numpy() != table.column("tj").to_numpy()
            data, off = flat_bytes(table.column("grams"))
            out: list[tuple[int, int, int]] = []
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                rows = np.arange(start, end)
                rows = rows[np.concatenate(([True], (rep[rows[1:]] != rep[rows[:-1]]) | (s1[rows[1:]] != s1[rows[:-1]])))]  # repeated rows
                if len(rows) < 2:
                    continue
                sets = [data[off[r] : off[r + 1]].view(np.uint64) for r in rows]
                if len(rows) == 2:
                    overlap = np.zeros((2, 2), np.int64)
                    overlap[0, 1] = overlap[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
                else:
                    overlap = _overlaps(sets)
                n = np.array([len(s) for s in sets])
                link = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap)
                np.fill_diagonal(link, False)
                if cross[start]:
                    link &= part[rows, None] != part[None, rows]
                ids, weight = rep[rows], copies[rows]
                link &= ids[:, None] != ids[None, :]
                linked = link @ weight
                out += [(int(ids[i]), None, int(linked[i])) for i in np.flatnonzero(linked)]
                forest = _Forest(len(rows))
                for i in range(1, len(rows)):
                    js = np.flatnonzero(link[i, :i])
                    if len(js):
                        forest.join(i, js)
                out += [(int(ids[i]), int(ids[j]), 0) for i, j in forest.edges]
            if out:
                a, b, links = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(links, pa.int64())], names=["a", "b", "links"])

    return run


def _tiled(df: DataFrame, tiles, by: str) -> DataFrame:
    """Copies of each row for the tiles (ti <= tj) of a square that its part ``part`` of ``tiles`` takes a share in."""
    df = df.withColumn("g", tiles.cast("int")).withColumn("part", F.pmod(F.xxhash64(by, F.lit(17)), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least("part", x).alias("ti"), F.greatest("part", x).alias("tj")))
    return df.withColumn("t", F.explode(pairs)).withColumn("ti", F.col("t.ti")).withColumn("tj", F.col("t.tj")).drop("t", "g")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, n_links, component_id) of every row of ``docs``.

    Two rows link when 100 * overlap >= ``percent`` * union of their sets of
    ``n``-word shingles (fewer words: all of them as one). ``n_links`` counts the
    other rows linked, copies included; ``component_id`` is the smallest id
    reachable. Null and empty texts have no shingles and no links. Rows that
    repeat an id are returned each, and with one text are one node; rows with a
    null id have null components. Texts are read whole, an empty table gives an
    empty one, and other columns don't matter.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    described = stage(_described(rows, n, percent), "ngram-described")
    known = described.where("id is not null and n > 0")
    classes = stage(known.groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies")), "ngram-classes")
    heads = known.alias("k").join(classes.alias("c"), (F.col("k.id") == F.col("c.rep")) & (F.col("k.s1") == F.col("c.s1")) & (F.col("k.s2") == F.col("c.s2")))
    heads = stage(heads.select("rep", "k.s1", F.col("k.n").alias("n"), "sketches", "sizes", "counts", "first"), "ngram-heads")

    firsts = heads.select("rep", "s1", "n", "counts", "first").mapInArrow(_cells, "h long, pos int, rep long, s1 long, block int")
    columns = firsts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    parts = heads.select("rep", "s1", "n", "sketches", "sizes").mapInArrow(_parts, "rep long, s1 long, block int, n int, m int, sketch binary")
    cells = firsts.join(columns, "h").join(parts, ["rep", "s1", "block"])
    cells = _tiled(cells, F.ceil(F.col("c") / COLUMN_TILE), "rep").select("h", "ti", "tj", "part", "rep", "n", "m", "pos", "sketch")
    cells = cells.repartition("h", "ti", "tj").sortWithinPartitions("h", "ti", "tj")
    near = cells.mapInArrow(tidied(_column_forests(percent)), "a long, b long")
    clusters = connected_components(near).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))

    chosen = classes.select("rep", "s1", "s2", "n", "copies").join(clusters, "rep")
    sizes = chosen.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("total"))
    tiles = F.greatest(F.ceil(F.col("m") / TILE_CLASSES), F.ceil(F.col("total") / TILE_GRAMS))
    chosen = stage(chosen.join(sizes, "cluster").withColumn("tiles", tiles), "ngram-chosen")
    few = small_enough(chosen)
    wanted = chosen.select(F.col("rep").alias("id"))
    texts = rows.join(F.broadcast(wanted.distinct()) if few else wanted.distinct(), "id", "left_semi")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(1), n))
            digests = [_digests(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["rep", "s1", "s2", "grams"],
            )

    sets = texts.mapInArrow(tidied(grams), "rep long, s1 long, s2 long, grams binary")
    small = chosen.select("rep", "s1", "s2", "cluster", "copies", "tiles")
    cells = sets.join(F.broadcast(small) if few else small, ["rep", "s1", "s2"])
    cells = _tiled(cells, F.col("tiles"), "rep").select("cluster", "ti", "tj", "part", "rep", "s1", "copies", "grams")
    cells = cells.repartition("cluster", "ti", "tj").sortWithinPartitions("cluster", "ti", "tj", "rep", "s1")
    links = stage(cells.mapInArrow(tidied(_tile_links(percent)), "a long, b long, links long"), "ngram-links")

    groups = connected_components(links.where("b is not null").select("a", "b"))
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")).where("links > 0")
    per_class = classes.join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    per_class = per_class.select("s1", "s2", F.col("n").alias("m"), F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("component", "rep")).toDF("s1", "s2", "m", "n_links", "found")
    d = described.alias("d").join(per_class.alias("p"), (F.col("d.s1") == F.col("p.s1")) & (F.col("d.s2") == F.col("p.s2")) & (F.col("d.n") == F.col("p.m")), "left")
    return d.select(
        F.col("d.id").alias(id_column), F.col("d.n").cast("long").alias("n_shingles"),
        F.when(F.col("d.id").isNotNull(), F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("d.id").isNotNull(), F.coalesce("found", "d.id")).alias("component_id"),
    )
