"""Exact Jaccard join of word-shingle sets in metric space: pivots, regions, windows, recursion.

1 - Jaccard is a metric, but in it nearly every document is at distance 1 from any pivot, so
pivots that are documents divide nothing at first. The first pivots are therefore sets of one
shingle: the distance from {s} is below 1 only for holders of s. A document lies in the regions
of its rarest shingles, so many of them that two documents within the radius share one
(``overlap >= 0.8 * max(sizes)`` leaves no other way). In a region the pivot is then a
document, the one with the fewest shingles rarer than s. Distances from it

* link documents within the radius,
* divide the region into rings one radius wide; by the triangle inequality partners lie in the
  same or the next ring, so each document is also copied over the boundary into the next,
* and the rings are joined by the same steps. Regions whose documents are one component are
  done, small ones have their pairs compared, and what neither pivots nor rings could divide is
  compared block by block: nothing is left out.

Before the texts of a pair are compared, counts of shingles by hash class bound their overlap
from above: that map of sets to vectors shrinks distances, never stretches them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.arrays import giving_back, packed, spans, text_slices
from fleetlens.llm.common import commonest, join_by_key, private, stored, text_or_empty
from fleetlens.llm.components import components
from fleetlens.llm.shingles import WIDTH, mixed, shingle_sets, sums_by_row

SIMILAR = 80            # percent
COMMON = 1 << 17        # so many of the commonest shingles are told apart by their counts
SLICE = 8 << 20
CELLS = 256             # hash classes of the bounding counts
SMALL_REGION = 12       # regions of this size have all their pairs compared at once
RING_REGION = 48        # larger regions are divided into rings
MEMBERS = 200           # documents that are compared with one copy of their pivot
BLOCK = 64              # documents of a block, where a region is compared block by block
PIVOT_ROUNDS = 2
SALTS = 64
HOT_ROWS = 1000         # shingles seen more often are dealt over SALTS tasks

SETS = "id long, n long, k long, k2 long, counts binary, common binary"


def _sets(width: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per document, and one per slice (null id) with shingles that it has repeatedly."""
        for part in text_slices(batches, "text", SLICE):
            flat, ends = shingle_sets(part.column("text"), width)
            rows, sizes = len(ends) - 1, np.diff(ends)
            cell = np.repeat(np.arange(rows), sizes) * CELLS + (flat & np.uint64(CELLS - 1)).astype(np.int64)
            counts = np.minimum(np.bincount(cell, minlength=rows * CELLS), 255).astype(np.uint8)
            keys = sums_by_row(mixed(flat, 1), ends).astype(np.int64)
            keys2 = sums_by_row(mixed(flat, 2), ends).astype(np.int64)
            values, often = np.unique(flat, return_counts=True)
            again = often > 1
            common = np.empty((int(again.sum()), 2), np.uint64)
            common[:, 0], common[:, 1] = values[again], often[again]
            ids = pa.concat_arrays([part.column("id"), pa.nulls(1, pa.int64())])
            none = pa.nulls(rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.append(sizes, -1)), pa.array(np.append(keys, 0)),
                 pa.array(np.append(keys2, 0)),
                 packed(np.append(counts, []).astype(np.uint8), np.append(np.arange(rows + 1) * CELLS, rows * CELLS)),
                 pa.concat_arrays([none, pa.array([common.tobytes()], pa.binary())])],
                names=["id", "n", "k", "k2", "counts", "common"])
    return run


@giving_back
def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("common").to_pylist():
            pairs = np.frombuffer(cell, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["s", "n"])


def common_shingles(sets: DataFrame, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` shingles with counts. Only the order of shingles comes from them: which
    pairs are found does not depend on it, how many regions are large does."""
    counted = sets.filter("n = -1").select("common").mapInArrow(_unpack, "s long, n long")
    rows = commonest(counted.groupBy("s").agg(F.sum("n").alias("n")), "n", most).toArrow()
    shingles = rows.column("s").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows.column("n").to_numpy()[order]


def least_overlap(n, similar: int):
    """The smallest overlap of a set of n with any similar one: ceil(similar * n / 100)."""
    return -(-n * similar // 100)


def _entries(known, width: int, similar: int, hot: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = known.value
        for part in text_slices(batches, "text", SLICE):
            flat, ends = shingle_sets(part.column("text"), width)
            sizes = np.diff(ends)
            keys = sums_by_row(mixed(flat, 1), ends).astype(np.int64)
            _, once = np.unique(keys, return_index=True)
            once = once[sizes[once] > 0]
            often = np.zeros(len(flat), np.int64)
            if len(shingles):
                at = np.minimum(np.searchsorted(shingles, flat), len(shingles) - 1)
                hit = np.flatnonzero(shingles[at] == flat)
                often[hit] = counts[at[hit]]
            if not len(once):
                continue
            order = np.arange(len(flat))
            for row in np.unique(np.searchsorted(ends, np.flatnonzero(often), "right") - 1).tolist():
                a, b = int(ends[row]), int(ends[row + 1])
                order[a:b] = a + np.argsort(often[a:b], kind="stable")
            lengths = sizes[once] - least_overlap(sizes[once], similar) + 1
            at = order[spans(ends[once], lengths)]
            owner = np.repeat(keys[once], lengths)
            salt = np.where(often[at] > hot, 1 + owner % (SALTS - 1), 0).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[at].view(np.int64)), pa.array(salt), pa.array(owner),
                 pa.array(np.repeat(sizes[once], lengths).astype(np.int32)),
                 pa.array(spans(np.zeros(len(lengths), np.int64), lengths).astype(np.int32))],
                names=["s", "salt", "k", "n", "pos"])
    return run


def regions(entries: DataFrame, similar: int) -> DataFrame:
    """(rid, k, n, pos): the holders of each shingle that has more than one. Shingles with the
    same holders make one region."""
    by_shingle = Window.partitionBy("s", "salt")
    shared = stored(
        entries.repartition("s", "salt").dropDuplicates(["s", "salt", "k"])
        .withColumn("size", F.count("*").over(by_shingle)).filter("size > 1 or salt > 0")
        .select(F.col("s").alias("rid"), "k", "n", "pos"), "jaccard-holders")
    stats = stored(shared.groupBy("rid").agg(
        F.count("*").alias("n"), F.min("n").alias("least"),
        F.sum(F.xxhash64("k") % (1 << 40)).alias("sign")).filter("n > 1"), "jaccard-shingles")
    holders = join_by_key(shared.withColumnRenamed("n", "size"), stats, ["rid"], max(1, shared.count()))
    # overlap >= similar / (100 + similar) * (size + m), where m is at least ``other``: a holder
    # with too many rarer shingles to leave that overlap has no partner here
    other = F.greatest("least", F.ceil(F.col("size") * similar / 100))
    able = holders.filter((F.col("size") - F.col("pos")) * (100 + similar) >= (F.col("size") + other) * similar)
    return able.groupBy(F.xxhash64("n", "sign").alias("rid"), "k").agg(
        F.first("size").alias("n"), F.min("pos").alias("pos"))


def _could_be_similar(similar: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS)
                    for c in ("ca", "cb"))
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            overlap = np.minimum(a, b).sum(1, dtype=np.int64)
            full = (np.maximum(a, b) == 255).any(1)
            keep = full | (overlap * (100 + similar) >= (n + m) * similar)
            keep |= batch.column("ring").to_numpy(zero_copy_only=False)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _compare(width: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (b, part), the pivot's text first: a, b, overlap, union."""
        pivot, pivot_set = None, np.empty(0, np.uint64)
        for part in text_slices(batches, "text", 2 << 20):
            flat, ends = shingle_sets(part.column("text"), width)
            keys = sums_by_row(mixed(flat, 1), ends).astype(np.int64)
            out = []
            for i, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist())):
                own = flat[ends[i]:ends[i + 1]]
                if keys[i] != a:        # another text under the same id
                    continue
                if a == b:
                    pivot, pivot_set = b, own.copy()
                elif pivot == b:
                    same = len(np.intersect1d(own, pivot_set, assume_unique=True))
                    out.append((a, b, same, len(own) + len(pivot_set) - same))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "same", "all"])
    return run


def distances(pairs: DataFrame, texts: DataFrame, counts: DataFrame, width: int, similar: int) -> DataFrame:
    """(a, b, same, all) of the pairs (a, b, ring): the sizes of intersection and union of
    their sets. Pairs whose sizes or counts by cell rule out a link are skipped, unless the
    distance is wanted for a ring. b is the pivot: the documents a are dealt into parts of
    MEMBERS, each with its copy of the pivot's text, which is read first."""
    pivots = stored(pairs.groupBy("b").agg(F.count("*").alias("n")).join(
        counts.select(F.col("k").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb")), "b"), "jaccard-pivots")
    own = counts.select(F.col("k").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    sized = join_by_key(pairs.join(own, "a"), pivots, ["b"], max(1, pairs.count())).filter(
        F.col("ring") | (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * similar))
    likely = stored(sized.select("a", "b", "na", "nb", "ca", "cb", "ring").mapInArrow(
        _could_be_similar(similar), "a long, b long"), "jaccard-likely")
    parts = stored(likely.groupBy("b").agg(F.count("*").alias("n")).withColumn(
        "parts", F.ceil(F.col("n") / MEMBERS).cast("int")), "jaccard-parts")
    copies = parts.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = join_by_key(likely, parts, ["b"], max(1, likely.count())).select("a", "b", (F.abs(F.xxhash64("a")) % F.col("parts")).cast("int").alias("part"))
    rows = dealt.unionByName(copies).join(texts.withColumnRenamed("k", "a"), "a")
    ordered = rows.repartition("b", "part").sortWithinPartitions("b", "part", F.col("a") != F.col("b"))
    return stored(ordered.select("a", "b", "text").mapInArrow(
        _compare(width), "a long, b long, same long, all long"), "jaccard-distances")


def jaccard_components(docs: DataFrame, similar: int = SIMILAR, width: int = WIDTH, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row of ``docs``: the distinct shingles of its text,
    and the smallest id that is reached over links between sets with ``100 * intersection >=
    similar * union``.

    Null texts, empty texts and texts without words have no shingles and no links: they are
    their own component. Rows with equal sets are one class and are compared once, so repeated
    rows add no work; rows without an id take no part and get a null component. No rows, no
    result; other columns are not looked at; texts are never cut.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    sets = stored(rows.mapInArrow(_sets(width), SETS), "jaccard-sets")
    own = sets.filter("n >= 0")
    classes = stored(own.filter("n > 0 and id is not null").groupBy("k", "k2").agg(
        F.min("id").alias("first"), F.count("*").alias("members"), F.first("n").alias("n"),
        F.first("counts").alias("counts")), "jaccard-classes")

    known = docs.sparkSession.sparkContext.broadcast(common_shingles(sets))
    entries = rows.filter("id is not null").mapInArrow(
        _entries(known, width, similar, HOT_ROWS), "s long, salt int, k long, n int, pos int")
    active = stored(regions(entries, similar), "jaccard-regions")
    wanted = classes.join(active.select("k").distinct(), "k").select("k", F.col("first").alias("id"))
    texts = stored(rows.join(wanted, "id").select("k", "text"), "jaccard-texts")
    counts = classes.select("k", "n", "counts")

    links, roots = None, None
    for turn in range(PIVOT_ROUNDS + 1):
        state = region_state(active, roots)
        if state is None:
            break
        small = state.filter(F.lit(turn > 0) & (F.col("size") <= SMALL_REGION))
        large = state.filter(F.lit(turn == 0) | (F.col("size") > SMALL_REGION))
        pairs = small_pairs(small)
        if turn < PIVOT_ROUNDS:
            stars = stored(large.filter(F.col("k") != F.col("pivot")).withColumns(
                {"ring": F.col("size") > RING_REGION, "a": F.col("k"), "b": F.col("pivot")}), "jaccard-stars")
            pairs = pairs.unionByName(stars.select("a", "b", "ring"))
        else:
            pairs = pairs.unionByName(block_pairs(large, counts, similar))
        pairs = stored(pairs.groupBy("a", "b").agg(F.max("ring").alias("ring")), "jaccard-pairs")
        found = distances(pairs, texts, counts, width, similar)
        close = found.filter(F.col("same") * 100 >= F.col("all") * similar).select("a", "b")
        links = close if links is None else links.unionByName(close)
        roots = stored(components(links), "jaccard-roots")
        if turn < PIVOT_ROUNDS:
            active = next_regions(stars, found, similar)
    by_key = classes.select("k", "k2", "first", F.col("members").alias("n"))
    if roots is not None:
        # components of class keys, named by the smallest id of a class in them
        joined = stored(classes.select("k", "k2", "first", "members").join(
            roots.select(F.col("node").alias("k"), "root"), "k", "left")
            .withColumn("root", F.coalesce("root", "k")), "jaccard-joined")
        named = stored(joined.groupBy("root").agg(F.min("first").alias("name"), F.count("*").alias("n")), "jaccard-named")
        by_key = join_by_key(joined, named, ["root"], max(1, joined.count())).select(
            "k", "k2", F.col("name").alias("first"), F.col("members").alias("n"))
    by_key = stored(by_key, "jaccard-names")
    linked = own.filter("n > 0 and id is not null").select("id", F.col("n").alias("n_shingles"), "k", "k2")
    alone = own.filter("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return join_by_key(linked, by_key, ["k", "k2"], max(1, own.count())).select(
        "id", "n_shingles", F.col("first").alias("component_id")).unionByName(alone).withColumnRenamed("id", id_col)


def region_state(active: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """(rid, k, n, pos, root, size, pivot) of the regions with more than one component, None if
    there are none."""
    rooted = active.withColumn("root", F.col("k"))
    if roots is not None:
        known = roots.select(F.col("node").alias("k"), "root")
        rooted = active.join(known, "k", "left").withColumn("root", F.coalesce("root", "k"))
    rooted = stored(rooted, "jaccard-rooted")
    about = stored(rooted.groupBy("rid").agg(
        F.count("*").alias("n"), F.min(F.struct("pos", "k")).getField("k").alias("pivot"),
        F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").drop("low", "high"),
        "jaccard-about")
    if about.isEmpty():
        return None
    joined = join_by_key(rooted.withColumnRenamed("n", "own"), about, ["rid"], max(1, rooted.count()))
    return stored(joined.select("rid", "k", F.col("own").alias("n"), "pos", "root", F.col("n").alias("size"), "pivot"),
                  "jaccard-state")


def small_pairs(small: DataFrame) -> DataFrame:
    """Pairs of different components in regions of at most SMALL_REGION documents."""
    x, y = (small.select("rid", F.col("k").alias(k), F.col("root").alias(f"{k}_root")) for k in "ab")
    return x.join(y, "rid").filter("a < b and a_root <> b_root").select("a", "b", F.lit(False).alias("ring"))


def next_regions(stars: DataFrame, found: DataFrame, similar: int) -> DataFrame:
    """What is left of the regions: without their pivots, and large ones divided into rings
    around the pivot, each with a copy of the documents of the ring within."""
    radius = 100 - similar
    plain = stars.filter(~F.col("ring")).select("rid", "k", "n", "pos")
    ring = F.floor((F.col("all") - F.col("same")) * 100 / F.col("all") / radius).cast("int")
    rings = stars.filter("ring").join(found, ["a", "b"]).withColumn("at", ring)
    dealt = rings.withColumn("at", F.explode(F.array("at", F.col("at") + 1)))
    return plain.unionByName(dealt.select(F.xxhash64("rid", "b", "at").alias("rid"), "k", "n", "pos"))


def _near_in_blocks(similar: int):
    def run(group: pa.Table) -> pa.Table:
        k, n, root, block = (group.column(c).to_numpy() for c in ("k", "n", "root", "block"))
        cells = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8).reshape(-1, CELLS)
        here, there = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        out_a, out_b = [], []
        second = np.flatnonzero(block == there)
        for x in np.flatnonzero(block == here):
            ys = second[(root[second] != root[x]) & (k[second] != k[x])]
            overlap = np.minimum(cells[ys], cells[x]).sum(1, dtype=np.int64)
            full = (np.maximum(cells[ys], cells[x]) == 255).any(1)
            ys = ys[full | (overlap * (100 + similar) >= (n[ys] + n[x]) * similar)]
            out_a += [min(k[x], v) for v in k[ys]]
            out_b += [max(k[x], v) for v in k[ys]]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
    return run


def block_pairs(large: DataFrame, counts: DataFrame, similar: int) -> DataFrame:
    """Pairs of different components whose counts by cell allow a link, from each two blocks of
    BLOCK documents of a region. Only such pairs are written, whatever the region's size."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = large.join(counts.select("k", "counts"), "k").withColumn("blocks", blocks).withColumn(
        "block", (F.abs(F.xxhash64("k", "rid")) % F.col("blocks")).cast("int"))
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rid", "k", F.col("n").cast("long").alias("n"), "root", "counts", "block",
        F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    near = dealt.groupBy("rid", "i", "j").applyInArrow(_near_in_blocks(similar), "a long, b long")
    return near.distinct().withColumn("ring", F.lit(False))


def one_of_each(docs: DataFrame, similar: int = SIMILAR, width: int = WIDTH, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all columns, and the
    rows without an id. Of repeated ids all rows stay. Edge cases as in ``jaccard_components``."""
    name = private(docs, "_kept")
    kept = jaccard_components(docs, similar, width, id_col, text_col).filter(
        F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, F.col(id_col) == F.col(name)).drop(name).unionByName(
        docs.filter(F.col(id_col).isNull()))
