"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. On each level, runs of one symbol become one symbol; deterministic
coin tossing (the lowest bit in which a symbol differs from the one before it, three times over)
turns symbols into small labels of which no two neighbours are equal; a phrase begins where a
label is a local maximum, and is named by a hash of its symbols. Where phrases begin depends on
a few symbols around, so equal substrings get equal phrases in their interior at any offset.

The fingerprint has, for each level, the smallest names of the text's phrases: a sample of its
phrases by which two texts' shares of common phrases can be estimated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import text_slices
from fleetlens.llm.common import text_or_empty
from fleetlens.llm.shingles import mixed

KEPT = (12, 24, 48)     # names per level, from short to long phrases
ENOUGH = 8              # a level is compared if both texts have so many names
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([pow(int(MULTIPLIER), i, 1 << 64) for i in range(1, 129)], np.uint64)


def tossed(values: int) -> np.ndarray:
    """Label of each pair (before, now) of numbers below ``values``, by before * values + now."""
    before, now = np.divmod(np.arange(values * values), values)
    differ = before ^ now
    bit = np.array([(int(x) & -int(x)).bit_length() - 1 if x else 0 for x in differ])
    return (2 * bit + ((now >> bit) & 1)).astype(np.uint8)


SECOND, THIRD = tossed(128), tossed(16)


def lowest_bit(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit of nonzero 64-bit numbers."""
    low = (x & (~x + np.uint64(1))).astype(np.float64)      # a power of two is exact
    return (np.frexp(low)[1] - 1).astype(np.uint64)


def phrases(names: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next level: phrase names, and the text of each. ``text`` numbers the symbols' texts."""
    if not len(names):
        return names, text
    n = len(names)
    begins = np.ones(n, bool)
    begins[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(begins)
    run = np.diff(np.append(starts, n))
    symbols, text = names[starts], text[starts]
    many = run > 1
    symbols[many] = mixed(symbols[many] + run[many].astype(np.uint64) * MULTIPLIER, 3)
    first = np.ones(len(symbols), bool)
    first[1:] = text[1:] != text[:-1]

    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ np.uint64(1)
    bit = lowest_bit(symbols ^ before)
    label = (2 * bit + ((symbols >> bit) & np.uint64(1))).astype(np.int32)
    for table, values in ((SECOND, 128), (THIRD, 16)):
        last = np.empty_like(label)
        last[1:] = label[:-1]
        last[first] = label[first] ^ 1
        label = table[last * values + label].astype(np.int32)
    peak = first.copy()
    peak[1:] |= label[1:] > label[:-1]
    follows = np.full(len(label), -1, np.int32)
    follows[:-1][~first[1:]] = label[1:][~first[1:]]
    peak &= (label > follows) | first
    at = np.flatnonzero(peak)
    lengths = np.diff(np.append(at, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(at, lengths)
    sums = np.add.reduceat(symbols * PLACES[place], at)
    return mixed(sums + lengths.astype(np.uint64), 5), text[at]


def fingerprint_sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each text the smallest distinct names of each level."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    names = points.astype(np.uint64)
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    levels = []
    for kept in KEPT:
        names, text = phrases(names, text)
        short = (names >> np.uint64(32)).astype(np.uint32)
        ends = np.searchsorted(text, np.arange(len(texts) + 1))
        levels.append([np.unique(short[a:b])[:kept] for a, b in zip(ends[:-1], ends[1:])])
    return list(zip(*levels))


def written(sketch: tuple[np.ndarray, ...]) -> str:
    """Names as eight hexadecimal digits each, levels parted by hyphens; empty for the empty text."""
    return "-".join(level.astype(">u4").tobytes().hex() for level in sketch) if len(sketch[0]) else ""


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Estimated Dice coefficient of two texts' sets of phrases, on the level of the longest
    phrases of which both have enough; 1 for two empty texts, 0 if one is empty."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    level = max((i for i in range(len(KEPT)) if min(len(a[i]), len(b[i])) >= ENOUGH), default=0)
    x, y, kept = a[level], b[level], KEPT[level]
    union = np.union1d(x, y)[:kept]
    shared = np.isin(union, np.intersect1d(x, y)).sum() / len(union)
    return float(2 * shared / (1 + shared))


RANGES_PER_TASK = 4     # several ranges to a task even out what hashing deals unevenly


def with_next(rows: DataFrame, parts: int) -> DataFrame:
    """(at, own, id, text): ``rows`` dealt by ranges of id, one range per ``at``, in each of
    them in rising order of id and text, preceded by the row before the range (own = false).
    Of the first range that is the last row of all. Rows without an id come first of all."""
    key = F.coalesce("id", F.lit(-(2**63)))
    ranges = parts * RANGES_PER_TASK
    bounds = rows.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10_000).alias("b")).head()
    bounds = np.unique(np.array(bounds["b"] or [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), "left").astype(np.int32))

    # one row per range
    last = sorted(tuple(r) for r in rows.select(range_of(key).alias("at"), key.alias("key"))
                  .groupBy("at").agg(F.max("key")).collect())
    before = [(last[i - 1][1], at) for i, (at, _) in enumerate(last)]
    copies = rows.sparkSession.createDataFrame(before, "key long, to int")
    keyed = rows.withColumn("key", key).withColumn("at", range_of("key"))
    dealt = keyed.join(F.broadcast(copies), "key", "left").select(
        F.explode(F.array_compact(F.array(
            F.struct("at", F.lit(True).alias("own")),
            F.when(F.col("to").isNotNull(), F.struct(F.col("to").alias("at"), F.lit(False).alias("own")))))).alias("d"),
        "id", "key", "text")
    return (dealt.select("d.at", "d.own", "id", "key", "text").repartition(parts, "at")
            .sortWithinPartitions("at", "own", "key", "text").select("at", "own", "id", "text"))


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[:len(text) - cut] + following[:cut]


RESULT = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, following, next_sketch = None, "", None
    for part in text_slices(batches, "text"):
        texts, ranges, own = (part.column(c).to_pylist() for c in ("text", "at", "own"))
        nexts = [following, *texts[:-1]]
        edits = [edited_text(t, n) if o else "" for t, n, o in zip(texts, nexts, own)]
        sketches = fingerprint_sketches(texts + edits)
        out = []
        for i, text in enumerate(texts):
            sketch = sketches[i]
            if own[i]:
                if ranges[i] != at:
                    raise ValueError("a range without the row before it")
                edited = sketches[len(texts) + i]
                out.append((i, len(text), hashlib.sha256(edits[i].encode()).hexdigest(), written(sketch),
                            written(edited), likeness(sketch, edited), likeness(sketch, next_sketch)))
            at, next_sketch = ranges[i], sketch
        following = texts[-1]
        if out:
            which, *columns = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(which)), *[pa.array(list(c)) for c in columns]],
                names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next"])


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT for every row of ``docs``: its text's fingerprint, that of the text with its last
    third replaced by the beginning of the next document's (descending id; after the last
    comes the first), and the likeness of the first to the second and to the next document's.

    Null texts are empty; the empty text has the empty fingerprint. Rows without an id come
    last in descending order; of repeated ids the larger text comes first. A single document is
    its own next. No rows, no result; other columns are not looked at; texts are never cut.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return with_next(rows, parts).mapInArrow(_compare, RESULT).withColumnRenamed("id", id_col)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row of ``docs``; edge cases as in ``fingerprints_with_edits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            made = [written(s) for s in fingerprint_sketches(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.string())],
                                             names=["id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)
