"""A hierarchical Pitman-Yor language model, sampled over all training documents.

Tokens are words and document ends. Restaurants are contexts: the two words before a token, whose
tables are customers of the word before, whose base is the probability by classes. All words
are told apart, and the contexts grow with the corpus.

In the base, the VOCABULARY commonest tokens are classes of their own, the others are classed by
their last bytes; a word's probability is that of its class after the class before, times its
share of its class (add one half, with one place for unknown words). The first factor is again
hierarchical: a restaurant per class before, whose tables are customers of one parent restaurant
that all of them share, whose base is uniform.

Seating is sampled by Gibbs: the guests of one dish leave, and are seated anew at a number of tables
drawn given all other tables of the restaurant (how they are split among these tables does not
matter to any prediction). Predictive probabilities are averaged over the samples.

Both levels of word contexts that end with one word meet in one part: tokens are sent once, by the
word before them, and the part that seats them sends back sums per document. Nothing else that
grows with the tokens is stored. A word that comes before more than PART_TOKENS tokens has several
parts, by the word before it; for these words the second level is joined in tables between rounds.

Customers of one context are exchangeable, so a context with many of them is dealt over several
restaurants of about CUSTOMERS each, whose predictions are averaged; those of one dish stay
together up to TOGETHER of them. No task seats an unbounded group.
Sizes that do not grow with the corpus: classes, pairs of classes, and the table of the commonest
words, which are broadcast. Counts of words beyond that table are joined for the parts that need them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.arrays import giving_back, text_slices
from fleetlens.llm.common import commonest, join_by_key, stored, text_or_empty
from fleetlens.llm.shingles import BYTE_CODES, hashes_of, mixed, words_of

VOCABULARY = 1536
ENDINGS = 256
CLASSES = VOCABULARY + ENDINGS
COMMON_WORDS = 1 << 18      # words whose counts are broadcast
CUSTOMERS = 2000
TOGETHER = 250
STRENGTH = 10.0             # the concentration of every restaurant
SWEEPS = ((1, 1), (2, 3))   # burn-in and samples of the children, each time before the parent's turn
SIDE_BY_SIDE = 2000         # full restaurants that a task samples together
WORDS_TOGETHER = 1 << 20    # customers of hot words that a task samples together
PART_TOKENS = 1 << 20       # tokens whose contexts one part seats
LEAST_TOGETHER = 1500       # a task gets at least about so many
SLICE = 8 << 20
END = np.uint64(0x5EED0E2D0C5EED01)
PARENT = -1


# ---- tokens ------------------------------------------------------------------------------

def is_training(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 != 1


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending class (0 to ENDINGS - 1) of every token, each text's followed by END,
    and the ends by text."""
    low, starts, stops, ends = words_of(text)
    words = hashes_of(low, starts, stops)
    tail = np.zeros(len(words), np.uint64)
    for back in (1, 2, 3):
        at = stops - back
        tail = tail * np.uint64(31) + np.where(at >= starts, BYTE_CODES[low[np.maximum(at, 0)]] if len(low) else 0,
                                               np.uint64(7))
    ending = (mixed(tail) % np.uint64(ENDINGS)).astype(np.int32)
    words = np.insert(words, ends[1:], END)
    ending = np.insert(ending, ends[1:], 0)
    return words, ending, ends + np.arange(len(ends))


def training_part(part: pa.RecordBatch) -> pa.RecordBatch:
    return part.filter(pa.array([is_training(i) for i in part.column("id").to_pylist()], pa.bool_()))


def _learnt(part: pa.RecordBatch, ends: np.ndarray) -> np.ndarray:
    """Of each token whether its text is in training."""
    return np.repeat(np.array([is_training(i) for i in part.column("id").to_pylist()], bool), np.diff(ends))


@giving_back
def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts in training (c) and in all texts (n)."""
    for part in text_slices(batches, "text", SLICE):
        words, ending, ends = tokens_of(part.column("text"))
        values, at, which, counts = np.unique(words, return_index=True, return_inverse=True, return_counts=True)
        learnt = np.bincount(which, weights=_learnt(part, ends), minlength=len(values)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), pa.array(ending[at]), pa.array(learnt), pa.array(counts)],
            names=["w", "g", "c", "n"])


class Lexicon:
    """Counts of the commonest words, numbered by rank, their classes, what the classes hold, and
    the parts that words are sent to."""

    def __init__(self, counts: DataFrame):
        totals = counts.agg(F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("n")).head()
        self.tokens, self.distinct, every = totals[0] or 0, totals[1], totals[2] or 0
        rows = commonest(counts, "n", COMMON_WORDS).toArrow()
        words, often, seen, ending = (rows.column(x).to_numpy() for x in ("w", "c", "n", "g"))
        rank = np.lexsort((words, -seen, -often))
        words, self.counts, seen, ending = words[rank].view(np.uint64), often[rank], seen[rank], ending[rank]
        tops = min(VOCABULARY, int((self.counts > 0).sum()))
        self.hashes = words                         # by rank
        order = np.argsort(words)
        self.words, self.rank = words[order], order.astype(np.int32)
        self.group = VOCABULARY + ending            # the class of each rank
        # tokens and distinct words by ending, of the words that are not classes of their own
        self.held, self.kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for r in counts.filter("c > 0").groupBy("g").agg(F.sum("c"), F.count("*")).collect():
            self.held[VOCABULARY + r[0]], self.kinds[VOCABULARY + r[0]] = r[1], r[2]
        np.subtract.at(self.held, self.group[:tops], self.counts[:tops])
        np.subtract.at(self.kinds, self.group[:tops], 1)
        self.group[:tops] = np.arange(tops)
        # hot words have parts of their own, after those that the others share
        hot = seen > PART_TOKENS
        self.subs = np.where(hot, -(-seen // PART_TOKENS), 0)
        self.shared = max(1, -(-(every - int(seen[hot].sum())) // PART_TOKENS))
        self.first = self.shared + np.cumsum(self.subs) - self.subs
        self.parts = self.shared + int(self.subs.sum())

    def ids(self, words: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the word is not in the table."""
        if not len(self.words):
            return np.full(len(words), -1, np.int32)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.rank[at], np.int32(-1))

    def classes(self, ids: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return self.of(self.group, ids, VOCABULARY + ending)

    def of(self, values: np.ndarray, ids: np.ndarray, otherwise) -> np.ndarray:
        """``values`` by rank, ``otherwise`` for words without one."""
        return np.where(ids >= 0, values[np.maximum(ids, 0)], otherwise) if len(values) else np.broadcast_to(
            otherwise, ids.shape)

    def part(self, mid: np.ndarray, mid_ids: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """The part of tokens after the words ``earlier`` and ``mid``."""
        own = (mixed(mid, 3) % np.uint64(self.shared)).astype(np.int64)
        hot = np.flatnonzero(self.of(self.subs, mid_ids, 0) > 0)
        at = mid_ids[hot]
        own[hot] = self.first[at] + (mixed(earlier[hot], 4) % self.subs[at].astype(np.uint64)).astype(np.int64)
        return own


def before(values: np.ndarray, ends: np.ndarray, first) -> np.ndarray:
    """The value before each token; before a text's first it is ``first``, that of an end."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[ends[:-1]] = first
    return out


# ---- seating -----------------------------------------------------------------------------

def stirling(most: int, discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the weight of all seatings of n customers of one
    dish at t tables, at n (n - 1) / 2 + t - 1, for n up to ``most``."""
    out = np.empty(most * (most + 1) // 2)
    row = np.zeros(1)
    for n in range(1, most + 1):
        out[n * (n - 1) // 2:n * (n + 1) // 2] = row
        longer = np.full(n + 1, -np.inf)
        longer[1:] = row
        longer[:-1] = np.logaddexp(longer[:-1], row + np.log(n - discount * np.arange(1, n + 1)))
        row = longer
    return out


class Restaurants:
    """Seating of many restaurants side by side. Rows are dishes: the restaurant of each (rising),
    its customers, and its probability in the parent. One step seats the guests of one dish of every
    restaurant, given all other tables; restaurants do not depend on each other, so this is plain
    Gibbs sampling of the numbers of tables."""

    def __init__(self, restaurant: np.ndarray, customers: np.ndarray, base: np.ndarray, discount: float,
                 strength: float, seed: int, alone: np.ndarray):
        """``alone``: tables of each restaurant besides those of the dishes given."""
        self.rng = np.random.default_rng(seed)
        dishes = np.bincount(restaurant, minlength=len(alone))
        turn = np.arange(len(restaurant)) - np.repeat(np.cumsum(dishes) - dishes, dishes)
        # dishes by turn, and the weights of 1, 2, ... tables of each, one after the other
        self.order = np.argsort(turn, kind="stable")
        self.room, n = restaurant[self.order], customers[self.order]
        self.turns = np.append(0, np.cumsum(np.bincount(turn))) if len(turn) else np.zeros(1, np.int64)
        self.ends = np.append(0, np.cumsum(n))
        self.number = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.t = np.arange(1, self.ends[-1] + 1, dtype=np.int32)
        self.t -= self.ends[:-1].astype(np.int32)[self.number]
        at = (n * (n - 1) // 2 - 1).astype(np.int32)[self.number]
        at += self.t
        self.weight = stirling(int(n.max()) if len(n) else 0, discount)[at]
        del at
        self.weight += self.t * np.log(base[self.order])[self.number]
        most = int((alone + np.bincount(restaurant, weights=customers, minlength=len(alone))).max()) if len(alone) else 0
        # of the first T tables of a restaurant together
        self.opening = np.append(0.0, np.cumsum(np.log(strength + discount * np.arange(most))))
        self.at = np.ones(len(n), np.int64)
        self.open = alone.astype(np.int64) + dishes

    @property
    def tables(self) -> np.ndarray:
        out = np.empty_like(self.at)
        out[self.order] = self.at
        return out

    def sweep(self) -> None:
        """Seats the guests of every dish once."""
        for a, b in zip(self.turns[:-1].tolist(), self.turns[1:].tolist()):
            room, ends = self.room[a:b], self.ends[a:b + 1]
            begin, end = int(ends[0]), int(ends[-1])
            others = self.open[room] - self.at[a:b]
            number = self.number[begin:end] - a
            weight = self.weight[begin:end] + self.opening[others[number] + self.t[begin:end]]
            weight -= np.maximum.reduceat(weight, ends[:-1] - begin)[number]
            sums = np.append(0.0, np.cumsum(np.exp(weight)))
            low, high = sums[ends[:-1] - begin], sums[ends[1:] - begin]
            drawn = np.searchsorted(sums, low + self.rng.random(b - a) * (high - low), "right") - 1
            self.at[a:b] = np.clip(drawn + begin - ends[:-1], 0, np.diff(ends) - 1) + 1
            self.open[room] = others + self.at[a:b]


def seat(restaurant: np.ndarray, customers: np.ndarray, base: np.ndarray, discount: float, strength: float,
         seed: int, burn_in: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean tables of each dish, and of each restaurant, over the samples. A dish with one customer
    has one table in every seating, so only the others are sampled."""
    many = customers > 1
    alone = np.bincount(restaurant[customers == 1], minlength=int(restaurant[-1]) + 1 if len(restaurant) else 0)
    rooms = Restaurants(restaurant[many], customers[many], base[many], discount, strength, seed, alone)
    rooms.sweep()
    tables, opened = (customers == 1).astype(float), np.zeros(len(rooms.open))
    for i in range(burn_in + samples):
        rooms.sweep()
        if i >= burn_in:
            tables[many] += rooms.tables / samples
            opened += rooms.open / samples
    return tables, opened


SEATED = "u long, v long, mid long, shares long, kept double, tables double, opened double"


def _seat_all(base, discount: float, strength: float, sweeps: tuple[int, int], together: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (u, share, shares, v, n, mid, base), those of one restaurant together."""
        def sample(rows: np.ndarray) -> pa.RecordBatch:
            u, share, shares, v, n, mid, beside = rows
            change = np.append(True, (u[1:] != u[:-1]) | (share[1:] != share[:-1]))
            room = np.cumsum(change) - 1
            seed = (int(u[0]) * 1_000_003 + int(share[0])) % (1 << 31)
            prior = beside.view(np.float64) if base is None else base.value[v]
            tables, opened = seat(room, n, prior, discount, strength, seed, *sweeps)
            size = np.bincount(room, weights=n)[room]
            # the weight that the restaurant leaves to its parent: on every row of an undivided
            # context, once per restaurant of a divided one
            rest = (strength + discount * opened[room]) / (strength + size) / shares
            return pa.RecordBatch.from_arrays(
                [pa.array(u), pa.array(v), pa.array(mid), pa.array(shares),
                 pa.array((n - discount * tables) / (strength + size) / shares), pa.array(tables),
                 pa.array(np.where(change | (shares == 1), rest, 0.0))],
                names=["u", "v", "mid", "shares", "kept", "tables", "opened"])

        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            held.append(np.array([batch.column(x).to_numpy().view(np.int64) if x == "base" else
                                  batch.column(x).to_numpy().astype(np.int64)
                                  for x in ("u", "share", "shares", "v", "n", "mid", "base")]))
            waiting += max(int(held[-1][4].sum()), held[-1].shape[1])
            if waiting <= together:
                continue
            rows = np.concatenate(held, axis=1)
            change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            if len(change):
                yield sample(np.ascontiguousarray(rows[:, :change[-1]]))
                rows = np.ascontiguousarray(rows[:, change[-1]:])
            held, waiting = [rows], max(int(rows[4].sum()), rows.shape[1])
        if held and sum(x.shape[1] for x in held):
            yield sample(np.concatenate(held, axis=1))
    return run


def dealt(rows: DataFrame) -> DataFrame:
    """Rows (u, v, c, shares and others) with the customers n of v in each share of the context u.
    A row without customers goes to one share."""
    over = F.greatest(F.least("shares", F.ceil(F.col("c") / TOGETHER)), F.lit(1)).cast("int")
    return rows.withColumn("over", over).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("over") - 1))).withColumn(
        "share", F.pmod(F.xxhash64("u", "v") + F.col("i"), F.col("shares"))).withColumn(
        "n", F.floor(F.col("c") / F.col("over")) + F.when(F.col("i") < F.col("c") % F.col("over"), 1).otherwise(0))


def sample_level(pairs: DataFrame, base: np.ndarray, discount: float, strength: float, sweeps: tuple[int, int],
                 name: str) -> DataFrame:
    """u, v, kept, tables, opened, summed by (u, v), for the customers c of (u, v) in ``pairs``."""
    spark = pairs.sparkSession
    sizes = pairs.groupBy("u").agg(F.ceil(F.sum("c") / CUSTOMERS).cast("int").alias("shares"))
    # at most CLASSES + 1 rows
    rows = dealt(pairs.join(F.broadcast(sizes), "u")).select(
        "u", "share", "shares", "v", "n", F.lit(0).alias("mid"), F.lit(0.0).alias("base"))
    rooms = sizes.agg(F.coalesce(F.sum("shares"), F.lit(0))).head()[0]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")), rooms // (10 * SIDE_BY_SIDE))
    parts = min(parts, 1 + rooms // LEAST_TOGETHER)
    ordered = rows.repartition(parts, "u", "share").sortWithinPartitions("u", "share")
    seated = ordered.mapInArrow(
        _seat_all(spark.sparkContext.broadcast(base), discount, strength, sweeps, CUSTOMERS * SIDE_BY_SIDE), SEATED)
    first = F.when(F.col("shares") > 1, F.sum("opened")).otherwise(F.max("opened"))
    by_dish = seated.groupBy("u", "v", "shares").agg(
        F.sum("kept").alias("kept"), F.sum("tables").alias("tables"), first.alias("opened"))
    return stored(by_dish.select("u", "v", "shares", "kept", "tables", "opened"), name)


def discount_of(pairs: DataFrame, column: str) -> float:
    """From the numbers of dishes with one and with two customers, kept off the ends."""
    return discount_from(*pairs.agg(F.count(F.when(F.round(column) == 1, 1)), F.count(F.when(F.round(column) == 2, 1))).head())


def discount_from(one: int, two: int) -> float:
    return float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))


def class_model(pairs: DataFrame) -> np.ndarray:
    """log10 P(class | class before) as a matrix of CLASSES x CLASSES, from (u, v, c)."""
    spark, discount = pairs.sparkSession, discount_of(pairs, "c")
    share = np.full(CLASSES, 0.5)
    for r in pairs.groupBy("v").agg(F.sum("c")).collect():
        share[r[0]] += r[1]
    parent = share / share.sum()      # never zero: half a customer each
    for sweeps in SWEEPS:
        children = sample_level(pairs, parent, discount, STRENGTH, sweeps, "py-children")
        if sweeps == SWEEPS[-1]:
            break
        tables = children.groupBy("v").agg(F.sum("tables").alias("t")).select(
            F.lit(PARENT).alias("u"), "v", F.greatest(F.round("t"), F.lit(1.0)).cast("long").alias("c"))
        uniform = np.full(CLASSES, 1 / CLASSES)
        top = sample_level(tables, uniform, discount_of(tables, "c"), STRENGTH, sweeps, "py-parent").collect()
        rest = sum(r["opened"] for r in top) if top and top[0]["shares"] > 1 else max((r["opened"] for r in top), default=0)
        parent = np.full(CLASSES, rest) * uniform
        for r in top:
            parent[r["v"]] += r["kept"]
        # without any training row there are no tables, and nothing but the uniform base
        parent = parent / parent.sum() if parent.sum() > 0 else uniform
    # pairs of classes: a number that does not grow with the corpus
    rows = children.select("u", "v", "shares", F.col("kept").cast("float"), "opened").toArrow()
    u, v, shares, kept, opened = (rows.column(x).to_numpy() for x in ("u", "v", "shares", "kept", "opened"))
    split = shares > 1
    rest = np.bincount(u[split], weights=opened[split], minlength=CLASSES)
    rest[u[~split]] = opened[~split]
    rest[rest == 0] = 1.0
    model = (rest[:, None] * parent).astype(np.float32)
    np.add.at(model, (u, v), kept)
    model /= model.sum(1, keepdims=True)
    return np.log10(model, out=model)


# ---- word contexts -----------------------------------------------------------------------

def with_shares(rows: DataFrame, total: int) -> DataFrame:
    """``rows`` (u, v, c) with the number of restaurants of each context u."""
    large = rows.groupBy("u").agg(F.sum("c").alias("size"), F.count("*").alias("n")).filter(
        F.col("size") > CUSTOMERS).select("u", "n", F.ceil(F.col("size") / CUSTOMERS).cast("long").alias("large"))
    return join_by_key(rows, large, ["u"], total, "left").drop("n").withColumn(
        "shares", F.coalesce("large", F.lit(1).cast("long"))).drop("large")


def sample_words(rows: DataFrame, discount: float, sweeps: tuple[int, int], total: int, name: str) -> DataFrame:
    """u, v, mid, kept, tables, opened for rows (u, v, mid, c, shares, base), also those with c = 0:
    P(v | u) is kept + opened * base."""
    ordered = dealt(rows).select("u", "share", "shares", "v", "n", "mid", "base").repartition(
        "u", "share").sortWithinPartitions("u", "share")
    seated = stored(ordered.mapInArrow(_seat_all(None, discount, STRENGTH, sweeps, WORDS_TOGETHER), SEATED), name)
    whole = seated.filter("shares = 1").select("u", "v", "mid", "kept", "tables", "opened")
    split = seated.filter("shares > 1")
    dishes = split.groupBy("u", "v").agg(F.first("mid").alias("mid"), F.sum("kept").alias("kept"),
                                         F.sum("tables").alias("tables"))
    rest = split.groupBy("u").agg(F.sum("opened").alias("opened"), F.count("*").alias("n"))
    return whole.unionByName(join_by_key(dishes, rest, ["u"], total).select(*whole.columns))


def seat_level(room: np.ndarray, word: np.ndarray, c: np.ndarray, base: np.ndarray, sweeps: tuple[int, int],
               seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with c customers, the contexts numbered by ``room`` (rising from 0): what they keep, what
    is left to the base, so that P(word | context) = kept + left * base, and mean tables. The discount
    is that of all contexts given."""
    discount = discount_from(int((c == 1).sum()), int((c == 2).sum()))
    size = np.bincount(room, weights=c)
    shares = np.maximum(np.ceil(size / CUSTOMERS), 1).astype(np.int64)
    row = np.flatnonzero(c)
    over = np.clip(-(-c[row] // TOGETHER), 1, shares[room[row]])
    turn = np.arange(int(over.sum())) - np.repeat(np.cumsum(over) - over, over)
    row, over = np.repeat(row, over), np.repeat(over, over)
    n = c[row] // over + (turn < c[row] % over)
    here = room[row]
    first = np.cumsum(shares) - shares
    share = first[here] + (mixed(word[row], 6) % shares[here].astype(np.uint64)).astype(np.int64) + turn
    share = np.where(share >= first[here] + shares[here], share - shares[here], share)
    if len(shares) < int(shares.sum()):
        order = np.argsort(share, kind="stable")
        row, n, here, share = row[order], n[order], here[order], share[order]
    total = int(shares.sum())
    t, few = seat(share, n, base[row], discount, STRENGTH, seed, *sweeps)
    opened = np.zeros(total)
    opened[:len(few)] = few
    guests = np.bincount(share, weights=n, minlength=total)
    kept = np.bincount(row, weights=(n - discount * t) / (STRENGTH + guests[share]) / shares[here], minlength=len(c))
    rest = np.add.reduceat((STRENGTH + discount * opened) / (STRENGTH + guests), first) / shares
    return kept, rest[room], np.bincount(row, weights=t, minlength=len(c))


def customers_of(tables: np.ndarray) -> np.ndarray:
    """A word that was seated has a table."""
    return np.where(tables > 0, np.maximum(np.round(tables), 1), 0).astype(np.int64)


def shrunk(*arrays: np.ndarray) -> bytes:
    """The arrays in few bytes: all lowest bytes, then all next ones, and so on, compressed."""
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes() for x in arrays)
    return np.array([len(x) for x in arrays], np.int64).tobytes() + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def grown(data: bytes, *types) -> list[np.ndarray]:
    """The arrays, of these types, that ``shrunk`` was given."""
    sizes = np.frombuffer(data, np.int64, len(types)).tolist()
    widths = [np.dtype(t).itemsize for t in types]
    ends = np.append(0, np.cumsum([n * w for n, w in zip(sizes, widths)])).tolist()
    if not ends[-1]:
        return [np.empty(0, t) for t in types]
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(data[8 * len(types):], ends[-1], asbytes=True), np.uint8)
    return [planes[a:b].reshape(w, n).T.copy().view(t).ravel()
            for a, b, w, n, t in zip(ends[:-1], ends[1:], widths, sizes, types)]


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of ``column``, which come one after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(column)[0].as_py() != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Tokens:
    """The tokens of a slice of texts, with the two words before each, and the parts they are sent to."""

    def __init__(self, part: pa.RecordBatch, lex: Lexicon):
        words, ending, self.ends = tokens_of(part.column("text"))
        ids = lex.ids(words)
        self.learnt = _learnt(part, self.ends)
        self.end = lex.ids(np.array([END]))
        # the word itself, the word before, the word before that
        self.words, self.ids, self.ending = [words], [ids], [ending]
        for _ in range(2):
            self.words.append(before(self.words[-1], self.ends, END))
            self.ids.append(before(self.ids[-1], self.ends, self.end[0]))
            self.ending.append(before(self.ending[-1], self.ends, 0))
        self.part = lex.part(self.words[1], self.ids[1], self.words[2])


BLOCK = 64      # classes before whose counts are summed together


def _count_classes(lexicon):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of training texts the counts of pairs of classes, by blocks; and of all texts which words
        without a rank come in which part."""
        lex = lexicon.value
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        names = ["part", "w", "counts"]
        for part in text_slices(batches, "text", SLICE):
            tokens = Tokens(part, lex)
            now, last = (lex.classes(i, g) for i, g in zip(tokens.ids[:2], tokens.ending))
            pairs += np.bincount((last.astype(np.int64) * CLASSES + now)[tokens.learnt], minlength=len(pairs))
            rare = np.flatnonzero(tokens.ids[0] < 0)
            w, at = tokens.words[0][rare], tokens.part[rare]
            order = np.lexsort((w, at))
            w, at = w[order], at[order]
            new = np.append(True, (w[1:] != w[:-1]) | (at[1:] != at[:-1])) if len(w) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[new].astype(np.int32)), pa.array(w[new].view(np.int64)),
                 pa.nulls(int(new.sum()), pa.binary())], names=names)
        blocks = [(i, x) for i, x in enumerate(np.split(pairs, np.arange(BLOCK, CLASSES, BLOCK) * CLASSES)) if x.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in blocks], pa.int32()), pa.nulls(len(blocks), pa.int64()),
             pa.array([shrunk(x) for _, x in blocks], pa.binary())], names=names)
    return run


@giving_back
def _sum_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "part"):
        counts = sum(grown(x.as_py(), np.int64)[0] for x in rows.column("counts"))
        pair = np.flatnonzero(counts)
        c = counts[pair]
        pair += rows.column("part")[0].as_py() * BLOCK * CLASSES
        yield pa.RecordBatch.from_arrays([pa.array((pair // CLASSES).astype(np.int32)),
                                          pa.array((pair % CLASSES).astype(np.int32)), pa.array(c)], names=["u", "v", "c"])


# rows of a part: counts of words without a rank (a, p), probabilities of words (b) after a hot one (p, q),
# tokens of a slice, and what a slice knows of its documents
COUNTS, GIVEN, SENT_TOKENS, DOCUMENTS = range(4)
SENT = "part int, kind int, slice long, a long, b long, p double, q double, rare binary, blob binary"
TOKEN_TYPES = (np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)


def _send(lexicon, hot: bool):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tokens of each slice by part, those of hot words only with ``hot``."""
        lex = lexicon.value
        known = len(lex.hashes)
        total = np.log10(lex.tokens + 0.5 * (lex.distinct + 1))
        task = TaskContext.get().partitionId()
        for number, part in enumerate(text_slices(batches, "text", SLICE)):
            tokens = Tokens(part, lex)
            doc = np.repeat(np.arange(len(part), dtype=np.uint32), np.diff(tokens.ends))
            which = tokens.part.astype(np.uint16) if lex.parts < 1 << 16 else tokens.part
            order = np.argsort(which, kind="stable")
            which = which[order]
            if hot:
                order = order[np.searchsorted(which, lex.shared):]
                which = which[len(which) - len(order):]
            cuts = np.append(0, np.flatnonzero(which[1:] != which[:-1]) + 1) if len(which) else np.empty(0, np.int64)
            parts, kinds, rares, blobs = which[cuts].tolist(), [SENT_TOKENS] * len(cuts), [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(which))):
                at = order[a:b]
                ids = np.concatenate([x[at] for x in tokens.ids]).astype(np.int64)
                rare = np.flatnonzero(ids < 0)
                of = rare // len(at)
                words, endings = (np.stack([x[at[rare % len(at)]] for x in y])[of, np.arange(len(rare))]
                                  for y in (tokens.words, tokens.ending))
                words, first, index = np.unique(words, return_index=True, return_inverse=True)
                ids[rare] = known + index
                rares.append(shrunk(words, endings[first].astype(np.uint8) if len(first) else np.empty(0, np.uint8)))
                blobs.append(shrunk(np.diff(doc[at], prepend=np.uint32(0)),
                                    *ids.astype(np.uint32).reshape(3, -1), tokens.learnt[at].view(np.uint8)))
            if not hot:
                ids = tokens.ids[0]
                c = lex.of(lex.counts, ids, -1)
                base = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0.0) - total
                own = part.column("id")
                parts.append((task + number) % lex.shared)
                kinds.append(DOCUMENTS)
                rares.append(None)
                blobs.append(shrunk(own.fill_null(0).to_numpy(), own.is_valid().to_numpy(zero_copy_only=False).view(np.uint8),
                                    np.diff(tokens.ends), np.add.reduceat((c > 0).astype(np.int64), tokens.ends[:-1]),
                                    np.add.reduceat(base, tokens.ends[:-1])))
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array([task << 32 | number] * n, pa.int64()),
                 pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()),
                 pa.array(rares, pa.binary()), pa.array(blobs, pa.binary())],
                names=["part", "kind", "slice", "a", "b", "p", "q", "rare", "blob"])
    return run


def distinct(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows in rising order, and the number of each row's."""
    width = max((int(x.max()).bit_length() for x in columns if len(x)), default=1)
    if width * len(columns) <= 64:
        key = columns[0].astype(np.uint64)
        for x in columns[1:]:
            key = key << np.uint64(width) | x.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])[:len(key)]
    else:
        order = np.lexsort(columns[::-1])
        new = np.append(True, np.any([x[order][1:] != x[order][:-1] for x in columns], axis=0))
    index = np.empty(len(order), np.int32)
    index[order] = np.cumsum(new, dtype=np.int32) - 1
    return [x[order[new]] for x in columns], index


class Part:
    """The tokens of one part: its distinct words after two words (mid, earlier, word), their training
    counts, and what is to be sent back. Tokens are merged by about PART_TOKENS at a time."""

    def __init__(self, rows: pa.Table, lex: Lexicon):
        kind = rows.column("kind").to_numpy()
        sent = rows.filter(pa.array(kind == SENT_TOKENS))
        self.slices = sent.column("slice").to_numpy()
        lists = [grown(x.as_py(), np.uint64, np.uint8) for x in sent.column("rare")]
        self.ranked = len(lex.hashes)
        rare = np.concatenate([x for x, _ in lists]) if lists else np.empty(0, np.uint64)
        words, first, index = np.unique(rare, return_index=True, return_inverse=True)
        ending = np.concatenate([x for _, x in lists])[first] if lists else np.empty(0, np.uint8)
        counts = np.zeros(len(words), np.int64)
        told = rows.filter(pa.array(kind == COUNTS))
        asked = told.column("a").to_numpy().view(np.uint64)
        if len(words):
            at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
            same = words[at] == asked
            counts[at[same]] = told.column("p").to_numpy()[same].astype(np.int64)
        # of all words, by their numbers here
        self.hashes = np.append(lex.hashes, words)
        self.group = np.append(lex.group, VOCABULARY + ending.astype(np.int32))
        self.counts = np.append(lex.counts, counts)
        self.docs, self.index, self.rare = [], [], []
        known: list[np.ndarray] = [np.empty(0, np.uint32)] * 3
        c = np.empty(0, np.int64)
        begin, done = 0, 0
        waiting: list[list[np.ndarray]] = []
        blobs = sent.column("blob")
        for i, blob in enumerate(blobs):
            step, now, mid, earlier, learnt = grown(blob.as_py(), *TOKEN_TYPES)
            here = index[begin:begin + len(lists[i][0])]
            begin += len(lists[i][0])
            columns = [mid, earlier, now]
            for x in columns:
                at = np.flatnonzero(x >= self.ranked)
                x[at] = self.ranked + here[x[at] - self.ranked]
            doc = np.cumsum(step, dtype=np.uint32)
            self.docs.append(doc)
            self.rare.append((doc[at], self.counts[now[at]]))
            waiting.append([*columns, learnt])
            if i + 1 == len(blobs) or sum(len(x[3]) for x in waiting) > PART_TOKENS:
                old = len(c)
                fresh = [np.concatenate([k, *(x[j] for x in waiting)]) for j, k in enumerate(known)]
                weight = np.concatenate([c, *(x[3] for x in waiting)])
                known, where = distinct(*fresh)
                c = np.bincount(where, weights=weight, minlength=len(known[0])).astype(np.int64)
                self.index = [where[:old][x] for x in self.index]
                cuts = old + np.append(0, np.cumsum([len(x[3]) for x in waiting]))
                self.index += [where[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                waiting = []
        self.mid, self.earlier, self.word, self.c = *known, c
        (self.pair_mid, self.pair_word), self.pair = distinct(self.mid, self.word)
        self.room = numbered(self.mid, self.earlier)
        self.pair_room = numbered(self.pair_mid)

    def by_class(self, lex: Lexicon, model: np.ndarray) -> np.ndarray:
        """The probability of each pair by the classes."""
        now = self.group[self.pair_word]
        p = model[self.group[self.pair_mid], now].astype(np.float64)
        share = np.log10(lex.held + 0.5 * (lex.kinds + 1))
        p += np.where(now >= VOCABULARY, np.log10(self.counts[self.pair_word] + 0.5) - share[now], 0.0)
        return 10.0 ** p


def numbered(*columns: np.ndarray) -> np.ndarray:
    """The numbers from 0 of runs of equal rows."""
    new = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return np.append(0, np.cumsum(new))[:len(columns[0])]


TABLES = "part int, u long, v long, t double, p1 double"
REPLIES = "slice long, part int, own boolean, blob binary"
REPLY_TYPES = (np.uint32, np.float32, np.uint32, np.int64)
DOCUMENT_TYPES = (np.int64, np.uint8, np.int64, np.int64, np.float64)


def _seat_parts(lexicon, model, rounds: int):
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """With ``rounds``, of which the last: the tables of words after hot words, by part. Without:
        sums per document of the parts' tokens, and what slices know, by slice."""
        lex, classes = lexicon.value, model.value
        for rows in grouped(batches, "part"):
            number = rows.column("part")[0].as_py()
            kind = rows.column("kind").to_numpy()
            own = rows.filter(pa.array(kind == DOCUMENTS))
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [own.column("slice").combine_chunks(), own.column("part").combine_chunks(),
                     pa.array(np.ones(len(own), bool)), own.column("blob").combine_chunks()],
                    names=["slice", "part", "own", "blob"])
            if not (kind == SENT_TOKENS).any():
                continue
            part = Part(rows, lex)
            words, pair_words = part.hashes[part.word], part.hashes[part.pair_word]
            p1 = part.by_class(lex, classes)
            hot = number >= lex.shared
            if hot:
                given = rows.filter(pa.array(kind == GIVEN))
                told = given.column("b").to_numpy().view(np.uint64)
                order = np.argsort(told)
                at = order[np.searchsorted(told, pair_words, sorter=order)] if len(told) else order
                i = (rounds or len(SWEEPS)) - 1
                current = given.column("p").to_numpy()[at] if i else p1
                kept, left, tables = seat_level(part.room, words, part.c, current[part.pair], SWEEPS[i], 100 * number + 2 * i)
                if rounds:
                    t = np.bincount(part.pair, weights=tables, minlength=len(p1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(p1), number, np.int32)),
                         pa.array(part.hashes[part.pair_mid].view(np.int64)), pa.array(pair_words.view(np.int64)),
                         pa.array(t), pa.array(p1)], names=["part", "u", "v", "t", "p1"])
                    continue
                current = given.column("q").to_numpy()[at]
            else:
                current = p1
                for i, sweeps in enumerate(SWEEPS):
                    seed = 100 * number + 2 * i
                    kept, left, tables = seat_level(part.room, words, part.c, current[part.pair], sweeps, seed)
                    t = np.bincount(part.pair, weights=tables, minlength=len(p1))
                    above, rest, _ = seat_level(part.pair_room, pair_words, customers_of(t), p1, sweeps, seed + 1)
                    current = above + rest * p1
            logs = np.log10(kept + left * current[part.pair])
            for at, doc, index, rare in zip(part.slices.tolist(), part.docs, part.index, part.rare):
                cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                sums = np.add.reduceat(logs[index], cuts).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([number], pa.int32()), pa.array([False]),
                     pa.array([shrunk(np.diff(doc[cuts], prepend=np.uint32(0)), sums, *rare)], pa.binary())],
                    names=["slice", "part", "own", "blob"])
    return run


@giving_back
def _sum_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, n_tokens, n_known, base, score of every document, from what the parts sent back."""
    for rows in grouped(batches, "slice"):
        own = rows.column("own").to_numpy()
        blobs = rows.column("blob")
        ids, valid, n_tokens, n_known, base = grown(blobs[int(np.flatnonzero(own)[0])].as_py(), *DOCUMENT_TYPES)
        score = np.zeros(len(ids))
        for i in np.flatnonzero(~own).tolist():
            step, sums, doc, counts = grown(blobs[i].as_py(), *REPLY_TYPES)
            score[np.cumsum(step)] += sums
            np.add.at(base, doc, np.log10(counts + 0.5))
            np.add.at(n_known, doc, (counts > 0).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=valid == 0), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score)],
            names=["id", "n_tokens", "n_known", "base_score", "score"])


def by_part(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(2 * parts, "part").sortWithinPartitions("part", "kind", "slice")


def hot_words(rows: DataFrame, asked: DataFrame, shared, model, lex: Lexicon) -> DataFrame:
    """GIVEN rows: the probabilities of words after hot ones, before the last turn of the level above
    and after it. The parts of a hot word send the tables of its contexts, seated in each."""
    sent = rows.mapInArrow(_send(shared, True), SENT).unionByName(asked.filter(F.col("part") >= lex.shared))
    given = None
    for i, sweeps in enumerate(SWEEPS):
        every = sent if given is None else sent.unionByName(given)
        tables = stored(by_part(every, lex.parts - lex.shared).mapInArrow(_seat_parts(shared, model, i + 1), TABLES),
                        "py-tables-of-hot-words")
        pairs = stored(tables.groupBy("u", "v").agg(F.sum("t").alias("t"), F.first("p1").alias("base")).select(
            "u", "v", F.lit(0).cast("long").alias("mid"), "base",
            F.when(F.col("t") > 0, F.greatest(F.round("t"), F.lit(1.0))).otherwise(0.0).cast("long").alias("c")),
            "py-pairs-of-hot-words")
        total = pairs.count()
        middle = sample_words(with_shares(pairs, total), discount_of(pairs, "c"), sweeps, total, "py-middle-of-hot-words")
        now = middle.drop("mid").join(pairs.select("u", "v", "base"), ["u", "v"]).select(
            "u", "v", (F.col("kept") + F.col("opened") * F.col("base")).alias("now"))
        found = tables.select("part", "u", "v").join(now, ["u", "v"])
        if given is not None:
            found = found.join(given.select("part", F.col("b").alias("v"), F.col("p").alias("last")), ["part", "v"])
        last, new = (F.col("now"), F.lit(None)) if i + 1 < len(SWEEPS) else (
            F.col("last") if given is not None else F.lit(None), F.col("now"))
        given = stored(found.select(
            "part", F.lit(GIVEN).alias("kind"), F.lit(None).cast("long").alias("slice"), F.col("u").alias("a"),
            F.col("v").alias("b"), last.cast("double").alias("p"), new.cast("double").alias("q"),
            F.lit(None).cast("binary").alias("rare"), F.lit(None).cast("binary").alias("blob")), "py-hot-words")
    return given


# ---- scores ------------------------------------------------------------------------------

def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``,
    by a model learnt from the rows that are not held out (crc32 of the id as text, mod 5, is not
    1; a null id counts as the empty text, so it is in training).

    Null and empty texts are one token, their end. Repeated rows are learnt and scored as often
    as they occur. No rows, no result; without training rows every token is unknown; other
    columns are not looked at; texts are never cut.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    counts = stored(rows.mapInArrow(_count_words, "w long, g int, c long, n long").groupBy("w").agg(
        F.first("g").alias("g"), F.sum("c").alias("c"), F.sum("n").alias("n")), "py-words")
    lexicon = Lexicon(counts)
    shared = spark.sparkContext.broadcast(lexicon)
    classes = stored(rows.mapInArrow(_count_classes(shared), "part int, w long, counts binary"), "py-classes")
    blocks = classes.filter("counts is not null").repartition(-(-CLASSES // BLOCK), "part").sortWithinPartitions("part")
    pairs = stored(blocks.mapInArrow(_sum_classes, "u int, v int, c long"), "py-pairs")
    model = spark.sparkContext.broadcast(class_model(pairs))
    asked = classes.filter("counts is null").join(counts.select("w", "c"), "w").select(
        "part", F.lit(COUNTS).alias("kind"), F.lit(None).cast("long").alias("slice"), F.col("w").alias("a"),
        F.lit(None).cast("long").alias("b"), F.col("c").cast("double").alias("p"), F.lit(None).cast("double").alias("q"),
        F.lit(None).cast("binary").alias("rare"), F.lit(None).cast("binary").alias("blob"))
    sent = rows.mapInArrow(_send(shared, False), SENT).unionByName(asked)
    if lexicon.parts > lexicon.shared:
        sent = sent.unionByName(hot_words(rows, asked, shared, model, lexicon))
    replies = by_part(sent, lexicon.parts).mapInArrow(_seat_parts(shared, model, 0), REPLIES)
    total = replies.repartition("slice").sortWithinPartitions("slice", "part").mapInArrow(
        _sum_documents, "id long, n_tokens long, n_known long, base_score double, score double")
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return total.select(
        F.col("id").alias(id_col), (F.crc32(text_id.cast("binary")) % 5 == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """held_out and the perplexity per token, from the rows of ``score_documents``."""
    return scored.groupBy("held_out").agg(
        F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
