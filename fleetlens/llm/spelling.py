"""Spelling variants: words one error apart, found by search schemes on bidirectional FM-indexes.

Two words one error apart agree in the first or in the second half of either of them. So every
word is filed under its halves, and under the beginnings and ends that are halves of a word one
longer or shorter; a word's neighbours are filed under one of its own halves. Words that share a
key meet in a task. A task gathers keys up to a bounded number of words, and indexes these as one
text in which every word stands between delimiters.

The index is a pair of FM-indexes, of the text and of its reverse: one extends a match to the
left, the other to the right, as an interval of ranks of suffixes. A search scheme for one error
has two searches: the first half exactly from its delimiter, then on to the right with one error
to the delimiter at the end; and the second half exactly, then on to the left. All searches of a
batch advance together, as arrays of intervals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import spans, text_bytes, text_slices
from fleetlens.llm.common import stored, text_or_empty

LEAST_LENGTH, LEAST_COUNT = 7, 2
RATIO = 10              # a form occurs so many times as often
INDEX_WORDS = 50_000    # words of one index
SPLIT_WORDS = 20_000    # a key with more words is divided, its queries are copied
ROWS = 1 << 18          # intervals that are branched at a time


# ---- words ------------------------------------------------------------------------


def letter_runs(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of A-Z, a-z and U+00C0..U+00FF (bytes C3 80 to C3 BF) start and stop."""
    two = np.zeros(len(data), bool)
    two[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128) | two
    letter[1:] |= two[:-1]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    begins = ends[:-1][np.diff(ends) > 0]
    first[begins] = letter[begins]
    last[begins[1:] - 1] = letter[begins[1:] - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _counts(least: int, drop_every: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        data, ends = text_bytes(part.column("text"))
        if not len(data):
            continue
        starts, stops = letter_runs(data, ends)
        lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        long = lead[stops] - lead[starts] >= least
        starts, stops = starts[long], stops[long]
        low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
        sizes = stops - starts
        flat = low[spans(starts, sizes)]
        coded = pa.Array.from_buffers(pa.binary(), len(sizes), [
            None, pa.py_buffer(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        runs, number = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        docs = np.searchsorted(ends, starts, "right") - 1
        pairs, times = np.unique(docs * max(len(runs), 1) + number, return_counts=True)
        total: dict[bytes, int] = {}
        ids = [b"" if i is None else str(i).encode() for i in part.column("id").to_pylist()]
        seeds = [zlib.crc32(i + b":") for i in ids]
        for doc, at, n in zip((pairs // max(len(runs), 1)).tolist(), (pairs % max(len(runs), 1)).tolist(), times.tolist()):
            word = runs[at]
            if drop_every:
                h = zlib.crc32(word, seeds[doc])
                if h % drop_every == 0:
                    text = word.decode()
                    i = h % len(text)
                    if len(text) == least:
                        continue
                    word = (text[:i] + text[i + 1:]).encode()
            total[word] = total.get(word, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()),
                                          pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
                drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts with ``least_length`` code points and ``least_count``
    occurrences or more: maximal runs of letters, A-Z as a-z.

    With ``drop_every``, a run loses the code point h % length if that number divides h, the
    crc32 of ``<id>:<run>`` (a null id is the empty text). Null texts are empty; repeated rows
    count as often as they occur; no words, no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    counted = rows.mapInArrow(partial(_counts, least_length, drop_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- index ------------------------------------------------------------------------


def suffix_order(text: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling; comparison ends at a delimiter (0), and delimiters are
    told apart by place, so as many rounds are needed as the longest word has binary digits."""
    n = len(text)
    rank = text.astype(np.int64) + len(breaks)
    rank[breaks] = np.arange(len(breaks))
    step = 1
    order = np.argsort(rank, kind="stable")
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        # what follows a delimiter does not matter
        pair = rank * (int(rank.max()) + 2) + np.where(rank < len(breaks), 0, after)
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        fresh = np.append(0, np.cumsum(sorted_pair[1:] != sorted_pair[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """Backward search on ``text``, which is cyclic: 0 delimits, and starts it."""

    def __init__(self, text: np.ndarray, symbols: int):
        breaks = np.flatnonzero(text == 0)
        self.n, self.symbols = len(text), symbols
        self.order = suffix_order(text, breaks)
        self.before = text[self.order - 1].astype(np.int64)
        # places by (symbol, rank): their number below a bound is a step of the backward search
        self.places = np.sort(self.before * (self.n + 1) + np.arange(self.n))

    def extend(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with ``symbol`` before them."""
        base = symbol * (self.n + 1)
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (interval, symbol) such that the symbol stands before a match of the interval."""
        size = high - low
        few = np.flatnonzero(size <= 2 * self.symbols)
        rows = np.repeat(few, size[few])
        pairs = np.unique(rows * self.symbols + self.before[spans(low[few], size[few])])
        many = np.flatnonzero(size > 2 * self.symbols)
        every = np.repeat(many, self.symbols) * self.symbols + np.tile(np.arange(self.symbols), len(many))
        pairs = np.concatenate([pairs, every])
        return pairs // self.symbols, pairs % self.symbols


class WordIndex:
    """Distinct words between delimiters, to be matched from their beginnings (``<``) or from their
    ends (``>``): of the pair of indexes the one that the search extends."""

    def __init__(self, side: str, words: np.ndarray, sizes: np.ndarray, symbols: int):
        """``words`` holds the symbols (from 1 on) of all words, one after the other."""
        number = np.repeat(np.arange(len(sizes)), sizes)
        text = np.zeros(len(words) + len(sizes), np.int64)
        text[np.arange(len(words)) + number + 1] = words
        owner = np.cumsum(text == 0) - 1
        # to go right in the text is to go left in its reverse
        self.index = FmIndex(text if side == ">" else text[::-1].copy(), symbols)
        self.owner = owner if side == ">" else owner[::-1]

    def words_at(self, ranks: np.ndarray) -> np.ndarray:
        """The numbers of the words whose suffixes, from their first symbol on, have these ranks."""
        return self.owner[self.index.order[ranks]]


def one_error(index: FmIndex, queries: np.ndarray, ends: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, rank of the match) of all words one error away from a query, the error being after its first ``exact`` symbols. Queries are given in the order in which the index extends a match; ``queries`` holds their symbols, ``ends`` where each one ends."""
    begins = np.append(0, ends[:-1])
    n = len(ends)
    low, high = np.zeros(n, np.int64), np.full(n, index.n)
    low, high = index.extend(low, high, np.zeros(n, np.int64))
    alive = np.arange(n)
    for k in range(int(exact.max()) if n else 0):
        going = exact[alive] > k
        step = alive[going]
        low[step], high[step] = index.extend(low[step], high[step], queries[begins[step] + k])
        alive = alive[low[alive] < high[alive]]
    found_q, found_r = [], []
    for at in range(0, len(alive), ROWS // 8):
        q, r = _with_error(index, queries, begins, ends, alive[at:at + ROWS // 8], low, high, exact)
        found_q.append(q)
        found_r.append(r)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *found_q]), np.concatenate([none, *found_r])


def _with_error(index, queries, begins, ends, query, low, high, exact):
    """Go on from the exact part of the queries ``query``, without and with the error."""
    low, high, at = low[query], high[query], begins[query] + exact[query]
    free = (query, low, high, at)                       # no error so far
    spent = [np.empty(0, np.int64)] * 4                 # the error is made
    found_q, found_r = [], []
    while len(free[0]) or len(spent[0]):
        query, low, high, at = free
        more = at < ends[query]
        # the error here: another symbol in place of this one, or before it, or this one left out
        row, symbol = index.branches(low, high)
        real = symbol > 0
        row, symbol = row[real], symbol[real]
        b_low, b_high = index.extend(low[row], high[row], symbol)
        held = b_low < b_high
        row, symbol, b_low, b_high = row[held], symbol[held], b_low[held], b_high[held]
        q, p = query[row], at[row]
        same = np.zeros(len(row), bool)
        inside = more[row]
        same[inside] = queries[p[inside]] == symbol[inside]
        other = inside & ~same
        made = [[q[other], b_low[other], b_high[other], p[other] + 1],
                [q, b_low, b_high, p],
                [query[more], low[more], high[more], at[more] + 1]]
        # an insertion before an equal symbol is the same as one after it, which comes later
        made[1] = [x[~same] for x in made[1]]
        # without an error
        go = inside & same
        free = (q[go], b_low[go], b_high[go], p[go] + 1)
        spent = [np.concatenate([x, *[m[i] for m in made]]) for i, x in enumerate(spent)]
        # those that have their error read on until they end
        query, low, high, at = spent
        done = at == ends[query]
        # delimiters are in the order of their places: take the match before the step to them
        first, beyond = np.searchsorted(index.places, low[done]), np.searchsorted(index.places, high[done])
        hit = first < beyond
        found_q.append(query[done][hit])
        found_r.append(index.places[first[hit]])
        query, low, high, at = query[~done], low[~done], high[~done], at[~done]
        low, high = index.extend(low, high, queries[at])
        held = low < high
        spent = [query[held], low[held], high[held], at[held] + 1]
    none = np.empty(0, np.int64)
    pairs = np.unique(np.concatenate([none, *found_q]) * index.n + np.concatenate([none, *found_r]))
    return pairs // index.n, pairs % index.n


# ---- neighbours ---------------------------------------------------------------------


class _Batch:
    """The words filed under some keys of one task, and those that ask there, by side."""

    def __init__(self):
        self.words: dict[str, dict[str, int]] = {"<": {}, ">": {}}
        self.queries: dict[str, dict[str, None]] = {"<": {}, ">": {}}

    def results(self) -> pa.RecordBatch:
        best: dict[str, tuple[int, int, str]] = {}
        for side in "<>":
            if self.words[side] and self.queries[side]:
                self._search(side, best)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(best), pa.string()), *[pa.array([b[i] for b in best.values()], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.string()))]], names=["word", "n_near", "most", "form"])

    def _search(self, side: str, best: dict[str, tuple[int, int, str]]) -> None:
        words, queries = sorted(self.words[side]), sorted(self.queries[side])
        counts = [self.words[side][w] for w in words]
        letters = sorted(set("".join(words)).union("".join(queries)))
        symbol = np.zeros(max(map(ord, letters)) + 1, np.int64)
        symbol[[ord(c) for c in letters]] = np.arange(len(letters)) + 1

        def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            return symbol[points], np.array([len(t) for t in texts], np.int64)

        index = WordIndex(side, *coded(words), len(letters) + 1)
        flat, sizes = coded(queries if side == "<" else [q[::-1] for q in queries])
        exact = sizes // 2 if side == "<" else sizes - sizes // 2
        q, rank = one_error(index.index, flat, np.cumsum(sizes), exact)
        for i, t in zip(q.tolist(), index.words_at(rank).tolist()):
            query, word, n = queries[i], words[t], counts[t]
            # with an equal first half, the search from the other side has it
            if side == ">" and word[:len(query) // 2] == query[:len(query) // 2]:
                continue
            near, most, form = best.get(query, (0, 0, ""))
            if n > most or n == most and word < form:
                most, form = n, word
            best[query] = near + 1, most, form


def _neighbours(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. A batch ends between two keys; a part of a divided key is a batch
    of its own, so no word is met under another key that belongs to another part."""
    batch, last, alone = _Batch(), None, False
    for rows in batches:
        cols = [rows.column(c).to_pylist() for c in ("key", "sub", "parts", "word", "n", "asks", "held")]
        for key, sub, parts, word, n, asks, held in zip(*cols):
            if (key, sub) != last:
                if alone or parts > 1 or sum(map(len, batch.words.values())) >= most:
                    yield batch.results()
                    batch = _Batch()
                last, alone = (key, sub), parts > 1
            if held:
                batch.words[key[0]][word] = n
            if asks:
                batch.queries[key[0]][word] = None
    yield batch.results()


def near_words(vocabulary: DataFrame, index_words: int = INDEX_WORDS, split_words: int = SPLIT_WORDS) -> DataFrame:
    """(word, n_near, most, form) of the words that have near ones, words with exactly one code
    point inserted, deleted or replaced: their number, the largest count among them, and the
    first word in code-point order with that count.

    ``vocabulary`` has each word once, with its count ``n``; its words have two code points or
    more. A key with more than ``split_words`` words is divided among several tasks.
    """
    length = F.char_length("word")

    def filed(side: str, size, asks) -> DataFrame:
        text = F.substring(F.col("word"), F.lit(1), size) if side == "<" else \
            F.substring(F.col("word"), length - size + 1, size)
        return F.struct(F.concat(F.lit(side), text).alias("key"), asks.alias("asks"))

    # Halves of words one shorter, as long, and one longer: two sizes on each side.
    low, even = F.floor((length - 1) / 2).cast("int"), length % 2 == 0
    entries = F.array(filed("<", low, ~even), filed("<", low + 1, even),
                      filed(">", F.floor(length / 2).cast("int"), even), filed(">", F.floor(length / 2).cast("int") + 1, ~even))
    rows = vocabulary.select("word", "n", F.explode(entries).alias("e")).select("word", "n", "e.key", "e.asks")
    crowded = rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > split_words).select(
        "key", F.ceil(F.col("rows") / F.lit(float(split_words))).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("word"), parts).cast("int")
    copies = F.when(F.col("asks"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(own))
    dealt = rows.join(crowded, "key", "left").select(
        "key", "word", "n", "asks", parts.alias("parts"), own.alias("own"), F.explode_outer(copies).alias("sub")).select(
        "key", "sub", "parts", "word", "n", "asks", (F.col("sub") == F.col("own")).alias("held"))
    ordered = dealt.repartition("key", "sub").sortWithinPartitions("key", "sub")
    found = ordered.mapInArrow(partial(_neighbours, index_words), "word string, n_near long, most long, form string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.max("most").alias("most"),
        F.min(F.struct((-F.col("most")).alias("less"), F.col("form"))).alias("best"),
    ).select("word", "n_near", "most", F.col("best.form").alias("form"))


def variants(vocabulary: DataFrame, ratio: int = RATIO, index_words: int = INDEX_WORDS,
             split_words: int = SPLIT_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``vocabulary`` (word, n).

    The form is the near word of the largest n, the first in code-point order among equals, if
    that is at least ``ratio`` times the word's own n, else null. The root is reached from the
    word by following forms to the last; each is commoner than the one before, so that takes
    fewer steps than the largest count has digits.
    """
    vocabulary = stored(vocabulary, "spelling-words")
    near = near_words(vocabulary, index_words, split_words)
    is_form = F.col("most") >= F.col("n") * F.lit(ratio)
    words = stored(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("most")).alias("form_n")), "spelling-near")
    hops = words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # doubling: after each round a root is twice as many forms away
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = stored(hops.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        hops = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return words.join(hops, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
