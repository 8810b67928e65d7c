"""Packing token sequences: a configuration linear program over the length histogram.

A configuration says how many pieces of each length class share one sequence. The program's
covering constraints (every class has its pieces placed) are solved by multiplicative weights:
classes that are covered lose weight, and the next configuration is priced by a knapsack
dynamic program over the weights. The fractional solution is rounded down to whole numbers of
sequences, what is left over makes a smaller program, and the last remainder goes by best fit.
Pieces shorter than their class leave room, which the longest piece that fits takes.

All this works on counts by length, of which there are at most ``capacity``, however many
documents there are. The documents themselves stay distributed: a piece's rank among the
pieces of its length says which slot of the plan it gets.
"""

from __future__ import annotations

import functools
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm.arrays import giving_back, packed, spans, text_slices
from fleetlens.llm.common import stored, text_or_empty

CAPACITY = 4096
END_ID = 1
CLASSES = 128
STEP = 0.1              # coverage by which a class's weight falls to 1/e
PART = 0.2              # the share of it that one configuration covers of its scarcest class
ROUNDS = 12_000
SMALL = 16              # pieces under 1/16 of a sequence only fill the room that others leave
EXACT = 24              # larger lengths that are a class each
PASSES = 3              # programs: of all pieces, then of what rounding down leaves
CACHED = 1_000_000      # words that a worker remembers
SLICE_BYTES = 8 << 20    # of text that is tokenised at a time


# ---- tokens ------------------------------------------------------------------------------

class WordTokens:
    """Ids of a tokenizer that treats each stretch without white space on its own, so that the
    ids of a text are those of its stretches. Distinct stretches are encoded once and kept as
    arrays: their texts, in which those of the next slice are looked up all at once, and their
    ids one after the other."""

    MARK = "\x01"       # a token of its own; stretches that hold it are encoded alone
    ENDS = "".join(set(string.punctuation) - {"'"})

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.mark, = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([""], pa.large_string())
        self.flat, self.ends = np.empty(0, "<u4"), np.zeros(2, np.int64)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Encode words, many in one call, and keep them; their numbers."""
        alone = {w: self._plain(w) for w in words if self.MARK in w or "<|" in w}
        rest = [w for w in words if w not in alone]
        ids, sizes = list(alone.values()), [len(x) for x in alone.values()]
        for at in range(0, len(rest), 500):
            some = rest[at:at + 500]
            coded = self._plain(f" {self.MARK} ".join(some))
            marks = coded == self.mark
            cuts = np.flatnonzero(marks)
            if len(cuts) != len(some) - 1:
                raise ValueError("this tokenizer does not keep stretches apart")
            ids.append(coded[~marks])
            sizes += np.diff(cuts, prepend=-1, append=len(coded)).tolist()
            sizes[-len(some):] = [n - 1 for n in sizes[-len(some):]]
        return self._keep([*alone, *rest], np.concatenate([np.empty(0, "<u4"), *ids]), np.array(sizes, np.int64))

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> dict[str, int]:
        numbers = dict(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.known = pa.concat_arrays([self.known, pa.array(words, pa.large_string())])
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return numbers

    def _find(self, words: pa.Array) -> np.ndarray:
        """Numbers of kept words, -1 of others. Arrow hashes all kept words for each call."""
        return pc.fill_null(pc.index_in(words, self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def _split(self, word: str) -> tuple[str, str]:
        """Letters, then signs, are two stretches to the tokenizer's own pattern."""
        stem = word.rstrip(self.ENDS)
        return (stem, word[len(stem):]) if word.isascii() and stem.isalpha() and "<|" not in word else (word, "")

    def gather(self, rows: np.ndarray) -> np.ndarray:
        """The ids of kept words, one after the other."""
        return self.flat[spans(self.ends[rows], self.ends[rows + 1] - self.ends[rows])]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number under which each of the distinct ``words`` is kept, after learning new ones."""
        words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words).cast(pa.large_string())
        if len(self.known) > CACHED:
            self._forget()
        at = self._find(words)
        new = np.flatnonzero(at < 0)
        if not len(new):
            return at
        wanted = words.take(pa.array(new)).to_pylist()
        parts = [(w, *self._split(w)) for w in dict.fromkeys(wanted)]
        pieces = list(dict.fromkeys(x for _, *p in parts for x in p))
        number = dict(zip(pieces, self._find(pa.array(pieces, pa.large_string())).tolist()))
        number |= self._learn([x for x, n in number.items() if n < 0])
        # a word with signs at its end is kept as a whole, too
        both = [p for p in parts if p[2]]
        if both:
            halves = np.array([number[x] for _, *p in both for x in p])
            sizes = (self.ends[halves + 1] - self.ends[halves]).reshape(-1, 2).sum(1)
            number |= self._keep([w for w, *_ in both], self.gather(halves), sizes)
        at[new] = [number[w] for w in wanted]
        return at

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's followed by END_ID, and the ends by text."""
        lists = pc.ascii_split_whitespace(text)
        coded = lists.flatten().dictionary_encode()
        rows = self.numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.ends[rows + 1] - self.ends[rows]
        offsets = lists.offsets.to_numpy()
        ends = np.append(0, np.cumsum(sizes))[offsets - offsets[0]]
        # every text's end has a place of its own behind the text's ids
        ids = np.full(int(ends[-1]) + len(text), END_ID, "<u4")
        of = np.repeat(np.arange(len(text)), np.diff(ends))
        ids[np.arange(len(of)) + of] = self.gather(rows)
        return ids, ends + np.arange(len(ends))


@functools.cache
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


PIECES = ("id long, piece int, start long, length long, ids_crc32 long, ids binary, "
          "task int, place long")


def cut_pieces(docs: DataFrame, path: str, capacity: int, id_col: str, text_col: str,
               with_ids: bool) -> DataFrame:
    """PIECES of every document: ``place`` numbers a task's pieces of one length from 0."""
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = word_tokens(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in text_slices(batches, "text", SLICE_BYTES):
            ids, ends = tokens.encode(part.column("text"))
            sizes = np.diff(ends)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), pieces)
            piece = spans(np.zeros(len(pieces), np.int64), pieces)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            order = np.argsort(length, kind="stable")
            values, first, counts = np.unique(length[order], return_index=True, return_counts=True)
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - np.repeat(first, counts) + np.repeat(seen[values], counts)
            seen[values] += counts
            begin = ends[doc] + start
            raw = ids.astype("<u4")
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist())]
            cuts = packed(raw, np.append(begin, len(raw))) if with_ids else pa.nulls(len(doc), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                 pa.array(length), pa.array(crc, pa.int64()), cuts,
                 pa.array(np.full(len(doc), task, np.int32)), pa.array(place)],
                names=["id", "piece", "start", "length", "ids_crc32", "ids", "task", "place"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES)


# ---- the plan ----------------------------------------------------------------------------

def best_configuration(prices: np.ndarray, units: int) -> np.ndarray:
    """Unbounded knapsack: how many of each class k (size k + 1) are worth most in ``units``."""
    worth, last = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for room in range(1, units + 1):
        gains = worth[room - 1::-1][:room] + prices[:room]
        k = int(gains.argmax())
        worth[room], last[room] = gains[k], k
    counts, room = np.zeros(len(prices), np.int64), units
    while room > 0:
        k = last[room]
        if prices[k] > 0:
            counts[k] += 1
            room -= k + 1
        else:
            room -= 1       # a unit that no class makes use of
    return counts


def best_of_sizes(prices: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """The same for a few classes of any ``sizes``: each in turn, one more piece at a time."""
    worth, last = np.zeros(room + 1), np.full(room + 1, -1)
    for k in np.flatnonzero(prices > 0).tolist():
        size = int(sizes[k])
        for at in range(size, room + 1, size):
            now = worth[at:at + size]
            then = worth[at - size:at - size + len(now)] + prices[k]
            better = then > now
            now[better] = then[better]
            last[at:at + size][better] = k
    counts, at = np.zeros(len(prices), np.int64), int(worth.argmax())
    while last[at] >= 0:
        counts[last[at]] += 1
        at -= int(sizes[last[at]])
    return counts


def fractional_cover(demand: np.ndarray, rounds: int = ROUNDS, step: float = STEP,
                     price=None) -> dict[tuple, float]:
    """Configurations with their amounts, near an optimum of the covering program. ``price``
    finds the configuration worth most at given prices; by default class k has size k + 1."""
    price = price or (lambda prices: best_configuration(prices, len(demand)))
    need = demand > 0
    if not need.any():
        return {}
    covered = np.zeros(len(demand))
    amounts: dict[tuple, float] = {}
    for _ in range(rounds):
        share = np.where(need, covered / np.maximum(demand, 1), np.inf)
        if share.min() >= 1:
            break
        prices = np.where(need, np.exp(-(share - share[need].min()) / step) / np.maximum(demand, 1), 0.0)
        config = price(prices)
        used = config > 0
        amount = PART * step * (demand[used] / config[used]).min()
        key = tuple(np.repeat(np.flatnonzero(used)[::-1], config[used][::-1]).tolist())
        amounts[key] = amounts.get(key, 0.0) + amount
        covered += config * amount
    least = (covered[need] / demand[need]).mean()
    return {k: v / max(least, 1e-9) for k, v in amounts.items()}


class Filling:
    """Sequences that are being filled, by pattern. A slot holds the pieces of one length with
    ranks from ``first`` on, in consecutive sequences, all at one offset."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left, self.given = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
        self.slots: list[tuple[int, int, int, int]] = []      # length, first rank, sequence, offset
        self.lengths = np.flatnonzero(self.left)

    def best_fit(self) -> Filling:
        """All that is left, longest first, each sequence by the longest piece that still fits."""
        for length in self.lengths[::-1].tolist():
            while left := int(self.left[length]):
                copies = min(left, self.capacity // length)
                n, have = left // copies, ()
                for _ in range(copies):
                    _, have = self.take(n, have, length)
                self.complete(n, have)
        return self

    def program(self, classes: int, step: float) -> Filling:
        """Whole configurations of the program, rounded down; what that leaves makes a program of
        its own; then best fit. The room that pieces shorter than their class leave in a sequence
        goes to the longest piece that fits.

        If there are but a few lengths, each is a class; else classes are stretches of lengths.
        """
        width = -(-self.capacity // classes)
        large = self.lengths[self.lengths > self.capacity // SMALL]
        if len(large) <= EXACT:
            above, upto = large - 1, large
            price = functools.partial(best_of_sizes, sizes=large, room=self.capacity)
        else:
            above, price = np.arange(classes) * width, None
            upto = np.minimum(above + width, self.capacity)
        for _ in range(PASSES):
            left = np.append(0, np.cumsum(self.left))
            demand = np.where(upto > self.capacity // SMALL, left[upto + 1] - left[np.minimum(above, upto) + 1], 0)
            rounded = {c: int(n + 1e-6) for c, n in fractional_cover(demand, step=step, price=price).items()}
            if not any(rounded.values()):
                break
            # configurations with the longest pieces first
            for config, amount in sorted(rounded.items(), key=lambda x: [-k for k in x[0]]):
                groups = [(amount, ())] if amount else []
                for k in config:
                    groups = [g for n, have in groups for g in self.take_class(n, have, int(above[k]), int(upto[k]))]
                for n, have in groups:
                    self.complete(n, have)
        return self.best_fit()

    def take(self, n: int, have: tuple, length: int) -> tuple[int, tuple]:
        first = self.given[length]
        self.given[length] += n
        self.left[length] -= n
        return n, (*have, (length, int(first)))

    def take_class(self, n: int, have: tuple, above: int, upto: int) -> list[tuple[int, tuple]]:
        """n open sequences with one piece more of the class, longest first; where the pieces
        run out, those that got none stay as they are. Ranks of split groups stay aligned."""
        out = []
        for length in range(upto, above, -1):
            some = min(n, int(self.left[length]))
            if some:
                _, more = self.take(some, have, length)
                out.append((some, more))
                have, n = tuple((a, b + some) for a, b in have), n - some
        return out + ([(n, have)] if n else [])

    def complete(self, n: int, have: tuple) -> None:
        while n:
            room = self.capacity - sum(x for x, _ in have)
            fits = self.lengths[:np.searchsorted(self.lengths, room, "right")]
            fits = fits[self.left[fits] > 0]
            if not len(fits):
                break
            length = int(fits[-1])
            some = min(n, int(self.left[length]))
            if some < n:        # split: the first ``some`` go on, the others look further
                self.complete(*self.take(some, have, length))
                have, n = tuple((a, b + some) for a, b in have), n - some
            else:
                n, have = self.take(some, have, length)
        if n and have:
            offset = 0
            for length, first in have:
                self.slots.append((length, first, self.sequences, offset))
                offset += length
            self.sequences += n


class Plan:
    """Where each piece goes, by its length and its rank among the pieces of that length: the
    filling by the program, or plain best fit where that opens fewer sequences."""

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY, classes: int = CLASSES, step: float = STEP):
        fillings = [Filling(counts, capacity).program(classes, step), Filling(counts, capacity).best_fit()]
        best = min(fillings, key=lambda f: f.sequences)
        self.capacity, self.sequences = capacity, best.sequences
        self.by_program, self.by_best_fit = (f.sequences for f in fillings)
        total = np.append(0, np.cumsum(counts))
        table = np.array(best.slots, np.int64).reshape(-1, 4)
        key = total[table[:, 0]] + table[:, 1]
        order = np.argsort(key)
        # rank among all pieces, shortest first, where a slot begins; its sequence and offset
        self.base, self.key = total, key[order]
        self.sequence, self.offset = table[order, 2], table[order, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.base[length] + rank
        at = np.searchsorted(self.key, key, "right") - 1
        return self.sequence[at] + key - self.key[at], self.offset[at]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places: id, piece, start, length, ids_crc32,
    sequence_id, offset, and with ``with_ids`` the ids (unsigned 32-bit little-endian).

    A document's ids are its text's, then END_ID; null and empty texts are END_ID alone. Only
    documents longer than ``capacity`` are cut. Repeated rows are packed as often as they
    occur, null ids stay null; no rows, no result; other columns are not looked at.
    """
    pieces = stored(cut_pieces(docs, path, capacity, id_col, text_col, with_ids), "pack-pieces")
    per_task = stored(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "pack-counts")
    # at most ``capacity`` rows, whatever the input
    histogram = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row["length"]] = row["n"]
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    @giving_back
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = plan.value.find(length, rank)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = pieces.join(before.hint("merge"), ["task", "length"]).select(
        *names, (F.col("before") + F.col("place")).alias("rank"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def sequences(packed_rows: DataFrame) -> DataFrame:
    """sequence_id and ids of each packed sequence, from ``pack(..., with_ids=True)``; a
    sequence has at most ``capacity`` ids, so its group is small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed_rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.expr("aggregate(parts.ids, cast('' as binary), (a, x) -> concat(a, x))").alias("ids"))
