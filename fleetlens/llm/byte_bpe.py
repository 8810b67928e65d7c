"""Byte-level BPE: encoding and decoding of whole texts, in batches of arrays.

Token boundaries of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

come from a finite automaton over symbols (codepoint classes with a look at the neighbours).
Each symbol is a function on states; functions compose associatively, so the codepoints of a
batch are cut into equal blocks, the functions of all blocks are composed side by side, the
block functions give each block's first state, and one more pass over the blocks side by side
yields the boundaries. The slices between boundaries are made distinct; their merges are cached.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import distinct_slices, packed, spans, text_bytes, text_slices
from fleetlens.llm.common import text_or_empty

BLOCK = 256
CACHED = 300_000        # slices whose tokens a worker remembers; then it starts anew
MATRIX_BYTES = 48       # slices up to this length are merged many at a time
NO_RANK = np.int32(2**31 - 1)

LETTER, NUMBER, OTHER, SPACES, LAST_SPACE, LAST_WHITE, SHORT, LONG = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, PREFIX, EAT_1, EAT_2 = range(8)
# The codepoints of Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F,
         0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACES of every codepoint."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    first = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    kinds = np.array(first)
    out[kinds == "L"], out[kinds == "N"] = LETTER, NUMBER
    out[WHITE] = SPACES
    return out


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token begins here", both by symbol * 8 + state. Symbols from 8 on are
    the same at the first codepoint of a text, where the state before does not count."""
    step, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, SPACES: IN_SPACES,
           LAST_SPACE: PREFIX, LAST_WHITE: IN_SPACES, SHORT: IN_OTHERS, LONG: IN_OTHERS}
    for symbol in range(16):
        for state in range(8):
            at = FRESH if symbol >= 8 else state
            kind = symbol % 8
            if at in (EAT_1, EAT_2):
                step[symbol, state] = FRESH if at == EAT_1 else EAT_1
                continue
            joins = at == run[kind] and kind not in (LAST_SPACE, LAST_WHITE)
            joins |= at == PREFIX and kind not in (SPACES, LAST_SPACE, LAST_WHITE)
            cut[symbol, state] = not joins
            step[symbol, state] = run[kind]
            if kind in (SHORT, LONG) and not joins:
                step[symbol, state] = EAT_1 if kind == SHORT else EAT_2
    return step.ravel(), cut.ravel()


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The automaton's symbol of each codepoint; ``firsts`` are the first ones of the texts."""
    kind = classes()[points]
    begins = np.zeros(len(points) + 1, bool)
    begins[firsts] = True
    begins[-1] = True
    ends = begins[1:]
    white = kind == SPACES
    last = white & ~ends
    last[:-1] &= ~white[1:]
    out = kind.copy()
    out[last] = LAST_WHITE
    out[last & (points == 32)] = LAST_SPACE
    quotes = np.flatnonzero((points == ord("'")) & ~ends)
    if len(quotes):
        one = points[quotes + 1]
        two = points[np.minimum(quotes + 2, len(points) - 1)] * ~ends[quotes + 1]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))
        out[quotes[pairs | (one == ord("l")) & (two == ord("l"))]] = LONG
    out[begins[:-1]] += 8
    return out


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the slices of the pattern begin; every text's first codepoint is one of them."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    step, cut = automaton()
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, OTHER, np.uint8)
    padded[:n] = symbols(points, firsts)
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T) * np.uint8(8)
    composed = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    for column in columns:
        composed = step[column[:, None] + composed]
    state = np.zeros(blocks, np.uint8)
    for i in range(1, blocks):
        state[i] = composed[i - 1, state[i - 1]]
    begins = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(columns):
        at = column + state
        begins[j] = cut[at]
        state = step[at]
    return np.flatnonzero(begins.T.ravel()[:n])


class Vocabulary:
    """Ranks of byte strings, the ranks of pairs, and the tokens of slices seen before."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        tokens = sorted(self.ranks.items(), key=lambda x: x[1])
        self.size = tokens[-1][1] + 1
        lengths = np.zeros(self.size, np.int64)
        lengths[[i for _, i in tokens]] = [len(t) for t, _ in tokens]
        self.lengths, self.data = lengths, np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        self.starts = np.cumsum(lengths) - lengths
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)
        self.cache: dict[bytes, bytes] = {}

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NO_RANK)

    def merge_many(self, slices: list[bytes], length: int) -> list[bytes]:
        """Tokens of slices of one length: each round merges every slice's best pair."""
        ids = self.byte_ids[np.frombuffer(b"".join(slices), np.uint8).reshape(-1, length)]
        rank = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows, width = np.arange(len(slices)), np.full(len(slices), length)
        out: list[bytes] = [b""] * len(slices)
        columns = np.arange(length)
        while True:
            best = rank.argmin(1)
            low = rank[np.arange(len(rows)), best]
            done = low == NO_RANK
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, :width[i]].astype("<u4").tobytes()
            if done.all():
                return out
            go = ~done
            ids, rank, rows, width, best, low = ids[go], rank[go], rows[go], width[go] - 1, best[go], low[go]
            n = np.arange(len(rows))
            ids = np.take_along_axis(ids, np.minimum(columns + (columns > best[:, None]), length - 1), 1)
            ids[n, best] = low
            shifted = np.minimum(columns[:-1] + (columns[:-1] >= best[:, None]), length - 2)
            rank = np.take_along_axis(rank, shifted, 1)
            rank[:, -1] = NO_RANK
            left = n[best > 0]
            rank[left, best[left] - 1] = self.pair_ranks(ids[left, best[left] - 1], low[left])
            right = n[best < width - 1]
            rank[right, best[right]] = self.pair_ranks(low[right], ids[right, best[right] + 1])

    def merge_long(self, piece: bytes) -> bytes:
        """Tokens of one slice, by a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.pairs.get(ids[i] * self.size + ids[j])) is not None:
                heapq.heappush(heap, (r, i, ids[i], j, ids[j]))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            r, i, a, j, b = heapq.heappop(heap)
            if ids[i] != a or after[i] != j or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def tokens_of(self, slices: list[bytes]) -> list[bytes]:
        """The ids of each slice as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        found = [self.cache.get(s) for s in slices]
        by_length: dict[int, list[int]] = {}
        for i, (piece, known) in enumerate(zip(slices, found)):
            if known is None:
                whole = self.ranks.get(piece)
                if whole is not None:
                    found[i] = self.cache[piece] = whole.to_bytes(4, "little")
                elif len(piece) > MATRIX_BYTES:
                    found[i] = self.merge_long(piece)
                else:
                    by_length.setdefault(len(piece), []).append(i)
        for length, where in by_length.items():
            for i, ids in zip(where, self.merge_many([slices[i] for i in where], length)):
                found[i] = self.cache[slices[i]] = ids
        return found

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the texts, where each token begins in its text (bytes), the ends by text."""
        data, ends = text_bytes(text)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at_byte = np.flatnonzero((data & 0xC0) != 0x80)
        firsts = np.searchsorted(at_byte, ends[:-1][np.diff(ends) > 0])
        starts = at_byte[token_starts(points, firsts)]
        which, contents = distinct_slices(data, starts)
        tokens = self.tokens_of(contents)
        sizes = np.array([len(t) // 4 for t in tokens], np.int64)
        flat = np.frombuffer(b"".join(tokens), "<u4")
        ids = flat[spans((np.cumsum(sizes) - sizes)[which], sizes[which])]
        per_slice = np.append(0, np.cumsum(sizes[which]))
        token_ends = per_slice[np.searchsorted(starts, ends)]
        widths = self.lengths[ids]
        begins = np.cumsum(widths) - widths
        begins = begins - np.repeat(ends[:-1], np.diff(token_ends))
        return ids, begins, token_ends

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spans(self.starts[ids], self.lengths[ids])]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and starts of every row of ``docs``; the last two hold unsigned 32-bit
    little-endian integers: token ids, and the byte of the text at which each token begins.

    ``path`` names a rank file that every executor has. Null and empty texts have no tokens;
    a null id stays null; repeated rows give equal rows; no rows, no result. A text is
    never cut, whatever its length, and other columns are not looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in text_slices(batches, "text"):
            ids, begins, ends = vocab.encode(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(ends)), packed(ids, ends),
                 packed(begins.astype("<u4"), ends)], names=["id", "n_tokens", "ids", "starts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids binary, starts binary").withColumnRenamed(
        "id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids and the bytes that the ids stand for, of rows made by ``encode``.
    Every token's length is held against the retained starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in text_slices(batches, "ids", limit=4 << 20):
            ids, ends = text_bytes(part.column("ids"))
            begins, _ = text_bytes(part.column("starts"))
            ids, begins, ends = ids.view("<u4"), begins.view("<u4"), ends // 4
            data = vocab.decode(ids)
            widths = vocab.lengths[ids]
            at = np.append(0, np.cumsum(widths))
            if len(ids) and not np.array_equal(at[:-1] - np.repeat(at[ends[:-1]], np.diff(ends)), begins):
                raise ValueError("ids and starts do not belong together")
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("n_tokens"), part.column("ids"), packed(data, at[ends])],
                names=["id", "n_tokens", "ids", "data"])

    return encoded.withColumnRenamed(id_col, "id").mapInArrow(
        run, "id long, n_tokens long, ids binary, data binary").withColumnRenamed("id", id_col)
