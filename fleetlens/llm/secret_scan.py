"""Secrets in whole texts: a trigram index of each slice of documents, then regular expressions.

Every rule is a regular expression. From its syntax tree a Boolean query over trigrams is derived
that each match must satisfy: sets of the strings a part can be, begin with or end in are carried
up the tree, and what they say in trigrams is joined by "and" along a sequence and by "or" over
alternatives. Trigrams are of bytes, A-Z as a-z, so letters of either case are one.

A task cuts its documents into slices and writes, for each, the postings of the trigrams that
any query names. The queries run on postings; only documents they leave over are matched against
the rule. A rule from which no trigram follows is matched against every text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _parser as syntax

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.arrays import text_bytes, text_slices
from fleetlens.llm.common import text_or_empty

PIECE = 4 << 20     # bytes of text that are turned into trigrams at a time
MOST_STRINGS = 64   # strings of a part that are carried up the tree
MOST_CHARS = 12     # characters of a class that are told apart


@dataclass(frozen=True)
class Rule:
    """``kind`` of the matches of ``pattern`` whose ``group`` has ``least`` characters or more.
    Matches are found from left to right and do not overlap; shorter ones use up their text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three kinds that the contract names, then well-known forms of keys.
# Runs of at least 16 of a class are just its maximal runs with 16 or more.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("github", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})"),
    Rule("slack", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"\bAIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----"),
    Rule("bearer", r"\b(?i:bearer)\x20+[A-Za-z0-9._~+/-]{24,}=*"),
    Rule("credentials", r"\b[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{6,128}@"),
)
BASE = ("assign", "access", "hex")


# ---- Boolean queries ------------------------------------------------------------------
# True (every text), a trigram, or ("and" | "or", queries).

Query = bool | bytes | tuple


def both(*queries: Query) -> Query:
    parts = dict.fromkeys(q for q in queries if q is not True)
    flat = dict.fromkeys(p for q in parts for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else (q,)))
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def either(*queries: Query) -> Query:
    if any(q is True for q in queries):
        return True
    flat = dict.fromkeys(queries)
    return next(iter(flat)) if len(flat) == 1 else ("or", tuple(flat))


def trigrams(text: bytes) -> Query:
    """All trigrams of ``text``."""
    return both(*[text[i:i + 3] for i in range(len(text) - 2)])


def one_of(strings: frozenset[bytes]) -> Query:
    return either(*[trigrams(s) for s in sorted(strings)])


@dataclass(frozen=True)
class Part:
    """What is known of the strings a piece of an expression matches: all of them (``exact``), or
    what they begin with and end in, and a query that texts with a match satisfy."""

    exact: frozenset[bytes] | None
    first: frozenset[bytes]
    last: frozenset[bytes]
    query: Query = True

    def loose(self) -> Part:
        """The same without the list of all strings."""
        if self.exact is None:
            return self
        return Part(None, frozenset(s[:2] for s in self.exact), frozenset(s[-2:] for s in self.exact),
                    both(self.query, one_of(self.exact)))

    def then(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None \
                and len(self.exact) * len(other.exact) <= MOST_STRINGS:
            strings = frozenset(a + b for a in self.exact for b in other.exact)
            return Part(strings, strings, strings, both(self.query, other.query))
        a, b = self.loose(), other.loose()
        over = _joined(self.exact if self.exact is not None else a.last,
                       other.exact if other.exact is not None else b.first)
        first = a.first if self.exact is None or over is None else frozenset(s[:2] for s in over)
        last = b.last if other.exact is None or over is None else frozenset(s[-2:] for s in over)
        return Part(None, first, last, both(a.query, b.query, True if over is None else one_of(over)))

    def otherwise(self, other: Part) -> Part:
        if self.exact is not None and other.exact is not None \
                and len(self.exact | other.exact) <= MOST_STRINGS:
            strings = self.exact | other.exact
            return Part(strings, strings, strings, either(self.query, other.query))
        a, b = self.loose(), other.loose()
        return Part(None, a.first | b.first, a.last | b.last, either(a.query, b.query))


def _joined(lasts: frozenset[bytes], firsts: frozenset[bytes]) -> frozenset[bytes] | None:
    """Every end with every beginning; none if that makes too many."""
    if len(lasts) * len(firsts) > MOST_STRINGS:
        return None
    return frozenset(a + b for a in lasts for b in firsts)


def known(strings: frozenset[bytes]) -> Part:
    return Part(strings, strings, strings)


NOTHING = known(frozenset([b""]))
ANYTHING = NOTHING.loose()


def folded(code: int) -> bytes:
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "surrogatepass")


def part_of(tree) -> Part:
    """The part for a parsed expression or a list of its operations."""
    out = NOTHING
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            piece = known(frozenset([folded(arg)]))
        elif name == "IN":
            piece = _class(arg)
        elif name == "SUBPATTERN":
            piece = part_of(arg[-1])
        elif name == "BRANCH":
            piece = functools.reduce(Part.otherwise, [part_of(b) for b in arg[1]])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            piece = _repeated(*arg)
        elif name in ("AT", "ASSERT", "ASSERT_NOT"):
            piece = NOTHING
        else:
            piece = ANYTHING
        out = out.then(piece)
    return out


def _class(items) -> Part:
    codes: set[int] = set()
    for op, arg in items:
        if str(op) == "LITERAL":
            codes.add(arg)
        elif str(op) == "RANGE" and arg[1] - arg[0] < MOST_CHARS:
            codes.update(range(arg[0], arg[1] + 1))
        else:
            return ANYTHING
    strings = frozenset(map(folded, codes))
    return known(strings) if len(strings) <= MOST_CHARS else ANYTHING


def _repeated(least: int, most: int, tree) -> Part:
    piece = part_of(tree)
    if least == 0:
        return piece.otherwise(NOTHING) if most == 1 else ANYTHING
    out = piece
    for _ in range(min(least, 4) - 1):
        out = out.then(piece)
    if least == most <= 4:
        return out
    # more of the same may follow
    return out.loose().then(ANYTHING).then(Part(None, piece.loose().first, piece.loose().last))


def query_of(pattern: str) -> Query:
    """A query that every text with a match of ``pattern`` satisfies; True if none follows."""
    return part_of(syntax.parse(pattern, re.ASCII)).loose().query


def named(query: Query) -> set[bytes]:
    """The trigrams of a query."""
    if isinstance(query, tuple):
        return set().union(*map(named, query[1]))
    return set() if query is True else {query}


# ---- index ------------------------------------------------------------------------------


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), query_of(r.pattern)) for r in rules]
        grams = sorted(set().union(*[named(q) for _, _, q in self.rules]))
        self.number = {g: i for i, g in enumerate(grams)}
        self.codes = np.array([int.from_bytes(g, "big") for g in grams], np.int64)
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[self.codes] = True

    def postings(self, data: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """By trigram number, the rising numbers of the texts that have it."""
        n, found = len(ends) - 1, []
        for at in range(0, max(len(data) - 2, 0), PIECE):
            piece = data[at:at + PIECE + 2]
            low = (piece + np.where((piece >= 65) & (piece <= 90), np.uint8(32), np.uint8(0))).astype(np.int32)
            code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
            hits = np.flatnonzero(self.wanted[code])
            texts = np.searchsorted(ends, hits + at, "right") - 1
            inside = hits + at + 2 < ends[texts + 1]
            found.append(np.unique(np.searchsorted(self.codes, code[hits[inside]]) * n + texts[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        grams, starts = np.unique(pairs // max(n, 1), return_index=True)
        return {int(g): p % n for g, p in zip(grams, np.split(pairs, starts[1:]))} if len(grams) else {}

    def candidates(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        """The numbers of the texts that satisfy ``query``, from postings."""
        if query is True:
            return np.arange(n)
        if isinstance(query, bytes):
            return postings.get(self.number[query], np.empty(0, np.int64))
        sets = [self.candidates(q, postings, n) for q in query[1]]
        if query[0] == "or":
            return functools.reduce(np.union1d, sets)
        sets.sort(key=len)
        return functools.reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), sets)

    def spans(self, text: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Of each text the spans found: (start, number of the rule, end), in this order."""
        data, ends = text_bytes(text)
        postings, n = self.postings(data, ends), len(text)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        texts: dict[int, str] = {}
        for at, (rule, regex, query) in enumerate(self.rules):
            for i in self.candidates(query, postings, n).tolist():
                if i not in texts:
                    texts[i] = text[i].as_py()
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), at, m.end()))
        return [sorted(spans) for spans in out]


@functools.cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """id and ``spans`` of every row of ``docs``: kind, start and end (exclusive) in code points,
    by start, then in the order of the rules. Spans of different kinds may overlap.

    Null and empty texts have no spans; a null id stays null; repeated rows give equal rows; no
    rows, no result. Texts are matched whole, whatever their length; other columns are not looked
    at. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            found = scanner(rules).spans(part.column("text"))
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in doc] for doc in found]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, _SPANS)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)
