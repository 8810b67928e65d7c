"""The prefix trie of conversations, from adaptive radix trees over ranges of sorted keys.

A turn becomes an id of fixed width: 16 bytes of the SHA-256 of role and text, then the number of
its words, both big-endian. A conversation's key is its ids one after the other, so keys sort as
sequences of turns and every prefix of whole ids is a node of the trie.

Keys are sorted by range, together with the conversations that have them, so a key of any
number of conversations is spread over several ranges. Each range is cut into runs of bounded
size, and every run builds one adaptive radix tree: inner nodes have room for 4, 16, 48 or 256
children, and a path without branches is one compressed node. Only byte depths that are
whole turns emit nodes.

A node whose members lie in two runs or more is on the seam: it is a prefix of a run's first key
and of the key before it, or of the last key and of the one after it. How many turns neighbouring
keys share tells which nodes these are and which run sees a node first, or last; with that every
figure of a seam node is a sum over runs. All other nodes are whole within their run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.arrays import text_bytes
from fleetlens.llm.common import join_by_key, stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
DIGEST = 16
WIDTH = DIGEST + 4
RUN_ROWS = 20_000           # a run ends at so many conversations,
RUN_BYTES = 8 << 20         # or at so many bytes of keys
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ---- keys -------------------------------------------------------------------------


def turn_id(role: str, text: str) -> Column:
    """The fixed-width id of a turn; null role or text count as empty."""
    r, t = text_or_empty(role), text_or_empty(text)
    digest = F.sha2(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t), 256)
    words = F.lpad(F.hex(F.regexp_count(t, F.lit(WORD)).cast("long")), 8, "0")
    return F.unhex(F.concat(F.substring(digest, 1, 2 * DIGEST), words))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    """(block, conversation, its ids) of rows sorted by both."""
    last, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, _ = text_bytes(batch.column("id"))
        block, conv = (batch.column(c).to_numpy() for c in ("block", "conv"))
        starts = np.flatnonzero(np.diff(conv) != 0) + 1
        for a, b in zip([0, *starts.tolist()], [*starts.tolist(), len(conv)]):
            own = (int(block[a]), int(conv[a]))
            if own != last and last is not None:
                yield (*last, b"".join(parts))
                parts = []
            last = own
            parts.append(ids[a * WIDTH:b * WIDTH].tobytes())
    if last is not None:
        yield (*last, b"".join(parts))


def sequences(turns: DataFrame, group: int = 1, openings: int = 1, conv_col: str = "conv_id",
              turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv_id) of every conversation, its turns in order, null first.

    With ``group`` and ``openings``, conversation c begins with the first h turns of conversation
    c - c % group (all if it has fewer, none if it is absent) and goes on after its own first h,
    h being crc32(decimal c) % openings; the remainder has the sign of c. Turns with one number
    are ordered by their ids. A conversation may have no turn left. Rows without a conversation
    belong to none. One conversation is held in memory, at 20 bytes a turn.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        turn_id(role_col, text_col).alias("id"))
    rows = rows.withColumn("block", F.col("conv") - F.col("conv") % F.lit(group))
    ordered = rows.repartition("block").sortWithinPartitions(
        "block", F.col("conv") != F.col("block"), "conv", F.asc_nulls_first("turn"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, opening, keys, convs, size = None, b"", [], [], 0
        for block, conv, ids in _grouped(batches):
            if block != at:
                at, opening = block, b""
            if conv == block:
                opening = ids[:WIDTH * (openings - 1)]
            h = WIDTH * (zlib.crc32(str(conv).encode()) % openings)
            keys.append(opening[:h] + ids[h:])
            convs.append(conv)
            size += len(keys[-1])
            if size > RUN_BYTES or len(convs) >= RUN_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(convs)], names=["key", "conv"])
                keys, convs, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(convs, pa.int64())], names=["key", "conv"])

    return ordered.select("block", "conv", "id").mapInArrow(run, "key binary, conv long")


# ---- adaptive radix tree ------------------------------------------------------------


class Node:
    """A compressed path and what follows it: at most 4 or 16 children in the order of their
    bytes, at most 48 found through an index of 256 places, or 256 places."""

    __slots__ = ("path", "value", "room", "index", "children", "size")

    def __init__(self, path: bytes, value: int = -1):
        self.path, self.value, self.room, self.size = path, value, 4, 0
        self.index: bytearray | None = bytearray()
        self.children: list[Node | None] = []

    def child(self, byte: int) -> Node | None:
        if self.room <= 16:
            at = self.index.find(byte)
            return self.children[at] if at >= 0 else None
        if self.room == 48:
            at = self.index[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Set the child of ``byte``, which may be there already."""
        if self.room <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.children[at] = node
                return
            if self.size < self.room:
                at = sum(b < byte for b in self.index)
                self.index.insert(at, byte)
                self.children.insert(at, node)
                self.size += 1
                return
        elif self.room == 48 and self.index[byte]:
            self.children[self.index[byte] - 1] = node
            return
        elif self.room == 48 and self.size < 48:
            self.children.append(node)
            self.size += 1
            self.index[byte] = self.size
            return
        elif self.room == 256:
            self.size += self.children[byte] is None
            self.children[byte] = node
            return
        self.grow()
        self.put(byte, node)

    def grow(self) -> None:
        """The next larger layout with the same children."""
        pairs = list(self.pairs())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.index = bytearray(256)
            self.children = [n for _, n in pairs]
            for at, (byte, _) in enumerate(pairs):
                self.index[byte] = at + 1
        elif self.room == 256:
            self.index, self.children = None, [None] * 256
            for byte, n in pairs:
                self.children[byte] = n

    def pairs(self) -> Iterator[tuple[int, Node]]:
        """(byte, child) in the order of the bytes."""
        if self.room <= 16:
            yield from zip(self.index, self.children)
        elif self.room == 48:
            yield from ((b, self.children[at - 1]) for b, at in enumerate(self.index) if at)
        else:
            yield from ((b, n) for b, n in enumerate(self.children) if n is not None)


def shared(a: bytes, b: bytes) -> int:
    """Number of leading bytes that are equal."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        """Store ``value`` under ``key``, splitting a compressed path where the key leaves it."""
        above, node, at = None, self.root, 0
        while True:
            same = shared(node.path, key[at:at + len(node.path)])
            if same < len(node.path):
                upper = Node(node.path[:same])
                upper.put(node.path[same], node)
                node.path = node.path[same + 1:]
                if above is None:
                    self.root = upper
                else:
                    above.put(key[at - 1], upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at + 1:], value))
                return
            above, node, at = node, below, at + 1

    def postorder(self) -> Iterator[tuple[Node, int, int, int]]:
        """(node, its end as a byte depth, end of the node above or -1, number of children),
        children first and in order."""
        stack = [(self.root, len(self.root.path), -1, False)]
        while stack:
            node, end, above, seen = stack.pop()
            if seen or not node.size:
                yield node, end, above, node.size
                continue
            stack.append((node, end, above, True))
            below = [(n, end + 1 + len(n.path), end, False) for _, n in node.pairs()]
            stack.extend(reversed(below))


# ---- runs -----------------------------------------------------------------------------

RUNS = ("pid int, k int, before int, after int, head binary, tail binary, keys binary, "
        "key_ends binary, convs binary, conv_ends binary")


def _common_turns(a: bytes | None, b: bytes | None) -> int | None:
    return None if a is None or b is None else shared(a, b) // WIDTH


class _Run:
    """Conversations in the order of their keys, equal keys once."""

    def __init__(self):
        self.keys, self.convs, self.ends, self.size = [], [], [], 0

    def add(self, key: bytes, conv: int) -> None:
        if not self.keys or key != self.keys[-1]:
            self.keys.append(key)
            self.ends.append(0)
            self.size += len(key)
        self.convs.append(conv)
        self.ends[-1] = len(self.convs)

    def row(self, pid: int, k: int, before: _Run | None, after: _Run | None) -> pa.RecordBatch:
        ends = np.cumsum([len(x) for x in self.keys])
        values = [
            pid, k, _common_turns(before and before.keys[-1], self.keys[0]),
            _common_turns(self.keys[-1], after and after.keys[0]),
            None if before else self.keys[0], None if after else self.keys[-1], b"".join(self.keys),
            ends.astype("<i8").tobytes(), np.array(self.convs, "<i8").tobytes(), np.array(self.ends, "<i8").tobytes()]
        kinds = [pa.int32()] * 4 + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)],
                                          names=[c.split()[0] for c in RUNS.split(", ")])


def _runs(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid = TaskContext.get().partitionId()
    k, before, now = 0, None, _Run()
    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
            if len(now.convs) >= most or now.size >= RUN_BYTES:
                full, now = now, _Run()
                now.add(key, conv)
                yield full.row(pid, k, before, now)
                before, k = full, k + 1
            else:
                now.add(key, conv)
    if now.convs:
        yield now.row(pid, k, before, None)


def _edges(runs: DataFrame) -> DataFrame:
    """How many turns the keys on both sides of each border between ranges share: one row of
    three numbers per range, of which there are as many as shuffle partitions."""
    ranges = runs.groupBy("pid").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    order = Window.orderBy("pid")
    sides = ranges.select("pid", "head", "tail", F.lag("tail").over(order).alias("last"),
                          F.lead("head").over(order).alias("next"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail, last, after = (b.column(c).to_pylist() for c in ("head", "tail", "last", "next"))
            yield pa.RecordBatch.from_arrays(
                [b.column("pid"), pa.array([_common_turns(x, y) for x, y in zip(last, head)], pa.int32()),
                 pa.array([_common_turns(x, y) for x, y in zip(tail, after)], pa.int32())],
                names=["pid", "edge_before", "edge_after"])

    return sides.mapInArrow(compare, "pid int, edge_before int, edge_after int")


# ---- nodes ----------------------------------------------------------------------------

NODES = ("pid int, k int, nid binary, pnid binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string, ends_sha256 string")
ROWS_OUT = 10_000


def _prefix_ids(key: bytes, deepest: int) -> list[bytes]:
    """A digest of the first 0, 1, ... ``deepest`` turns."""
    state, out = hashlib.sha256(), []
    for d in range(deepest + 1):
        if d:
            state.update(key[(d - 1) * WIDTH:d * WIDTH])
        out.append(state.digest())
    return out


def nodes_of_run(keys: list[bytes], convs: np.ndarray, ends: list[int], before: int,
                 after: int) -> list[list]:
    """Rows as NODES from ``nid`` on of one run. ``before`` and ``after`` tell how many turns the
    first key shares with the key before the run and the last with the one after it (-1: none)."""
    tree = RadixTree()
    for i, key in enumerate(keys):
        tree.insert(key, i)
    final, starts = len(keys) - 1, [0, *ends[:-1]]
    left, right = _prefix_ids(keys[0], before), _prefix_ids(keys[-1], after)
    rows: list[list] = []
    done = []           # of subtrees: members, least, leaves, saved, first and last key, new tops, tops
    for node, end, above, below in tree.postorder():
        n, least, leaves, saved, low, high, new, tops = 0, None, 0, 0, final + 1, -1, 0, []
        if below:
            for part in done[-below:]:
                n, leaves, saved, new = n + part[0], leaves + part[2], saved + part[3], new + part[6]
                least = part[1] if least is None else min(least, part[1])
                low, high = min(low, part[4]), max(high, part[5])
                tops += part[7]
            del done[-below:]
        members: list[int] = []
        if node.value >= 0:
            members = convs[starts[node.value]:ends[node.value]].tolist()
            n += len(members)
            least = members[0] if least is None else min(least, members[0])
            low, high = min(low, node.value), max(high, node.value)
        # the whole turns that end on this node's path, the deepest first
        for depth in range(end // WIDTH, above // WIDTH if above >= 0 else -1, -1):
            known = low == 0 and depth <= before            # the run before has this node, too
            goes_on = high == final and depth <= after      # and the run after
            words = int.from_bytes(keys[low][depth * WIDTH - 4:depth * WIDTH], "big") if depth else 0
            saved += (n if known else n - 1) * words
            ended = members if depth * WIDTH == end else []
            if not tops:
                leaves = 0 if goes_on else 1
            nid = (left[depth] if known else right[depth]) if known or goes_on else None
            listed = ",".join(map(str, ended))
            sha = None if nid is not None else hashlib.sha256(listed.encode()).hexdigest() if ended else EMPTY_SHA
            for t in tops:
                rows[t][1 if nid is not None else 4] = nid if nid is not None else least
            rows.append([nid, None, least, depth, None, n, new, leaves, saved,
                         listed if nid is not None and ended else None, sha])
            tops, new = [len(rows) - 1], 0 if known else 1
        done.append((n, least, leaves, saved, low, high, new, tops))
    return rows


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[c.split()[1]]
             for c in NODES.split(", ")]
    for batch in batches:
        for run in batch.to_pylist():
            ends = np.frombuffer(run["key_ends"], "<i8").tolist()
            keys = [run["keys"][a:b] for a, b in zip([0, *ends[:-1]], ends)]
            convs, conv_ends = np.frombuffer(run["convs"], "<i8"), np.frombuffer(run["conv_ends"], "<i8").tolist()
            edge = [-1 if run[c] is None else run[c] for c in ("before", "after")]
            rows = nodes_of_run(keys, convs, conv_ends, *edge)
            for at in range(0, len(rows), ROWS_OUT):
                part = rows[at:at + ROWS_OUT]
                values = [[run["pid"]] * len(part), [run["k"]] * len(part), *zip(*part)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)


def _seam_ends(seams: DataFrame) -> DataFrame:
    """(nid, ends_sha256) of the nodes whose members' ids come from several runs. A run's ids
    are one row, so the task that reads a node's ids in order gets few rows."""
    parts = seams.where(F.col("ends").isNotNull()).select("nid", "pid", "k", "ends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, nids, shas = None, None, [], []
        for batch in batches:
            for nid, ids in zip(batch.column("nid").to_pylist(), batch.column("ends").to_pylist()):
                if nid != last:
                    if last is not None:
                        nids.append(last)
                        shas.append(state.hexdigest())
                    last, state = nid, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if last is not None:
            nids.append(last)
            shas.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(nids, pa.binary()), pa.array(shas, pa.string())],
                                         names=["nid", "ends_sha256"])

    ordered = parts.repartition("nid").sortWithinPartitions("nid", "pid", "k")
    return ordered.select("nid", "ends").mapInArrow(run, "nid binary, ends_sha256 string")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(keyed: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """The nodes of the trie of all ``keyed`` rows (key, conv), as ``sequences`` makes them.

    One row per node: conv_id (smallest member), depth in turns, parent_conv_id (null at the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Conversations without turns
    are members of the root alone. Without any conversation there is no node, not even a root. ``run_rows`` bounds
    the conversations of one tree; results do not depend on it.
    """
    keyed = stored(keyed, "trie-keys")
    ordered = keyed.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    runs = stored(ordered.mapInArrow(partial(_runs, run_rows), RUNS), "trie-runs")
    # as many rows of three numbers as there are shuffle partitions
    edges = F.broadcast(_edges(runs.select("pid", "head", "tail")))
    whole = runs.join(edges, "pid", "left").withColumns({
        "before": F.coalesce("before", "edge_before"), "after": F.coalesce("after", "edge_after")})
    nodes = stored(whole.drop("edge_before", "edge_after", "head", "tail").mapInArrow(_nodes, NODES), "trie-nodes")

    seams = nodes.where(F.col("nid").isNotNull())
    merged = seams.groupBy("nid").agg(
        F.max("pnid").alias("pnid"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = stored(merged.join(_seam_ends(seams), "nid", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY_SHA))), "trie-seams")
    inside = nodes.where(F.col("nid").isNull())
    parents = merged.select(F.col("nid").alias("pnid"), F.col("conv_id").alias("parent"), F.col("n_children").alias("n"))
    total = merged.agg(F.sum("n_children")).head()[0] or 0
    columns = ["pnid", *[c for c in RESULT if c != "parent_conv_id"]]
    below = inside.where(F.col("pnid").isNotNull()).select(columns).unionByName(
        merged.where(F.col("pnid").isNotNull()).select(columns))
    joined = join_by_key(below, parents, ["pnid"], total).withColumnRenamed("parent", "parent_conv_id")
    tops = merged.where(F.col("pnid").isNull()).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return joined.select(RESULT).unionByName(tops.select(RESULT)).unionByName(
        inside.where(F.col("pnid").isNull()).select(RESULT))
