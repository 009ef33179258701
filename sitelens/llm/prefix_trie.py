"""Conversation prefix trie in balanced parentheses.

Every distinct sequence of a conversation's first ``depth`` turns is a node; the
conversations that start with it are its members.  ``(conv_id, depth)`` names a
node: the first ``depth`` turns of its smallest member.

1. Turns become digests before any exchange, get their position (buckets of a
   conversation are numbered apart, so a hot conversation is split) and a 128-bit
   key of the prefix they end: sums of hashes of (position, turn), summed slice by
   slice in the same way.
2. Members are counted by key with map-side combine, so a first turn shared by a
   third of all conversations is one partial row a task.
3. Nodes with the same members form a chain (one child, nobody ends).  Their
   smallest member and their number of members name the chain, so chains come out
   of an aggregate, not of a walk.  A path to a childless chain has at most
   sqrt(2 * rows) chains: each branching on it needs another conversation that is
   as long.
4. These paths, ordered, are dealt by range into shards; a task cuts its share
   into shards of bounded size and writes each as balanced parentheses.  A range
   min-max tree over blocks of excess gives ``find_close`` of every opening, the
   span between is the subtree: the rank of ``()`` pairs counts its leaves,
   cumulative savings by rank of openings give its savings.
5. Only the chains on a shard's first and last path, its spines, are shared with
   other shards.  A chain's own savings count in the shard that holds its first
   leaf, which flags of first children tell locally, so spines merge by adding.

Defined cases: null role or text is empty; rows of equal turn are ordered by role
and text; equal rows stay separate turns; rows with a null ``conv_id`` belong to no
conversation and are left out; a conversation may have no turns (it ends at the
root); no conversations give no rows, not even a root.  Only the named columns are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import bound_batches, quoted, written
from sitelens.operators.ordering import key_ordinal

#: Rows of a key that one task sums in a row; more are summed slice by slice.
SLICE = 4096

#: Path elements of one shard of parentheses (a shard takes a whole path at least).
SHARD_ELEMENTS = 1 << 18

#: Members of neighbouring ids whose list is made in one piece are within 2**13 of each other.
PIECE_BITS = 13

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``(conv_id, pos, turn_id, chars)``: turns as digests, ``pos`` gapless from 0 in order of
    turn (null first), role, text."""
    role = F.coalesce(quoted(role_col).cast("string"), F.lit(""))
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    src = turns.select(quoted(conv_col).cast("bigint").alias("conv_id"), quoted(turn_col).cast("bigint").alias("turn"),
                       role.alias("role"), text.alias("text")).filter(F.col("conv_id").isNotNull())
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    src = src.withColumn("turn_id", said)
    rows = src.select("conv_id", "turn", "turn_id", F.char_length("text").cast("bigint").alias("chars"))
    rows = written(rows, "turns")
    tied = rows.groupBy("conv_id", "turn").agg(F.min("turn_id").alias("least"), F.max("turn_id").alias("most"))
    tied = written(tied.filter("least <> most").select("conv_id", "turn"), "tied")
    if tied.isEmpty():  # texts are only compared where turns are equal
        rows = rows.withColumn("tie", F.lit(0))
    else:
        same = [src["conv_id"] == tied["conv_id"], src["turn"].eqNullSafe(tied["turn"])]
        among = src.join(tied, same[0] & same[1], "left_semi").distinct()
        rank = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
        among = among.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("turn_id").alias("i"), rank.alias("tie"))
        on = (rows["conv_id"] == among["c"]) & rows["turn"].eqNullSafe(among["t"]) & (rows["turn_id"] == among["i"])
        rows = rows.join(among, on, "left").drop("c", "t", "i")
    return key_ordinal(rows, "conv_id", ["turn", "tie"], "pos").select("conv_id", "pos", "turn_id", "chars")


def running_sums(df: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    """``df`` with ``names`` replaced by their sums over the rows of the key up to the row
    (``order`` unique in a key and not negative)."""
    rows = df.withColumn("slice", F.floor(F.col(order) / F.lit(SLICE)).cast("bigint"))
    parts = rows.groupBy(*keys, "slice").agg(*[F.sum(n).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "slice", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in names])
    inside = Window.partitionBy(*keys, "slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    others = [c for c in df.columns if c not in names]
    return rows.join(parts, [*keys, "slice"]).select(
        *others, *[(F.sum(n).over(inside) + F.col(f"before_{n}")).alias(n) for n in names])


def _keys(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, hi, lo, up_hi, up_lo, chars)``: key of the prefix that each turn ends, and of its parent."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    rows = turns.select("conv_id", (F.col("pos") + 1).alias("depth"), "chars",
                        F.xxhash64(F.lit(1), "pos", "turn_id").alias("h"), F.xxhash64(F.lit(2), "pos", "turn_id").alias("g"))
    rows = rows.select("conv_id", "depth", "chars", "h", "g", F.col("h").bitwiseAND(low).alias("a"),
                       F.shiftrightunsigned("h", 32).alias("b"), F.col("g").bitwiseAND(low).alias("c"),
                       F.shiftrightunsigned("g", 32).alias("d"))
    sums = running_sums(rows, ["conv_id"], "depth", ["a", "b", "c", "d"])

    def packed(x, y):
        return F.shiftleft(x.bitwiseAND(low), 32).bitwiseOR(y.bitwiseAND(low))

    a, b, c, d = (F.col(x) for x in "abcd")
    own = (F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32), F.col("g").bitwiseAND(low), F.shiftrightunsigned("g", 32))
    return sums.select("conv_id", "depth", packed(a, b).alias("hi"), packed(c, d).alias("lo"),
                       packed(a - own[0], b - own[1]).alias("up_hi"), packed(c - own[2], d - own[3]).alias("up_lo"), "chars")


# --- balanced parentheses -----------------------------------------------------------

class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with a range min-max tree over blocks of excess."""

    BLOCK = 64
    #: Places looked up together (memory only).
    ASKED = 1 << 14

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        size = -(-max(1, len(bits)) // self.BLOCK)
        far = np.iinfo(np.int64).max
        wide = np.full(size * self.BLOCK, far)
        wide[: len(bits)] = self.excess
        self.blocks = wide.reshape(size, self.BLOCK)
        self.levels = [self.blocks.min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            if len(low) % 2:
                low = np.append(low, far)
                self.levels[-1] = low
            self.levels.append(np.minimum(low[::2], low[1::2]))
        opens = bits.astype(np.int64)
        self.opened = np.concatenate(([0], np.cumsum(opens)))  # openings before a place
        pairs = np.zeros(len(bits), np.int64)
        pairs[:-1] = (bits[:-1] == 1) & (bits[1:] == 0)
        self.paired = np.concatenate(([0], np.cumsum(pairs)))  # leaf pairs that start before a place

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing place of every opening place: the first one behind with a smaller excess."""
        cuts = range(0, len(at), self.ASKED)
        return np.concatenate([np.zeros(0, np.int64), *[self._find_close(at[i: i + self.ASKED]) for i in cuts]])

    def _find_close(self, at: np.ndarray) -> np.ndarray:
        goal = self.excess[at] - 1
        block = at // self.BLOCK
        ahead = np.arange(self.BLOCK)[None, :] > (at % self.BLOCK)[:, None]
        hit = (self.blocks[block] <= goal[:, None]) & ahead
        close = block * self.BLOCK + hit.argmax(axis=1)
        todo = np.flatnonzero(~hit.any(axis=1))
        node, level = block[todo], np.zeros(len(todo), np.int64)
        where = np.full(len(todo), -1, np.int64)
        high = 0
        climbing = np.arange(len(todo))
        while len(climbing):  # up until the right neighbour holds the place
            low = self.levels[high]
            right = np.minimum(node[climbing] + 1, len(low) - 1)
            found = (node[climbing] % 2 == 0) & (right > node[climbing]) & (low[right] <= goal[todo[climbing]])
            where[climbing[found]] = right[found]
            level[climbing[found]] = high
            climbing = climbing[~found]
            node[climbing] //= 2
            high += 1
        for high in range(len(self.levels) - 1, 0, -1):  # down to the first block that holds it
            here = np.flatnonzero(level == high)
            left = where[here] * 2
            where[here] = left + (self.levels[high - 1][left] > goal[todo[here]])
            level[here] = high - 1
        close[todo] = where * self.BLOCK + (self.blocks[where] <= goal[todo][:, None]).argmax(axis=1)
        return close


def shard_sums(paths: list[list[tuple]]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Chains of one shard with their leaves and savings in it.

    ``paths``: ordered paths to leaves, of (conv, members, is a first child, own savings).
    """
    bits, nodes, own = bytearray(), [], []
    before: list[tuple] = []
    for path in paths:
        same = 0
        while same < len(before) and same < len(path) and path[same][0] == before[same][0]:
            same += 1
        bits += b"\0" * (len(before) - same) + b"\1" * (len(path) - same)
        first = not before
        mine = True  # from the end: does the first leaf below lie here?
        weights = []
        for chain in reversed(path[same:]):
            weights.append(chain[3] if mine or not first else 0)
            mine = mine and chain[2]
        nodes += [chain[:2] for chain in path[same:]]
        own += reversed(weights)
        before = path
    bits += b"\0" * len(before)
    seq = Parentheses(np.frombuffer(bytes(bits), np.uint8))
    opens = np.flatnonzero(seq.bits)
    closes = seq.find_close(opens)
    saved = np.concatenate(([0], np.cumsum(np.array(own, np.int64))))
    return (nodes, seq.paired[closes] - seq.paired[opens], saved[seq.opened[closes]] - saved[seq.opened[opens]])


def _subtrees(paths: DataFrame) -> DataFrame:
    """``(conv_id, n_convs, n_leaves, saved)`` of every chain from the paths to all leaves."""
    bound_batches(paths.sparkSession)
    limit = SHARD_ELEMENTS
    ordered = paths.select(F.transform("path", lambda x: x["conv"]).alias("at"), "path") \
        .repartitionByRange(F.col("at")).sortWithinPartitions("at").select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nodes, leaves, saved = shard_sums(held)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in nodes], pa.int64()), pa.array([n for _, n in nodes], pa.int64()),
                 pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["conv_id", "n_convs", "n_leaves", "saved"])

        for b in batches:
            for path in b.column(0).to_pylist():
                held.append([(x["conv"], x["n"], x["first"], x["own"]) for x in path])
                size += len(path)
                if size >= limit:
                    yield shard()
                    size = 0
        if held:
            yield shard()

    parts = ordered.mapInArrow(run, "conv_id bigint, n_convs bigint, n_leaves bigint, saved bigint")
    return parts.groupBy("conv_id", "n_convs").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, hi, lo, ends_sha256)`` of conversations ``(conv_id, depth, hi, lo)`` by the node where they
    end.  Lists are made in pieces of neighbouring ids; a task reads the pieces of a node in order."""
    bound_batches(ends.sparkSession)
    key = ["depth", "hi", "lo"]
    pieces = ends.groupBy(*key, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = pieces.repartition(*key).sortWithinPartitions(*key, "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())],
                                              names=[*key, "ends_sha256"])

        for b in batches:
            for *at, _, ids in zip(*[b.column(i).to_pylist() for i in range(5)]):
                if at == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = at, hashlib.sha256(ids.encode())
            if len(out) >= 4096:
                yield batch()
        if now is not None:
            out.append((*now, digest.hexdigest()))
            yield batch()

    return ordered.mapInArrow(run, "depth bigint, hi bigint, lo bigint, ends_sha256 string")


# --- the trie -----------------------------------------------------------------------

def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``(conv_id, pos, turn_id, chars)`` as :func:`numbered` gives; ``convs``: every
    ``conv_id`` once, those without turns too.  ``saved_tokens`` is what the subtree saves when
    the ``chars`` of each node are kept once instead of once a member.
    """
    keys = written(_keys(turns), "prefixes")
    node = ["depth", "hi", "lo"]
    nodes = keys.groupBy(*node).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                    F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"), F.min("chars").alias("chars"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in node], "n_convs", "conv_id", none.alias("up_hi"), none.alias("up_lo"), zero.alias("chars"))
    nodes = written(nodes.unionByName(top), "nodes")

    chain = ["conv_id", "n_convs"]
    chains = written(nodes.groupBy(*chain).agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"),
        F.min_by(F.struct("hi", "lo"), "depth").alias("head"), F.max_by(F.struct("hi", "lo"), "depth").alias("foot"),
        F.min_by(F.struct("up_hi", "up_lo"), "depth").alias("up"),
        F.sum(F.col("chars") * (F.col("n_convs") - 1)).alias("own")), "chains")

    root = chains.filter("top = 0").select("conv_id", "n_convs", "own").first() or (None, None, None)

    # the chain above, and the first child and number of children of each
    over = nodes.select(F.col("depth").alias("p_depth"), F.col("hi").alias("p_hi"), F.col("lo").alias("p_lo"),
                        F.col("conv_id").alias("p_conv"), F.col("n_convs").alias("p_n"))
    below = chains.filter("top > 0").join(over, (F.col("top") - 1 == F.col("p_depth")) & (F.col("up.up_hi") == F.col("p_hi"))
                                          & (F.col("up.up_lo") == F.col("p_lo"))).drop("p_depth", "p_hi", "p_lo")
    below = written(below, "children")
    kids = written(below.groupBy("p_conv", "p_n").agg(F.count(F.lit(1)).alias("n_kids"), F.min("conv_id").alias("first_conv")),
                   "siblings")
    tops = below.join(kids, ["p_conv", "p_n"]).select(
        F.col("top").alias("depth"), F.col("head.hi").alias("hi"), F.col("head.lo").alias("lo"), F.col("conv_id").alias("conv"),
        F.col("n_convs").alias("n"), (F.col("conv_id") == F.col("first_conv")).alias("first"), "own")
    tops = written(tops, "heads")

    leaves = chains.join(kids, (F.col("conv_id") == F.col("p_conv")) & (F.col("n_convs") == F.col("p_n")), "left_anti")
    leaves = leaves.select("conv_id")
    on_path = keys.join(leaves, "conv_id", "left_semi").select("conv_id", *node)
    parts = on_path.join(tops, node).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "conv", "n", "first", "own"))).alias("path"))
    conv, n, own = (F.lit(v).cast("bigint") for v in root)  # three numbers: the chain that every path starts with
    base = F.array(F.struct(zero.alias("depth"), conv.alias("conv"), n.alias("n"), F.lit(True).alias("first"), own.alias("own")))
    paths = leaves.join(parts, "conv_id", "left").select(F.concat(base, F.coalesce("path", F.slice(base, 1, 0))).alias("path"))
    sums = _subtrees(written(paths, "paths"))

    ends = keys.groupBy("conv_id").agg(F.max_by(F.struct(*node), "depth").alias("last"))
    ends = convs.select("conv_id").join(ends, "conv_id", "left").select(
        "conv_id", *[F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in node])
    digests = _end_digests(ends).withColumnsRenamed({"depth": "e_depth", "hi": "e_hi", "lo": "e_lo"})

    about = chains.select(*chain, "top", "bottom", "foot").join(sums, chain)
    about = about.join(below.select(*chain, "p_conv"), chain, "left")
    about = about.join(kids.select(F.col("p_conv").alias("conv_id"), F.col("p_n").alias("n_convs"), "n_kids"), chain, "left")
    about = about.join(digests, (F.col("bottom") == F.col("e_depth")) & (F.col("foot.hi") == F.col("e_hi"))
                       & (F.col("foot.lo") == F.col("e_lo")), "left").drop("e_depth", "e_hi", "e_lo", "foot")
    about = written(about, "subtrees")

    shared = nodes.filter("n_convs > 1").select(*chain, "depth", (F.col("chars") * (F.col("n_convs") - 1)).alias("mine"))
    upto = running_sums(shared.withColumn("upto", F.col("mine")), chain, "depth", ["upto"])
    upto = upto.select(*chain, "depth", (F.col("upto") - F.col("mine")).alias("above"))
    lone = nodes.filter("n_convs = 1").select(*chain, "depth", zero.alias("above"))
    out = written(lone.unionByName(upto), "above").join(about, chain)
    at_foot = F.col("depth") == F.col("bottom")
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("p_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(at_foot, F.coalesce("n_kids", zero)).otherwise(F.lit(1)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("saved") - F.col("above")).alias("saved_tokens"),
        F.when(at_foot, F.coalesce("ends_sha256", F.lit(EMPTY_SHA))).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
