"""SimHash near-duplicates found by fuzzy hashing with the binary Golay code.

Fingerprint: 64 majority bits over the XXH64 (seed 42) of word shingles.  Two
fingerprints link at ``max_bits`` <= 2 differing bits.

Search.  The 64 bits are cut into three segments of 22, 21 and 21 bits, each
padded to a 23-bit word of the perfect (23,12) Golay code.  Every word lies
within 3 bits of exactly one codeword.  A segment is decoded together with all
words one bit away: that gives one codeword index (its codeword is at most 2
bits off) or up to six.  Two segments that differ in at most two bits have a
word between them that is one bit from both, so they share an index.  By the
pigeonhole principle one of the three segments has no error at all if two bits
differ in total, so a fingerprint gets the keys (exact bits of segment s, a
codeword index of the next segment) for each s: about 16 keys of 33 bits.
Fingerprints meet by key and every link is verified by its bit distance.

Groups.  Copies are collapsed to distinct fingerprints before anything is
joined.  A key's group of up to ``max_group`` distinct fingerprints is linked
inside one task and leaves as a spanning forest, never as all pairs; a larger
one (known from a count before) is dealt anew by the exact keys "all bits but
two", which hold at most four fingerprints each and need no limit.

Classes.  Links contract to components by alternating large and small stars
until nothing changes; every round is written to the shared folder.

Defined cases: a null or wordless text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle of the whole sequence;
equal rows share a class; a class holding only null ids has a null id; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import bound_batches, free_name, map_texts, quoted, without, written
from sitelens.llm.components import components

SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_GROUP = 65_536
#: Generator polynomial of the binary Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101


# --- fingerprints ---------------------------------------------------------------

def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits of the shingle hashes of one text (UTF-8, A-Z lower-cased)."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        spans = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = [joined[a:b] for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1:].tolist())]
    one = xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), 1 << 16):
        h = np.array([one(s, seed) for s in spans[at:at + (1 << 16)]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(spans)).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", result: str = "simhash", shingle: int = 3,
                 carry_text: bool = True) -> DataFrame:
    """``df`` with the struct column ``result`` (``fp`` long)."""
    def make():
        return lambda texts: {"fp": [fingerprint(x.as_py(), shingle) for x in texts]}

    return map_texts(df, text_col, result, T.StructType([T.StructField("fp", T.LongType())]), make, carry_text)


# --- keys by Golay decoding -----------------------------------------------------

def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where((rest >> bit) & 1, rest ^ (GOLAY << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    """The error pattern (weight 3 at most) of each of the 2,048 remainders."""
    patterns = [0]
    for weight in (1, 2, 3):
        patterns += [sum(1 << b for b in c) for c in combinations(range(23), weight)]
    at = np.array(patterns, np.int64)
    table = np.full(2048, -1, np.int64)
    table[_syndromes(at)] = at
    if (table < 0).any():
        raise AssertionError("not a perfect code")
    return table


ERRORS = _error_table()
FLIPS = _syndromes(np.int64(1) << np.arange(23, dtype=np.int64))


def codeword_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """Indices (12 bits) of the codewords nearest to each word and to its
    neighbours one of ``bits`` low bits away: shape (n, bits + 1)."""
    syn = _syndromes(words)
    out = np.empty((len(words), bits + 1), np.int64)
    out[:, 0] = (words ^ ERRORS[syn]) >> 11
    for b in range(bits):
        out[:, b + 1] = (words ^ (1 << b) ^ ERRORS[syn ^ FLIPS[b]]) >> 11
    return out


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``fps``, key) rows: segment number, exact segment, codeword index."""
    u = fps.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    owners, keys = [], []
    rows = np.arange(len(fps))
    for s in range(3):
        t = (s + 1) % 3
        idx = np.sort(codeword_indices(parts[t], SEGMENTS[t][1]), axis=1)
        first = np.ones_like(idx, bool)
        first[:, 1:] = idx[:, 1:] != idx[:, :-1]
        key = (np.int64(s) << 40) | (parts[s][:, None] << 12) | idx
        owners.append(np.broadcast_to(rows[:, None], idx.shape)[first])
        keys.append(key[first])
    return np.concatenate(owners), np.concatenate(keys)


# --- links inside one group -----------------------------------------------------

def spanning_links(fps: np.ndarray, max_bits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links among distinct fingerprints."""
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    u = fps.view(np.uint64)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = find(i), find(j)
            if i != j:
                root[max(i, j)] = min(i, j)

    if n <= 1024:
        for i in range(n - 1):
            near = np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= max_bits)
            if len(near):
                link(np.full(len(near), i), near + i + 1)
    else:
        # equal after masking two of the bits that vary: sort, and link neighbours
        varying = int(np.bitwise_or.reduce(u ^ u[0]))
        bits = [b for b in range(64) if varying >> b & 1]
        for pair in combinations(bits, min(max_bits, len(bits))):
            masked = u & np.uint64(~sum(1 << b for b in pair) & (2**64 - 1))
            order = np.argsort(masked, kind="stable")
            same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
            link(order[same], order[same + 1])
    tops = np.array([find(i) for i in range(n)])
    child = np.flatnonzero(tops != np.arange(n))
    return fps[child], fps[tops[child]]


LINKS = "u bigint, v bigint"


def links(fps: DataFrame, max_bits: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """Links (u, v) that connect the distinct fingerprints of the column ``fp``
    exactly as all links of at most ``max_bits`` bits do."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys are exact for distances up to 2")
    bound_batches(fps.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array(b.column(0).to_numpy(zero_copy_only=False), np.int64)
            who, key = keys_of(own)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[who])], names=["key", "fp"])

    keyed = fps.select("fp").mapInArrow(explode, "key bigint, fp bigint")
    hot = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                       .filter(F.col("n") > max_group).select("key"), "simhash-hot")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        done: list[tuple[np.ndarray, np.ndarray]] = []

        def close():
            if held:
                a, b = spanning_links(np.concatenate(held), max_bits)
                if len(a):
                    done.append((a, b))

        for b in batches:
            key = b.column(0).to_numpy()
            fp = b.column(1).to_numpy()
            if not len(key):
                continue
            at = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            runs = np.flatnonzero(np.diff(at) > 1)  # lone fingerprints inside a batch link to nothing
            for r in sorted({0, len(at) - 2, *runs.tolist()}):
                if key[at[r]] != held_key:
                    close()
                    held_key, held = key[at[r]], []
                held.append(fp[at[r]:at[r + 1]])
            if done:
                yield _pairs(done)
                done.clear()
        close()
        if done:
            yield _pairs(done)

    normal = keyed
    rest = None
    if not hot.isEmpty():
        normal = keyed.join(hot, "key", "left_anti")
        rest = _dealt_anew(keyed.join(hot, "key", "left_semi"), max_bits)
    found = normal.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(group, LINKS)
    if rest is not None:
        found = found.unionByName(rest)
    return found.distinct()


def _pairs(done: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in done])) for i in (0, 1)], names=["u", "v"])


def _dealt_anew(rows: DataFrame, max_bits: int) -> DataFrame:
    """Links of oversized groups: fingerprints equal in all bits but two link
    to the smallest of their at most four."""
    pairs = list(combinations(range(64), 2)) if max_bits == 2 else [(b, b) for b in range(64)]
    if max_bits == 0:
        return rows.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    masks = [int(np.int64(np.uint64(~((1 << a) | (1 << b)) & (2**64 - 1)).view(np.int64))) for a, b in pairs]
    m = rows.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.lit(x) for x in masks])).alias("mask", "bits"))
    m = m.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("rest"), "fp")
    low = m.groupBy("mask", "rest").agg(F.min("fp").alias("v"), F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    return low.select(F.explode("all").alias("u"), "v").filter(F.col("u") != F.col("v"))


# --- classes --------------------------------------------------------------------

def _classed(hashed: DataFrame, id_col: str, fp: str, max_bits: int, max_group: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of every fingerprint of a written table with column ``fp``, and the
    classes (root, component_id, rows)."""
    nodes = written(hashed.groupBy(F.col(fp).alias("fp"))
                    .agg(F.min(quoted(id_col)).alias("low"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    roots = components(links(nodes, max_bits, max_group))
    labelled = nodes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left") \
                    .withColumn("root", F.coalesce("root", "fp"))
    tops = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("rows"))
    return labelled.select("fp", "root"), tops


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", result: str = "simhash",
            shingle: int = 3, max_bits: int = 2, max_group: int = MAX_GROUP, carry_text: bool = True) -> DataFrame:
    """``df`` with the struct column ``result``: ``fingerprint`` (16 hex digits),
    ``component_id`` (smallest id of the class) and ``rows`` (rows of the class).
    Columns of ``df`` keep their values whatever their names are."""
    bare = without(df, result)
    sim, fp = free_name(bare, "__simhash"), free_name(bare, "__fp")
    hashed = fingerprints(bare, text_col, sim, shingle, carry_text)
    carried = [quoted(c) for c in hashed.columns if c != sim]
    # written once: fingerprints are not computed again for the nodes, the join and each retry
    stored = written(hashed.select(*carried, F.col(f"{sim}.fp").alias(fp)), "simhash-fp")
    labelled, tops = _classed(stored, id_col, fp, max_bits, max_group)
    named = labelled.join(tops, "root").select(F.col("fp").alias(fp), F.struct(
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "rows").alias(result))
    return stored.join(named, fp).select(*carried, quoted(result))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                max_bits: int = 2, max_group: int = MAX_GROUP) -> DataFrame:
    """The rows of ``df`` without near-copies: of each class the row with the
    smallest id stays (null ids last; among equal ids the one with the smallest
    hash of its whole content; of wholly equal rows one).

    Texts do not travel with the classes: survivors are named by a 128-bit
    content hash, and one join brings them back to the rows.
    """
    cols = [quoted(c) for c in df.columns]
    k1, k2 = free_name(df, "__k1"), free_name(df, "__k2")
    hashes = [F.xxhash64(F.lit(s), *cols) for s in (1, 2)]
    narrow = fingerprints(df.select(quoted(id_col).alias("__id"), quoted(text_col).alias("__text"),
                                    *[h.alias(k) for h, k in zip(hashes, ("__h1", "__h2"))]),
                          "__text", "__simhash", shingle, carry_text=False)
    stored = written(narrow.select("__id", "__h1", "__h2", F.col("__simhash.fp").alias("__fp")), "simhash-fp")
    labelled, _ = _classed(stored, "__id", "__fp", max_bits, max_group)
    best = (stored.join(labelled, F.col("__fp") == F.col("fp")).groupBy("root")
                  .agg(F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("i"),
                                      F.col("__h1"), F.col("__h2"))).alias("m")))
    keep = best.select(F.col("m.__h1").alias(k1), F.col("m.__h2").alias(k2))
    out = df.select(*cols, *[h.alias(k) for h, k in zip(hashes, (k1, k2))])
    return out.join(keep, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*cols)
