"""Removal of long repeated byte strings with sorted suffixes.

Every byte covered by a string of ``length`` bytes (200) that also starts
anywhere else in the texts goes; texts are UTF-8 bytes and matches stay inside
one text.

Sorting all suffixes of a corpus would move each byte many times, so only
suffixes at anchors are compared: the anchor of a 200-byte window is the place
of the smallest hash among its 48-byte substrings.  Equal windows have equal
anchors at equal distance, so every repeat shows at an anchor, and one place in
about 75 is one.

1. Anchors leave a text with the hash of their 48 bytes and of their whole
   neighbourhood (the 352 bytes that windows with this anchor can touch).  Hashes
   that occur once are dropped; the rest is written to the shared folder.
2. Where all neighbourhoods of a hash are equal, all their bytes are repeated.
3. Otherwise one text place for each distinct neighbourhood sends its bytes.
   Tasks sort the suffixes at the anchors and, backwards, the prefixes before
   them by deep-shallow sorting; common prefix lengths of neighbours then tell
   for every anchor the first and last window that another place shares.
   Those are compared byte by byte, so no hash decides what is removed here.
   A hash with more than ``max_group`` distinct neighbourhoods is never brought
   together: its windows are counted by (distance, hash) instead.
4. The spans go to their texts (one shuffle of the texts, used for 3 and 4) and
   the rest is joined.

Copies cost nothing extra: equal texts share their places by content hash.

Defined cases: null texts are empty and lose nothing; texts shorter than the
length lose nothing; equal rows lose the same; ids are never used, so they may
be null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import bound_batches, quoted, utf8, without, written
from sitelens.llm.suffix_sort import deep_shallow

LENGTH = 200
GRAM = 48
SLICE = 1 << 20
MAX_GROUP = 100_000
CHUNK = 20_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1


class Hasher:
    """Hashes of substrings from prefix sums: sum of table[byte] * base**place, modulo 2**64."""

    def __init__(self, places: int) -> None:
        rng = np.random.Generator(np.random.Philox(20))
        self.table = rng.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
        inverse = pow(_BASE, -1, 2**64)
        self.up = _powers(_BASE, places)
        self.down = _powers(inverse, places)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.down[start])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def anchors(texts: list[bytes], hasher: Hasher, length: int = LENGTH, gram: int = GRAM):
    """(text, place, gram hash, neighbourhood hash) arrays of all anchors."""
    reach = length - gram
    got: list[tuple] = []
    group: list[tuple[int, int, int, bytes, int]] = []  # text, first window, end of windows, bytes, place of the bytes
    size = 0
    for k, t in enumerate(texts):
        n = len(t)
        if n < length:
            continue
        windows = n - length + 1
        for a in range(0, windows, SLICE):
            b = min(windows, a + SLICE)
            lo, hi = max(0, a - reach), min(n, b + length + reach)
            if group and size + hi - lo > SLICE:
                got.append(_anchors(group, hasher, length, gram))
                group, size = [], 0
            group.append((k, a, b, t[lo:hi], lo))
            size += hi - lo
    if group:
        got.append(_anchors(group, hasher, length, gram))
    if not got:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    text, place, g, near = (np.concatenate(x) for x in zip(*got))
    # a text cut into slices can name the anchor at a cut twice
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    return text[keep], place[keep], g[keep], near[keep]


def _anchors(group, hasher: Hasher, length: int, gram: int):
    reach = length - gram
    data = np.frombuffer(b"".join(x[3] for x in group), np.uint8)
    n = len(data)
    sums = hasher.sums(data)
    at = np.arange(n - gram + 1)
    h = hasher.of(sums, at, at + gram)
    low = (h & _U(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    # smallest over reach + 1 places, by doubling
    span = 1
    while span * 2 <= reach + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = reach + 1 - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    best = (low & _U(0xFFFFFFFF)).astype(np.int64)  # anchor of the window at each place
    text, place, first, end = [], [], [], []
    begin = 0
    for k, a, b, part, lo in group:
        own = best[begin + a - lo: begin + b - lo]
        own = own[np.append(True, own[1:] != own[:-1])]
        text.append(np.full(len(own), k))
        place.append(own - begin + lo)
        first.append(np.maximum(own - reach, begin))
        end.append(np.minimum(own + length, begin + len(part)))
        begin += len(part)
    where = np.concatenate(place)
    spot = np.concatenate([p - x[4] + o for p, x, o in zip(place, group, np.cumsum([0] + [len(x[3]) for x in group[:-1]]))])
    first, end = np.concatenate(first), np.concatenate(end)
    near = hasher.of(sums, first, end) + (spot - first).astype(np.uint64) * _U(0xA24BAED4963EE407) \
        + (end - spot).astype(np.uint64) * _U(0x9FB21C651E98DF25)
    return np.concatenate(text), where, h[spot].view(np.int64), _mixed(near).view(np.int64)


def shared_windows(group: np.ndarray, left: list[bytes], right: list[bytes], copies: np.ndarray,
                   length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct neighbourhood the first and last window start, relative
    to its anchor, that another member of its group shares (first > last: none).

    ``left`` bytes before the anchor, ``right`` bytes from it on, ``copies``
    places with this very neighbourhood.
    """
    n = len(left)
    reach = length - gram
    nl = np.fromiter(map(len, left), np.int64, n)
    nr = np.fromiter(map(len, right), np.int64, n)
    first, last = np.full(n, 1), np.full(n, 0)
    tag = [int(g).to_bytes(8, "big") for g in (group - group.min()).tolist()] if n else []
    r_order, r_common = deep_shallow([t + r for t, r in zip(tag, right)], length + 8)
    l_order, l_common = deep_shallow([t + x[::-1] for t, x in zip(tag, left)], reach + 8)

    def best(order, common):
        out = np.empty(n, np.int64)
        nxt = np.append(common[1:], 0)
        out[order] = np.maximum(common, nxt) - 8
        return out

    mr, ml = best(r_order, r_common), best(l_order, l_common)
    lo = np.maximum(-np.minimum(ml, reach), -nl)
    hi = np.minimum(np.minimum(mr, nr) - length, 0)
    whole = copies > 1
    first[whole], last[whole] = -np.minimum(nl, reach)[whole], np.minimum(nr - length, 0)[whole]
    open_ = (lo <= hi) & ~whole
    if not open_.any():
        return first, last
    r_rank, l_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(lo[open_].min()), int(hi[open_].max()) + 1):
        # classes of members that share the bytes of the window at distance d
        r_rank[r_order] = np.cumsum(r_common < length + d + 8)
        l_rank[l_order] = np.cumsum(l_common < -d + 8)
        some = np.flatnonzero((nl >= -d) & (nr >= length + d) & (mr >= length + d) & (ml >= -d))
        if len(some) < 2:
            continue
        key = r_rank[some] * np.int64(n + 1) + l_rank[some]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit = np.zeros(len(some), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        who = some[hit]
        who = who[~whole[who]]
        fresh = who[first[who] > last[who]]
        first[fresh] = d
        last[who] = d
    return first, last


CONTEXT = "kh bigint, nh bigint, n bigint, left binary, right binary"
EXTENT = "kh bigint, nh bigint, first int, last int"


def repeats(docs: DataFrame, text_col: str = "text", result: str = "dedup", length: int = LENGTH, gram: int = GRAM,
            max_group: int = MAX_GROUP) -> DataFrame:
    """``docs`` (without its text column) with the struct column ``result``:
    ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes)."""
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and the length")
    bound_batches(docs.sparkSession)
    reach = length - gram
    base = without(docs, result) if result.lower() != text_col.lower() else docs
    carried = [c for c in base.columns if c != text_col]
    t = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = base.select(F.xxhash64(F.lit(1), t).alias("__t1"), F.xxhash64(F.lit(2), t).alias("__t2"),
                       F.struct(*[quoted(c) for c in carried], F.lit(0).alias("__none")).alias("__row"),
                       utf8(quoted(text_col)).alias("__utf8"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SLICE + 4 * length + 8)
        for b in batches:
            who, place, g, near = anchors(b.column(2).to_pylist(), hasher, length, gram)
            at = pa.array(who)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(place), pa.array(g),
                                              pa.array(near)], names=["t1", "t2", "pos", "kh", "nh"])

    long_ = rows.filter(F.octet_length("__utf8") >= length).select("__t1", "__t2", "__utf8")
    found = long_.mapInArrow(find, "t1 bigint, t2 bigint, pos bigint, kh bigint, nh bigint")
    # written first, so that both sides of the join are plain exchanges and a hot hash can be split
    often = written(found.groupBy("kh").agg(F.count(F.lit(1)).alias("n"), F.min("nh").alias("a"), F.max("nh").alias("b"))
                         .filter("n > 1").select("kh", (F.col("a") != F.col("b")).alias("mixed")), "repeated")
    places = written(found.join(often, "kh"), "anchors")

    mixed = places.filter("mixed")
    one = written(mixed.groupBy("kh", "nh").agg(F.count(F.lit(1)).alias("n"),
                                                F.min(F.struct("t1", "t2", "pos")).alias("at"))
                       .select("kh", "nh", "n", "at.t1", "at.t2", "at.pos"), "neighbourhoods")
    wanted = one.groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "kh", "nh", "n")).alias("w"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, w in zip(b.column(0), b.column(2)):
                text = text.as_py()
                for x in w.as_py():
                    p = x["pos"]
                    out.append((x["kh"], x["nh"], x["n"], text[max(0, p - reach):p], text[p:p + length]))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 names=["kh", "nh", "n", "left", "right"])

    # the texts are hashed out once: both joins read the same exchange, so both take all of its columns
    here = rows.join(wanted, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")))
    context = here.select("__utf8", "__row", "w").mapInArrow(cut, CONTEXT)

    def extent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows):
            seen = {}
            for r in rows:  # copies of a text send the same neighbourhood
                seen.setdefault(r[:2], r)
            rows = list(seen.values())
            kh, nh, n, left, right = zip(*rows)
            key = np.unique(np.array(kh, np.int64), return_inverse=True)[1]
            a, z = shared_windows(key, list(left), list(right), np.array(n), length, gram)
            ok = np.flatnonzero(a <= z)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(kh, np.int64)[ok]), pa.array(np.array(nh, np.int64)[ok]),
                 pa.array(a[ok].astype(np.int32)), pa.array(z[ok].astype(np.int32))], names=["kh", "nh", "first", "last"])

        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if len(held) >= CHUNK and r[0] != held[-1][0]:
                    yield done(held)
                    held = []
                if not held or r[:2] != held[-1][:2]:
                    held.append(r)
        if held:
            yield done(held)

    hot = one.groupBy("kh").count().filter(F.col("count") > max_group).select("kh")
    usual, extra = context, None
    if not hot.isEmpty():
        usual = context.join(hot, "kh", "left_anti")
        extra = _counted(context.join(hot, "kh", "left_semi"), length, gram)
    extents = usual.repartition("kh").sortWithinPartitions("kh", "nh").mapInArrow(extent, EXTENT)
    if extra is not None:
        extents = extents.unionByName(extra)
    spans = places.filter("not mixed").select("t1", "t2", F.struct(
        (F.col("pos") - reach).alias("a"), (F.col("pos") + length).alias("b")).alias("s"))
    more = mixed.join(extents, ["kh", "nh"]).select("t1", "t2", F.struct(
        (F.col("pos") + F.col("first")).alias("a"), (F.col("pos") + F.col("last") + length).alias("b")).alias("s"))
    by_text = spans.unionByName(more).groupBy("t1", "t2").agg(F.collect_set("s").alias("s"))
    whole = rows.join(by_text, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left")
    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])
    src = whole.select("__utf8", "__row", "s")
    schema = T.StructType([T.StructField("__row", src.schema["__row"].dataType), T.StructField("__got", fields)])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [without_spans(t.as_py(), s.as_py()) for t, s in zip(b.column(0), b.column(2))]
            cols = [pa.array([o[i] for o in out], k) for i, k in
                    enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            got = pa.StructArray.from_arrays(cols, names=[f.name for f in fields])
            yield pa.RecordBatch.from_arrays([b.column(1), got], names=["__row", "__got"])

    done_ = src.mapInArrow(remove, schema)
    return done_.select(*[F.col("__row").getField(c).alias(c) for c in carried], F.col("__got").alias(result))


def without_spans(text: bytes, spans) -> tuple[int, int, int, bytes]:
    """(bytes, removed, maximal runs removed, what is left)."""
    n = len(text)
    runs: list[list[int]] = []
    for s in sorted((max(0, x["a"]), min(n, x["b"])) for x in spans or ()):
        if runs and s[0] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], s[1])
        else:
            runs.append(list(s))
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return n, sum(b - a for a, b in runs), len(runs), b"".join(kept)


def _counted(context: DataFrame, length: int, gram: int) -> DataFrame:
    """Extents of oversized groups: every window of a neighbourhood is counted by
    (group, distance, content hash), with map-side combine and no group in one place."""
    reach = length - gram
    at = F.explode(F.sequence(F.lit(-reach), F.lit(0))).alias("d")
    every = (context.dropDuplicates(["kh", "nh"])
             .select("kh", "nh", "n", F.octet_length("left").alias("nl"), F.concat("left", "right").alias("t"), at)
             .filter((F.col("nl") + F.col("d") >= 0) & (F.octet_length("t") >= F.col("nl") + F.col("d") + length)))
    piece = F.expr(f"substring(t, nl + d + 1, {length})")
    w = every.select("kh", "nh", "n", "d", F.xxhash64(F.lit(1), piece).alias("h1"), F.xxhash64(F.lit(2), piece).alias("h2"))
    often = w.groupBy("kh", "d", "h1", "h2").agg(F.sum("n").alias("m")).filter("m > 1").select("kh", "d", "h1", "h2")
    return (w.join(often, ["kh", "d", "h1", "h2"]).groupBy("kh", "nh")
             .agg(F.min("d").cast("int").alias("first"), F.max("d").cast("int").alias("last")))


def cleaned(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of its texts; bytes of a character
    that a cut split are dropped with it, so texts stay valid UTF-8."""
    out = repeats(docs, text_col, "__dedup", length)

    @F.pandas_udf("string")
    def text(kept):
        return kept.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return out.withColumn(text_col, text("__dedup.kept")).select(*[quoted(c) for c in docs.columns])
