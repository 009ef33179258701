"""Objects of one huge JSON document, read in parallel (A1).

``[{...}, ...]`` and ``{"companies": [{...}, ...], ...}`` may be one line of any
length.  Spark's text reader cuts the file at every ``}``, so splits of the file
are read by different tasks, over whatever storage Spark reads.  What a piece
means depends on whether it starts inside a string and how deep it is nested:

1. each split is summed up once: whether it flips the string state, and its change
   of depth for both start states (a piece starting inside a string counts the
   brackets of its other halves);
2. prefix sums over the splits (one row each) give the true start of every split;
3. each split is then cut into items; an item that ends in a later split leaves as
   fragments, which are put together by the number of the item.

An item is an object directly inside the top-level array, or inside the array under
the member's name of a top-level object; anything else is skipped.  Positions
count the items over all files, by path and place.  A file without items gives no
rows.  A document that ends early gives the items that are complete.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.sources.tables import landed

#: Characters of a file's head that decide about its layout.
HEAD_BYTES = 1 << 16

#: Splits whose starts are broadcast; more are joined by a shuffle.
BROADCAST_SPLITS = 100_000

#: Names that tell a document with a member of items from a line of its own.
DOCUMENT_MEMBERS = ("companies", "total_scanned")

_ESCAPE = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}\[\]]', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*', re.S)


# --- layout -------------------------------------------------------------------------

def head_of(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> str:
    """The first ``size`` bytes (unpacked) of the first file under ``path`` that has any, read by
    the driver through Spark's own file system."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    for name in sorted(spark.read.format("binaryFile").load(path).inputFiles()):
        at = hadoop.fs.Path(jvm.java.net.URI(name))
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
            data = bytes((codec.createInputStream(stream) if codec else stream).readNBytes(size))
        finally:
            stream.close()
        text = data.decode("utf-8", "ignore").removeprefix("﻿")
        if text.strip():
            return text
    return ""


def layout_of(head: str) -> str:
    """``array``, ``object`` (a document with a member of items) or ``lines``, by the head of a file:
    an object is a document if one of :data:`DOCUMENT_MEMBERS` is a member of the first object."""
    head = head.lstrip()
    if not head or head[0] == "[":
        return "array"
    depth = 0
    for m in _TOKEN.finditer(head):
        t = m[0]
        if t in "{[":
            depth += 1
        elif t in "}]":
            depth -= 1
            if depth == 0:
                return "lines"
        elif depth == 1 and t[1:-1] in DOCUMENT_MEMBERS and head[m.end():].lstrip().startswith(":"):
            return "object"
    return "lines"


# --- what a piece does ----------------------------------------------------------------

def _change(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("}") - text.count("]")


def effect(piece: str) -> tuple[bool, int, int]:
    """Whether the piece with its ``}`` flips the string state, and the change of depth if it
    starts outside and if it starts inside a string."""
    parts = (_ESCAPE.sub("", piece) + "}").split('"')
    return len(parts) % 2 == 0, _change("".join(parts[::2])), _change("".join(parts[1::2]))


class Cutter:
    """Cuts one split into fragments of items, piece by piece.

    ``base``: depth of an item's surroundings (1 array, 2 member).  ``active``: does an array of
    items surround us (None: as at the end of the split before)?  A split that starts deeper
    than ``base`` starts in an item or in an array among the items; the bracket that leads
    back to ``base`` tells.
    """

    def __init__(self, member: str | None, inside: bool, depth: int) -> None:
        self.member, self.base = member, 1 if member is None else 2
        self.inside, self.depth = inside, depth
        self.active: bool | None = None if depth >= self.base else False
        self.unknown, self.in_item = depth > self.base, False
        self.key: str | None = None
        self.begun = False  # did the open item begin in this split?
        self.held: list[str] = []
        self.out: list[tuple[bool, bool, bool | None, str]] = []

    def take(self, piece: str) -> None:
        text, at = piece + "}", 0
        if self.unknown:
            at = self._leave(text)
        if at is not None and not self.in_item:
            at = self._look(text, at)
        if at is None:
            return
        flips, outside, within = effect(text[at:-1])
        self.depth += within if self.inside else outside
        self.inside ^= flips
        self.held.append(text[at:])
        if self.depth <= self.base and not self.inside:
            self.end(True)

    def _after_string(self, text: str) -> int | None:
        """Where the string that the piece starts in is over (None: not in this piece)."""
        at = _REST_OF_STRING.match(text).end()
        if at >= len(text):
            return None
        self.inside = False
        return at + 1

    def _leave(self, text: str) -> int | None:
        """Walk the tokens of whatever the split started in; the place behind it if it was no item."""
        at = self._after_string(text) if self.inside else 0
        for m in _TOKEN.finditer(text, at) if at is not None else ():
            t = m[0]
            if t in ("{", "["):
                self.depth += 1
            elif t in ("}", "]"):
                self.depth -= 1
                if self.depth <= self.base:
                    self.unknown = False
                    if t == "}":  # the last of the piece
                        self.held.append(text)
                        self.end(True)
                        return None
                    self.held = []
                    return m.end()
            elif not t.endswith('"'):
                self.inside = True
        self.held.append(text)
        return None

    def _look(self, text: str, at: int) -> int | None:
        """Walk the tokens outside items up to the ``{`` of the next one."""
        if self.inside:
            at = self._after_string(text)
            if at is None:
                return None
            if self.depth == 1 and text[at:].lstrip().startswith(":"):
                self.key = None  # a name that holds a } is none we look for
        for m in _TOKEN.finditer(text, at):
            t = m[0]
            if t == "{" and self.depth == self.base and self.active is not False:
                self.in_item = self.begun = True
                return m.start()
            if t in ("{", "["):
                self.depth += 1
                if self.depth == self.base:
                    self.active = t == "[" and (self.member is None or self.key == self.member)
                elif self.depth < self.base:
                    self.active = False
            elif t in ("}", "]"):
                self.depth -= 1
                if self.depth < self.base:
                    self.active = False
            elif not t.endswith('"'):  # a piece ends with }, so this string goes on
                self.inside = True
            elif self.depth == 1 and text[m.end():].lstrip().startswith(":"):
                self.key = json.loads(t, strict=False)
        return None

    def end(self, complete: bool) -> None:
        if self.held:
            self.out.append((self.begun, complete, self.active, "".join(self.held)))
        self.held, self.begun, self.in_item = [], False, False


# --- the scan -------------------------------------------------------------------------

_AT = ["path", "start"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Runs of pieces of one split, in order; a split may come in several runs."""
    for b in batches:
        rows = zip(*[b.column(i).to_pylist() for i in range(b.num_columns)])
        now, held = None, []
        for *key, value in rows:
            if key != now:
                if held:
                    yield tuple(now), held
                now, held = key, []
            held.append(value)
        if held:
            yield tuple(now), held


def _split_starts(pieces: DataFrame) -> DataFrame:
    """``(path, start, inside, depth)`` at the first piece of every split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for at, values in _by_split(batches):
            flip, a, b = sums.get(at, (False, 0, 0))
            for v in values:
                f, outside, within = effect(v)
                a, b = a + (within if flip else outside), b + (outside if flip else within)
                flip ^= f
            sums[at] = [flip, a, b]
        keys = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             *[pa.array([int(sums[k][i]) for k in keys], pa.int64()) for i in range(3)]], names=[*_AT, "flip", "outside", "within"])

    splits = pieces.mapInArrow(run, "path string, start bigint, flip bigint, outside bigint, within bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    inside = F.coalesce(F.sum("flip").over(before), F.lit(0)) % 2
    splits = splits.withColumn("inside", inside == 1)
    here = F.when(F.col("inside"), F.col("within")).otherwise(F.col("outside"))
    return splits.withColumn("here", here).select(*_AT, "inside", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("depth"))


def json_items(spark: SparkSession, path: str, member: str | None = None) -> DataFrame:
    """``(pos, item)``: the objects of the top-level array, or of the array under ``member``, as JSON text."""
    pieces = _pieces(spark, path)
    starts = landed(_split_starts(pieces), "json-splits")
    few = starts.count() <= BROADCAST_SPLITS
    if few:
        rows = pieces.join(F.broadcast(starts), _AT)
    else:  # the scan's order is restored after the exchange
        rows = pieces.withColumn("mid", F.monotonically_increasing_id()).join(starts, _AT)
        rows = rows.repartition(*_AT).sortWithinPartitions(*_AT, "mid")
    rows = rows.select(*_AT, "inside", "depth", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, number = None, None, 0

        def out(last: bool) -> pa.RecordBatch:
            nonlocal number
            if last:
                cutter.end(False)
            got = [(True, *x) for x in cutter.out] + ([(False, False, False, cutter.active, None)] if last else [])
            cutter.out = []
            first, number = number, number + len(got)
            cols = list(zip(*got)) or [()] * 5
            kinds = [pa.bool_()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]] * len(got), pa.string()), pa.array([now[1]] * len(got), pa.int64()),
                 pa.array(range(first, number), pa.int64()), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=[*_AT, "no", "part", "begins", "ends", "active", "item"])

        for at, values in _by_split(batches):
            if now != at[:2]:
                if now is not None:
                    yield out(True)
                now, number, cutter = at[:2], 0, Cutter(member, at[2], at[3])
            for v in values:
                cutter.take(v)
            if cutter.out:
                yield out(False)
        if now is not None:
            yield out(True)

    parts = rows.mapInArrow(run, "path string, start bigint, no bigint, part boolean, begins boolean, ends boolean, "
                                 "active boolean, item string")
    parts = landed(parts, "json-fragments")
    # what surrounds a split at its start, then how many items began before it
    ahead = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.filter("not part").select(*_AT, F.last("active", True).over(ahead).alias("was"))
    parts = parts.filter("part").join(ends, _AT).filter(F.coalesce("active", "was", F.lit(member is None)))
    counts = parts.groupBy(*_AT).agg(F.count_if("begins").alias("n"))
    over = Window.orderBy(*_AT).rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    counts = counts.select(*_AT, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("offset"))
    # a continued fragment is the first of its split, so items that begin are the others, in order
    first = parts.groupBy(*_AT).agg(F.min(F.when(F.col("begins"), F.col("no"))).alias("first_no"))
    parts = parts.join(counts, _AT).join(first, _AT)
    pos = F.col("offset") + F.when(F.col("begins"), F.col("no") - F.col("first_no")).otherwise(-1)
    parts = parts.withColumn("pos", pos)
    whole = parts.filter("begins and ends").select("pos", "item")
    cut = parts.filter("not (begins and ends)").groupBy("path", "pos").agg(
        F.sort_array(F.collect_list(F.struct("start", "begins", "ends", "item"))).alias("of"))  # the fragments of one item
    # what follows its end is no item: an array among the items that goes on for splits
    last = F.array_position(F.col("of.ends"), True)
    cut = cut.filter(F.get("of", F.lit(0))["begins"] & (last > 0))
    cut = cut.select("pos", F.array_join(F.slice(F.col("of.item"), 1, last.cast("int")), "").alias("item"))
    return whole.unionByName(cut)
