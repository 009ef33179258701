"""Benchmark decontamination with an FM-index per training shard.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z.
A test item's windows are its sequences of ``window`` words, or all its words if
it has fewer.  Documents are indexed shard by shard: a shard is the words of a
slice of a partition.  Words that no window holds become one separator, runs
shorter than the shortest window are left out (neither can be part of an
occurrence), and the rest is an FM-index: all windows of one length are
searched backwards at once by ranks in a wavelet matrix, occurrences are
located by sampled suffix positions, and a document's overlapping occurrences
merge into removal spans.

The windows are broadcast in passes of about ``pass_windows`` (window, item) rows,
cut by a hash of both, so a window of many items is spread over the passes.  The
driver holds one pass at a time, and so does a task: it opens them one after
another for each group of texts and adds up their spans and items.  A benchmark
of any size is searched with bounded memory, no shuffle of documents and no join.

Defined cases: null texts and items have no words; items without words have no
window; a null item id is written "null"; equal item ids count once; repeated
documents are judged alike; empty tables give empty or clean results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import WORD, bound_batches, map_texts, quoted, utf8, words_of, written
from sitelens.llm.fm_index import FMIndex

WINDOW = 13
PASS_WINDOWS = 100_000
SHARD_WORDS = 1 << 20
PIECE_WORDS = 1 << 18
#: Bytes of rows searched for all passes in turn, if there is more than one.
GROUP_BYTES = 16 << 20

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                       T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN)])


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(words, item) rows: every distinct window of every item, words joined by spaces."""
    bound_batches(benchmark.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, items = [], []
            for item, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = words_of(t)
                own = {b" ".join(w[i:i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                words += own
                items += [item] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(items, pa.string())],
                                             names=["words", "item"])

    src = benchmark.select(F.coalesce(quoted(id_col).cast("string"), F.lit("null")).alias("item"), utf8(quoted(text_col)).alias("t"))
    return src.mapInArrow(run, "words binary, item string").distinct()


class Windows:
    """One pass: the windows by length as symbol rows, and the items of each."""

    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        items: dict[bytes, set[str]] = {}
        for words, item in rows:
            items.setdefault(words, set()).add(item)
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list] = {}
        for words in sorted(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words.split(b" ")]
            by_length.setdefault(len(ids), []).append((ids, sorted(items[words])))
        self.patterns = {n: np.array([x[0] for x in v], np.int64) for n, v in by_length.items()}
        self.items = {n: [x[1] for x in v] for n, v in by_length.items()}
        self.shortest = min(self.patterns, default=0)
        self.longest = max(self.patterns, default=0)
        self.sigma = len(self.vocabulary) + 1


def _pieces(ids: np.ndarray, w: Windows) -> Iterator[tuple[int, np.ndarray]]:
    """(first word, symbols) of the runs that may hold a window; long runs are cut
    into pieces that overlap by all but one word of the longest window."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], ids > 0, [False])).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a < w.shortest:
            continue
        at = a
        while True:
            end = min(b, at + PIECE_WORDS)
            yield at, ids[at:end]
            if end == b:
                break
            at = end - w.longest + 1


def _search(shard: list[tuple[int, int, np.ndarray]], w: Windows, spans: list[list], items: list[set]) -> None:
    """Index the pieces (document, first word, symbols) and add what occurs in them."""
    parts, starts, total = [], [], 0
    for _, _, ids in shard:
        starts.append(total)
        parts += [ids, np.ones(1, np.int64)]
        total += len(ids) + 1
    index = FMIndex(np.concatenate(parts), w.sigma)
    at = np.array(starts)
    for n, patterns in w.patterns.items():
        lo, hi = index.search(patterns)
        found = np.flatnonzero(hi > lo)
        if not len(found):
            continue
        counts = (hi - lo)[found]
        ends = np.cumsum(counts)
        rows = np.repeat(lo[found] - np.concatenate(([0], ends[:-1])), counts) + np.arange(ends[-1])
        pattern = np.repeat(found, counts)
        place = index.locate(rows)
        piece = np.searchsorted(at, place, side="right") - 1
        for p, pos, k in zip(pattern.tolist(), place.tolist(), piece.tolist()):
            doc, first, _ = shard[k]
            start = first + pos - starts[k]
            spans[doc].append((start, start + n))
            items[doc].update(w.items[n][p])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", result: str = "decon",
              item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              pass_windows: int = PASS_WINDOWS, carry_text: bool = True) -> DataFrame:
    """``docs`` with the struct column ``result``: ``n_words``, ``n_hit`` (words
    inside any occurrence), ``items`` (sorted ids) and ``spans`` (merged word
    ranges to remove)."""
    windows = item_windows(benchmark, item_col, item_text_col, window)
    passes = max(1, -(-windows.count() // pass_windows))
    if passes > 1:
        slot = F.pmod(F.xxhash64("words", "item"), F.lit(passes)).cast("int")
        windows = written(windows.withColumn("slot", slot), "windows", ["slot"])
    shared = []
    for k in range(passes):
        own = windows.filter(F.col("slot") == k) if passes > 1 else windows
        w = Windows([(bytes(r["words"]), r["item"]) for r in own.select("words", "item").collect()])
        shared.append(docs.sparkSession.sparkContext.broadcast(w))

    def make():
        def run(texts):
            spans: list[list] = [[] for _ in range(len(texts))]
            items: list[set] = [set() for _ in range(len(texts))]
            for part in shared:
                n_words = _one_pass(texts.to_pylist(), part.value, spans, items)
                if len(shared) > 1:
                    vars(part).pop("_value", None)  # read again for the next texts: one pass in memory at a time
            done = [merged(s) for s in spans]
            return {"n_words": n_words, "n_hit": [sum(b - a for a, b in s) for s in done],
                    "items": [sorted(i) for i in items], "spans": [[{"start": a, "end": b} for a, b in s] for s in done]}
        return run

    return map_texts(docs, text_col, result, FIELDS, make, carry_text, GROUP_BYTES if passes > 1 else 0)


def _one_pass(texts: list[bytes], w: Windows, spans: list[list], items: list[set]) -> list[int]:
    """Add the occurrences of one pass's windows in each text; the words of each."""
    n_words = []
    shard: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for d, t in enumerate(texts):
        words = words_of(t)
        n_words.append(len(words))
        if len(words) < max(1, w.shortest) or not w.patterns:
            continue
        get = w.vocabulary.get
        ids = np.fromiter((get(x, 0) for x in words), np.int64, len(words))
        for at, piece in _pieces(ids, w):
            shard.append((d, at, piece))
            size += len(piece)
            if size >= SHARD_WORDS:
                _search(shard, w, spans, items)
                shard, size = [], 0
    if shard:
        _search(shard, w, spans, items)
    return n_words


def contaminated(result: str = "decon", share: int = 20):
    """The verdict: at least one word in ``share`` lies inside an occurrence."""
    return (F.col(f"{result}.n_hit") > 0) & (F.lit(share) * F.col(f"{result}.n_hit") >= F.col(f"{result}.n_words"))


def cut_spans(df: DataFrame, text_col: str = "text", result: str = "decon", out_col: str = "cleaned") -> DataFrame:
    """The texts without their removal spans (from the first byte of a span's
    first word to the end of its last word)."""
    plain = F.struct(utf8(quoted(text_col)).alias("t"), F.col(f"{result}.spans").alias("s"))

    @F.pandas_udf("string")
    def cut(x):
        return x.apply(lambda r: _cut(r["t"], r["s"]), axis=1) if len(x) else x.apply(str, axis=1)

    return df.withColumn(out_col, F.when(F.size(f"{result}.spans") == 0, F.coalesce(quoted(text_col), F.lit("")))
                         .otherwise(cut(plain)))


def _cut(data: bytes, spans) -> str:
    where = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for s in spans:
        out.append(data[at:where[int(s["start"])][0]])
        at = where[int(s["end"]) - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")
