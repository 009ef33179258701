"""Packing of tokenized documents by shortest-pack-first over the length histogram.

1. Tokenize: each document becomes its token ids and an end id, cut into pieces
   of at most ``size`` ids.  The pieces are written to the shared folder with
   their number among the equally long pieces of their task.
2. The histogram of piece lengths (at most ``size`` numbers, whatever the input)
   is packed on the driver: lengths longest first, each added to the shortest
   open packs, keeping counts of packing patterns instead of packs.
3. Pieces find their place by rank: the number inside the task plus the pieces
   of that length in the tasks before is the rank among all pieces of that
   length, and the patterns are ranges of ranks.

Token ids come from the ``tokenizers`` library with the vocabulary file given by
path, read once on the driver and broadcast (a fixed file).  For a vocabulary
that lower-cases and drops white space the ids of a text are those of its words
one after the other, so words are encoded once and remembered (a bounded memory
of frequent words; what it holds never changes a result).

Defined cases: a null or blank text has the end id only; ids may be null or
repeated (a piece is named by its own row, not by its document's id); special
tokens written in a text are ordinary text; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import bound_batches, free_name, gathered, quoted, utf8, written

SIZE = 2048
END_ID = 1
KEPT_WORDS, KEPT_PARTS = 400_000, 100_000
#: Texts whose words are looked up together.
GROUP_BYTES = 3 << 20

#: The normalizer and splitter that word-by-word encoding relies on (fixed values of the vocabulary file).
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        spec = json.loads(vocabulary)
        self.whole = Tokenizer.from_str(vocabulary)
        self.whole.encode_special_tokens = True
        model = spec["model"]
        self.wordwise = (all(spec.get(k) == v for k, v in WORDWISE.items()) and model.get("end_of_word_suffix") == "</w>"
                         and model.get("type") == "BPE")
        self.words, self.parts = Memory(KEPT_WORDS), Memory(KEPT_PARTS)
        if self.wordwise:
            # the same merges; the parts arrive split, lower-cased and in byte letters
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            self.ends = np.zeros(1 + max(model["vocab"].values()), bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith("</w>")]] = True
            # the same splitter with a mark between words, for the characters that are not odd
            plain = sorted({x for c in range(0x21, 0x250) for x in chr(c) + chr(c).lower()})
            kinds = {k: "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == k) for k in "LN"}
            pattern = WORDWISE["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            for written_so, class_ in ((r"[\p{L}]", f"[{kinds['L']}]"), (r"[\p{N}]", f"[{kinds['N']}]"),
                                       (r"\p{L}", kinds["L"]), (r"\p{N}", kinds["N"])):
                pattern = pattern.replace(written_so, class_)
            self.split = re.compile(pattern + r"|\n").findall
            self.letters = byte_letters()
            del self.letters[32]  # parts hold no blank: it separates them
            self.odd = re.compile("(?m)^.*[^\x21-\x7e\xa1-\u024f\n].*$").findall

    def encode(self, data: bytes) -> bytes:
        return self.encode_all([data])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        if not self.wordwise:
            lines = [t.decode("utf-8", "replace") for t in texts]
            return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(lines, add_special_tokens=False)]
        if not texts:
            return []
        # every distinct word of the group is looked up once, its ids are then put in place by number
        lists = pc.ascii_split_whitespace(as_strings(pa.array(texts, pa.binary())))
        coded = lists.flatten().dictionary_encode()
        words = as_binary(coded.dictionary).to_numpy(zero_copy_only=False).tolist()
        known = self.words.memory
        found = list(map(known.get, words))
        holes = [i for i, ids in enumerate(found) if ids is None]
        if holes:
            new = [words[i] for i in holes]
            self.words.used(set(words).difference(new))
            self._learn(new)
            for i, w in zip(holes, new):
                found[i] = known[w]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        each = size[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        kind = np.int32 if upto[-1] < 1 << 31 else np.int64
        place = np.arange(upto[-1], dtype=kind)
        place += np.repeat((first[which] - upto[:-1]).astype(kind), each)
        out = ids[place].tobytes()
        del place
        ends = 4 * upto[lists.offsets.to_numpy()]
        self.words.shrink()
        self.parts.shrink()
        return [out[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _learn(self, words: list[bytes]) -> None:
        known, held = self.words.memory, self.parts.memory
        plain = [w for w in words if w.isalpha() and w.islower()]  # a to z: one part each, as it stands
        if plain:
            names = b"\n".join(plain).decode().split("\n")
            fresh = [n for n in names if n not in held]
            made = dict(zip(fresh, self._encoded(fresh)))
            known.update(zip(plain, [made.get(n) or held[n] for n in names]))
            words = [w for w in words if w not in known]
        text = b"\n".join(words).decode("utf-8", "replace")
        odd = set(self.odd(text))  # rare scripts, marks and blanks: the library's own steps
        if odd:
            for w in words:
                if (t := w.decode("utf-8", "replace")) in odd:
                    known[w] = np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
            words = [w for w in words if w not in known]
            text = b"\n".join(words).decode("utf-8")
        if not words:
            return
        parts = self.split(unicodedata.normalize("NFC", text).lower())
        distinct = set(parts)
        distinct.discard("\n")
        fresh = []
        here = {"\n": b"\xff\xff\xff\xff"}  # ids fit in three bytes, so this is none: it marks the end of a word
        for p in distinct:
            ids = held.get(p) or known.get(p.encode())
            if ids is None:
                fresh.append(p)
            else:
                here[p] = ids
        self.parts.used(distinct.difference(fresh))
        made = dict(zip(fresh, self._encoded(fresh)))
        held.update(made)
        here.update(made)
        known.update(zip(words, b"".join(map(here.__getitem__, parts)).split(b"\xff\xff\xff\xff")))

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, not remembered."""
        out: list[bytes] = []
        for at in range(0, len(parts), 1024):
            some = parts[at:at + 1024]
            line = " ".join(some).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                raise RuntimeError("a word without an end token")
            raw = ids.tobytes()
            ends = (4 * cuts).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out


def as_strings(a: pa.Array) -> pa.Array:
    """A binary array as strings, bytes as they are (white space is looked for among ASCII bytes only)."""
    return pa.Array.from_buffers(pa.string(), len(a), a.buffers())


def as_binary(a: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(a), a.buffers())


class Memory:
    """A dict that forgets, when it holds too much, what was not met again since the last time."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.memory: dict = {}
        self.again: set = set()

    def used(self, keys: set) -> None:
        self.again |= keys

    def shrink(self) -> None:
        if len(self.memory) > self.limit:
            kept = {k: self.memory[k] for k in self.again if k in self.memory}
            self.memory = kept if len(kept) <= self.limit // 2 else {}
            self.again = set()


class Vocabulary:
    """A vocabulary file's text with its encoder.  Workers keep a broadcast value,
    so the encoder and the words it knows serve all tasks of a worker."""

    def __init__(self, text: str) -> None:
        self.text, self.kept = text, None

    def __getstate__(self) -> dict:
        return {"text": self.text, "kept": None}

    def encoder(self) -> Encoder:
        if self.kept is None:
            self.kept = Encoder(self.text)
        return self.kept


def byte_letters() -> dict[int, str]:
    """Byte -> the printable letter that byte-level vocabularies write for it."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def tokenized(docs: DataFrame, vocabulary_path: str, text_col: str = "text", size: int = SIZE,
              end_id: int = END_ID) -> DataFrame:
    """The written table of pieces: the other columns of ``docs``, ``start``,
    ``length``, ``doc_tokens``, ``ids`` (little-endian unsigned 32-bit) and
    ``__task``, ``__number``, which name a piece among those of its length."""
    bound_batches(docs.sparkSession)
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))
    own = ("start", "length", "doc_tokens", "ids", "__task", "__number")
    base = docs.select(*[quoted(c) for c in docs.columns if c.lower() not in own or c == text_col])
    tmp = free_name(base, "__utf8")
    src = base.withColumn(tmp, utf8(quoted(text_col)))
    src = src.select(*[quoted(c) for c in src.columns if c != text_col])
    keep = [c for c in src.columns if c != tmp]
    extra = [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.IntegerType()), ("doc_tokens", T.LongType()),
                                              ("ids", T.BinaryType()), ("__task", T.LongType()), ("__number", T.LongType()))]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder = vocabulary.value.encoder()
        seen = [0] * (size + 1)

        def encoded(texts: pa.Array) -> Iterator[bytes]:
            group, held = [], 0
            for t in texts:
                group.append(t.as_py())
                held += len(group[-1])
                if held >= GROUP_BYTES:
                    yield from encoder.encode_all(group)
                    group, held = [], 0
            yield from encoder.encode_all(group)
        for b in gathered(batches, GROUP_BYTES):
            owner, start, length, total, ids, number = [], [], [], [], [], []
            for row, got in enumerate(encoded(b.column(b.num_columns - 1))):
                got += end
                n = len(got) // 4
                for at in range(0, n, size):
                    k = min(size, n - at)
                    owner.append(row)
                    start.append(at)
                    length.append(k)
                    total.append(n)
                    ids.append(got[4 * at:4 * (at + k)])
                    number.append(seen[k])
                    seen[k] += 1
                if len(ids) >= 512:
                    yield pieces(b, owner, start, length, total, ids, number, task)
                    owner, start, length, total, ids, number = [], [], [], [], [], []
            if ids:
                yield pieces(b, owner, start, length, total, ids, number, task)

    def pieces(b, owner, start, length, total, ids, number, task) -> pa.RecordBatch:
        at = pa.array(owner, pa.int64())
        return pa.RecordBatch.from_arrays(
            [*[c.take(at) for c in b.columns[:-1]], pa.array(start, pa.int64()), pa.array(length, pa.int32()),
             pa.array(total, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(ids), pa.int64()),
             pa.array(number, pa.int64())], names=[*keep, *[f.name for f in extra]])

    return written(src.mapInArrow(run, T.StructType([*[src.schema[c] for c in keep], *extra])), "pieces")


def pack_histogram(counts: dict[int, int], size: int = SIZE) -> tuple[np.ndarray, int]:
    """Patterns as ranges of ranks: rows (length, first rank, first sequence,
    offset), sorted; and the number of sequences.

    Shortest pack first: a length goes to the open packs with the most room, one
    piece to each, all packs of a pattern at once; without room, new packs are
    opened and filled with that length.
    """
    open_: dict[int, list[tuple[int, tuple | None]]] = {}
    heap: list[int] = []
    done: list[tuple[int, tuple]] = []

    def put(room: int, packs: int, chain: tuple) -> None:
        if room == 0:
            done.append((packs, chain))
        else:
            if room not in open_:
                open_[room] = []
                heapq.heappush(heap, -room)
            open_[room].append((packs, chain))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0] >= length:
                room = -heap[0]
                packs, chain = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    heapq.heappop(heap)
                use = min(left, packs)
                if use < packs:
                    put(room, packs - use, chain)
                put(room - length, use, (chain, length, 1))
                left -= use
            else:
                each = min(size // length, left)
                packs = left // each
                put(size - each * length, packs, (None, length, each))
                left -= packs * each
    for room, own in open_.items():
        done += own
    rank = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for packs, chain in done:
        offset = 0
        parts = []
        while chain is not None:
            chain, length, copies = chain
            parts.append((length, copies))
        for length, copies in reversed(parts):
            for _ in range(copies):
                rows.append((length, rank[length], sequence, offset))
                rank[length] += packs
                offset += length
        sequence += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 4), sequence


def assign(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (any columns beside ``length``, ``__task``, ``__number``) with
    ``sequence_id`` and ``offset``, without the naming columns."""
    per_task = pieces.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    rows, _ = pack_histogram(counts, size)
    places = pieces.sparkSession.sparkContext.broadcast(rows)  # grows with the histogram, not with the input
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("__task", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = pieces.join(offsets, ["__task", "length"]).withColumn("__rank", F.col("__before") + F.col("__number"))
    keep = [c for c in pieces.columns if c not in ("__task", "__number")]
    src = ranked.select(*[quoted(c) for c in keep], F.col("length").cast("bigint").alias("__length"), "__rank")
    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = places.value
        key = (r[:, 0] << 44) | r[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length = b.column(b.num_columns - 2).to_numpy()
            rank = b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-2], pa.array(r[at, 2] + rank - r[at, 1]), pa.array(r[at, 3])],
                names=[*keep, "sequence_id", "offset"])

    return src.mapInArrow(run, schema)


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """One row a sequence: ``ids`` padded to ``size`` (unless their number is a
    power of two) and ``tokens``, the ids that are not padding.  A group holds
    at most ``size`` ids."""
    one = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
    hexed = F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")
    n = F.col("tokens")
    power = F.pow(F.lit(2.0), F.round(F.log2(n.cast("double")))) == n.cast("double")
    pad = F.when(power, F.lit("")).otherwise(F.expr(f"repeat('{pad_id.to_bytes(4, 'little').hex()}', int({size} - tokens))"))
    return one.select("sequence_id", "tokens", F.unhex(F.concat(hexed, pad)).alias("ids"))


