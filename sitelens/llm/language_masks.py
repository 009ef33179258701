"""Language identification by n-gram filters that answer with a bitmask of languages.

Learning: n-grams of 1 to 3 code points (letters in lower case, a word's ends as a
blank) are counted exactly by language over a sample of the labelled texts.  An
n-gram belongs to a language at a level if its share among the language's n-grams
of that size reaches the level's threshold; shares add up to 1, so a level of 1/10,000
has at most 10,000 n-grams of a size and the filters have a bound whatever the corpus.

The filters are one bit-sliced Bloom table: each place holds a bit for every
(language, level), and the bitwise and of the places of an n-gram is the set of all
languages that hold it, in one look-up.

Deciding: the bits are counted by document.  Of ``N`` n-grams a filter with false
positive rate ``f`` (its fill to the power of places asked) takes about ``f`` of those
it does not hold, so ``(count - N f) / (1 - f)`` is counted.  The language with the
largest sum over its levels wins (ties: more labelled documents, then the smaller
name); ``score`` is its share of the sum of the best two, 0 if no filter holds
anything.

The sample: at most about ``sample_docs`` labelled documents of each language, by a hash
of their text, so a language below that is learned whole.  Everything else covers
all rows and whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0; without
labelled rows all texts are ``und``; rows with a null language are not learned from;
repeated rows count each and get equal results; an input column named like the
result is replaced, all others pass through.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import bound_batches, map_texts, quoted, utf8, written

#: Labelled documents of a language that are learned from, at most about.
SAMPLE_DOCS = 4000
#: Share of a language's n-grams of one size from which an n-gram belongs to it, by level.
LEVELS = (1e-3, 1e-4)
#: Code points of the n-grams.  Three of 21 bits fit one number.
SIZES = (1, 2, 3)
#: Places asked for each n-gram, and places a held n-gram has in the table at least.
ASKED, ROOM = 3, 16
#: Code points worked on at a time, and n-grams a task holds before it hands on their counts.
PIECE, HELD = 1 << 20, 1 << 20

UNDECIDED = "und"
RESULT = T.StructType([T.StructField("lang", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # odd multipliers of the places
_BLANK = 32


@lru_cache
def letter_bits() -> bytes:
    """A bit for every code point, set for letters (made once, on the driver)."""
    return np.packbits(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)).tobytes()


def letter_table(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def pieces(texts: list[bytes], letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of ``texts`` (blank where no letter), the number of each one's text and whether an
    n-gram may start there.  Texts stand between blanks; a long one goes in pieces that overlap
    by two places where no n-gram starts."""
    held, owner, start, size = [], [], [], 0
    for i, data in enumerate(texts):
        a = np.frombuffer((" " + data.decode().lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(a), PIECE):
            part = a[at: at + PIECE + 2]
            held.append(np.where(letter[part], part, _BLANK).astype(np.uint64))
            owner.append(np.full(len(part), i, np.int64))
            live = np.ones(len(part), bool)
            live[PIECE:] = False
            start.append(live)
            size += len(part)
            if size >= PIECE:
                yield np.concatenate(held), np.concatenate(owner), np.concatenate(start)
                held, owner, start, size = [], [], [], 0
    if held:
        yield np.concatenate(held), np.concatenate(owner), np.concatenate(start)


def ngrams(codes: np.ndarray, owner: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, n-grams as numbers, their texts): letters with a blank at the ends only, so none
    reaches from one text into the next."""
    blank = codes == _BLANK
    gram = codes
    for n in SIZES:
        if n > 1:
            gram = (gram[:-1] << np.uint64(21)) | codes[n - 1:]
        size = len(gram)
        if size <= 0:
            return
        good = start[:size].copy()
        if n == 1:
            good &= ~blank
        elif n == 2:
            good &= ~(blank[:-1] & blank[1:])
        else:
            for k in range(1, n - 1):
                good &= ~blank[k: k + size]
        yield n, gram[good], owner[:size][good]


# --- learning ---------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    """``table``: one row of bytes a group of 8 bits, one column a place; bit ``b`` belongs to
    language ``b // levels``.  ``false``: false positive rate of every bit."""

    languages: tuple[str, ...]
    levels: int
    shift: int
    table: np.ndarray
    false: np.ndarray

    def masks(self, grams: np.ndarray, group: int) -> np.ndarray:
        """Bits of 8 filters for each n-gram."""
        row = self.table[group]
        out = None
        for mix in _MIX[:ASKED]:
            got = row[(grams * np.uint64(mix)) >> np.uint64(self.shift)]
            out = got if out is None else out & got
        return out

    def counts(self, texts: list[bytes], letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (text, language) and the number of letters of each text."""
        spread = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)
        groups = len(self.table)
        held, total, lettered = np.zeros((len(texts), groups * 8)), np.zeros(len(texts)), np.zeros(len(texts))
        for codes, owner, start in pieces(texts, letter):
            first = int(owner[0])
            width = int(owner[-1]) - first + 1
            for n, gram, of in ngrams(codes, owner, start):
                of = of - first
                number = np.bincount(of, minlength=width)
                total[first: first + width] += number
                if n == 1:
                    lettered[first: first + width] += number
                for g in range(groups):
                    seen = np.bincount(of * 256 + self.masks(gram, g), minlength=width * 256).reshape(width, 256)
                    held[first: first + width, g * 8: g * 8 + 8] += seen @ spread
        bits = len(self.languages) * self.levels
        real = (held[:, :bits] - total[:, None] * self.false) / (1 - self.false)
        return np.maximum(real, 0).reshape(len(texts), len(self.languages), self.levels).sum(axis=2), lettered


def count_ngrams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, size, gram, n)`` over ``docs``; summed in each task first."""
    bound_batches(docs.sparkSession)
    src = docs.select(quoted(lang_col).cast("string").alias("lang"), utf8(quoted(text_col)).alias("text"))
    letter_set = letter_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = letter_table(letter_set)
        held: dict[tuple[str, int], list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in held.items():
                grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                sums = np.bincount(at, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), n), pa.int32()),
                     pa.array(grams.astype(np.int64)), pa.array(sums)], names=["lang", "size", "gram", "n"])
            held.clear()

        for b in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for piece in pieces(texts, letter):
                    for n, gram, _ in ngrams(*piece):
                        part = np.unique(gram, return_counts=True)
                        held.setdefault((lang, n), []).append(part)
                        size += len(part[0])
                if size >= HELD:
                    yield from flush()
                    size = 0
        yield from flush()

    counts = src.mapInArrow(run, "lang string, size int, gram bigint, n bigint")
    return counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Filters of every language among ``docs``.  The driver gets the held n-grams: at most
    1/min(LEVELS) of each size and language, and one row a language."""
    rows = docs.filter(quoted(lang_col).isNotNull())
    number = {r["lang"]: r["n"] for r in rows.groupBy(quoted(lang_col).cast("string").alias("lang"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    if not number:
        return Model((), len(LEVELS), 63, np.zeros((0, 2), np.uint8), np.zeros(0))
    languages = tuple(sorted(number, key=lambda x: (-number[x], x)))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_docs / number[k])))])
    place = F.pmod(F.xxhash64(quoted(text_col)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    counts = written(count_ngrams(rows.filter(place < share[quoted(lang_col).cast("string")]), text_col, lang_col), "ngrams")
    whole = counts.groupBy("lang", "size").agg(F.sum("n").alias("whole"))
    kept = counts.join(whole, ["lang", "size"]).withColumn("share", F.col("n") / F.col("whole"))
    got = kept.filter(F.col("share") >= min(LEVELS)).select("lang", "gram", "share").toArrow()
    return filters(languages, got["lang"].to_pylist(), got["gram"].to_numpy(), got["share"].to_numpy())


def filters(languages: tuple[str, ...], lang: list[str], gram: np.ndarray, share: np.ndarray) -> Model:
    """The bit-sliced table of n-grams with their shares."""
    levels = len(LEVELS)
    number = {name: i for i, name in enumerate(languages)}
    who = np.array([number[x] for x in lang], np.int64)
    most = max(1, int(np.bincount(who).max())) if len(who) else 1
    power = max(8, int(np.ceil(np.log2(ROOM * most))))
    shift, size = 64 - power, 1 << power
    bits = len(languages) * levels
    table = np.zeros((-(-bits // 8), size), np.uint8)
    for level, least in enumerate(LEVELS):
        here = share >= least
        bit = who[here] * levels + level
        for mix in _MIX[:ASKED]:
            place = (gram[here].astype(np.uint64) * np.uint64(mix)) >> np.uint64(shift)
            np.bitwise_or.at(table, (bit // 8, place), (1 << (bit % 8)).astype(np.uint8))
    fill = np.array([(table[b // 8] >> (b % 8) & 1).mean() for b in range(bits)])
    return Model(languages, levels, shift, table, fill ** ASKED)


# --- deciding ---------------------------------------------------------------------

def identified(docs: DataFrame, model: Model, text_col: str = "text", result: str = "language", carry_text: bool = True) -> DataFrame:
    """``docs`` with the struct ``result``: ``lang`` and ``score`` of every whole text.  Narrow."""
    sent = docs.sparkSession.sparkContext.broadcast(
        (letter_bits(), model.languages, model.levels, model.shift, model.table, model.false))

    def make():
        bits, *parts = sent.value
        letter, held = letter_table(bits), Model(*parts)

        def work(column: pa.Array) -> dict[str, object]:
            texts = column.to_pylist()
            if not held.languages:
                return {"lang": [UNDECIDED] * len(texts), "score": [0.0] * len(texts)}
            counts, lettered = held.counts(texts, letter)
            best = counts.argmax(axis=1)  # the first of equal ones: languages stand by number of labelled documents
            top = np.sort(counts, axis=1)[:, ::-1][:, :2].sum(axis=1)
            value = np.divide(counts.max(axis=1), top, out=np.zeros(len(texts)), where=top > 0)
            return {"lang": [held.languages[b] if n else UNDECIDED for b, n in zip(best.tolist(), lettered.tolist())],
                    "score": np.where(lettered > 0, value, 0.0)}

        return work

    return map_texts(docs, text_col, result, RESULT, make, carry_text)
