"""Quality rules by distribution divergence.

Each text gives two histograms: its characters by class, and its words by the
common words of a language (one more bin for all other words).  The language
references are the same histograms summed over all texts of the language, so
they are statistics of the whole corpus.  The Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1) of a text to the reference that fits
its words best must stay below a limit.

Guards: a text of fewer than ``min_words`` words has too little to compare and
fails outright; above that, the limit of the word histogram is widened by
the distance that sampling alone gives a text of that length (the expectation
of the divergence falls with 1 / words), so short clean texts are not punished.

Common words: every task counts its words and sends the counts off whenever it
holds ``held`` different ones; their sums are the exact counts of all words.  The
``common`` most frequent words of each language make its bins (ties: the smaller
word).  Every language is a reference, however many there are; texts are compared
to ``AT_ONCE`` of them at a time.

Defined cases: a null text is empty and fails; a null language is a language
named ""; no texts or no reference: only the base rules decide; repeated rows
get equal results.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.llm.common import bound_batches, map_texts, quoted, utf8

COMMON = 64
#: Different words (of all languages) that a task holds before it sends their counts off.
HELD = 200_000
#: Languages of one broadcast; a task opens one broadcast at a time.
AT_ONCE = 200
CLASSES = ("lower", "upper", "digit", "space", "stop", "quote", "symbol", "other_ascii", "letter_above_ascii")

_CLASS_OF = np.full(256, 7)
for _b in range(256):
    _c = chr(_b)
    if _b >= 192:
        _CLASS_OF[_b] = 8
    elif _b >= 128:
        _CLASS_OF[_b] = 9  # continuation bytes: not a code point of their own
    elif _c.islower():
        _CLASS_OF[_b] = 0
    elif _c.isupper():
        _CLASS_OF[_b] = 1
    elif _c.isdigit():
        _CLASS_OF[_b] = 2
    elif _c in " \t\n\v\f\r":
        _CLASS_OF[_b] = 3
    elif _c in ".,;:":
        _CLASS_OF[_b] = 4
    elif _c in "'\"!?()-":
        _CLASS_OF[_b] = 5
    elif _c in "#*$%&|<>":
        _CLASS_OF[_b] = 6


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def class_counts(hist: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS_OF, weights=hist, minlength=10)[:9]


def repeated_words(ids: np.ndarray, window: int = 3) -> int:
    """Words inside a ``window``-word sequence that the text holds twice or more."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, window):
        width = int(ids.max()) + 1
        key = key * width + ids[k:n + k]
        if k < window - 1 and width ** 3 >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(data: bytes) -> tuple[dict[str, int], np.ndarray, dict[bytes, int], np.ndarray]:
    """The plain counts, the byte histogram, the ids of the words and their counts."""
    words = data.split()
    ids_of: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(ids_of.__getitem__, words), np.int64, len(words))
    hist = byte_counts(data)
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    counts = {"n_words": len(words), "word_chars": int(hist.sum() - hist[128:192].sum() - hist[9:14].sum() - hist[32]),
              "n_symbols": int(hist[list(b"#*$%&|<>")].sum()), "n_dup_lines": dup,
              "n_repeat_words": repeated_words(ids)}
    return counts, hist, ids_of, np.bincount(ids, minlength=len(ids_of))


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of histograms ``p`` to histogram ``q``."""
    p = p / np.maximum(1e-300, p.sum(-1, keepdims=True))
    q = q / max(1e-300, q.sum())
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum(-1)
    return np.sqrt(np.clip((a + b) / 2, 0, 1))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON,
               held: int = HELD) -> dict[str, tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Language -> (common words, their counts and the count of all others, class
    counts), over all texts in one pass.  ``common`` + 10 numbers a language reach
    the driver, whatever the number of texts."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.coalesce(quoted(lang_col).cast("string"), F.lit("")).alias("lang"),
                      utf8(quoted(text_col)).alias("t"))

    def rows(kind: str, langs: list[str], words: list[bytes], counts: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(kind, pa.string()), len(langs)), pa.array(langs, pa.string()), pa.array(words, pa.binary()),
             pa.array(counts, pa.int64())], names=["kind", "lang", "word", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        sums: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            yield rows("word", [lang for lang, c in words.items() for _ in range(len(c))],
                       [w for c in words.values() for w in c], [n for c in words.values() for n in c.values()])
            yield rows("sum", [k[0] for k in sums], [k[1] for k in sums], list(sums.values()))
            words.clear()
            sums.clear()

        for b in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts.setdefault(lang, []).append(t)
            for lang, own in texts.items():
                c = words.setdefault(lang, Counter())
                for t in own:
                    w = t.split()
                    c.update(w)
                    sums[lang, b""] += len(w)
                for i, v in enumerate(class_counts(sum(byte_counts(t) for t in own)).tolist()):
                    sums[lang, b"%d" % i] += int(v)
            if sum(map(len, words.values())) + len(sums) > held:
                yield from out()
        yield from out()

    sums = (src.mapInArrow(tally, "kind string, lang string, word binary, n bigint")
               .groupBy("kind", "lang", "word").agg(F.sum("n").alias("n")))
    # row_number below a bound: Spark keeps the first rows of every partition before the exchange by language
    top = Window.partitionBy("kind", "lang").orderBy(F.desc("n"), "word")
    picked = sums.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= max(common, 10))
    got: dict[str, dict[str, dict[bytes, int]]] = {}
    for b in picked.select("kind", "lang", "word", "n").toArrow().to_batches():
        for kind, lang, word, n in zip(*(x.to_pylist() for x in b.columns)):
            got.setdefault(lang, {"word": {}, "sum": {}})[kind][word] = n
    out = {}
    for lang, c in sorted(got.items()):
        total = c["sum"].get(b"", 0)
        best = sorted(c["word"].items(), key=lambda x: (-x[1], x[0]))[:common]
        if total:
            out[lang] = ([w for w, _ in best], np.array([*[n for _, n in best], total - sum(n for _, n in best)], float),
                         np.array([c["sum"].get(b"%d" % i, 0) for i in range(9)], float))
    return out


FIELDS = T.StructType([T.StructField(n, T.LongType()) for n in
                       ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                      + [T.StructField("base_failed", T.BooleanType()), T.StructField("language", T.StringType()),
                         T.StructField("js_words", T.DoubleType()), T.StructField("js_chars", T.DoubleType()),
                         T.StructField("kept", T.BooleanType())])


def judged(docs: DataFrame, refs: dict, text_col: str = "text", result: str = "rules", max_words_distance: float = 0.17,
           max_chars_distance: float = 0.15, min_words: int = 50, carry_text: bool = True) -> DataFrame:
    """``docs`` with the struct column ``result``: the counts, the language that
    fits best, both distances and the verdict.

    The limits hold for long texts; a text of n words gets 0.6 (words) and 0.3
    (characters) of ``sqrt(bins / (8 ln 2 n))`` on top.
    """
    langs = list(refs)
    context = docs.sparkSession.sparkContext
    parts = [context.broadcast([(lang, *refs[lang]) for lang in langs[k:k + AT_ONCE]]) for k in range(0, len(langs), AT_ONCE)]

    def make():
        def work(texts):
            got = [base_counts(t) for t in texts.to_pylist()]
            n = np.array([g[0]["n_words"] for g in got], float)
            failed = [base_failed(g[0]) for g in got]
            classes = np.array([np.bincount(_CLASS_OF, weights=g[1], minlength=10)[:9] for g in got]).reshape(-1, 9)
            best: list[str | None] = [None] * len(got)
            jw, jc = np.full(len(got), np.inf), np.full(len(got), np.inf)
            for part in parts:
                for lang, words, ref, ref_classes in part.value:
                    p = np.array([[c[i] if (i := ids.get(w)) is not None else 0 for w in words] for _, _, ids, c in got],
                                 float).reshape(len(got), len(words))
                    d = js_distance(np.column_stack([p, n - p.sum(1)]), ref)
                    nearer = (n > 0) & (d < jw)
                    for k in np.flatnonzero(nearer).tolist():
                        best[k] = lang
                    jw[nearer] = d[nearer]
                    jc[nearer] = js_distance(classes[nearer], ref_classes)
                if len(parts) > 1:
                    vars(part).pop("_value", None)  # read again for the next batch: one part in memory at a time
            noise = np.sqrt(COMMON / (8 * math.log(2) * np.maximum(n, 1)))
            ok = (n >= min_words) & (jw <= max_words_distance + 0.6 * noise) & (jc <= max_chars_distance + 0.3 * noise)
            if not langs:
                ok = n >= min_words
            out = {f: [g[0][f] for g in got] for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            known = [x is not None for x in best]
            return out | {"base_failed": failed, "language": best,
                          "js_words": [float(x) if y else None for x, y in zip(jw, known)],
                          "js_chars": [float(x) if y else None for x, y in zip(jc, known)],
                          "kept": [bool(o and not f) for o, f in zip(ok, failed)]}
        return work

    return map_texts(docs, text_col, result, FIELDS, make, carry_text)
