"""Spelling variants: words of a corpus that are one edit apart, grouped under their common form.

The words (runs of letters, counted over all texts) form a trie kept as a table of
edges ``(parent, ch, child)``, one row a prefix.  A search state is
``(word, position, node, edits)``: the word has been read up to a position, the
trie up to a node.  Words that share the prefix read so far move as one state, so
the word side of a state is a trie node too (``x``), the other side is ``y``:

* with no edit used both sides are the same node, so these states need no walk:
  they are the inner nodes of the trie;
* the edit turns a node ``v`` into ``(v.a, v.b)`` for two of its edges (one code
  point replaced) or ``(v.a, v)`` (one code point more on the left).  A run of equal
  letters gives its last one, so a pair of words is reached by one edit only;
* after the edit a state moves along equal edges of both sides, one level a
  round, by two joins with the edge table.

A state ends where both sides are words: these are neighbours.  A state with one
word left on a side names the only word that can match it, which is looked up in
the word table.  Every node carries a 128-bit signature of the endings below it;
states whose signatures share no bit have no ending in common and go.  The
signature only saves work: endings that agree always share their bit.

Defined cases: a null text has no words; a null id is written ``null`` where a word
is thinned; equal documents count each; no words give no rows; a word without a
neighbour has a null ``form``, itself as ``root`` and ``n_near`` 0.  Extra columns of
the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import bound_batches, quoted, utf8, written

#: Letters of a word, after lower-casing A-Z.
LETTERS = "[a-zÀ-ÿ]"

#: Distinct words a task holds before it hands on their counts.
HELD_WORDS = 1 << 18

#: Texts over so many code points are searched match by match instead of at once (same words).
LONG_TEXT = 1 << 22

#: Levels of the trie made at a time.  Only words that still share their prefix go on.
TRIE_LEVELS = 32

#: Doublings that settle any chain of forms: each form has ``ratio`` times the count, so a
#: chain is shorter than log2(2**63) and 2**6 steps are more.
DOUBLINGS = 6


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                min_count: int = 5, thin_every: int | None = None) -> DataFrame:
    """``(word, n)``: distinct words of at least ``min_length`` code points with ``n >= min_count``.

    ``thin_every``: a run whose crc32 with its document's id is a multiple of it loses the
    code point at crc32 modulo its length (misspellings planted by rule); counts follow.
    Counts are summed in each task first, then by word.
    """
    bound_batches(docs.sparkSession)
    src = docs.select(F.coalesce(quoted(id_col).cast("string"), F.lit("null")).alias("id"), utf8(quoted(text_col)).alias("text"))
    held_words, long_text = HELD_WORDS, LONG_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(LETTERS + "{%d,}" % min_length)
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = data.lower().decode()
                runs = find.findall(text) if len(text) < long_text else (m[0] for m in find.finditer(text))
                if thin_every is None:
                    held.update(runs)
                else:
                    head = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(runs).items():
                        h = zlib.crc32(word.encode(), head)
                        if h % thin_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1:]
                            if len(word) < min_length:
                                continue
                        held[word] += n
                if len(held) >= held_words:
                    yield flush()
        if held:
            yield flush()

    partial = src.mapInArrow(run, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# --- the trie ---------------------------------------------------------------------

_NODE = ("id", "parent", "ch", "depth", "cnt", "word", "lo", "hi")


def _nodes(words: DataFrame, first: int, last: int) -> DataFrame:
    """Prefixes of ``first`` to ``last`` code points: how many words have them, the smallest
    of these, and the signature of what follows."""
    at = F.sequence(F.lit(first), F.least(F.lit(last), F.char_length("word")))
    rows = words.select("word", F.explode(at).alias("depth"))
    ending = "xxhash64(substring(word, depth + 1))"
    one = F.expr(f"shiftleft(1L, cast(pmod({ending}, 64) as int))")
    high = F.expr(f"shiftrightunsigned({ending}, 32) % 2 = 1")
    rows = rows.select(F.expr("md5(cast(substring(word, 1, depth) as binary))").alias("id"),
                       F.expr("if(depth = 0, null, md5(cast(substring(word, 1, depth - 1) as binary)))").alias("parent"),
                       F.expr("if(depth = 0, null, substring(word, depth, 1))").alias("ch"), "depth", "word",
                       F.when(high, F.lit(0).cast("bigint")).otherwise(one).alias("lo"),
                       F.when(high, one).otherwise(F.lit(0).cast("bigint")).alias("hi"))
    return rows.groupBy("id", "parent", "ch", "depth").agg(
        F.count(F.lit(1)).alias("cnt"), F.min("word").alias("word"), F.bit_or("lo").alias("lo"), F.bit_or("hi").alias("hi"),
    ).select(*_NODE)


def trie(words: DataFrame) -> DataFrame:
    """All prefixes that two or more words share, and the prefixes one code point longer."""
    longest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    parts, first, active = [], 0, words.select("word")
    while True:
        last = first + TRIE_LEVELS
        part = written(_nodes(active, first, last), "trie")
        parts.append(part if first == 0 else part.filter(F.col("depth") > first))
        if last >= longest:
            break
        shared = part.filter((F.col("depth") == last) & (F.col("cnt") > 1)).select("id")
        key = F.md5(F.expr(f"cast(substring(word, 1, {last}) as binary)"))
        active = written(active.filter(F.char_length("word") > last).withColumn("id", key)
                         .join(shared, "id", "left_semi").select("word"), "trie-words")
        if active.isEmpty():
            break
        first = last
    return reduce(DataFrame.unionByName, parts)


# --- the frontier -----------------------------------------------------------------

_SIDE = ("id", "depth", "cnt", "word", "lo", "hi")


def _side(df: DataFrame, side: str, *more: Column) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in _SIDE], *more)


def _met(states: DataFrame) -> DataFrame:
    """States whose sides have an ending in common, as far as signatures tell."""
    both = F.col("x_lo").bitwiseAND(F.col("y_lo")).bitwiseOR(F.col("x_hi").bitwiseAND(F.col("y_hi")))
    return states.filter(both != 0)


def _many() -> Column:
    return (F.col("x_cnt") > 1) & (F.col("y_cnt") > 1)


def neighbours(words: DataFrame) -> DataFrame:
    """``(a, b)``: every two of ``words`` (column ``word``, distinct) that differ by one
    inserted, deleted or replaced code point, once."""
    nodes = trie(words)
    inner = nodes.filter(F.col("cnt") > 1)
    edges = written(nodes.join(inner.select(F.col("id").alias("parent")), "parent", "left_semi").select(*_NODE), "edges")
    left = _side(edges, "x", F.col("parent").alias("x_parent"), F.col("ch").alias("x_ch"))
    right = _side(edges, "y", F.col("parent").alias("y_parent"), F.col("ch").alias("y_ch"))

    replaced = left.join(right, (F.col("x_parent") == F.col("y_parent")) & (F.col("x_ch") < F.col("y_ch")))
    replaced = replaced.drop("x_parent", "y_parent", "x_ch", "y_ch").withColumn("extra", F.lit(None).cast("string"))
    longer = left.join(_side(inner, "y"), F.col("x_parent") == F.col("y_id")).withColumnRenamed("x_ch", "extra").drop("x_parent")
    now = written(_met(replaced.unionByName(longer)), "frontier")
    levels = [now]
    while True:
        going = now.filter(_many()).select("x_id", "y_id", "extra")
        if going.isEmpty():
            break
        step = going.join(left.withColumnRenamed("x_id", "x_to"), F.col("x_id") == F.col("x_parent")).drop("x_id")
        step = step.filter(F.col("extra").isNull() | (F.col("extra") != F.col("x_ch")))
        step = step.join(right.withColumnRenamed("y_id", "y_to"),
                         (F.col("y_id") == F.col("y_parent")) & (F.col("x_ch") == F.col("y_ch"))).drop("y_id")
        step = step.withColumnsRenamed({"x_to": "x_id", "y_to": "y_id"}).withColumn("extra", F.lit(None).cast("string"))
        now = written(_met(step.select(*levels[0].columns)), "frontier")
        levels.append(now)

    states = reduce(DataFrame.unionByName, levels)
    ended = states.filter(_many() & F.expr("char_length(x_word) = x_depth and char_length(y_word) = y_depth"))
    ended = ended.select(F.col("x_word").alias("a"), F.col("y_word").alias("b"))
    last = states.filter(~_many())
    alone = F.col("x_cnt") == 1
    rest = F.when(alone, F.expr("substring(x_word, x_depth + 1)")).otherwise(F.expr("substring(y_word, y_depth + 1)"))
    head = F.when(alone, F.expr("substring(y_word, 1, y_depth)")).otherwise(F.expr("substring(x_word, 1, x_depth)"))
    asked = last.filter(F.col("extra").isNull() | (F.col("extra") != F.substring(rest, 1, 1)))
    asked = asked.select(F.when(alone, F.col("x_word")).otherwise(F.col("y_word")).alias("a"), F.concat(head, rest).alias("b"))
    found = asked.join(words.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b")
    return ended.unionByName(found)


# --- forms ------------------------------------------------------------------------

def variants(words: DataFrame, pairs: DataFrame, ratio: int = 5) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words`` (word, n).

    The form of a word is its neighbour of largest count (ties: smallest in code-point
    order) if that has ``ratio`` times the word's count; the root is the last of its forms.
    """
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")), "b")
    best = near.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b"))).alias("best"))
    out = words.select("word", "n").join(best, "word", "left")
    has = -F.col("best.minus") >= F.lit(ratio) * F.col("n")
    out = written(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                             F.when(has, F.col("best.b")).alias("form"),
                             F.when(has, -F.col("best.minus")).alias("form_n")), "forms")
    roots = out.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                   F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    out = out.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
