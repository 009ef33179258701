"""Request building, batch planning and result collection (J16-J20, G7, G8,
E6, F10-F13).

Requests are rows: ids come from a bucketed global ordinal (no single-task
window), batches from a blockwise next-fit over ``(ordinal, size)`` only, results
are joined back on ``(batch_id, custom_id)`` and reassembled per domain with a
bounded ``collect_list`` (the parts of one document).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import requests as RQ
from sitelens.functions.text import is_blank, trim_ws
from sitelens.operators.ordering import global_ordinal, key_running_total
from sitelens.sources.tables import landed


def translate_requests(work: DataFrame, model: str = RQ.TRANSLATE_DEFAULT_MODEL,
                       chunk_chars: int = RQ.CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """J16 (+ D8, J8, J10, G7): one request per chunk of each non-blank text.

    ``work`` has ``seq, domain, text`` (and optionally ``source_path``).
    Returns ``(requests, skipped)``; skipped rows carry ``error='empty_source'``.
    ``custom_id`` is ``r<n>`` numbered over (work order, part), real requests only.
    """
    skipped = work.filter(is_blank("text")).select("seq", "domain", F.lit("empty_source").alias("error"))
    real = work.filter(~is_blank("text"))
    ch = RQ.chunked(real.select("seq", "domain", "text"), "text", chunk_chars)
    parts = ch.select("seq", "domain", F.size("chunks").alias("n_parts"),
                      F.posexplode("chunks").alias("part", "chunk"))
    # chunk text stays where it is: numbers come from (seq, parts) of each text and join back on seq
    first = key_running_total(real.select("seq", F.size(RQ.chunk_array("text", chunk_chars)).cast("bigint").alias("_n")), "seq", "_n", "_first")
    parts = parts.join(first.select("seq", "_first"), "seq").withColumn("ordinal", F.col("_first") + F.col("part"))
    n_sys = len(RQ.TRANSLATE_SYSTEM_PROMPT)
    req = parts.select(
        F.concat(F.lit("r"), F.col("ordinal").cast("string")).alias("custom_id"), "ordinal", "seq", "domain",
        F.col("part").cast("int").alias("part"), F.col("n_parts").cast("int").alias("n_parts"),
        F.lit(model).alias("model"), RQ.max_tokens_for_chars(F.length("chunk")).alias("max_tokens"),
        F.length("chunk").cast("bigint").alias("chars"), "chunk",
        RQ.request_params(F.lit(model), RQ.max_tokens_for_chars(F.length("chunk")), RQ.TRANSLATE_SYSTEM_PROMPT,
                          F.col("chunk")).alias("params"),
        (F.length("chunk") + F.lit(n_sys + RQ.TRANSLATE_OVERHEAD)).cast("bigint").alias("size"))
    return req, skipped


def classify_requests(work: DataFrame, model: str = RQ.CLASSIFY_DEFAULT_MODEL,
                      max_input_chars: int = RQ.MAX_INPUT_CHARS, think_budget: int = 0
                      ) -> tuple[DataFrame, DataFrame]:
    """J17 (+ D8, J7, J11, J14, G7): one request per domain with a non-blank
    source; input cut to ``max_input_chars``; ``custom_id`` = ``c<n>``."""
    skipped = work.filter(is_blank("text")).select("seq", "domain", F.lit("empty_source").alias("error"))
    real = work.filter(~is_blank("text"))
    # number a narrow (seq) projection: the shuffle moves ids only; the text joins back once
    ords = global_ordinal(real.select("seq"), ["seq"], "ordinal")
    real = real.join(ords, "seq")
    prompt = RQ.user_prompt(F.col("domain"), F.substring("text", 1, max_input_chars))
    m, b = F.lit(model), F.lit(think_budget)
    n_sys = len(RQ.CLASSIFY_SYSTEM_PROMPT)
    cols = [F.concat(F.lit("c"), F.col("ordinal").cast("string")).alias("custom_id"), "ordinal", "seq", "domain"]
    if "source" in work.columns:
        cols.append("source")
    req = real.select(*cols, m.alias("model"), RQ.verdict_max_tokens(m, b).alias("max_tokens"),
                      RQ.thinking_type(m, b).alias("thinking"), prompt.alias("prompt"))
    req = req.withColumn("params", RQ.request_params("model", "max_tokens", RQ.CLASSIFY_SYSTEM_PROMPT, "prompt",
                                                     RQ.verdict_output_config(), "thinking", RQ.thinking_budget(m, b)))
    req = req.withColumn("size", (F.length("prompt") + F.lit(n_sys + RQ.CLASSIFY_OVERHEAD)).cast("bigint"))
    return req, skipped


# ---- G8 next-fit batch planning --------------------------------------------------------

#: Ordinals that one task handles together (never fewer than a batch can hold).
BLOCK = 1 << 16


def _next_starts(sizes: np.ndarray, max_count: int, max_size: int) -> np.ndarray:
    """Where the next batch starts if one starts at each place (one request at
    least, ``max_count`` at most, no more than ``max_size`` together)."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(len(sizes))
    full = np.searchsorted(total, total[:-1] + max_size, side="right") - 1
    return np.minimum(np.maximum(full, at + 1), at + max_count)


def _starts_from(entry: int, end: int, following: np.ndarray) -> list[int]:
    starts = []
    while entry < end:
        starts.append(entry)
        entry = int(following[entry])
    return starts


def plan_batches(requests: DataFrame, max_count: int = RQ.MAX_PER_BATCH,
                 max_size: int = RQ.MAX_BYTES_PER_BATCH, block: int = BLOCK) -> DataFrame:
    """Next-fit grouping of requests in ``ordinal`` order (dense from 0).

    A new batch starts when the open one holds ``max_count`` requests or the
    next request would push its size over ``max_size`` (a single oversized
    request still gets its own batch): exactly the serial fold, at any size.
    Blocks of ordinals first tell, for each place where a batch may enter them,
    where it leaves; these passages are composed pairwise (2, 4, 8 ... blocks)
    until one is left, then real entries are handed back down the same pairs, and
    the blocks number their batches from there.  No task sees more than a block's
    requests or the passages of two blocks.  Only ``(ordinal, size)`` travel, each
    to its block and the first ``max_count`` of a block to the one before as well.
    Returns ``ordinal, batch_no, batch_id``.
    """
    width = max(block, max_count)
    r = requests.select(F.col("ordinal").cast("bigint").alias("ordinal"), F.col("size").cast("bigint").alias("size"))
    own = r.withColumn("block", F.floor(F.col("ordinal") / width).cast("bigint"))
    ahead = own.filter((F.col("ordinal") % width < max_count) & (F.col("block") > 0)).withColumn("block", F.col("block") - 1)
    rows = own.unionByName(ahead)

    def passages(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        block_no, first = int(pdf["block"].iloc[0]), int(pdf["ordinal"].iloc[0])
        sizes = pdf["size"].to_numpy(np.int64)
        end = min(width, len(sizes))
        leave = _next_starts(sizes, max_count, max_size)
        for i in range(end - 1, -1, -1):
            if leave[i] < end:
                leave[i] = leave[leave[i]]
        leave = leave[:min(end, max_count)]
        change = np.flatnonzero(np.append(True, leave[1:] != leave[:-1]))
        return pd.DataFrame({"block": block_no, "entry": first + change, "leave": first + leave[change]})

    last = r.agg(F.max("ordinal")).first()[0]
    entries = _entries(rows.groupBy("block").applyInPandas(passages, PASSAGE), 0 if last is None else last // width + 1)

    def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        first = int(pdf["ordinal"].iloc[0])
        sizes = pdf["size"].to_numpy(np.int64)
        following = _next_starts(sizes, max_count, max_size)
        end = min(width, len(sizes))
        starts = _starts_from(int(pdf["entry"].iloc[0]) - first, end, following)
        upto = int(following[starts[-1]])
        number = np.searchsorted(starts, np.arange(starts[0], upto), side="right") - 1
        return pd.DataFrame({"block": int(pdf["block"].iloc[0]), "ordinal": first + np.arange(starts[0], upto), "k": number})

    known = rows.join(entries, "block")
    parts = known.groupBy("block").applyInPandas(labelled, "block long, ordinal long, k long")
    per_block = parts.groupBy("block").agg((F.max("k") + 1).alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    offsets = per_block.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    out = parts.join(offsets, "block").select("ordinal", (F.col("before") + F.col("k")).cast("bigint").alias("batch_no"))
    return out.withColumn("batch_id", F.format_string("b%08d", "batch_no"))


#: Of every entry at ``entry`` or later (up to the next row's), where it leaves the block.
PASSAGE = "block long, entry long, leave long"


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The passage through two neighbouring blocks (or one, at the end) as one block of the next level."""
    pdf = pdf.sort_values(["block", "entry"])
    block = pdf["block"].to_numpy()
    entry, leave = pdf["entry"].to_numpy(), pdf["leave"].to_numpy()
    left, right = block % 2 == 0, block % 2 == 1
    if right.any():
        leave = leave[right][np.searchsorted(entry[right], leave[left], side="right") - 1]
        entry = entry[left]
    change = np.flatnonzero(np.append(True, leave[1:] != leave[:-1]))
    return pd.DataFrame({"block": int(block[0]) // 2, "entry": entry[change], "leave": leave[change]})


def _entries(passages: DataFrame, blocks: int) -> DataFrame:
    """``(block, entry)``: where the first batch that begins in each of ``blocks`` blocks begins."""
    spark = passages.sparkSession
    levels, sizes = [landed(passages, "passages")], [blocks]
    while sizes[-1] > 1:
        up = levels[-1].groupBy(F.floor(F.col("block") / 2)).applyInPandas(_composed, PASSAGE)
        levels.append(landed(up, "passages"))
        sizes.append((sizes[-1] + 1) // 2)
    entries = spark.range(1).select(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("entry"))
    for level, size in zip(reversed(levels[:-1]), reversed(sizes[:-1])):
        left = entries.select((F.col("block") * 2).alias("block"), F.col("entry").alias("at"))
        through = level.join(left, "block").filter(F.col("entry") <= F.col("at"))
        right = through.groupBy((F.col("block") + 1).alias("block")).agg(F.max_by("leave", "entry").alias("entry"))
        entries = landed(left.withColumnRenamed("at", "entry").unionByName(right.filter(F.col("block") < size)), "entries")
    return entries


# ---- E6 / J18 / F11 / J20 / F12 / F13 ------------------------------------------------------

def result_text(content) -> F.Column:
    """Concatenation of the text blocks of a result message."""
    c = F.col(content) if isinstance(content, str) else content
    return F.array_join(F.transform(F.filter(c, lambda b: b["type"] == "text"), lambda b: b["text"]), "")


def collect_join(requests: DataFrame, results: DataFrame, keys=("batch_id", "custom_id")) -> DataFrame:
    """Every request with its result (``missing`` when none arrived);
    results with unknown ids are dropped."""
    r = results.select(*keys, "result_type", "text")
    j = requests.join(r, list(keys), "left")
    return j.withColumn("result_type", F.coalesce("result_type", F.lit("missing")))


def reassemble(joined: DataFrame, domain: str = "domain_id", source_bytes: DataFrame | None = None) -> DataFrame:
    """F11 + J20: per domain over all its batches of the run (deviation q6):
    ok when no part errored and every part arrived; text = parts in order joined
    with newlines; chars_out = code points; chars_in = source bytes."""
    ok = F.col("result_type") == "succeeded"
    errored = ~F.col("result_type").isin("succeeded", "missing")
    g = joined.groupBy(domain).agg(
        F.max("n_parts").cast("int").alias("parts"),
        F.count_if(ok).alias("_got"),
        F.max(errored.cast("int")).alias("_err"),
        F.array_sort(F.collect_list(F.when(ok, F.struct("part", "text")))).alias("_p"))
    done = (F.col("_err") == 0) & (F.col("_got") == F.col("parts"))
    text = F.array_join(F.transform("_p", lambda x: x["text"]), "\n")
    out = g.select(domain, "parts", F.when(done, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
                   F.when(done, text).alias("translated"))
    out = out.withColumn("chars_out", F.length("translated").cast("bigint"))
    if source_bytes is not None:
        out = out.join(source_bytes, domain, "left").withColumn(
            "chars_in", F.when(F.col("status") == "ok", F.col("chars_in")))
    return out


def batch_status(joined: DataFrame) -> DataFrame:
    """per batch: requests, succeeded, errored (any other result), processing (none yet)."""
    rt = F.col("result_type")
    return joined.groupBy("batch_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("requests"),
        F.count_if(rt == "succeeded").cast("bigint").alias("succeeded"),
        F.count_if(~rt.isin("succeeded", "missing")).cast("bigint").alias("errored"),
        F.count_if(rt == "missing").cast("bigint").alias("processing"))


def _truthy(v: F.Column, path: str) -> F.Column:
    """A JSON value's truth: false for null, absent, ``false``, 0, and empty strings, lists and objects."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.try_variant_get(v, path, "string")
    true = (F.when(kind == "BOOLEAN", F.try_variant_get(v, path, "boolean"))
            .when(kind == "STRING", text != "").when(kind.startswith("ARRAY"), text != "[]")
            .when(kind.startswith("OBJECT"), text != "{}").otherwise(F.try_variant_get(v, path, "double") != 0))
    return F.coalesce(true, F.lit(False))


def parse_verdicts(feed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Succeeded + valid JSON -> ok with innovative (truthiness), confidence
    (null when absent), rationale (newlines to spaces, trimmed, '' when absent);
    invalid JSON -> ``parse_error``; not succeeded -> ``error``."""
    v = F.try_parse_json(F.col("body"))
    succeeded = F.col("result_type") == "succeeded"
    status = F.when(~succeeded, F.lit("error")).when(v.isNull(), F.lit("parse_error")).otherwise(F.lit("ok"))
    ok = status == "ok"
    innov = _truthy(v, "$.innovative")
    conf = F.try_variant_get(v, "$.confidence", "double")
    rat = trim_ws(F.replace(F.coalesce(F.try_variant_get(v, "$.rationale", "string"), F.lit("")),
                            F.lit("\n"), F.lit(" ")))
    return feed.select(key, status.alias("status"), F.when(ok, innov).alias("innovative"),
                       F.when(ok, conf).alias("confidence"), F.when(ok, rat).alias("rationale"))


def dry_run(requests: DataFrame, skipped: DataFrame, prices: DataFrame, model: str,
            default_price: tuple[float, float], output: str = "same", think_budget: int = 0) -> DataFrame:
    """F10 + E10: requests, distinct domains, skipped, characters, ~tokens
    (chars/4) and the cost at full and batch price.  ``output='same'`` (translation:
    output tokens = input tokens) or ``'verdict'`` (120 per request plus the
    thinking budget)."""
    chars_col = "chars" if "chars" in requests.columns else "prompt_chars"
    agg = requests.agg(F.count(F.lit(1)).cast("bigint").alias("requests"),
                       F.countDistinct("domain").cast("bigint").alias("domains"),
                       F.coalesce(F.sum(chars_col), F.lit(0)).cast("bigint").alias("chars"))
    agg = agg.withColumn("skipped", skipped.select(F.count(F.lit(1)).cast("bigint")).scalar())
    agg = agg.withColumn("in_tokens", F.col("chars") / F.lit(4.0))
    if output == "same":
        agg = agg.withColumn("out_tokens", F.col("in_tokens"))
    else:
        each = RQ.VERDICT_OUTPUT_TOKENS + (max(1024, think_budget) if think_budget > 0 else 0)
        agg = agg.withColumn("out_tokens", (F.col("requests") * F.lit(each)).cast("double"))
    p = F.broadcast(prices.filter(F.col("model") == model))
    agg = agg.withColumn("model", F.lit(model)).join(p, "model", "left")
    pin = F.coalesce("price_in", F.lit(default_price[0]))
    pout = F.coalesce("price_out", F.lit(default_price[1]))
    full = F.col("in_tokens") / 1e6 * pin + F.col("out_tokens") / 1e6 * pout
    return agg.select("model", "requests", "domains", "skipped", "chars",
                      F.round("in_tokens", 6).alias("in_tokens"), F.round("out_tokens", 6).alias("out_tokens"),
                      F.round(full, 6).alias("cost_full"), F.round(full * RQ.BATCH_DISCOUNT, 6).alias("cost_batched"))
