"""Query keys for request building, batching and collection (SURVEY §2.6 F10-F13,
§2.7 G7/G8, §2.10 J7-J20, §2.1 A6/A7, §2.5 E6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import requests as RQ
from sitelens.operators import batches as B
from sitelens.plans import oracle as O
from sitelens.plans.catalog import query
from sitelens.plans.resume_queries import OK_CTE, OK_VIEWS, PREF_CTE, classify_work, translate_work
from sitelens.session import shared_path
from sitelens.sources import files as FS
from sitelens.sources import fixtures as FX
from sitelens.sources.tables import table

PLAN_MAX_COUNT = 100
PLAN_MAX_BYTES = 1 * 1024 * 1024

PROMPT_SQL = (f"concat({O.q(RQ.USER_TEMPLATE_HEAD)}, domain, {O.q(RQ.USER_TEMPLATE_MID)}, "
              f"substring(text, 1, {RQ.MAX_INPUT_CHARS}), {O.q(RQ.USER_TEMPLATE_TAIL)})")

REQ_CTE = PREF_CTE + f""",
realw AS (SELECT * FROM pref WHERE NOT {O.is_blank('text')}),
req AS (SELECT concat('c', CAST(row_number() OVER (ORDER BY seq) - 1 AS VARCHAR)) AS custom_id, domain, source, seq,
  {PROMPT_SQL} AS prompt FROM realw)"""


def _classify(spark, sf_dir):
    return B.classify_requests(classify_work(spark, sf_dir))


@query("build_classify_requests", O.with_views(f"""
SELECT custom_id, domain, source, {O.q(RQ.CLASSIFY_DEFAULT_MODEL)} AS model, 1024 AS max_tokens,
  CAST(NULL AS VARCHAR) AS thinking, CAST(length(prompt) AS BIGINT) AS prompt_chars, md5(prompt) AS prompt_md5
FROM req""", *OK_VIEWS, extra=REQ_CTE))
def q_build_classify_requests(spark, sf_dir):
    req, _ = _classify(spark, sf_dir)
    return req.select("custom_id", "domain", "source", "model", "max_tokens", "thinking",
                      F.length("prompt").cast("bigint").alias("prompt_chars"), F.md5("prompt").alias("prompt_md5"))


@query("classify_request_params", O.with_views(f"""
SELECT custom_id, CAST(length(body) AS BIGINT) AS params_chars, md5(body) AS params_md5 FROM (
  SELECT custom_id, replace(CAST(to_json({{'model': {O.q(RQ.CLASSIFY_DEFAULT_MODEL)}, 'max_tokens': 1024,
    'system': {O.q(RQ.CLASSIFY_SYSTEM_PROMPT)}, 'messages': [{{'role': 'user', 'content': prompt}}], 'end': 0}}) AS VARCHAR),
    ',"end":0}}', concat(',"output_config":', {O.q(RQ.verdict_output_config())}, '}}')) AS body FROM req)""",
                                               *OK_VIEWS, extra=REQ_CTE))
def q_classify_request_params(spark, sf_dir):
    """The request bodies as they are submitted."""
    req, _ = _classify(spark, sf_dir)
    return req.select("custom_id", F.length("params").cast("bigint").alias("params_chars"), F.md5("params").alias("params_md5"))


@query("request_ids", O.with_views("SELECT custom_id, domain FROM req", *OK_VIEWS, extra=REQ_CTE))
def q_request_ids(spark, sf_dir):
    req, _ = _classify(spark, sf_dir)
    return req.select("custom_id", "domain")


@query("dry_run_classify", O.with_views(f"""
SELECT {O.q(RQ.CLASSIFY_DEFAULT_MODEL)} AS model, count(*) AS requests, count(DISTINCT domain) AS domains,
  (SELECT count(*) FROM pref WHERE {O.is_blank('text')}) AS skipped, CAST(sum(length(prompt)) AS BIGINT) AS chars,
  round(sum(length(prompt)) / 4.0, 6) AS in_tokens, round(count(*) * {RQ.VERDICT_OUTPUT_TOKENS}.0, 6) AS out_tokens,
  round(sum(length(prompt)) / 4.0 / 1e6 * 1.0 + count(*) * {RQ.VERDICT_OUTPUT_TOKENS}.0 / 1e6 * 5.0, 6) AS cost_full,
  round((sum(length(prompt)) / 4.0 / 1e6 * 1.0 + count(*) * {RQ.VERDICT_OUTPUT_TOKENS}.0 / 1e6 * 5.0) * 0.5, 6) AS cost_batched
FROM req""", *OK_VIEWS, extra=REQ_CTE))
def q_dry_run_classify(spark, sf_dir):
    req, skipped = _classify(spark, sf_dir)
    req = req.withColumn("prompt_chars", F.length("prompt"))
    return B.dry_run(req, skipped, RQ.price_table(spark), RQ.CLASSIFY_DEFAULT_MODEL, RQ.CLASSIFY_DEFAULT_PRICE,
                     output="verdict")


@query("max_tokens", """SELECT doc_id, CAST(length(text) AS BIGINT) AS chars,
  CAST(least(16384, greatest(1024, floor(length(text) * 0.5))) AS INTEGER) AS max_tokens FROM documents""")
def q_max_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    return d.select("doc_id", "chars", RQ.max_tokens_for_chars("chars").alias("max_tokens"))


MODELS = (RQ.CLASSIFY_DEFAULT_MODEL, "claude-sonnet-4-6", "claude-3-haiku")


@query("request_limits", f"""
WITH runs AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN {O.q(MODELS[0])} WHEN 1 THEN {O.q(MODELS[1])}
    ELSE {O.q(MODELS[2])} END AS model, CAST((doc_id % 4) * 500 AS INTEGER) AS budget FROM labels)
SELECT doc_id, model, budget,
  CASE WHEN budget <= 0 THEN NULL WHEN {" OR ".join(f"contains(model, {O.q(t)})" for t in RQ.ADAPTIVE_THINKING_TAGS)}
       THEN 'adaptive' ELSE 'enabled' END AS thinking,
  CAST(CASE WHEN budget > 0 AND NOT ({" OR ".join(f"contains(model, {O.q(t)})" for t in RQ.ADAPTIVE_THINKING_TAGS)})
       THEN greatest(1024, budget) END AS INTEGER) AS budget_tokens,
  CAST(CASE WHEN budget <= 0 THEN 1024 WHEN {" OR ".join(f"contains(model, {O.q(t)})" for t in RQ.ADAPTIVE_THINKING_TAGS)}
       THEN 4096 ELSE greatest(1024, budget) + 1024 END AS INTEGER) AS max_tokens
FROM runs""")
def q_request_limits(spark, sf_dir):
    """J11 over per-request (model, budget) settings derived from ``labels``."""
    l = table(spark, sf_dir, "labels").select("doc_id")
    i = F.col("doc_id")
    model = F.when(i % 3 == 0, F.lit(MODELS[0])).when(i % 3 == 1, F.lit(MODELS[1])).otherwise(F.lit(MODELS[2]))
    runs = l.select("doc_id", model.alias("model"), ((i % 4) * 500).cast("int").alias("budget"))
    return runs.select("doc_id", "model", "budget", RQ.thinking_type("model", "budget").alias("thinking"),
                       RQ.thinking_budget("model", "budget").alias("budget_tokens"),
                       RQ.verdict_max_tokens("model", "budget").alias("max_tokens"))


# ---- translation requests ----------------------------------------------------------------

def _translate(spark, sf_dir):
    return B.translate_requests(translate_work(spark, sf_dir))


CHUNK_CTE = OK_CTE + f""",
work AS (SELECT o.domain, o.seq, t.text FROM okd o JOIN scrape_text t ON t.domain = o.domain
  WHERE o.domain NOT IN (SELECT domain FROM done_t) AND o.domain NOT IN (SELECT domain FROM flying)),
lines AS (SELECT seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM work),
cuts AS (SELECT seq, no, k, substring(line, k * {RQ.CHUNK_CHARS} + 1, {RQ.CHUNK_CHARS}) AS piece,
    k < (greatest(length(line), 1) - 1) // {RQ.CHUNK_CHARS} AS alone
  FROM lines, LATERAL (SELECT unnest(range(0, (greatest(length(line), 1) - 1) // {RQ.CHUNK_CHARS} + 1)) AS k)),
pieces AS MATERIALIZED (SELECT seq, piece, alone, length(piece) AS n, row_number() OVER (PARTITION BY seq ORDER BY no, k) AS i FROM cuts),
placed AS (SELECT * FROM (WITH RECURSIVE fold AS (
  SELECT seq, i, 0 AS chunk, CASE WHEN alone THEN NULL ELSE n END AS held FROM pieces WHERE i = 1
  UNION ALL SELECT p.seq, p.i,
    CASE WHEN NOT p.alone AND f.held + 1 + p.n <= {RQ.CHUNK_CHARS} THEN f.chunk ELSE f.chunk + 1 END,
    CASE WHEN p.alone THEN NULL WHEN f.held + 1 + p.n <= {RQ.CHUNK_CHARS} THEN f.held + 1 + p.n ELSE p.n END
  FROM fold f JOIN pieces p ON p.seq = f.seq AND p.i = f.i + 1) SELECT * FROM fold)),
chunks AS (SELECT w.domain, w.seq, CAST(q.chunk AS INTEGER) AS part, string_agg(p.piece, chr(10) ORDER BY p.i) AS chunk,
    CAST(max(q.chunk) OVER (PARTITION BY w.seq) + 1 AS INTEGER) AS n_parts
  FROM placed q JOIN pieces p USING (seq, i) JOIN work w USING (seq) GROUP BY w.domain, w.seq, q.chunk),
treq AS (SELECT *, length(chunk) AS chars, row_number() OVER (ORDER BY seq, part) - 1 AS no FROM chunks
  WHERE seq NOT IN (SELECT seq FROM work WHERE {O.is_blank('text')}))"""


@query("chunk_texts", O.with_views("SELECT domain, part, n_parts, CAST(length(chunk) AS BIGINT) AS chars, md5(chunk) AS chunk_md5 FROM chunks",
                                   *OK_VIEWS, extra=CHUNK_CTE))
def q_chunk_texts(spark, sf_dir):
    w = translate_work(spark, sf_dir)
    ch = RQ.chunked(w.select("domain", "seq", "text"))
    return ch.select("domain", F.size("chunks").alias("n_parts"), F.posexplode("chunks").alias("part", "chunk")) \
             .select("domain", "part", "n_parts", F.length("chunk").cast("bigint").alias("chars"), F.md5("chunk").alias("chunk_md5"))


@query("build_translate_requests", O.with_views(f"""
SELECT concat('r', CAST(no AS VARCHAR)) AS custom_id, domain, part, n_parts, {O.q(RQ.TRANSLATE_DEFAULT_MODEL)} AS model,
  CAST(least(16384, greatest(1024, floor(chars * 0.5))) AS INTEGER) AS max_tokens, CAST(chars AS BIGINT) AS chars FROM treq""",
                                                *OK_VIEWS, extra=CHUNK_CTE))
def q_build_translate_requests(spark, sf_dir):
    req, _ = _translate(spark, sf_dir)
    return req.select("custom_id", "domain", "part", "n_parts", "model", "max_tokens", "chars")


@query("dry_run_translate", O.with_views(f"""
SELECT {O.q(RQ.TRANSLATE_DEFAULT_MODEL)} AS model, count(*) AS requests, count(DISTINCT domain) AS domains,
  (SELECT count(*) FROM work WHERE {O.is_blank('text')}) AS skipped, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars,
  round(sum(chars) / 4.0, 6) AS in_tokens, round(sum(chars) / 4.0, 6) AS out_tokens,
  round(sum(chars) / 4.0 / 1e6 * 30.0, 6) AS cost_full, round(sum(chars) / 4.0 / 1e6 * 30.0 * 0.5, 6) AS cost_batched
FROM treq""", *OK_VIEWS, extra=CHUNK_CTE))
def q_dry_run_translate(spark, sf_dir):
    req, skipped = _translate(spark, sf_dir)
    return B.dry_run(req, skipped, RQ.price_table(spark), RQ.TRANSLATE_DEFAULT_MODEL, RQ.TRANSLATE_DEFAULT_PRICE)


@query("batch_plan", O.with_views(f"""
SELECT q.custom_id, q.ordinal, q.size, printf('b%08d', f.batch) AS batch_id FROM sized q JOIN f USING (ordinal)""",
                                  *OK_VIEWS, extra=REQ_CTE + f""",
sized AS MATERIALIZED (SELECT custom_id, row_number() OVER (ORDER BY seq) - 1 AS ordinal,
  CAST(length(prompt) + {len(RQ.CLASSIFY_SYSTEM_PROMPT)} + {RQ.CLASSIFY_OVERHEAD} AS BIGINT) AS size FROM req),
f AS (SELECT * FROM (WITH RECURSIVE fold AS (
  SELECT 0::BIGINT AS ordinal, 0::BIGINT AS batch, 1::BIGINT AS n, size AS total FROM sized WHERE ordinal = 0
  UNION ALL SELECT s.ordinal,
    CASE WHEN f.n >= {PLAN_MAX_COUNT} OR f.total + s.size > {PLAN_MAX_BYTES} THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.n >= {PLAN_MAX_COUNT} OR f.total + s.size > {PLAN_MAX_BYTES} THEN 1 ELSE f.n + 1 END,
    CASE WHEN f.n >= {PLAN_MAX_COUNT} OR f.total + s.size > {PLAN_MAX_BYTES} THEN s.size ELSE f.total + s.size END
  FROM fold f JOIN sized s ON s.ordinal = f.ordinal + 1) SELECT * FROM fold))"""))
def q_batch_plan(spark, sf_dir):
    req, _ = _classify(spark, sf_dir)
    plan = B.plan_batches(req, PLAN_MAX_COUNT, PLAN_MAX_BYTES)
    return req.select("ordinal", "custom_id", "size").join(plan, "ordinal").select(
        "custom_id", "ordinal", "size", "batch_id")


@query("batch_requests", O.with_views("SELECT custom_id, domain, 'submitted' AS status FROM req",
                                      *OK_VIEWS, extra=REQ_CTE))
def q_batch_requests(spark, sf_dir):
    """B7 -> A6 round trip: one manifest per planned batch (its entries nested,
    bounded by the batch limits), written as JSON, scanned back and exploded."""
    req, _ = _classify(spark, sf_dir)
    plan = B.plan_batches(req, PLAN_MAX_COUNT, PLAN_MAX_BYTES)
    entries = req.join(plan, "ordinal").select(
        "batch_id", "ordinal", F.struct("custom_id", "domain", F.lit(None).cast("int").alias("part"),
                                        F.lit(None).cast("int").alias("n_parts"),
                                        F.concat("domain", F.lit(".txt")).alias("source_path")).alias("e"))
    manifests = entries.groupBy("batch_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "e"))), lambda x: x["e"]).alias("requests"))
    manifests = manifests.select("batch_id", F.lit("1970-01-01T00:00:00").alias("created"),
                                 F.lit("submitted").alias("status"), "requests")
    path = shared_path(spark, "batch-manifests")
    manifests.write.mode("overwrite").json(path)
    return FS.explode_requests(FS.read_batch_manifests(spark, path)).select("custom_id", "domain", "status")


# ---- results: A7 / J18 / E6 / F11 / J20 / F12 / F13 / J19 ------------------------------

def _content(df):
    """Result message blocks: a thinking block and the text split in two text blocks."""
    t = F.col("text")
    return F.array(F.struct(F.lit("thinking").alias("type"), F.lit("...").alias("text")),
                   F.struct(F.lit("text").alias("type"), F.substring(t, 1, 10).alias("text")),
                   F.struct(F.lit("text").alias("type"), F.expr("substring(text, 11)").alias("text")))


@query("result_text", O.with_views(
    "SELECT custom_id, concat(substring(text, 1, 10), substring(text, 11)) AS text FROM batch_results",
    "batch_results"))
def q_result_text(spark, sf_dir):
    r = FX.batch_results(spark, sf_dir).withColumn("content", _content(None))
    return r.select("custom_id", B.result_text("content").alias("text"))


@query("batch_results", O.with_views("""
SELECT CAST(batch_id AS VARCHAR) AS batch_id, custom_id, result_type, text FROM batch_results""", "batch_results"))
def q_batch_results(spark, sf_dir):
    """The result feed landed as JSON lines, scanned back with a schema."""
    r = FX.batch_results(spark, sf_dir)
    feed = r.select(F.col("batch_id").cast("string").alias("batch_id"), "custom_id", "result_type",
                    _content(None).alias("content"))
    path = shared_path(spark, "batch-results")
    feed.write.mode("overwrite").json(path)
    back = FS.read_batch_results(spark, path)
    return back.select("batch_id", "custom_id", "result_type", B.result_text("content").alias("text"))


JOIN_CTE = """j AS (SELECT q.batch_id, q.custom_id, q.domain_id, q.part, q.n_parts, coalesce(r.result_type, 'missing') AS result_type, r.text
  FROM batch_requests_log q LEFT JOIN batch_results r ON r.batch_id = q.batch_id AND r.custom_id = q.custom_id),
src AS (SELECT conv_id AS domain_id, CAST(sum(strlen(text)) + count(*) - 1 AS BIGINT) AS chars_in FROM conversations GROUP BY conv_id),
asm AS (SELECT domain_id, CAST(max(n_parts) AS INTEGER) AS parts,
  CASE WHEN max(CASE WHEN result_type NOT IN ('succeeded', 'missing') THEN 1 ELSE 0 END) = 0
        AND count(*) FILTER (WHERE result_type = 'succeeded') = max(n_parts) THEN 'ok' ELSE 'error' END AS status,
  string_agg(CASE WHEN result_type = 'succeeded' THEN text END, chr(10) ORDER BY part) AS joined FROM j GROUP BY domain_id),
reassembled AS (SELECT a.domain_id, a.parts, a.status, CASE WHEN a.status = 'ok' THEN s.chars_in END AS chars_in,
  CAST(CASE WHEN a.status = 'ok' THEN length(a.joined) END AS BIGINT) AS chars_out,
  CASE WHEN a.status = 'ok' THEN md5(a.joined) END AS text_md5 FROM asm a LEFT JOIN src s ON s.domain_id = a.domain_id)"""

JOIN_VIEWS = ("batch_requests_log", "batch_results")


def _joined(spark, sf_dir):
    return B.collect_join(FX.batch_requests_log(spark, sf_dir), FX.batch_results(spark, sf_dir))


def _reassembled(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    src = conv.groupBy(F.col("conv_id").alias("domain_id")).agg(
        (F.sum(F.octet_length("text")) + F.count(F.lit(1)) - 1).cast("bigint").alias("chars_in"))
    return B.reassemble(_joined(spark, sf_dir), "domain_id", src)


@query("collect_join", O.with_views("SELECT batch_id, custom_id, domain_id, part, n_parts, result_type FROM j",
                                    *JOIN_VIEWS, extra=JOIN_CTE))
def q_collect_join(spark, sf_dir):
    return _joined(spark, sf_dir).select("batch_id", "custom_id", "domain_id", "part", "n_parts", "result_type")


@query("reassemble", O.with_views("SELECT * FROM reassembled", *JOIN_VIEWS, extra=JOIN_CTE))
def q_reassemble(spark, sf_dir):
    r = _reassembled(spark, sf_dir)
    return r.select("domain_id", "parts", "status", "chars_in", "chars_out", F.md5("translated").alias("text_md5"))


@query("collect_counts", O.with_views("""
SELECT count(*) FILTER (WHERE status = 'ok') AS written, count(*) FILTER (WHERE status = 'error') AS errors
FROM reassembled""", *JOIN_VIEWS, extra=JOIN_CTE))
def q_collect_counts(spark, sf_dir):
    r = _reassembled(spark, sf_dir)
    return r.agg(F.count_if(F.col("status") == "ok").cast("bigint").alias("written"),
                 F.count_if(F.col("status") == "error").cast("bigint").alias("errors"))


@query("batch_status", O.with_views("""
SELECT batch_id, count(*) AS requests, count(*) FILTER (WHERE result_type = 'succeeded') AS succeeded,
  count(*) FILTER (WHERE result_type NOT IN ('succeeded', 'missing')) AS errored,
  count(*) FILTER (WHERE result_type = 'missing') AS processing FROM j GROUP BY batch_id""",
    *JOIN_VIEWS, extra=JOIN_CTE))
def q_batch_status(spark, sf_dir):
    return B.batch_status(_joined(spark, sf_dir))


VERDICT_CTE = f"""vs AS (SELECT doc_id, body, CASE WHEN result_type <> 'succeeded' THEN 'error'
  WHEN NOT json_valid(body) THEN 'parse_error' ELSE 'ok' END AS status FROM verdict_feed),
verdicts AS (SELECT doc_id, status,
  CASE WHEN status = 'ok' THEN coalesce(CASE json_type(body, '$.innovative')
    WHEN 'BOOLEAN' THEN json_extract_string(body, '$.innovative') = 'true' WHEN 'VARCHAR' THEN json_extract_string(body, '$.innovative') <> ''
    WHEN 'ARRAY' THEN json_array_length(body, '$.innovative') > 0 WHEN 'OBJECT' THEN len(json_keys(body, '$.innovative')) > 0
    ELSE TRY_CAST(json_extract_string(body, '$.innovative') AS DOUBLE) <> 0 END, false) END AS innovative,
  CASE WHEN status = 'ok' THEN TRY_CAST(json_extract(body, '$.confidence') AS DOUBLE) END AS confidence,
  CASE WHEN status = 'ok' THEN {O.trim_ws("replace(coalesce(json_extract_string(body, '$.rationale'), ''), chr(10), ' ')")} END AS rationale
  FROM vs)"""


@query("verdicts", O.with_views("SELECT * FROM verdicts", "verdict_feed", extra=VERDICT_CTE))
def q_verdicts(spark, sf_dir):
    return B.parse_verdicts(FX.verdict_feed(spark, sf_dir))
