"""The pipeline on small tables: every stage against brute force over its own input, and odd rows."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_small_cases import brute_classes, brute_decon, brute_fingerprint, brute_repeats

import corpus_pipeline
from sitelens.llm import quality_classifier, sharding, simhash
from sitelens.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __simhash string, __fp long, __k1 long, __quality int"
ITEM = " ".join(f"item{i} word" for i in range(12))


def make_tables(spark, sf_dir, empty=False):
    """Clean and bad texts, copies, near copies, shared passages, a benchmark passage, nulls, empties, repeats, long texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("aeimnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    shared = text(80)
    rows, labels = [], []
    for i in range(260):
        t, good = text(rng.randint(40, 160)), 1
        if i % 5 == 0:
            t, good = " ".join(w + "###" for w in t.split()), 0
        elif i % 11 == 1:
            t = t + " " + shared + " " + text(30)
        elif i % 13 == 2:
            t = t[:150] + " " + ITEM + " " + t[150:]
        rows.append((i, t))
        labels.append((i, good, 0))
    good = [r for r in rows if r[0] % 5 and r[0] % 13 != 2 and r[0] % 11 != 1]
    rows += [(1000 + k, good[k][1]) for k in range(8)]  # exact copies
    rows += [(1100 + k, (good[9][1] + " " + text(600)).replace("a", "e", k)) for k in (0, 1)]  # near copies of a long text
    rows += [(2000, None), (2001, ""), (None, good[20][1] + " more of it."), (None, None), (2002, text(20_000)), (2003, " \n ")]
    rows += [rows[7], rows[7]]
    full = [(i, t, "en" if (i or 0) % 3 else None, "s", len(t or ""), "keep", 7, 8, 9) for i, t in rows]
    spark.createDataFrame([] if empty else full, DOCS).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([] if empty else [(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(name, rows in, rows out)] and the result of run()."""
    sf = str(tmp_path_factory.mktemp("tables"))
    make_tables(spark, sf)
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = written(stage(spark, docs, sf), "stage-test")
        out.append((name, docs, got))
        docs = got
    return out, corpus_pipeline.run(spark, sf), sf


def test_stages_in_order_and_their_columns(stages):
    out, _, _ = stages
    assert [n for n, _, _ in out] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "benchmark decontamination", "packing"]
    for _, before, after in out[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
        assert {(r["__simhash"], r["__fp"], r["__k1"], r["__quality"]) for r in after.select("__simhash", "__fp", "__k1", "__quality").collect()} \
            == {("keep", 7, 8, 9)}


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    _, before, after = stages[0][0]
    sf = stages[2]
    model = quality_classifier.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    scored = quality_classifier.scored(before, model, result="q").select(*[F.col(f"`{c}`") for c in before.columns], "q.score").collect()
    assert sorted([tuple(r)[:-1] for r in scored if r.score >= 0.3], key=str) == rows_of(after)
    held = {r.doc_id for r in after.collect() if r.doc_id is not None and r.doc_id < 260}
    unseen = [i for i in range(260) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((i in held) == bool(i % 5) for i in unseen) / len(unseen) >= 0.95


def test_near_copies_keep_one_of_each_group(stages):
    _, before, after = stages[0][1]
    rows = before.collect()
    root = brute_classes([brute_fingerprint(r.text) for r in rows])
    best = {}
    for r, g in zip(rows, root):
        key = (r.doc_id is None, r.doc_id or 0)
        best[g] = min(best.get(g, key), key)
    kept = after.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(best.values())
    assert {(r.doc_id, r.text) for r in kept} <= {(r.doc_id, r.text) for r in rows}


def test_long_repeats_are_cut(stages):
    _, before, after = stages[0][2]
    rows = before.collect()
    by = {r.doc_id: r for r in after.collect()}
    assert len(by) == len(rows)
    cut, one = 0, brute_repeats([r.text for r in rows])
    for r in rows:
        _, removed, _, kept = one(r.text)
        assert (by[r.doc_id].text or "") == kept.decode()
        assert by[r.doc_id].n_chars == (None if by[r.doc_id].text is None else len(by[r.doc_id].text))
        cut += removed > 0
    assert cut > 5


def test_contaminated_documents_go(stages):
    _, before, after = stages[0][3]
    want = set()
    for r in before.collect():
        n, hit, _ = brute_decon(r.text, [(1, ITEM)])
        if not (hit and 20 * hit >= n):
            want.add((r.doc_id, r.text))
    assert {(r.doc_id, r.text) for r in after.collect()} == want
    assert after.count() < before.count()


def test_packing_holds_every_id_once(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    _, before, after = stages[0][4]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = sorted(((r.doc_id, np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in before.collect()), key=str)
    pieces = {}
    for r in after.collect():
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(pieces, key=str) == sorted(((i, len(ids) // 4) for i, ids in want), key=str)
    for i, ids in want:
        own = sorted(pieces[i, len(ids) // 4], key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[4 * r.start: 4 * (r.start + r.length)]) for r in own]
    seqs = {}
    for r in after.collect():
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


def test_run_is_the_stages_in_a_row(stages):
    out, result, _ = stages
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(result.select(*cols)) == rows_of(out[-1][2].select(*cols))


def test_empty_tables(spark, tmp_path):
    make_tables(spark, str(tmp_path), empty=True)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_helper_columns_do_not_clash(spark):
    names = ["__simhash", "__fp", "__k1", "__k2", "__key", "__rank", "__bucket", "__off", "__pid", "__idx", "rows", "component_id", "root", "n"]
    df = spark.createDataFrame([(i, "a b c d" if i % 2 else f"x{i} y z", *range(len(names))) for i in range(12)],
                               "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    want = sorted((r.doc_id, *[r[n] for n in names]) for r in df.collect())
    for out in (simhash.classes(df), sharding.shuffle_shards(df, 3, bucket_rows=2)):
        assert set(df.columns) <= set(out.columns)
        assert sorted((r.doc_id, *[r[n] for n in names]) for r in out.select("doc_id", *names).collect()) == want
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == 7


def test_the_entry_imports_without_the_folders():
    """Queries of the library do not need the subpackage, its tests or the pipeline."""
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys; sys.modules['corpus_pipeline'] = None\n"
            "import importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'sitelens.llm' or name.startswith('sitelens.llm.') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "del sys.modules['corpus_pipeline']\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q), sorted(q)\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120).returncode == 0


# --- chat formatting: one fold -------------------------------------------------------

def test_closed_and_open_logs_agree(spark):
    from sitelens.llm import chat_format
    rng = random.Random(12)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1, 1, 2, 3]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b<|", "", None]))
            for _ in range(120)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat_format.turn_events(turns)
    streamed = events.unionByName(events.filter("msg = 2").limit(1).selectExpr(
        "conv_id", "seq", "'regenerate' as kind", "msg", "null as role", "null as text")).unionByName(events.filter("msg = 3").selectExpr(
            "conv_id", "seq", "'delta' as kind", "msg", "role", "'more' as text"))
    for log in (events, streamed):
        both = [sorted(map(tuple, chat_format.format_events(log, closed=c).collect()), key=str) for c in (False, True)]
        assert both[0] == both[1] and len(both[0]) >= 100
    assert len(chat_format.format_events(events, closed=True).collect()) == len(rows)  # repeated messages stay
    back = spark.createDataFrame([(1, 0, "message", 1, "u", "a"), (1, 1, "message", 2, "u", "b"), (1, 2, "edit", 1, "u", "c")], events.schema)
    with pytest.raises(Exception, match="goes back"):
        chat_format.format_events(back, closed=True).collect()
    assert [chat_format.read_turn(r.rendered)[1] for r in chat_format.format_events(back).orderBy("turn_no").collect()] == ["c", "b"]
