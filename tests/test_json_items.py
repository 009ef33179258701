"""One JSON document read in splits equals the serial parse, wherever the splits fall."""

import json
import os
import random

import pytest

from sitelens.sources import files as FS
from sitelens.sources import json_items as J

SMALL = {"spark.sql.files.maxPartitionBytes": "1499b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 5)
    if kind < 3:
        return "".join(rng.choice(['a', '"', '\\', '{', '}', '[', ']', ',', ':', 'ä', '\n', ' ', '😀', '\\"']) for _ in range(rng.randrange(14)))
    if kind < 5:
        return rng.choice([1, -2.5, None, True, ""])
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "b", "x}y", '"{', "companies"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}


def record(rng):
    return {"id": rng.randrange(1000), "v": value(rng), "w": value(rng)}


def serial(doc, member):
    top = doc if member is None else doc.get(member) if isinstance(doc, dict) else None
    return [x for x in top if isinstance(x, dict)] if isinstance(top, list) else []


@pytest.mark.parametrize("seed", range(2))
def test_equals_serial_parse_at_any_cut(small_splits, tmp_path, seed):
    rng = random.Random(seed)
    items = [rng.choice([record(rng), record(rng), record(rng), [record(rng), [record(rng)]], 5, "}{", None, {}]) for _ in range(60)]
    docs = [(items, None),
            ({"total_scanned": 7, "x}y": [record(rng), {"companies": [record(rng)]}], "meta": {"companies": [record(rng)], "n": {"m": [record(rng)]}},
              "companies": items, "after": [[record(rng)], record(rng)]}, "companies")]
    for n, (doc, member) in enumerate(docs):
        for style in ({}, {"indent": 2}, {"separators": (",", ":"), "ensure_ascii": False}):
            path = str(tmp_path / f"{n}-{len(style)}-{'indent' in style}.json")
            with open(path, "w", encoding="utf-8") as f:
                json.dump(doc, f, **style)
            got = sorted((r.pos, json.loads(r.item)) for r in J.json_items(small_splits, path, member).collect())
            want = serial(doc, member)
            assert [p for p, _ in got] == list(range(len(want)))
            assert [x for _, x in got] == want
            assert J.layout_of(J.head_of(small_splits, path)) == ("array" if member is None else "object")


def test_cutter_alone_at_every_cut():
    """Every way to cut a document's pieces into two splits."""
    rng = random.Random(11)
    doc = {"a}": [{"companies": [{"q": 1}]}], "companies": [record(rng), [{"no": [{}]}], record(rng), {"s": '}"{'}], "z": {"y": {"x": {}}}}
    text = json.dumps(doc)
    pieces = text.split("}")[:-1]
    want = [x for x in doc["companies"] if isinstance(x, dict)]
    for cut in range(len(pieces) + 1):
        inside, depth, parts, active = False, 0, [], False
        for share in (pieces[:cut], pieces[cut:]):
            c = J.Cutter("companies", inside, depth)
            for p in share:
                c.take(p)
                f, a, b = J.effect(p)
                depth, inside = depth + (b if inside else a), inside ^ f
            c.end(False)
            parts += [(x[0], x[1], x[3]) for x in c.out if (x[2] if x[2] is not None else active)]
            active = c.active if c.active is not None else active
        got, held = [], None
        for begins, ends, item in parts:
            held = item if begins else None if held is None else held + item
            if ends and held is not None:
                got.append(json.loads(held))
                held = None
        assert got == want, cut


@pytest.mark.parametrize("few", [100_000, 0])
def test_records_positions_and_many_files(small_splits, tmp_path, few, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_SPLITS", few)
    rows = [(i, f"id-{i}", f'a "quoted" {{name}} {i}', None if i % 3 else "s") for i in range(200)]
    df = small_splits.createDataFrame(rows, "seq long, businessId string, name string, status string").repartition(5)
    for member, head in ((None, None), ("companies", {"total_scanned": 200}), ("companies", None)):
        path = str(tmp_path / f"doc-{member}-{bool(head)}")
        FS.write_json_document(df, path, member=member, head=head)
        assert FS.json_layout(small_splits, path) == ("array" if member is None else "object")
        got = FS.read_json_records(small_splits, path, "seq BIGINT, businessId STRING, name STRING, status STRING").collect()
        assert sorted(tuple(r) for r in got) == rows
    empty = str(tmp_path / "none")
    FS.write_json_document(df.limit(0), empty)
    assert FS.read_json_records(small_splits, empty, "seq BIGINT, name STRING").collect() == []


def test_layouts_and_the_head_is_bounded(spark, tmp_path):
    cases = {"[]": "array", "  \n [1]": "array", "": "array", '{"a": 1}\n{"a": 2}': "lines", '{"a": {"companies": []}}\n{}': "lines",
             '{"companies": []}': "object", '{\n "x": [{"y": 1}],\n "companies" : []}': "object", '{"total_scanned": 3, "companies": []}': "object",
             '﻿{"companies": [{"name": "b"}]}': "object", '{"a": "companies"}': "lines"}
    for i, (text, want) in enumerate(cases.items()):
        path = str(tmp_path / f"{i}.json")
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        assert FS.json_layout(spark, path) == want, text
    path = str(tmp_path / "long.json")
    with open(path, "w") as f:
        f.write("[" + ",".join(['{"name": "' + "n" * 100 + '"}'] * 20_000) + "]")
    assert len(J.head_of(spark, path)) == J.HEAD_BYTES < os.path.getsize(path)
    assert FS.read_json_records(spark, path, "seq BIGINT, name STRING").count() == 20_000
    # a document that ends early gives what is complete
    path = str(tmp_path / "cut.json")
    with open(path, "w") as f:
        f.write('[{"name": "a"}, {"name": "b"}, {"name": "c')
    assert sorted(tuple(r) for r in FS.read_json_records(spark, path, "seq BIGINT, name STRING").collect()) == [(0, "a"), (1, "b")]
