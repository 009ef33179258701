"""Write-read round trips of the file sources and sinks."""

import json
import os
import tempfile

from sitelens.operators import registry as R
from sitelens.sources import files as FS
from sitelens.sources import fixtures as FX


def _tmp():
    return tempfile.mkdtemp(prefix="sitelens-test-")


RECORD = {"businessId": {"value": "1234567-8"},
          "names": [{"name": "Old Oy", "type": "1", "version": 2}, {"name": "New Oy", "type": "1", "version": 1}],
          "website": {"url": " www.new.fi "},
          "companyForms": [{"type": "16", "version": 1,
                            "descriptions": [{"languageCode": "3", "description": "Limited company"}]}],
          "tradeRegisterStatus": "1"}


def test_register_layouts(spark):
    d = _tmp()
    with open(os.path.join(d, "array.json"), "w") as f:
        json.dump([RECORD, RECORD], f, indent=2)
    with open(os.path.join(d, "object.json"), "w") as f:
        json.dump({"companies": [RECORD]}, f, indent=2)
    for name, n in (("array.json", 2), ("object.json", 1)):
        recs = FS.read_register(spark, os.path.join(d, name))
        out = R.parse_company(recs).collect()
        assert len(out) == n
        assert (out[0].business_id, out[0].name, out[0].website, out[0].company_form) == \
            ("1234567-8", "New Oy", "www.new.fi", "Limited company")


def test_manifest_round_trip(spark, sf_small):
    kept = R.manifest(FX.registry(spark, sf_small))
    d = _tmp()
    FS.write_manifest(kept, csv_path=f"{d}/csv", json_path=f"{d}/json", parquet_path=f"{d}/pq")
    a = FS.read_manifest(spark, f"{d}/csv", "csv")
    b = FS.read_manifest(spark, f"{d}/json", "json")
    assert a.count() == kept.count() == b.count()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_corpus_dir(spark):
    d = _tmp()
    for name, data in (("a.fi.txt", "äö\nx".encode()), ("b.fi.txt", b"\xffok"), ("skip.csv", b"x")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    out = {r.domain: r for r in FS.read_corpus_dir(spark, d).collect()}
    assert set(out) == {"a.fi", "b.fi"}
    assert out["a.fi"].text == "äö\nx" and out["b.fi"].text == "�ok"


def test_id_list(spark):
    d = _tmp()
    with open(os.path.join(d, "ids.txt"), "w") as f:
        f.write(" 1 \n\n2\n  \n3\n")
    assert [r.business_id for r in FS.read_id_list(spark, d).orderBy("pos").collect()] == ["1", "2", "3"]


def test_readers_take_the_published_layouts(spark, tmp_path):
    """Headers without ``seq``, both JSON documents, and file order over several files and splits."""
    import json

    rows = [{"businessId": f"{i}-1", "name": f'Foo "{i}", Oy', "companyForm": "OY", "status": "ok", "homepage": f"https://a{i}.fi",
             "domain": "" if i == 2 else f"a{i}.fi", "shared_site": 0} for i in range(4)]
    csv = tmp_path / "m.csv"
    quote = lambda v: '"' + str(v).replace('"', '""') + '"'
    csv.write_text("\n".join([",".join(rows[0])] + [",".join(quote(v) for v in r.values()) for r in rows]))
    want = [(i, f"{i}-1", f'Foo "{i}", Oy', f"https://a{i}.fi", f"https://a{i}.fi" if i == 2 else f"a{i}.fi") for i in range(4)]
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(FS.read_manifest(spark, str(csv), "csv")) == want
    for name, text in (("o.json", json.dumps({"total_scanned": 9, "companies": rows}, indent=2)), ("a.json", json.dumps(rows)),
                       ("l.json", "\n".join(map(json.dumps, rows)))):
        (tmp_path / name).write_text(text)
        assert got(FS.read_manifest(spark, str(tmp_path / name), "json")) == want
    acc = tmp_path / "acc.csv"
    acc.write_text("domain,homepage,accessible,status,final_url,reason,tls,elapsed_s\n"
                   "a.fi,http://a.fi,True,200,http://b/,ok,ok,0.1\na.fi,http://c.fi,True,200,,ok,ok,0.1\n")
    assert got(FS.accessible_urls(FS.read_accessibility(spark, str(acc)))) == [("a.fi", "http://b/")]
    ids = tmp_path / "ids"
    ids.mkdir()
    for k in range(3):
        (ids / f"part-{k}.txt").write_text("".join(f" {k * 1000 + i}\n\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        back = [r.business_id for r in FS.read_id_list(spark, str(ids)).orderBy("pos").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert back == [str(k * 1000 + i) for k in range(3) for i in range(400)]
