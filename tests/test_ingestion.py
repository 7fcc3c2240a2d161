"""Element-wise ingestion: bad elements, rows and files are rejects; the formats agree; digests and manifests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerweave.sources import elements

RECORDS = [
    {"txid": "a1", "timestamp": "2026-01-01T00:00:00Z", "input_wallets": ["w1", "w2"], "output_wallets": ["w3"], "input_amount": "2.5", "output_amount": "2.4", "fee": "0.1"},
    {"txid": "b2", "timestamp": "2026-01-02T00:00:00Z", "input_wallets": ["w4"], "output_wallets": [], "input_amount": "1", "output_amount": "1", "fee": "0"},
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("wrap", [lambda r: r, lambda r: {"records": r}, lambda r: {"data": r, "note": 1}])
def test_json_shapes(spark, tmp_path, wrap):
    got = elements.import_file(spark, write(tmp_path / "x.json", json.dumps(wrap(RECORDS))))
    assert (got.status, got.error, got.counts) == ("PASS", None, {"read": 2, "valid": 2, "invalid": 0, "duplicates": 0})
    assert {r.txid: json.loads(r.input_wallets) for r in got.valid.collect()} == {"a1": ["w1", "w2"], "b2": ["w4"]}


def test_one_object_is_one_record(spark, tmp_path):
    assert elements.import_file(spark, write(tmp_path / "x.json", json.dumps(RECORDS[0]))).counts["valid"] == 1


def test_bad_elements_do_not_end_the_import(spark, tmp_path):
    mixed = [RECORDS[0], 7, "text", None, [1], RECORDS[0], {"txid": "c3"}, {**RECORDS[1], "fee": -1}]
    got = elements.import_file(spark, write(tmp_path / "x.json", json.dumps(mixed)))
    assert got.status == "WARNING" and got.counts == {"read": 8, "valid": 2, "invalid": 6, "duplicates": 1}
    rejects = got.rejects.collect()
    assert sorted(r.position for r in rejects if r.fault == "NOT_AN_OBJECT") == [1, 2, 3, 4]
    assert {tuple(r.missing) for r in rejects if r.fault is None} == {("timestamp", "input_amount", "output_amount", "fee"), ()}
    assert ["fee"] in [r.invalid for r in rejects]


@pytest.mark.parametrize("text,reason", [("", "empty"), ("{broken", "no JSON"), ("42", "object or an array"), ("null", "object or an array")])
def test_bad_json_files_give_an_empty_result(spark, tmp_path, text, reason):
    got = elements.import_file(spark, write(tmp_path / "x.json", text))
    assert got.status == "FAILED" and reason in got.error and got.valid.count() == got.rejects.count() == 0


def test_missing_files_and_formats(spark, tmp_path):
    assert "FileNotFoundError" in elements.import_file(spark, str(tmp_path / "none.csv")).error
    assert "unsupported format" in elements.import_file(spark, write(tmp_path / "x.txt", "a")).error
    assert elements.import_file(spark, write(tmp_path / "e.csv", "")).status == "FAILED"


def test_formats_agree(spark, tmp_path):
    head = list(RECORDS[0])
    cells = [[";".join(v) if isinstance(v, list) else v for v in r.values()] for r in RECORDS]
    paths = [
        write(tmp_path / "a.json", json.dumps(RECORDS)),
        write(tmp_path / "a.csv", "﻿" + ",".join([" TXID ", *head[1:]]) + "\n" + "\n".join(",".join(c) for c in cells) + "\n"),
        write(tmp_path / "a.xml", "<all>" + "".join("<record>" + "".join(f"<{k}>{v}</{k}>" for k, v in zip(head, c, strict=True)) + "</record>" for c in cells) + "</all>"),
    ]
    found = []
    for p in paths:
        got = elements.import_file(spark, p)
        assert got.status == "PASS", got.error
        found.append(sorted((r.txid, r.timestamp, r.input_wallets, r.output_wallets, float(r.fee)) for r in got.valid.collect()))
    assert found[0] == found[1] == found[2]


def test_names_that_come_to_one(spark):
    rows = spark.createDataFrame([("x", '[{"TX-ID": "1"}, {"tx id": 2, "Txid": null}, {"a": {"b": [1]}, "txid": true}]')], "k string, t string")
    got = elements.widened(elements.json_elements(rows, "t"))
    assert got.columns.count("txid") <= 1
    assert elements.json_elements(rows, "t").filter("position = 2").first().fields["a"] == '{"b":[1]}'


NET = "timestamp,src_ip,src_port,dst_ip,dst_port,txid,geo_country,asn,observation_source"


def test_network_import(spark, tmp_path):
    row = "2026-01-01T00:00:00Z,10.0.0.1,8333,10.0.0.2,8333,5,in,AS64500,"
    path = write(tmp_path / "n.csv", "\n".join([NET, row, row, row.replace("10.0.0.2", "fe80::0001"), row.replace("8333", "99999"), row.replace("AS64500", "x") + "lab"]) + "\n")
    valid, report = elements.import_network(spark, path, "upload")
    got = valid.collect()
    assert valid.columns == [*elements.NETWORK_COLUMNS, "copies"] and sorted(r.copies for r in got) == [1, 1, 1, 2]
    assert {r.observation_source for r in got} == {"upload", "lab"} and {r.dst_ip for r in got} == {"10.0.0.2", "fe80::1"} and all(len(r.network_event_id) == 24 for r in got)
    nulls = {r["column"]: r["nulls"] for r in report.collect()}
    assert (nulls["src_port"], nulls["asn"], nulls["protocol"], nulls["timestamp"]) == (1, 1, 5, 0)
    with pytest.raises(ValueError, match="src_port: 1 unreadable"):
        elements.import_network(spark, path, "upload", strict=True)
    with pytest.raises(ValueError, match="asn"):
        elements.import_network(spark, write(tmp_path / "m.csv", NET.replace(",asn", "") + "\n"), "upload")
    with pytest.raises(ValueError, match="CSV"):
        elements.import_network(spark, str(tmp_path / "n.json"), "upload")


def test_digests_and_manifest(spark, tmp_path):
    paths = [write(tmp_path / n, t) for n, t in (("a", "one"), ("b", "two" * 5000), ("c", ""))]
    found = elements.chunk_digests(spark, [*paths, str(tmp_path / "gone")], chunk=7)
    got = {r.path: r for r in found.collect()}
    assert [got[p].sha256 for p in paths] == [hashlib.sha256(t.encode()).hexdigest() for t in ("one", "two" * 5000, "")]
    assert got[paths[1]].length == 15000 and got[str(tmp_path / "gone")].error
    manifest = found.filter("error is null").select("path", F.when(F.col("path") == paths[1], "0").otherwise(F.col("sha256")).alias("sha256")).filter(F.col("path") != paths[2])
    manifest = manifest.unionByName(spark.createDataFrame([(str(tmp_path / "gone"), "1")], "path string, sha256 string"))
    status = {r.path.rsplit("/", 1)[1]: r.status for r in elements.manifest_differences(manifest, found).collect()}
    assert status == {"a": "OK", "b": "CHANGED", "c": "UNLISTED", "gone": "MISSING"}
