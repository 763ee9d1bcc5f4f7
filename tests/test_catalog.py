"""Catalog by declared schemas: encodings, bad lines with their numbers, missing files."""

import json

import pytest

from kredo.sources import catalog as C
from tests.conftest import rows

SCHEMA = "id BIGINT, name STRING, amount DOUBLE"
CSV = ["id,name,amount,more", "1,Café,1.5,x", "2,b", "", "three,c,2.0,y", '4,"d, e",NaN,z', "5,f,hh,w", "6,g,3.0,u,v"]


def test_csv(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("\n".join(CSV).encode("utf-8"))
    (folder / "b.csv").write_bytes("\n".join([CSV[0], "7,Crème,4.0,é", "8,x,bad,é"]).encode("latin-1"))
    good, bad, absent = C.read_csv_checked(spark, str(folder), SCHEMA + ", gone INT")
    assert good.columns == ["id", "name", "amount", "gone", "more"] and absent == ["gone"]
    assert [(r["id"], r["name"], r["amount"], r["more"]) for r in rows(good, "id")] == [
        (1, "Café", 1.5, "x"), (4, "d, e", None, "z"), (7, "Crème", 4.0, "é")]
    got = sorted((r["file"][-5:], r["line"], r["raw"], r["reason"]) for r in bad.collect())
    assert got == [("a.csv", 3, "2,b", "columns"), ("a.csv", 5, "three,c,2.0,y", "type: id"), ("a.csv", 7, "5,f,hh,w", "type: amount"),
                   ("a.csv", 8, "6,g,3.0,u,v", "columns"), ("b.csv", 3, "8,x,bad,é", "type: amount")]


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [f'{{"id": {i}, "name": "n{i}", "amount": {"1.0" if i % 50 else "[]"}}}' for i in range(3000)]
    lines[1234] = '{"id": 1'
    (tmp_path / "x.json").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert spark.read.text(str(tmp_path / "x.json")).rdd.getNumPartitions() > 4
        good, bad, _ = C.read_ndjson_checked(spark, str(tmp_path / "x.json"), SCHEMA)
        got = {r["line"]: (r["raw"], r["reason"]) for r in bad.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {i + 1: (lines[i], "not JSON" if i == 1234 else "type: amount") for i in [*range(0, 3000, 50), 1234]}
    assert good.count() == 3000 - 61


def test_ndjson(spark, tmp_path):
    text = ['{"id": 1, "name": "a", "amount": 2}', "", "garbage", '{"id": "x", "amount": 1}', '{"name": null, "other": 1}', "[1]"]
    (tmp_path / "api.log").write_text("\n".join(text))
    good, bad, _ = C.read_ndjson_checked(spark, str(tmp_path / "api.log"), SCHEMA)
    assert [(r["id"], r["name"], r["amount"]) for r in rows(good, "id")] == [(1, "a", 2.0), (None, None, None)]
    assert sorted((r["line"], r["reason"]) for r in bad.collect()) == [(3, "not JSON"), (4, "type: id"), (6, "not JSON")]


def test_parquet(spark, tmp_path):
    spark.createDataFrame([("1", 2.0), ("x", 3.0), (None, None)], "id string, amount double").write.parquet(str(tmp_path / "p"))
    good, bad, absent = C.read_parquet_checked(spark, str(tmp_path / "p"), SCHEMA)
    assert good.dtypes == [("id", "bigint"), ("name", "string"), ("amount", "double")] and absent == ["name"]
    assert [r["id"] for r in rows(good, "id")] == [1, None]
    assert [(json.loads(r["raw"])["id"], r["reason"]) for r in bad.collect()] == [("x", "type: id")]


def test_catalog(spark, tmp_path, caplog):
    (tmp_path / "a.csv").write_text("id,name,amount\n1,x,2\n2,y,z\n")
    (tmp_path / "b.log").write_text('{"id": 1}\n')
    spark.range(3).write.parquet(str(tmp_path / "c.parquet"))
    (tmp_path / "c.csv").write_text("id\nnever read\n")
    schemas = {"a": ("a.csv", SCHEMA), "b": ("b.log", SCHEMA), "c": ("c.csv", "id BIGINT"), "d": ("d.csv", SCHEMA)}
    found = C.load_catalog(spark, str(tmp_path), schemas)
    assert found.missing == ["d"] and "table d" in caplog.text
    assert rows(found.counts(spark), "table") == [
        {"table": "a", "status": "loaded", "n_rows": 1, "n_bad": 1}, {"table": "b", "status": "loaded", "n_rows": 1, "n_bad": 0},
        {"table": "c", "status": "loaded", "n_rows": 3, "n_bad": 0}, {"table": "d", "status": "missing", "n_rows": None, "n_bad": None}]
    assert C.load_catalog(spark, str(tmp_path / "none"), schemas).quarantine.count() == 0


@pytest.mark.parametrize("name", sorted(C.CATALOG))
def test_declared_schemas_parse(name):
    from pyspark.sql.types import StructType
    assert len(StructType.fromDDL(C.CATALOG[name][1])) > 2
