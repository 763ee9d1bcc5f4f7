"""Payloads as VARIANT: mixed types, nested objects, odd keys, no objects at all."""

import pytest
from pyspark.sql import functions as F

from kredo.functions import variant as V
from kredo.functions.payload import flatten

TEXTS = ['{"a": 1, "b": {"c": "x", "d e": [1, 2.5]}, "m": 5, "n": null}', '{"a": 2.5, "b": {"c": "y"}, "m": "five", "odd`k": true}',
         "[1, 2]", "not json", None, '{"b": {"c": null}, "id": 7}', "{}", "7", '{"a": NaN}']


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, input_data string")


def test_objects_alone_are_parsed(logs):
    got = {r["id"] for r in logs.where(V.parsed("input_data").isNotNull()).collect()}
    assert got == {0, 1, 5, 6}


def test_one_schema(logs):
    assert V.object_schema(logs) == ("STRUCT<`a`: DOUBLE, `b`: STRUCT<`c`: STRING, `d e`: ARRAY<DOUBLE>>, `id`: BIGINT, "
                                     "`m`: STRING, `n`: STRING, `odd``k`: BOOLEAN>")
    with pytest.raises(ValueError, match="name the fields"):
        V.object_schema(logs, max_length=20)
    assert V.object_schema(logs.where("id in (2, 3, 4)")) == "STRUCT<>"
    assert V.object_schema(logs.where("id = 6")) == "STRUCT<>"


def test_typed_nested_frame(logs):
    got = {r["id"]: r for r in V.variant_frame(logs, keep=["id"]).collect()}
    assert set(got) == {0, 1, 5}
    assert got[0]["a"] == 1.0 and got[0]["b"]["d e"] == [1.0, 2.5] and got[0]["m"] == "5" and got[1]["m"] == "five"
    assert got[1]["odd`k"] is True and got[5]["a"] is None and got[5]["input_data_id"] == 7
    flat = flatten(V.variant_frame(logs.where("id < 2"), keep=["id"]))
    assert "b.c" in flat.columns and sorted(r["b.c"] for r in flat.collect()) == ["x", "y"]
    assert V.variant_frame(logs.where("id = 2"), keep=["id"]).columns == ["id"]


def test_a_given_schema_keeps_what_fits(logs):
    got = {r["id"]: r for r in V.variant_frame(logs, keep=["id"], schema="STRUCT<m: BIGINT, b: STRUCT<c: STRING>>").collect()}
    assert got[0]["m"] == 5 and got[1]["m"] is None and got[1]["b"]["c"] == "y"


def test_groups_hold_present_keys_alone(logs):
    rows = V.field_groups(logs, groups={"one": ["a", "zz"], "two": ["b", "m"]})
    got = {r["id"]: r for r in rows.select("id", F.map_keys("one").alias("one"), F.array_sort(F.map_keys("two")).alias("two")).collect()}
    assert got[0]["one"] == ["a"] and got[0]["two"] == ["b", "m"]
    assert got[6]["one"] == [] and got[2]["one"] is None and rows.count() == len(TEXTS)


@pytest.mark.parametrize("text,want", [
    ('{"SK_ID_CURR": 5}', 5), ('{"SK_ID_CURR": "5.0"}', 5), ('{"SK_ID_CURR": 0, "client_id": "9"}', 9), ('{"client_id": 3.0}', 3),
    ('{"SK_ID_CURR": "x", "client_id": null}', None), ('{"SK_ID_CURR": {"a": 1}, "client_id": 4}', 4), ("[5]", None)])
def test_client_id(spark, text, want):
    df = spark.createDataFrame([(text,)], "input_data string")
    assert df.select(V.client_id(V.parsed("input_data"))).first()[0] == want


def test_json_text_keeps_nulls(logs):
    got = logs.where("id = 0").select(V.json_text(V.parsed("input_data"))).first()[0]
    assert got == '{"a":1,"b":{"c":"x","d e":[1,2.5]},"m":5,"n":null}'
