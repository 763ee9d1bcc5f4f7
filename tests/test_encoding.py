from kredo.operators import encoding as E


def test_align_and_validate(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "a long, b double, extra string")
    out = E.align_columns(df, ["b", "a", "missing"])
    assert out.columns == ["b", "a", "missing"] and out.first().missing == 0.0
    req = spark.createDataFrame([(1, "hh", "3"), (2, "10", None)], "id long, AMT_INCOME_TOTAL string, CNT_CHILDREN string")
    ok, bad = E.split_valid(req, ["AMT_INCOME_TOTAL", "CNT_CHILDREN"])
    assert [r.id for r in ok.collect()] == [2]
    assert bad.first().rejected_fields == ["AMT_INCOME_TOTAL"]


def test_label_codes_and_one_hot(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id long, c string")
    codes = E.fit_codes(df, ["c"])
    enc = {r.id: r.c_enc for r in E.encode_labels(df, ["c"], codes).collect()}
    assert enc == {1: 2, 2: 1, 3: 0}       # byte order: __MISSING__ < a < b
    unseen = spark.createDataFrame([(4, "zz")], "id long, c string")
    assert E.encode_labels(unseen, ["c"], codes).first().c_enc == -1
    oh = E.one_hot(df, E.vocabulary(codes))
    assert {r.id: (r.c_enc_0, r.c_enc_1, r.c_enc_2) for r in oh.collect()} == {
        1: (0, 0, 1), 2: (0, 1, 0), 3: (1, 0, 0)}


def test_domain_rules(spark):
    df = spark.createDataFrame([("M", 2.0, -5), ("X", 0.0, 365000), ("F", None, 3)],
                               "CODE_GENDER string, CNT_FAM_MEMBERS double, DAYS_EMPLOYED int")
    counts = {r.rule: r.violations for r in E.violation_counts(df).collect()}
    assert counts == {"gender_allowed": 1, "family_at_least_1": 1, "employed_in_past": 1}


def test_yes_no_canonical_and_reference_frame(spark, tmp_path):
    from pyspark.sql import functions as F

    from kredo.sources.files import reference_frame
    df = spark.createDataFrame([("Y",), ("1",), ("N",), ("0",), ("maybe",)], "f string")
    got = [r.c for r in df.select(E.canonical_yes_no("f").alias("c")).collect()]
    assert got == ["Y", "Y", "N", "N", None]
    assert [r.i for r in df.select(E.yes_no_to_int(F.col("f")).alias("i")).collect()] == [1, 0, 0, 0, 0]
    path = str(tmp_path / "ref")
    df.write.parquet(path)
    ref = reference_frame(spark, path)
    assert ref.is_cached and ref.count() == 5
    ref.unpersist()
