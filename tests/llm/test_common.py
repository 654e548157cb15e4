"""Tables in the shared folder."""

import pytest

from clausegrid.llm import _common


def test_stored_forget_and_clean(spark):
    df = spark.range(5).withColumnRenamed("id", "n")
    a, b = _common.stored(df, "a"), _common.stored(df, "b")
    assert a.columns == ["n"] and a.count() == b.count() == 5 and all("/tables-" in f for f in a.inputFiles())
    _common.forget(a)
    assert b.count() == 5
    _common.clean(spark)
    with pytest.raises(Exception, match="does not exist|FileNotFound"):
        spark.read.schema("n long").parquet(b.inputFiles()[0]).count()


def test_names_and_batches(spark):
    assert _common.fresh_name(["A", "a_"], "a") == "a__"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    _common.bound_batches(spark.range(1))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"


def test_random_scramble_is_one_to_one():
    import numpy as np

    assert len(np.unique(_common.mix64(np.arange(100_000, dtype=np.uint64)))) == 100_000


def test_unread_tables_go(spark):
    with _common.owned() as outer:
        with _common.owned() as folders:
            one = _common.stored(spark.range(5), "one")
            two = _common.stored(one.selectExpr("id + 1 AS id"), "two")
            assert len(folders) == 2
            _common.delete_unread(folders, two.where("id > 2"))
        assert outer == folders and len(outer) == 1
    assert sorted(r.id for r in two.where("id > 2").collect()) == [3, 4, 5]
    with pytest.raises(Exception):
        one.collect()
    _common.stored(spark.range(2), "three")  # nobody's
    assert len(outer) == 1
