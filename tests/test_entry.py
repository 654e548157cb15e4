"""The driver contract."""

import importlib.util
import re

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "total", "high", "medium", "low", "other"]
    rows = df.collect()
    assert rows and all(r.total == r.high + r.medium + r.low + r.other for r in rows)


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
    if importlib.util.find_spec("clausegrid.llm"):
        assert {int(m[1]) for q in queries if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14))


def test_rest_does_not_import_the_subpackage():
    import glob
    import os

    top = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for f in glob.glob(f"{top}/clausegrid/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in f:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", open(f).read(), re.M), f
