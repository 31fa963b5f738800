import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_flagship_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    out = entry.entry(spark)
    assert out.columns == ["group_id", "files", "bytes"] and out.count() > 0


def test_every_oracle_is_sql():
    import __spark_entry__ as entry

    assert all(isinstance(sql, str) for sql in entry.oracle_sql().values())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_every_library_query_runs(spark):
    from twinsift.plans import queries

    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)
    failed = {}
    for name, query in queries.QUERIES.items():
        try:
            query(spark, DATA).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001  all that fail are told
            failed[name] = str(e)[:200]
    assert not failed
