"""The driver contract in __spark_entry__.py."""

import __spark_entry__ as entry_module


def test_entry_runs_flagship(spark):
    df = entry_module.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns == ["id", "player", "team", "position", "total_points", "cost", "value", "form", "minutes"]
    values = [r.value for r in rows]
    assert values == sorted(values, reverse=True)


def test_contract_shapes():
    q, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(q)
    assert all(callable(fn) for fn in q.values())
    assert all(isinstance(s, str) and s.strip() for s in sql.values())
