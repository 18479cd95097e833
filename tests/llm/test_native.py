"""The operators that must do without Python on their main path."""

import pytest

from millrace.llm import decontam, orderminhash, registry, sharding


@pytest.mark.parametrize("query", [orderminhash.op3_order_minhash, sharding.op5_sharding, decontam.op6_decontam])
def test_plans_have_no_python(spark, sf_dir, query, monkeypatch):
    plans = []
    for module in (sharding, decontam):
        real = module.stash
        monkeypatch.setattr(module, "stash", lambda df, name, real=real: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    plans.append(query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString())
    for text in plans:
        assert not any(word in text for word in ("Python", "Pandas", "Arrow", "Cartesian", "BroadcastNestedLoop")), text


def test_names_and_sql():
    assert [q.split("_")[0] for q in registry.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(registry.queries())
