"""Tasks over regions have a bounded share of the table, with the same results."""

import re

import pytest
from oracle import expected, found

from quernstone.plans import catalogue
from quernstone.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["shot_type", "multi_skip", "skip_tally", "max_index", "crop_manifest", "mask_tallies"])
def test_tasks_grow_with_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(fx, "SHARE", 4096, raising=False)
    df = catalogue.QUERIES[name](spark, SF)
    if name not in ("max_index", "crop_manifest"):  # there the plan starts from the checkpoint
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert [int(n) for n in re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION_BY_NUM", plan)] > [4]
        assert not re.search(r"BroadcastHashJoin \[l_orderkey", plan)
    assert found(df) == expected(catalogue.ORACLE_SQL[name], SF)


def test_numbers_in_many_tasks(spark):
    from quernstone.operators import numbering

    df = numbering.number(spark.range(0, 1000, 1, 3), ["id"], tasks=37)
    assert sorted((r["id"], r["index"]) for r in df.collect()) == [(k, k + 1) for k in range(1000)]
