import pytest
from oracle import expected, found

from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert found(catalogue.QUERIES[name](spark, SF)) == expected(catalogue.ORACLE_SQL[name], SF)


#: Queries on pixels, which numpy reads in Arrow batches.
PIXELS = {"isolate_person", "detect_plug_in", "png_round_trip", "crop_window", "fill_color", "person_boxes"}


def test_no_plan_has_a_cross_join_or_python(spark):
    for name, query in catalogue.QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan, name
        assert ("Python" in plan or "Pandas" in plan) == (name in PIXELS), name


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["regions_score_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "ReadSchema" in plan
