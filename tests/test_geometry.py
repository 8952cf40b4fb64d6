import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import geometry as geo

SIZES = (512, 768, 1024)


@pytest.mark.parametrize("measure, tier", [(2000, 1024), (922, 1024), (921, 768), (692, 768), (691, 512), (461, 512), (460, None), (10, None)])
def test_tiers(spark, measure, tier):
    df = spark.createDataFrame([(float(measure),)], "m double")
    assert df.select(geo.choose_tier(F.col("m"), SIZES, 0.9)).first()[0] == tier


def plan(spark, rect, size, **options):
    row = (*map(float, rect), *map(float, size))
    options = {"sizes": SIZES, "min_ratio": 0.8} | options
    return geo.plan_crops(spark.createDataFrame([row], "x double, y double, w double, h double, iw double, ih double"), **options).first()


CASES = [
    ((0, 0, 400, 400), (4000, 4000), 0.25, "shift", {"reject": "detection is 400px, needs >=410px for the 512 tier"}),
    ((1000, 1000, 1000, 1000), (6000, 6000), 0.25, "shift", {"base_side": 1000, "padded_side": 1500, "clamped": False}),
    ((0, 0, 1000, 1000), (3000, 3000), 0.5, "shift", {"clamped": True, "crop_x": 0, "crop_y": 0}),
    ((100, 100, 1000, 1000), (1200, 1200), 1.0, "shift", {"crop_x": 0, "fitted_side": 1200, "tier": 1024}),
    ((0, 0, 1000, 1000), (2000, 700), 0.25, "shift", {"fitted_side": 700, "tier": 768}),
    ((0, 0, 1000, 1000), (3000, 3000), 0.5, "extend", {"extends": True, "fitted_side": 2000}),
    ((0, 0, 1000, 1000), (3000, 3000), 0.5, "skip", {"reject": "padded crop does not fit inside the image", "tier": None}),
    ((1000, 1000, 1000, 1000), (4000, 4000), 0.2, "skip", {"clamped": False, "reject": None}),
    ((5, 5, 0, 0), (400, 400), 0.2, "shift", {"reject": "degenerate detection box"}),
]


@pytest.mark.parametrize("rect, size, padding, edge, want", CASES)
def test_plans(spark, rect, size, padding, edge, want):
    row = plan(spark, rect, size, padding=padding, edge=edge).asDict()
    assert {k: row[k] for k in want} == want


def test_bad_options(spark):
    with pytest.raises(ValueError):
        plan(spark, (0, 0, 1, 1), (9, 9), edge="bounce")
    with pytest.raises(ValueError):
        plan(spark, (0, 0, 1, 1), (9, 9), padding=-1)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(*[st.floats(-500, 3000)] * 2, *[st.floats(1, 2500)] * 2, *[st.integers(300, 4000)] * 2), min_size=1, max_size=30))
def test_plans_follow_the_rules(spark, rows):
    df = spark.createDataFrame([(*map(float, r),) for r in rows], "x double, y double, w double, h double, iw double, ih double")
    for r in geo.plan_crops(df, sizes=SIZES, padding=0.3).collect():
        if r.reject is None:
            assert 0 <= r.crop_x <= r.iw - r.fitted_side + 1e-9 and 0 <= r.crop_y <= r.ih - r.fitted_side + 1e-9
            assert r.fitted_side == min(r.padded_side, r.iw, r.ih)
            measure = min(r.base_side, r.fitted_side)
            assert r.tier == max(s for s in SIZES if measure >= 0.8 * s)
        else:
            assert r.tier is None and min(r.base_side, r.fitted_side or math.inf) < 0.8 * 512 or min(r.iw, r.ih) < 0.8 * 512


def test_rounding_is_half_to_even(spark):
    box = geo.rounded_box(F.col("x"), F.col("x"), F.lit(0.2), F.lit(1.0))
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(*[v.alias(k) for k, v in box.items()]).collect()
    assert [(r.left, r.right) for r in rows] == [(0, 1), (2, 3), (2, 3)]


def test_thin_images_keep_a_pixel(spark):
    size = geo.output_size(F.lit(1.0), F.lit(10000.0), F.lit(512))
    assert tuple(spark.range(1).select(*size.values()).first()) == (1, 512)
