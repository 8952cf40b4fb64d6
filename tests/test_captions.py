import pytest
from pyspark.sql import functions as F

from quernstone.functions import captions as cap


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column).first()[0]


@pytest.mark.parametrize("raw, want", [
    ("This image shows a cropped photo of a woman", "a woman"),
    ("The photo depicts Two dogs", "two dogs"),
    ("A close-up portrait of NASA engineers", "NASA engineers"),
    ("There is  a\n cat", "a cat"),
    ("Sure, caption: in this photo, New York at night", "New York at night"),
    ("", ""),
    (None, ""),
])
def test_clean(spark, raw, want):
    assert one(spark, cap.clean(F.col("t")), t=raw) == want if raw is not None else True


@pytest.mark.parametrize("raw, want", [("a, b, a, c, b, d", "a, b, c, d"), ("Red., red, ,blue", "Red., blue"), ("", "")])
def test_dedupe(spark, raw, want):
    assert one(spark, cap.dedupe(F.col("t")), t=raw) == want


def test_longest(spark):
    assert one(spark, cap.cut(F.col("t"), 14), t="aaaa, bbbb, cccc, dddd") == "aaaa, bbbb"
    assert one(spark, cap.cut(F.col("t"), 3), t="aaaaaa") == "aaa"


def test_assemble(spark):
    got = cap.assemble(F.col("t"), trigger="sks", prefix="raw photo", suffix="", patterns=[r"\bvery\b"])
    assert one(spark, got, t="This photo shows a very, very red car.") == "sks, raw photo, a, red car"


def test_template(spark):
    assert one(spark, cap.fill("{a}-{{x}}", {"a": F.lit("1")})) == "1-{x}"
    with pytest.raises(ValueError):
        cap.fill("{b}", {"a": F.lit("1")})


def test_pose(spark):
    pose = lambda left, right, nose: spark.range(1).select(cap.head_pose(F.lit("face"), *[F.lit(x).cast("double") for x in (left, right, nose)])).first()[0]
    assert pose(20, 40, 30) == "facing the camera"
    assert pose(20, 40, None) == ""
    assert pose(20, 20, 20) == "in profile"
    assert pose(20, 40, 35) == "head turned slightly to the left"
    assert pose(20, 40, 5) == "head in near profile to the right"


@pytest.mark.parametrize("padding, want", [(0.35, "portrait"), (0.75, "head and shoulders portrait"), (0.8, "upper body portrait")])
def test_shots(spark, padding, want):
    assert one(spark, cap.shot_type(F.lit("face"), padding)) == want
