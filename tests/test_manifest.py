import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import detection, manifest, numbering
from quernstone.sources import manifest as files
from quernstone.sources import scan
from quernstone.streaming import incremental


def row(index, **more):
    base = {name: None for name in files.FIELDS} | {"index": index, "source": f"s{index}", "image_file": f"{index:04d}.png", "tier": 512, "label": "face", "score": 0.9, "base_side": 1.0, "fitted_side": 1.0, "scale": 1.0, "sharpness": 1.0, "padding": 0.2, "offset_y": 0.0, "crop": [0.0, 0.0, 1.0, 1.0], "clamped": False, "extended": False, "face_index": 0, "faces_in_image": 1}
    return base | more


def write(path, lines, end="\n"):
    path.write_text("\n".join(lines) + end)
    return f"file://{path}"


def test_fields():
    assert len(files.FIELDS) == 26 and files.FIELDS[files.REQUIRED - 1] == "faces_in_image"


def test_read_keeps_defaults_and_skips_blank_lines(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [json.dumps(row(1, extra="x")), "", json.dumps(row(2))])
    got = files.read(spark, path).orderBy("index").collect()
    assert [r["index"] for r in got] == [1, 2] and got[0].landmarks == {} and got[0].caption == "" and got[0].recovered is False


def test_torn_last_line_is_left_out(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [json.dumps(row(1)), '{"index": 2, "sou'], end="")
    assert [r["index"] for r in files.read(spark, path).collect()] == [1]


@pytest.mark.parametrize("lines", [["{broken", json.dumps(row(1))], [json.dumps(row(1)), "{broken"], ["[1]"], [json.dumps(row(1, tier=None))]])
def test_broken_rows_are_errors(spark, tmp_path, lines):
    with pytest.raises(files.ManifestError):
        files.read(spark, write(tmp_path / "m.jsonl", lines))


def test_replace_orders_and_keeps_nulls(spark, tmp_path):
    path = write(tmp_path / "m.jsonl", [json.dumps(row(k)) for k in (3, 1, 2)])
    files.replace(spark, files.read(spark, path), path)
    lines = [json.loads(x) for x in (tmp_path / "m.jsonl").read_text().splitlines()]
    assert [x["index"] for x in lines] == [1, 2, 3] and lines[0]["mask_file"] is None and list(lines[0]) == files.FIELDS


def test_resume(spark):
    log = spark.createDataFrame([("a", 0, 2, 4), ("a", 1, 2, 5), ("b", 0, 2, 6), ("c", None, None, 7), ("d", 5, 2, 8)], "source string, face_index int, faces_in_image int, index long")
    state = {r.source: r.done for r in manifest.resume_state(log).collect()}
    assert state == {"a": True, "b": False, "c": True, "d": False}
    assert manifest.next_index(log).first()[0] == 9
    assert manifest.next_index(log.where("false"), 7).first()[0] == 7
    sources = spark.createDataFrame([("a",), ("b",), ("e",)], "source string")
    assert {r.source for r in manifest.remaining(sources, log).collect()} == {"b", "e"}


@pytest.mark.parametrize("path, out", [("a/b.png", False), ("../x", True), ("a/../../x", True), ("a/../x", False), ("/etc/x", True), ("./a", False)])
def test_paths_that_leave(spark, path, out):
    assert spark.createDataFrame([(path,)], "p string").select(manifest.escapes(F.col("p"))).first()[0] is out


def test_numbers_are_contiguous_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = numbering.number(df.repartition(7), ["k"], start=5).collect()
    assert sorted((r.k, r["index"]) for r in rows) == [(k, k + 5) for k in range(1000)]
    assert numbering.number(df.where("false"), ["k"]).count() == 0


def test_long_numbers_are_not_cut(spark):
    assert spark.range(1).select(numbering.padded(F.lit(123456), 4)).first()[0] == "123456"


def test_training_config(spark):
    crops = lambda n: spark.range(n).select(F.lit(512).alias("tier"), F.lit(None).cast("string").alias("mask_file"), F.lit(None).cast("string").alias("mask_dir"))
    for n, epochs in ((30, 267), (1, 300), (500, 16), (2000, 10)):
        assert numbering.training_config(crops(n), (512,)).first().epochs == epochs
    assert numbering.training_config(crops(0), (512,)).count() == 0
    assert numbering.training_config(crops(3), (256,)).first().resolution is None


def test_scan(spark, tmp_path):
    for name in ("b.png", "a/z.PNG", "a/b/c.jpg", "a/.h/x.png", "a/.x.png", "a/0001-masklabel.png", "a/t.txt", "done/x.png", "done/manifest.jsonl", "out/y.png", "ex/q.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    rows = scan.scan(spark, f"file://{tmp_path}", exclude=["ex"], skip=["out"])
    assert [r.path for r in rows.orderBy(scan.walk_key(F.col("path"))).collect()] == ["b.png", "a/z.PNG", "a/b/c.jpg"]
    assert [r.path for r in scan.scan(spark, f"file://{tmp_path}", exclude=["*.jpg"], skip=["out", "ex"], limit=1).collect()] == ["b.png"]


def test_suppression(spark):
    rows = [(1, "face", 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, "face", 1, 1.0, 1.0, 10.0, 10.0, 0.8), (1, "face", 2, 50.0, 50.0, 10.0, 10.0, 0.7), (1, "dog", 3, 1.0, 1.0, 10.0, 10.0, 0.6)]
    df = spark.createDataFrame(rows, "image_id int, label string, det int, x double, y double, w double, h double, score double")
    assert sorted(r.det for r in detection.suppress(df).collect()) == [0, 2, 3]


def test_unknown_detectors():
    with pytest.raises(ValueError):
        detection.detector("none such")


def test_stream_appends_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    write(source / "a.json", [json.dumps(row(1)), json.dumps(row(1))])
    for _ in range(2):
        incremental.append(incremental.rows(spark, f"file://{source}"), f"file://{target}", f"file://{tmp_path / 'cp'}")
    write(source / "b.json", [json.dumps(row(2))])
    incremental.append(incremental.rows(spark, f"file://{source}"), f"file://{target}", f"file://{tmp_path / 'cp'}")
    assert sorted(r["index"] for r in spark.read.parquet(f"file://{target}").collect()) == [1, 2]


def test_statistics_in_one_join_equal_those_of_three_tables(spark):
    images = spark.createDataFrame([(k,) for k in range(6)], "image_id long")
    fates = spark.createDataFrame([(0, "written", True), (0, "written", False), (1, "blurry", True), (2, "too_small", None), (2, "written", False), (3, "no_face", False)], "image_id long, fate string, clamped boolean")
    crops = fates.where("fate = 'written'")
    skips = fates.where("fate <> 'written'").select(F.col("fate").alias("reason")).unionAll(spark.createDataFrame([("no_detection",)] * 2, "reason string"))
    assert numbering.stats_of_fates(images, fates).collect() == numbering.run_stats(crops, skips, images).collect()
    assert numbering.stats_of_fates(images.where("false"), fates.where("false")).first().asDict() == numbering.run_stats(crops.where("false"), skips.where("false"), images.where("false")).first().asDict()
