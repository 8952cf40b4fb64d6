import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pytest
import stubs

from quernstone import cli
from quernstone.config import Settings
from quernstone.functions import pixels
from quernstone.operators import detection, masks
from quernstone.plans import runs
from quernstone.sources import models as fetched
from quernstone.sources import scan

detection.register_detector("stub", stubs.OneFace)


@pytest.fixture
def photos(tmp_path, monkeypatch):
    monkeypatch.setenv("PYTHONPATH", os.path.dirname(__file__))
    r = np.random.default_rng(1)
    root = tmp_path / "in"
    for name, size in (("a/x.png", 700), ("b.png", 1200), ("tiny.png", 60), ("odd.png", 33)):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(pixels.encode_png(r.integers(0, 255, (size, size, 3)).astype(np.uint8), 1))
    (root / "flat.png").write_bytes(pixels.encode_png(np.full((400, 400, 3), 9, np.uint8)))
    (root / "broken.png").write_bytes(b"no image")
    return tmp_path


def settings(**more):
    return Settings(detector="stub", min_sharpness=0.0, captioner="none", **more)


def paths(folder):
    return f"file://{folder / 'in'}", f"file://{folder / 'out'}", f"file://{folder / 'staging'}"


def test_codec_round_trip():
    r = np.random.default_rng(2)
    image = r.integers(0, 255, (17, 23, 3)).astype(np.uint8)
    assert (pixels.decode(pixels.encode_png(image)) == image).all()
    assert (pixels.decode(pixels.encode_png(image[:, :, 0]))[:, :, 1] == image[:, :, 0]).all()
    assert (pixels.decode(b"P6 # x\n23 17\n255\n" + image.tobytes()) == image).all()
    with pytest.raises(ValueError):
        pixels.decode(b"GIF89a")


@pytest.mark.parametrize("fill", ["edge", "reflect"])
def test_slice_padding_is_whole_padding(fill):
    r = np.random.default_rng(7)
    image = r.integers(0, 255, (90, 120, 3)).astype(np.uint8)
    whole = np.pad(image, ((80, 80), (80, 80), (0, 0)), fill)
    for _ in range(60):
        x, y, w, h = int(r.integers(-60, 100)), int(r.integers(-60, 70)), int(r.integers(1, 90)), int(r.integers(1, 90))
        got = pixels.window(image, x, y, x + w, y + h, fill)
        assert (got == whole[y + 80 : y + 80 + h, x + 80 : x + 80 + w]).all()


def test_blur_and_color_keep_real_pixels():
    image = np.random.default_rng(3).integers(0, 255, (40, 40, 3)).astype(np.uint8)
    for fill in ("blur", "color"):
        got = pixels.window(image, -10, -5, 40, 45, fill, (1, 2, 3))
        assert (got[5:45, 10:] == image).all() and got.shape == (50, 50, 3)
    assert (got[0, 0] == (1, 2, 3)).all()


def test_resize_and_sharpness():
    flat = np.full((50, 30, 3), 77, np.uint8)
    assert (pixels.resize(flat, 15, 25) == 77).all() and pixels.sharpness(flat) == 0
    noise = np.random.default_rng(4).integers(0, 255, (64, 64, 3)).astype(np.uint8)
    assert pixels.sharpness(noise) > pixels.sharpness(pixels.resize(pixels.resize(noise, 16, 16), 64, 64))


def test_masks():
    matte = np.zeros((20, 20))
    matte[2:8, 2:8], matte[12:18, 12:18] = 1.0, 0.9
    alone = pixels.isolated(matte, (3, 3, 4, 4))
    assert alone[2:8, 2:8].min() == 1 and alone[12:, 12:].max() == 0
    assert pixels.isolated(matte, (9, 9, 11, 11)) is None
    assert pixels.compose((20, 20), person=matte)[0, 0] == 26 and pixels.compose((20, 20), person=matte)[3, 3] == 255
    oval = pixels.ovals((100, 100), [(40, 40, 20, 20)])
    assert oval[48, 50] == 0 and oval[0, 0] == 255


def test_upright_photos():
    image = np.arange(2 * 3 * 3, dtype=np.uint8).reshape(2, 3, 3)
    body = pixels.encode_png(image)
    # how a viewer shows a stored image: flipped, turned by quarters to the right
    shown = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.transpose(1, 0, 2), 6: np.rot90(image, -1), 7: image[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(image)}
    for order, mark in ((">", b"MM"), ("<", b"II")):
        for way, want in shown.items():
            exif = mark + struct.pack(order + "HIHHHIHHI", 42, 8, 1, 0x0112, 3, 1, way, 0, 0)
            chunk = struct.pack(">I", len(exif)) + b"eXIf" + exif + struct.pack(">I", zlib.crc32(b"eXIf" + exif))
            assert np.array_equal(pixels.decode(body[:33] + chunk + body[33:]), want), way
    assert pixels.orientation(b"") == pixels.orientation(b"MM\0*\0\0\0\x08") == 1


def test_letterbox():
    out, ratio = pixels.letterbox(np.full((50, 100, 3), 9, np.uint8), 64)
    assert ratio == 0.64 and out.shape == (64, 64, 3) and (out[:32] == 9).all() and (out[32:] == 114).all()


def test_blobs_that_touch_a_seed():
    r = np.random.default_rng(6)
    for _ in range(40):
        on, seed = r.random((13, 17)) < r.choice([0.2, 0.5, 0.7]), r.random((13, 17)) < 0.02
        want = on & seed
        while True:
            wide = np.pad(want, 1)
            grown = on & np.logical_or.reduce([wide[1 + dy : 14 + dy, 1 + dx : 18 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
            if (grown == want).all():
                break
            want = grown
        assert (pixels.touching(on, seed) == want).all()


def test_face_outlines():
    image = np.full((80, 100, 3), 50, np.uint8)
    image[30:50, 40:56] = 200  # a face, and one of a neighbour
    image[5:15, 80:95] = 200
    image[38:40, 46:48] = 50  # a gap
    model = masks.FaceOutline(lambda head: (head[:, :, 0] > 100).astype(float))
    matte, missed = model.outline(image, [(38, 28, 20, 24), (2, 60, 10, 10)])
    assert missed == [(2, 60, 10, 10)] and matte[31:49, 41:55].min() == 1 and matte[:20].max() == 0
    assert 0 < matte[29, 45] < 1 and matte[26, 45] == 0
    corner, missed = model.outline(image, [(78, 0, 22, 18)])
    assert not missed and corner[6:14, 81:94].min() == 1 and corner.shape == (80, 100)
    assert model.outline(image, [(200, 200, 10, 10)])[1]


def test_crop_run_and_captions(spark, photos):
    spark.sparkContext.addPyFile(stubs.__file__)
    root, output, staging = paths(photos)
    assert runs.crop_run(spark, settings(dry_run=True), root, output, staging)["written"] == 2
    assert not (photos / "out").exists()
    stats = runs.crop_run(spark, settings(), root, output, staging)
    assert (stats["scanned"], stats["written"], stats["too_small"], stats["no_detection"], stats["error"]) == (6, 2, 1, 1, 2)
    assert stats["by_tier"] == {256: 1, 512: 1} or stats["by_tier"] == {512: 1, 256: 1}
    lines = [json.loads(x) for x in (photos / "out/manifest.jsonl").read_text().splitlines()]
    assert [(x["index"], x["source"], x["image_file"]) for x in lines] == [(1, "b.png", "0001.png"), (2, "a/x.png", "0002.png")]
    assert pixels.decode((photos / "out/0001.png").read_bytes()).shape == (512, 512, 3)
    assert {x["reason"] for x in json.loads((photos / "out/manifest.json").read_text())["skipped"]} == {"too_small", "no_detection", "error"}
    with pytest.raises(FileExistsError):
        runs.crop_run(spark, settings(), root, output, staging)
    (photos / "in/c.png").write_bytes((photos / "in/b.png").read_bytes())
    assert runs.crop_run(spark, settings(resume=True), root, output, staging)["written"] == 1
    lines = [json.loads(x) for x in (photos / "out/manifest.jsonl").read_text().splitlines()]
    assert [(x["index"], x["source"]) for x in lines] == [(1, "b.png"), (2, "a/x.png"), (3, "c.png")]

    assert runs.training_run(spark, settings(), output) == {"resolution": "256", "epochs": 300, "batch_size": 2, "masked_training": False}
    assert runs.training_run(spark, settings(), output, {"resolution": "512", "batch_size": 4, "rate": 1e-4}) == {"resolution": "256", "epochs": 300, "batch_size": 4, "rate": 1e-4, "masked_training": False}

    runs.register_captioner("template", stubs.Captioner)
    own = Settings(captioner="template", trigger="sks")
    assert runs.caption_run(spark, own, output, staging) == 2
    assert (photos / "out/0001.txt").read_text() == "sks, a Red dot\n"
    assert not (photos / "out/0002.txt").exists()
    assert runs.caption_run(spark, own, output, staging) == 0
    with pytest.raises(ValueError):
        runs.caption_run(spark, Settings(captioner="template", caption_only=True, caption_images=("none.png",)), output, staging)

    os.remove(photos / "out/manifest.jsonl")
    assert runs.rebuild_run(spark, output, staging) == 3
    rows = [json.loads(x) for x in (photos / "out/manifest.jsonl").read_text().splitlines()]
    assert all(x["recovered"] for x in rows) and "dot" in rows[0]["caption"]
    with pytest.raises(FileExistsError):
        runs.rebuild_run(spark, output, staging)


def test_overwrite_removes_only_its_own_files(spark, photos):
    spark.sparkContext.addPyFile(stubs.__file__)
    root, output, staging = paths(photos)
    runs.crop_run(spark, settings(prefix="old"), root, output, staging)
    (photos / "out/mine.png").write_bytes(b"1")
    runs.crop_run(spark, settings(overwrite=True), root, output, staging)
    assert {p.name for p in (photos / "out").glob("*.png")} == {"mine.png", "0001.png", "0002.png"}
    (photos / "out/manifest.jsonl").write_text((photos / "out/manifest.jsonl").read_text().replace("0001.png", "../in/b.png"))
    (photos / "out/.manifest.jsonl.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        runs.overwrite(spark, output)
    assert (photos / "in/b.png").exists()


def lines_of(folder):
    return [json.loads(x) for x in (folder / "manifest.jsonl").read_text().splitlines()]


@pytest.fixture
def models(spark):
    spark.sparkContext.addPyFile(stubs.__file__)
    masks.register_model("person", stubs.Person)
    masks.register_model("clothing", stubs.Clothing)
    masks.register_model("outline", stubs.Outline)
    detection.register_detector("yunet", stubs.FewFaces)
    detection.register_detector("body", stubs.Body)


def body(**more):
    return Settings(detector="body", min_sharpness=0.0, captioner="none", sizes=(256,), **more)


def test_background_and_clothing_masks(spark, photos, models):
    root, output, staging = paths(photos)
    runs.crop_run(spark, body(mask_background=True, mask_clothing=True, background_weight=0.2, clothing_weight=0.5), root, output, staging)
    rows = lines_of(photos / "out")
    assert [(r["source"], r["mask_file"], r["mask_dir"], r["background_mask"]) for r in rows] == [("b.png", "0001-masklabel.png", None, "outline"), ("a/x.png", "0002-masklabel.png", None, "outline")]
    assert all(r["masked_clothing"] == 0.25 and r["masked_faces"] == 0 for r in rows)
    mask = pixels.decode((photos / "out/0001-masklabel.png").read_bytes())[:, :, 0]
    # the person is the middle half, clothes its lower half; a second blob away from the box is background
    assert mask.shape == (256, 256) and mask[100, 128] == 255 and mask[160, 128] == 128 and mask[4, 4] == 51 and mask[128, 4] == 51


def test_masks_in_a_folder_of_their_own_and_boxes_without_a_matte(spark, photos, models):
    masks.register_model("person", stubs.Nobody)
    root, output, staging = paths(photos)
    runs.crop_run(spark, body(mask_background=True, mask_dir=photos / "masks"), root, output, staging)
    rows = lines_of(photos / "out")
    assert [(r["mask_file"], r["mask_dir"], r["background_mask"]) for r in rows] == [(f"000{k}.png", str(photos / "masks"), "box") for k in (1, 2)]
    mask = pixels.decode((photos / "masks/0001.png").read_bytes())[:, :, 0]
    assert mask[128, 128] == 255 and mask[2, 2] == 26 and not list((photos / "out").glob("*masklabel*"))


@pytest.mark.parametrize("face_mask", ["oval", "outline"])
def test_face_masks_and_crops_without_a_face(spark, photos, models, face_mask):
    root, output, staging = paths(photos)
    stats = runs.crop_run(spark, body(mask_faces=True, face_mask=face_mask), root, output, staging)
    assert (stats["written"], stats["no_face"]) == (1, 1)
    (row,) = lines_of(photos / "out")
    assert row["masked_faces"] == 1 and row["source"] == "b.png"
    mask = pixels.decode((photos / "out/0001-masklabel.png").read_bytes())[:, :, 0]
    assert mask[128, 128] == 0 and mask[2, 250] == 255
    stats = runs.crop_run(spark, body(mask_faces=True, face_mask=face_mask, mask_missing="keep", overwrite=True), root, output, staging)
    assert (stats["written"], stats["no_face"]) == (2, 0)
    white = pixels.decode((photos / "out/0002-masklabel.png").read_bytes())
    assert (white == 255).all() and [r["masked_faces"] for r in lines_of(photos / "out")] == [1, 0]


def test_masks_need_their_models(spark, photos, monkeypatch):
    monkeypatch.setattr(masks, "_models", {})
    with pytest.raises(ValueError, match="person"):
        runs.crop_run(spark, settings(mask_background=True), *paths(photos))


def test_landmarks_and_the_detectors_offset(spark, photos, models):
    root, output, staging = paths(photos)
    runs.crop_run(spark, body(), root, output, staging)
    row = lines_of(photos / "out")[0]
    assert row["landmarks"] == {"nose": [600.1, 300.0]} and row["offset_y"] == -0.1
    runs.crop_run(spark, body(offset_y=0.0, overwrite=True), root, output, staging)
    other = lines_of(photos / "out")[0]
    assert other["offset_y"] == 0.0 and other["crop"][1] > row["crop"][1]


def test_output_below_the_input_is_no_input(spark, photos, models):
    root, _, staging = paths(photos)
    output = f"{root}/made"
    assert runs.crop_run(spark, body(), root, output, staging)["scanned"] == 6
    os.remove(photos / "in/made/manifest.jsonl")
    with pytest.raises(FileExistsError, match="0001.png"):
        runs.crop_run(spark, body(), root, output, staging)
    assert len(list((photos / "in/made").glob("*.png"))) == 2


def test_enlarged_crops(spark, photos, models, monkeypatch):
    monkeypatch.setattr(runs, "_upscalers", [stubs.Twice])
    root, output, staging = paths(photos)
    runs.crop_run(spark, Settings(detector="body", min_sharpness=0.0, captioner="none", sizes=(1024,), min_ratio=0.5, padding=0.0, upscale=True), root, output, staging)
    (row,) = lines_of(photos / "out")
    assert (row["source"], row["tier"], row["fitted_side"]) == ("b.png", 1024, 600.0)
    assert pixels.decode((photos / "out/0001.png").read_bytes()).shape == (1024, 1024, 3)


def test_command(spark, photos, models, capsys, monkeypatch):
    monkeypatch.setattr(runs, "_captioners", {})
    folder = ["--input", str(photos / "in"), "--output", str(photos / "out")]
    heard = []
    flags = [*folder, "--detector", "body", "--min-sharpness", "0", "--captioner", "template", "--sizes", "256", "--training-config"]
    assert cli.main(flags, spark, lambda level, message: heard.append(level)) == 1  # one photo cannot be read
    assert {p.name for p in (photos / "out").iterdir() if p.suffix != ".crc"} == {"0001.png", "0001.txt", "0002.png", "0002.txt", "manifest.json", "manifest.jsonl", "training_config.json"}
    assert {"info", "progress", "warn"} <= {*heard}
    assert cli.main(flags, spark) == 2 and "resume or overwrite" in capsys.readouterr().err
    os.remove(photos / "in/broken.png")
    assert cli.main([*flags, "--overwrite"], spark) == 0
    out = capsys.readouterr().out
    assert "5  images scanned" in out and "2  crops written" in out and "2  captions written" in out and "2  crops of 256" in out
    assert cli.main([*folder, "--detector", "none such"], spark) == 2
    assert cli.main([*folder, "--detector", "none such", "--overwrite"], spark) == 1
    assert cli.main([*folder, "--digits", "0"], spark) == 2 and cli.main(["--version"]) == 0 and cli.main(["--list-models"]) == 0
    monkeypatch.setattr(cli, "run", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    assert cli.main(folder, spark) == 130
    assert cli.presets(spark).count() == len(cli.PRESETS)


def test_formats_need_an_encoder(spark, photos, models):
    with pytest.raises(NotImplementedError, match="jpg"):
        runs.crop_run(spark, body(format="jpg"), *paths(photos))


def test_captions_without_a_model(spark, photos, models, monkeypatch):
    monkeypatch.setattr(runs, "_captioners", {})
    root, output, staging = paths(photos)
    runs.crop_run(spark, body(), root, output, staging)
    assert runs.caption_run(spark, Settings(captioner="none"), output, staging) == 0
    with pytest.raises(ValueError, match="vlm"):
        runs.caption_run(spark, Settings(), output, staging)
    assert runs.caption_run(spark, Settings(captioner="template", trigger="sks"), output, staging) == 2
    assert (photos / "out/0001.txt").read_text() == "sks, full body shot, even lighting, muted desaturated colors\n"
    assert runs.caption_run(spark, Settings(captioner="template", caption_template="{label} {index} at {tier} of {source}"), output, staging) == 0
    os.remove(photos / "out/0002.txt")
    assert runs.caption_run(spark, Settings(captioner="template", caption_template="{label} {index} at {tier} of {source}"), output, staging) == 1
    assert (photos / "out/0002.txt").read_text() == "person 2 at 256 of a/x.png\n"


def test_whole_photos(spark, photos):
    root, output, staging = paths(photos)
    stats = runs.crop_run(spark, settings(skip_detection=True), root, output, staging)
    assert stats["written"] == 5 and stats["error"] == 1 and stats["too_small"] == 0  # without detection, any size is its own tier
    stats = runs.crop_run(spark, settings(skip_detection=True, keep_size=True, overwrite=True), root, output, staging)
    assert stats["written"] == 3 and stats["too_small"] == 2


def test_enlarging_without_a_model_is_refused(spark, photos):
    with pytest.raises(NotImplementedError, match="upscale"):
        runs.crop_run(spark, settings(upscale=True), *paths(photos))
    assert not (photos / "out").exists()


@pytest.mark.parametrize("follow, sources", [(False, ["b.png", "z.png", "a/x.png"]), (True, ["b.png", "z.png", "a/x.png", "link/y.png"])])
def test_symbolic_links(spark, photos, models, follow, sources):
    root, output, staging = paths(photos)
    (photos / "other").mkdir()
    (photos / "other/y.png").write_bytes((photos / "in/b.png").read_bytes())
    (photos / "in/link").symlink_to(photos / "other")
    (photos / "in/z.png").symlink_to(photos / "other/y.png")
    (photos / "in/a/loop").symlink_to(photos / "in")
    (photos / "other/again").symlink_to(photos / "in/a")
    runs.crop_run(spark, body(follow_symlinks=follow), root, output, staging)
    assert [r["source"] for r in lines_of(photos / "out")] == sources
    assert scan.walked("s3a://bucket/x", follow) is None and scan.walked(output, follow) is None


def test_model_files(tmp_path):
    (tmp_path / "far").mkdir()
    (tmp_path / "far/m.onnx").write_bytes(b"weights")
    url, good = (tmp_path / "far/m.onnx").as_uri(), hashlib.sha256(b"weights").hexdigest()
    with pytest.raises(ValueError, match="sum"):
        fetched.fetch(url, "0" * 64, tmp_path / "near")
    assert list((tmp_path / "near").iterdir()) == []
    assert fetched.fetch(url, good, tmp_path / "near").read_bytes() == b"weights"
    (tmp_path / "far/m.onnx").write_bytes(b"others")
    assert fetched.fetch(url, good, tmp_path / "near").read_bytes() == b"weights"
    (tmp_path / "near/m.onnx").unlink()
    with pytest.raises(ValueError, match="sum"):
        fetched.fetch(url, good, tmp_path / "near")


def test_channels_of_a_detector():
    class First:
        bgr = True

        def detect(self, image):
            return image[0, 0].tolist()

    image = np.array([[[1, 2, 3]]], np.uint8)
    assert detection.regions_in(First(), image) == [3, 2, 1]
    First.bgr = False
    assert detection.regions_in(First(), image) == [1, 2, 3]
