from pathlib import Path

import pytest

from quernstone import config
from quernstone.config import Settings, SettingsError


def test_defaults_are_sound():
    assert Settings().problems() == [] and Settings().checked() == Settings()


@pytest.mark.parametrize("values, about", [
    ({"padding": -1.0}, "padding"), ({"min_ratio": 0.0}, "min_ratio"), ({"multi": "some"}, "multi"), ({"quality": 0}, "quality"), ({"limit": -1}, "limit"),
    ({"sizes": ()}, "sizes"), ({"offset_x": float("nan")}, "offset_x"), ({"caption_drop": ("(",)}, "caption_drop"), ({"no_crop": True, "keep_size": True}, "no_crop"),
    ({"overwrite": True, "resume": True}, "overwrite"), ({"mask_faces": True}, "mask_faces"), ({"mask_dir": Path("./dataset/m")}, "mask_dir"), ({"caption_images": ("a",)}, "caption_images"),
    ({"captioner": "template", "caption_template": "{nope}"}, "caption_template"), ({"rebuild_manifest": True, "limit": 1}, "rebuild_manifest"), ({"fill_color": (1, 2, 300)}, "fill_color"),
    ({"mask_background": True, "detector": "yolox", "detector_opts": {"classes": "dog"}}, "mask_background"), ({"max_side": 1}, "max_side"),
    ({"mask_clothing": True, "detector": "yolox", "detector_opts": {"classes": ["cat", " Dog "]}}, "mask_clothing"), ({"detector": "yolox", "detector_opts": {"classes": 3}}, "detector_opts"),
])
def test_problems(values, about):
    assert any(p.startswith(about) for p in Settings(**values).problems())


@pytest.mark.parametrize("values", [
    {"mask_background": True}, {"mask_clothing": True, "detector": "haar"}, {"mask_background": True, "detector": "mine", "detector_opts": {"classes": "dog"}},
    {"mask_background": True, "detector": "yolox"}, {"mask_background": True, "detector": "yolox", "detector_opts": {"classes": "dog, Person"}}, {"mask_faces": True, "detector": "yolox"},
    {"mask_background": True, "detector": "yolox", "detector_opts": {"classes": " ,"}}, {"mask_clothing": True, "detector": "yolox", "detector_opts": {"classes": ("all",)}}, {"mask_faces": True, "no_crop": True},
])
def test_masks_that_fit_their_detector(values):
    assert Settings(**values).problems() == []


def test_all_problems_at_once():
    with pytest.raises(SettingsError) as error:
        Settings(padding=-1.0, multi="x", digits=0).checked()
    assert len(error.value.problems) == 3


def test_toml(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('[quernstone]\npadding = 30\nmin-score = 1\nsizes = [512]\ndetector_opts = {a = 1}\n')
    got = config.from_toml(file)
    assert (got.padding, got.min_score, got.sizes, got.detector_opts) == (0.3, 1.0, (512,), {"a": 1})
    for bad in ("nope = 1", "limit = true", "sizes = 5"):
        file.write_text(bad)
        with pytest.raises(SettingsError):
            config.from_toml(file)


def test_flags_over_file(tmp_path):
    file = tmp_path / "c.toml"
    file.write_text('min_score = 0.3\ndigits = 6\ndetector_opts = {a = 1, b = 2}\n')
    got = config.from_arguments(["--config", str(file), "--input", str(tmp_path), "--min-score", "0.5", "--sizes", "512,256,512", "--detector-opt", "b=true", "--fill-color", "1,2,999", "--no-crop"])
    assert (got.min_score, got.digits, got.sizes, got.detector_opts, got.fill_color, got.no_crop) == (0.5, 6, (256, 512), {"a": 1, "b": True}, (1, 2, 255), True)


def test_input_and_output(tmp_path):
    with pytest.raises(SettingsError):
        config.from_arguments(["--input", str(tmp_path), "--output", str(tmp_path)])
    with pytest.raises(SettingsError):
        config.from_arguments(["--input", str(tmp_path / "none")])
