"""Loss masks beside crops: mattes from plug-ins, composed to weights in numpy.

A mask is grey, of the crop's size: 255 counts in full, 0 not at all. Models are plug-ins, built
once for each Python worker: for "person" and "clothing" matte(image) gives shares from 0 to 1 of
every pixel; for "outline", outline(image, boxes) gives such a matte of the faces and the boxes
that it found no face in. Faces themselves come from the detector named FACES.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from quernstone.functions import pixels

KINDS = ("person", "clothing", "outline")
FACES = "yunet"
Box = tuple[float, float, float, float]

_models: dict[str, Callable[[], object]] = {}


def register_model(kind: str, factory: Callable[[], object]) -> None:
    if kind not in KINDS:
        raise ValueError(f"no kind of matte {kind!r}; there are {', '.join(KINDS)}")
    _models[kind] = factory


def needed(faces: bool, outline: bool, person: bool, clothing: bool) -> dict[str, Callable[[], object]]:
    """Factories of the models that these masks need; a missing one is an error on the driver."""
    kinds = [k for k, on in (("person", person), ("clothing", clothing), ("outline", faces and outline)) if on]
    missing = [k for k in kinds if k not in _models]
    if missing:
        raise ValueError(f"no model is registered for the matte of {', '.join(missing)}")
    return {k: _models[k] for k in kinds}


# The square around a face (of its larger side, and raised by a share of its height),
# the share of a box that its outline must cover, and the deviation of the feather.
HEAD, RAISED, COVER, FEATHER = 2.0, 0.1, 0.08, 0.6


@dataclass
class FaceOutline:
    """An "outline" model from a parser: parse(square image) gives the matte of all faces in it."""

    parse: Callable[[np.ndarray], np.ndarray]

    def outline(self, image: np.ndarray, boxes: Sequence[Box]) -> tuple[np.ndarray, list[Box]]:
        out, missed = np.zeros(image.shape[:2]), []
        for box in boxes:
            found = self._one(image, box)
            if found is None:
                missed.append(box)
            else:
                out = np.maximum(out, found)
        return out, missed

    def _one(self, image: np.ndarray, box: Box) -> np.ndarray | None:
        """The outline of the face in one box, in the whole image; None where the parser sees none there."""
        x, y, w, h = box
        side = max(2, int(np.ceil(HEAD * max(w, h))))
        left, top = (int(np.floor(c - side / 2)) for c in (x + w / 2, y + h / 2 - RAISED * h))
        rows, columns = (slice(max(0, a), min(n, a + side)) for a, n in ((top, image.shape[0]), (left, image.shape[1])))
        if rows.start >= rows.stop or columns.start >= columns.stop:
            return None
        matte = np.zeros(image.shape[:2])
        head = self.parse(pixels.window(image, left, top, left + side, top + side, "edge"))
        matte[rows, columns] = head[rows.start - top : rows.stop - top, columns.start - left : columns.stop - left] >= 0.5
        inside = box_person(matte.shape, box) > 0
        face = pixels.touching(matte > 0, inside)
        if not face.any() or (face & inside).sum() < COVER * inside.sum():
            return None
        face = pixels.closed(face)
        soft = np.maximum(face, pixels.blurred(pixels.dilated(face, 1).astype(np.float64), FEATHER))
        only = np.zeros_like(matte)
        only[rows, columns] = soft[rows, columns]
        return only


@dataclass
class Mask:
    weights: np.ndarray
    faces: int
    background: str | None
    clothing: float


def box_person(shape: tuple[int, int], box: Box) -> np.ndarray:
    """1 in the pixels that a box (x, y, w, h) touches, 0 elsewhere."""
    out = np.zeros(shape)
    x, y, w, h = box
    out[max(0, int(y)) : max(0, int(np.ceil(y + h))), max(0, int(x)) : max(0, int(np.ceil(x + w)))] = 1.0
    return out


def people(matte: np.ndarray, boxes: Sequence[Box]) -> tuple[np.ndarray, str]:
    """The union of the blobs that reach into a box; of the boxes themselves where none does."""
    found = [m for m in (pixels.isolated(matte, (x, y, x + w, y + h)) for x, y, w, h in boxes) if m is not None]
    kind = "outline" if found else "box"
    return np.maximum.reduce(found or [box_person(matte.shape, b) for b in boxes]), kind


def crop_mask(
    image: np.ndarray, boxes: Sequence[Box], models: dict[str, object], faces: Sequence[Box] | None,
    margin: float = 0.35, background: float = 0.1, clothing_weight: float = 0.0,
) -> Mask:
    """The mask of one crop; boxes of the detections, and of the faces to hide, in its pixels."""
    shape = image.shape[:2]
    person = kind = clothes = outline = None
    if "person" in models:
        person, kind = people(models["person"].matte(image), boxes)
    ovals = list(faces or ())
    if ovals and "outline" in models:
        outline, ovals = models["outline"].outline(image, ovals)
    if "clothing" in models:
        clothes = models["clothing"].matte(image)
    hidden = 1.0 - pixels.ovals(shape, ovals, margin) / 255.0 if ovals else None
    if outline is not None:
        hidden = outline if hidden is None else np.maximum(hidden, outline)
    weights = pixels.compose(shape, person, clothes, hidden, background, clothing_weight)
    return Mask(weights, len(faces or ()), kind, 0.0 if clothes is None else round(float((clothes >= 0.5).mean()), 3))
