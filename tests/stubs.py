"""Plug-ins for the tests; a module of its own so that workers can import it."""


class OneFace:
    """A face in the middle of every image; images of one colour have none."""

    offset_y = 0.0

    def detect(self, image):
        h, w = image.shape[:2]
        if w == h == 33:
            raise ValueError("a detector's error")
        if image.min() == image.max():
            return []
        return [{"x": w / 4, "y": h / 4, "w": w / 2, "h": h / 2, "score": 0.9, "label": "face", "landmarks": {}}]


class Body:
    """A person in the middle half of every square image of some size."""

    offset_y = -0.1

    def detect(self, image):
        h, w = image.shape[:2]
        if w < 100 or image.min() == image.max():
            return []
        return [{"x": w / 4, "y": h / 4, "w": w / 2, "h": h / 2, "score": 0.9, "label": "person", "landmarks": {"nose": {"x": w / 2 + 0.06, "y": h / 4}}}]


class FewFaces:
    """A face in the middle of crops that are nowhere bright red."""

    offset_y = 0.0

    def detect(self, image):
        return [{"x": 112.0, "y": 112.0, "w": 32.0, "h": 32.0, "score": 0.9, "label": "face", "landmarks": {}}] if image[:, :, 0].max() < 250 else []


class Person:
    """The middle half of a crop, and a blob in its corner."""

    def matte(self, image):
        import numpy as np

        out = np.zeros(image.shape[:2])
        h, w = out.shape
        out[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4] = 1.0
        out[: h // 16, : w // 16] = 0.9
        return out


class Nobody:
    def matte(self, image):
        import numpy as np

        return np.zeros(image.shape[:2])


class Clothing:
    """The third quarter of the rows."""

    def matte(self, image):
        import numpy as np

        out = np.zeros(image.shape[:2])
        out[len(out) // 2 : 3 * len(out) // 4] = 1.0
        return out


class Outline:
    """The first box as it is; others are left to ovals."""

    def outline(self, image, boxes):
        import numpy as np

        out = np.zeros(image.shape[:2])
        x, y, w, h = map(int, boxes[0])
        out[y : y + h, x : x + w] = 1.0
        return out, boxes[1:]


class Twice:
    def enlarge(self, image):
        return image.repeat(2, axis=0).repeat(2, axis=1)


class Captioner:
    def __init__(self, settings):
        pass

    def describe(self, requests):
        if any(r["image_file"].startswith("0002") for r in requests):
            if len(requests) > 1:
                raise ValueError("one bad crop")
            return [""]
        return ["This image shows a Red dot, a red dot"] * len(requests)
