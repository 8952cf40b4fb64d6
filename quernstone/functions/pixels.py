"""Pixels of one image in numpy: a PNG and PNM codec, cropping, filling, resizing, sharpness, masks."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """8-bit grey (h, w) or colour (h, w, 3)."""
    image = np.ascontiguousarray(image, np.uint8)
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG without their prediction; raw is (rows, 1 + bytes)."""
    out = np.zeros((len(raw) + 1, raw.shape[1] - 1), np.int32)
    for y, line in enumerate(raw, 1):
        kind, line = line[0], line[1:].astype(np.int32)
        above = out[y - 1]
        if kind == 0:
            out[y] = line
        elif kind == 1:
            for k in range(step):
                out[y, k::step] = np.cumsum(line[k::step]) & 255
        elif kind == 2:
            out[y] = (line + above) & 255
        else:
            for x in range(len(line)):
                left = out[y, x - step] if x >= step else 0
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    corner = above[x - step] if x >= step else 0
                    p = left + above[x] - corner
                    guess = min(((abs(p - left), 0, left), (abs(p - above[x]), 1, above[x]), (abs(p - corner), 2, corner)))[2]
                out[y, x] = (line[x] + guess) & 255
    return out[1:].astype(np.uint8)


def decode(content: bytes) -> np.ndarray:
    """An RGB image (h, w, 3) of an 8-bit PNG without interlacing, upright, or of a binary PGM or PPM."""
    if content[:8] == SIGNATURE:
        at, body, head, palette, way = 8, b"", None, None, 1
        while at + 8 <= len(content):
            (size,), kind = struct.unpack(">I", content[at : at + 4]), content[at + 4 : at + 8]
            part = content[at + 8 : at + 8 + size]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", part)
            elif kind == b"PLTE":
                palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += part
            elif kind == b"eXIf":
                way = orientation(part)
            at += 12 + size
        if head is None or head[2] != 8 or head[6]:
            raise ValueError("only 8-bit PNG without interlacing can be read")
        w, h, kind = head[0], head[1], head[3]
        n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
        pixels = _unfiltered(np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n), n).reshape(h, w, n)
        if kind == 3:
            return turned(palette[pixels[:, :, 0]], way)
        return turned(np.repeat(pixels[:, :, :1], 3, axis=2) if n < 3 else pixels[:, :, :3], way)
    if content[:2] in (b"P5", b"P6"):
        fields, at = [], 2
        while len(fields) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while not content[end : end + 1].isspace():
                end += 1
            fields.append(int(content[at:end]))
            at = end
        n = 3 if content[:2] == b"P6" else 1
        pixels = np.frombuffer(content, np.uint8, fields[0] * fields[1] * n, at + 1).reshape(fields[1], fields[0], n)
        return np.repeat(pixels, 3, axis=2) if n == 1 else pixels
    raise ValueError("no format that can be read")


def _weights(size: int, out: int) -> np.ndarray:
    """Rows of Lanczos weights (3 lobes) from `size` to `out` samples."""
    scale = max(1.0, size / out)
    centre = (np.arange(out) + 0.5) * size / out - 0.5
    x = (np.arange(size)[None, :] - centre[:, None]) / scale
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    rows = np.tensordot(_weights(image.shape[0], height), image.astype(np.float64), (1, 0))
    both = np.tensordot(_weights(image.shape[1], width), rows, (1, 1))
    return np.clip(np.rint(np.moveaxis(both, 0, 1)), 0, 255).astype(np.uint8)


def blurred(image: np.ndarray, radius: float) -> np.ndarray:
    """A Gaussian of that deviation, edges repeated."""
    reach = max(1, int(3 * radius))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    kernel /= kernel.sum()
    out = image.astype(np.float64)
    for axis in (0, 1):
        pad = [(reach, reach) if a == axis else (0, 0) for a in range(out.ndim)]
        wide = np.pad(out, pad, "edge")
        out = sum(k * np.take(wide, np.arange(i, i + image.shape[axis]), axis) for i, k in enumerate(kernel))
    return out


def window(image: np.ndarray, left: int, top: int, right: int, bottom: int, fill: str = "blur", color: tuple[int, ...] = (0, 0, 0)) -> np.ndarray:
    """The pixels of a window that may reach outside; only the part that is needed is padded."""
    h, w = image.shape[:2]
    x0, x1, y0, y1 = (int(np.clip(v, 0, n)) for v, n in ((left, w), (right, w), (top, h), (bottom, h)))
    inside = image[y0:y1, x0:x1]
    if (x0, x1, y0, y1) == (left, right, top, bottom):
        return inside
    rows, columns = np.arange(top, bottom), np.arange(left, right)
    real = ((rows >= 0) & (rows < h))[:, None] & ((columns >= 0) & (columns < w))[None, :]
    if fill == "color":
        out = np.empty((bottom - top, right - left, 3), np.uint8)
        out[:] = color
        out[real] = inside.reshape(-1, 3)
        return out

    def place(k: np.ndarray, n: int) -> np.ndarray:
        over = max(int(-k.min()), int(k.max()) - n + 1)
        if fill == "reflect" and over < n:
            return np.where(k < 0, -k, np.where(k >= n, 2 * n - 2 - k, k))
        return np.clip(k, 0, n - 1)

    out = image[place(rows, h)[:, None], place(columns, w)[None, :]]
    if fill == "blur":
        soft = np.clip(np.rint(blurred(out, max(4, min(out.shape[:2]) // 24))), 0, 255).astype(np.uint8)
        soft[real] = out[real]
        return soft
    return out


def luma(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def sharpness(image: np.ndarray, fraction: float = 1.0) -> float:
    """Variance of the Laplacian of luma over the central window, mirrored at its border."""
    h, w = image.shape[:2]
    my, mx = int(h * (1 - fraction) / 2), int(w * (1 - fraction) / 2)
    grey = np.rint(luma(image[my : h - my, mx : w - mx]))
    wide = np.pad(grey, 1, "reflect") if min(grey.shape) > 1 else np.pad(grey, 1, "edge")
    return float((wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * grey).var())


def isolated(matte: np.ndarray, box: tuple[float, float, float, float], least: float = 0.5) -> np.ndarray | None:
    """The matte where 8-connected blobs of at least `least` touch the box, or None."""
    on = matte >= least
    x, y, x2, y2 = box
    seed = np.zeros_like(on)
    seed[max(0, int(y)) : max(0, int(np.ceil(y2))), max(0, int(x)) : max(0, int(np.ceil(x2)))] = True
    reached = touching(on, seed)
    if not reached.any():
        return None
    # a hair more, so that the soft edge of the matte stays
    return np.where(dilated(reached, max(1, min(on.shape) // 100)), matte, 0.0)


def touching(on: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The 8-connected blobs that have a pixel in the seed: runs of rows are joined, not pixels."""
    h, w = on.shape
    edge = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]  # one past the run
    root = np.arange(len(row))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    starts = np.searchsorted(row, np.arange(h + 1))
    for r in range(1, h):
        i, j = starts[r - 1], starts[r]
        while i < starts[r] and j < starts[r + 1]:
            if first[i] <= last[j] and first[j] <= last[i]:  # corners touch as well
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    wanted = {find(k) for k in range(len(row)) if seed[row[k], first[k] : last[k]].any()}
    out = np.zeros_like(on)
    for k in range(len(row)):
        if find(k) in wanted:
            out[row[k], first[k] : last[k]] = True
    return out


def closed(on: np.ndarray) -> np.ndarray:
    """Grown by a pixel to each side and shrunk again: small gaps close."""
    return ~dilated(~np.pad(dilated(np.pad(on, 2), 1), 1, constant_values=False), 1)[3:-3, 3:-3]


def letterbox(image: np.ndarray, side: int = 640, grey: int = 114) -> tuple[np.ndarray, float]:
    """(the image in the upper left of a grey square, in its shape; its scale there)."""
    h, w = image.shape[:2]
    ratio = min(side / h, side / w)
    wide, high = max(1, int(w * ratio)), max(1, int(h * ratio))
    out = np.full((side, side, 3), grey, np.uint8)
    out[:high, :wide] = resize(image, wide, high)
    return out, ratio


def turned(image: np.ndarray, orientation: int) -> np.ndarray:
    """Upright, by the orientation (1 to 8) that a camera noted."""
    if orientation in (2, 4, 5, 7):
        image = image[:, ::-1]
    return np.ascontiguousarray(np.rot90(image, {3: 2, 4: 2, 5: 1, 6: 3, 7: 3, 8: 1}.get(orientation, 0)))


def orientation(exif: bytes) -> int:
    """The orientation of an EXIF block (a TIFF header and its first directory); 1 where it has none."""
    order = {b"II": "<", b"MM": ">"}.get(exif[:2])
    if order is None or len(exif) < 10:
        return 1
    (at,) = struct.unpack(order + "I", exif[4:8])
    (n,) = struct.unpack(order + "H", exif[at : at + 2]) if at + 2 <= len(exif) else (0,)
    for k in range(n):
        entry = exif[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def dilated(on: np.ndarray, radius: int) -> np.ndarray:
    """Grown by a disc of that radius."""
    h, w = on.shape
    wide, out = np.pad(on, radius), np.zeros_like(on)
    for dy in range(-radius, radius + 1):
        reach = int(round(np.sqrt(radius * radius - dy * dy)))
        for dx in range(-reach, reach + 1):
            out |= wide[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    return out


def compose(shape: tuple[int, int], person: np.ndarray | None = None, clothing: np.ndarray | None = None, face: np.ndarray | None = None, background: float = 0.1, clothing_weight: float = 0.0) -> np.ndarray:
    """Loss weights 0 to 255 of a crop."""
    weights = np.ones(shape)
    for matte, least in ((person, None), (clothing, clothing_weight), (face, 0.0)):
        if matte is not None:
            unit = np.clip(matte, 0.0, 1.0)
            weights = np.minimum(weights, background + (1 - background) * unit if least is None else 1 - (1 - least) * unit)
    return np.rint(weights * 255).astype(np.uint8)


def ovals(shape: tuple[int, int], boxes: list[tuple[float, float, float, float]], margin: float = 0.35, lift: float = 0.12) -> np.ndarray:
    """0 in an ellipse around each box (x, y, w, h), feathered outward, 255 elsewhere."""
    out = np.full(shape, 255.0)
    if not boxes:
        return out.astype(np.uint8)
    radius = 0.08 * max(max(w, h) for _, _, w, h in boxes)
    row, column = np.mgrid[: shape[0], : shape[1]]
    for x, y, w, h in boxes:
        side = max(w, h)
        rx, ry = w / 2 + margin * side + radius, h / 2 + margin * side + radius
        inside = ((column + 0.5 - x - w / 2) / rx) ** 2 + ((row + 0.5 - y - h / 2 + lift * h) / ry) ** 2 <= 1
        out[inside] = 0
    return np.rint(blurred(out, radius / 2) if radius >= 1 else out).astype(np.uint8)
