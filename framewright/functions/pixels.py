"""Pixels in Python workers: decoding, grey values, Lanczos resampling (SRC-06, FN-02, FN-06).

PNG is decoded here; other formats need Pillow, which is used if it can be imported. The bit step of
the fingerprint is exact on a given grey matrix; the grey matrix of a lossy format depends on the decoder.
"""

from __future__ import annotations

import importlib.util
import io
import struct
import zlib

import numpy as np

SIZE = 16  # a fingerprint has SIZE x SIZE bits


OTHER_FORMATS = (b"\xff\xd8\xff", b"BM", b"RIFF", b"II*\0", b"MM\0*", b"GIF8")  # fixed values: first bytes of JPEG, BMP, WebP, TIFF, GIF


class UndecodableImage(ValueError):
    """The bytes are no image that can be decoded here."""


class NoDecoder(UndecodableImage):
    """The bytes look like an image of a format that needs Pillow, which is not installed."""


def has_pillow() -> bool:
    return importlib.util.find_spec("PIL") is not None


def decode_png(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of a PNG with 8 bits a channel, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise UndecodableImage("not a PNG")
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, "uint8").reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6] != 0 or head[3] not in (0, 2, 3, 4, 6):
        raise UndecodableImage("unsupported PNG")
    width, height, colour = head[0], head[1], head[3]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    try:
        raw = np.frombuffer(zlib.decompress(packed), "uint8").reshape(height, 1 + width * channels)
    except (zlib.error, ValueError) as error:
        raise UndecodableImage("broken PNG") from error
    out = np.zeros((height, width * channels), "uint8")
    above = np.zeros(width * channels, "int64")
    for y in range(height):
        row = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype("int64"), above, channels)
        out[y] = row
        above = row.astype("int64")
    pixels = out.reshape(height, width, channels)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, :3] if channels >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row % 256
    if kind == 2:
        return (row + above) % 256
    out = row.copy()
    for i in range(len(row)):
        left = out[i - step] if i >= step else 0
        corner = above[i - step] if i >= step else 0
        if kind == 1:
            guess = left
        elif kind == 3:
            guess = (left + above[i]) // 2
        else:
            p = left + above[i] - corner
            guess = min((abs(p - left), 0, left), (abs(p - above[i]), 1, above[i]), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) % 256
    return out


def decode(data: bytes) -> np.ndarray:
    """RGB pixels, upright; raises if the bytes can't be decoded."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    try:
        from PIL import Image, ImageOps
    except ImportError as error:
        raise (NoDecoder if data.startswith(OTHER_FORMATS) else UndecodableImage)("install Pillow for other formats than PNG") from error
    with Image.open(io.BytesIO(data)) as image:
        return np.asarray(ImageOps.exif_transpose(image).convert("RGB"))


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma by ITU-R 601-2 in 16-bit fixed point."""
    r, g, b = (pixels[:, :, i].astype("int64") for i in range(3))
    return (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16


def _weights(old: int, new: int, lobes: int = 3) -> np.ndarray:
    scale = max(1.0, old / new)
    centre = (np.arange(new) + 0.5) * old / new
    x = (np.arange(old)[None, :] + 0.5 - centre[:, None]) / scale
    w = np.where(np.abs(x) < lobes, np.sinc(x) * np.sinc(x / lobes), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """Lanczos resampling, first along rows, rounded to 0..255 after each pass."""
    across = np.clip(np.rint(values @ _weights(values.shape[1], width).T), 0, 255)
    return np.clip(np.rint(_weights(values.shape[0], height) @ across), 0, 255).astype("int64")


def grey_matrix(pixels: np.ndarray) -> list[int]:
    """SIZE rows of SIZE + 1 grey values, row by row: what the bit step compares."""
    return resized(grey(pixels), SIZE + 1, SIZE).ravel().tolist()


def encode_png(pixels: np.ndarray) -> bytes:
    """RGB pixels as a PNG."""
    height, width = pixels.shape[:2]
    rows = np.zeros((height, 1 + 3 * width), "uint8")
    rows[:, 1:] = np.clip(pixels, 0, 255).astype("uint8").reshape(height, -1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def scaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each channel resampled to a size."""
    return np.stack([resized(pixels[:, :, c].astype("int64"), width, height) for c in range(3)], axis=2)


def thumbnail(pixels: np.ndarray, longest: int = 1600) -> np.ndarray:
    """The picture, made smaller if its longer side exceeds `longest`."""
    height, width = pixels.shape[:2]
    factor = longest / max(height, width)
    return pixels if factor >= 1 else scaled(pixels, max(1, round(width * factor)), max(1, round(height * factor)))


COLOURS = ((230, 25, 75), (60, 180, 75), (0, 130, 200), (245, 130, 48), (145, 30, 180))


def draw_boxes(pixels: np.ndarray, boxes: list[tuple[int, int, int, int]], line: int = 3) -> np.ndarray:
    """A copy with a frame per box, the colours taken in turn."""
    out = pixels.copy()
    for i, (x0, y0, x1, y1) in enumerate(boxes):
        colour = COLOURS[i % len(COLOURS)]
        out[y0 : min(y0 + line, y1), x0:x1] = colour
        out[max(y1 - line, y0) : y1, x0:x1] = colour
        out[y0:y1, x0 : min(x0 + line, x1)] = colour
        out[y0:y1, max(x1 - line, x0) : x1] = colour
    return out


def side_by_side(left: np.ndarray, right: np.ndarray, height: int = 500) -> np.ndarray:
    """Two pictures of one height next to each other."""
    fit = lambda p: scaled(p, max(1, round(p.shape[1] * height / p.shape[0])), height)
    return np.concatenate([fit(left), fit(right)], axis=1)
