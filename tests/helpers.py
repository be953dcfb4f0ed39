"""Pictures and models for the tests."""

import struct
import zipfile
import zlib

import numpy as np

from framewright.plugins import Classifier, Detector, Prediction

# a picture with n dark stripes shows the n-th of these documents
STRIPED = [
    ("none", "unknown", "n/a"),
    ("passport", "EG", "front"),
    ("residence_permit", "FR", "back"),
    ("passport", "EG", "back"),
    ("driving_license", "LB", "front"),
]


def png(pixels: np.ndarray) -> bytes:
    height, width = pixels.shape[:2]
    raw = b"".join(b"\0" + row.astype("uint8").tobytes() for row in pixels)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def plain(level: int, width=40, height=30) -> np.ndarray:
    return np.full((height, width, 3), level, "uint8")


def striped(n: int) -> np.ndarray:
    picture = plain(230)
    for i in range(n):
        picture[:, 8 * i + 2 : 8 * i + 6] = 20
    return picture


def blocks(seed: int, noise: int = 0) -> np.ndarray:
    """A picture of 8 x 8 grey blocks; `noise` changes bytes but hardly the look."""
    r = np.random.default_rng(seed)
    grey = r.integers(0, 255, (6, 8)).repeat(8, 0).repeat(8, 1)
    grey = np.clip(grey + (noise and np.random.default_rng(noise).integers(0, 2, grey.shape)), 0, 255)
    return np.repeat(grey[:, :, None], 3, 2).astype("uint8")


def zipped(path, data: bytes, member="original.jpeg"):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr(member, data)


class StripeCounter(Classifier):
    """Reads a striped picture; `sure` is its confidence, `out_of_order` lets it raise."""

    def __init__(self, name="stripes", sure=0.9, out_of_order=False):
        self.name, self.sure, self.out_of_order = name, sure, out_of_order

    def classify(self, crop):
        if self.out_of_order:
            raise ArithmeticError("no answer today")
        dark = crop[crop.shape[0] // 2, :, 0] < 128
        return Prediction(*STRIPED[int((np.diff(dark.astype(int)) == 1).sum() + dark[0])], self.sure)


class SameBoxes(Detector):
    """The same candidates in every picture."""

    def __init__(self, boxes, name="fixed"):
        self.boxes, self.name = boxes, name

    def detect(self, pixels):
        return self.boxes
