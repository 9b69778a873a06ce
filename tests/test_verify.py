"""Structure of image files: whole, cut and flipped ones."""

import random
import struct
import zlib

import numpy as np
import pytest

from sievewright.sources import verify

from .test_frames import IMAGES, tiff
from .test_images_scoring import png

PNG = png(np.random.default_rng(0).integers(0, 256, (9, 14, 3), dtype=np.uint8))


def jpeg(width=14, height=9, exif=b""):
    """Markers of a JPEG file around a scan that is none."""
    part = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    app = part(0xE1, b"Exif\0\0" + exif) if exif else part(0xE0, b"JFIF\0")
    return b"\xff\xd8" + app + part(0xDB, b"\0" * 65) + part(0xC0, struct.pack(">BHHB", 8, height, width, 3) + b"\0" * 9) + part(0xDA, b"\0" * 10) + b"ab\xff\0cd\xff\xd0ef\xff\xff\xd9"


def gif(width=14, height=9):
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80, 0, 0) + b"\0" * 6 + b"\x21\xfe\x02hi\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + b"\x02\x03abc\0" + b"\x3b"


def bmp(width=14, height=9):
    body = struct.pack("<IiiHHIIiiII", 40, width, -height, 1, 24, 0, 0, 0, 0, 0, 0) + b"\0" * 50
    return b"BM" + struct.pack("<IHHI", 14 + len(body), 0, 0, 54) + body


def webp(width=14, height=9):
    body = b"WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little") + b"\0" * 4
    return b"RIFF" + struct.pack("<I", len(body)) + body


SOUND = {"PNG": PNG, "JPEG": jpeg(), "GIF": gif(), "BMP": bmp(), "WEBP": webp()}


@pytest.mark.parametrize("kind", SOUND)
def test_sound_files_and_all_that_are_cut(kind):
    data = SOUND[kind]
    found, status, reason = verify.inspected_file(data)
    assert (found.format, found.width, found.height, status) == (kind, 14, 9, "ok"), reason
    for n in range(1, len(data)):
        assert verify.inspected_file(data[:n])[1] != "ok", n
    assert verify.inspected_file(data + b"more")[1] == "ok"


def test_flipped_bytes():
    for at in range(len(PNG)):
        flipped = PNG[:at] + bytes([PNG[at] ^ 0x10]) + PNG[at + 1 :]
        assert verify.inspected_file(flipped)[1] != "ok", at
    data = jpeg()
    for at in (2, data.index(b"\xff\xdb"), data.index(b"\xff\xda"), data.index(b"\xff\xc0")):
        assert verify.inspected_file(data[:at] + b"\0" + data[at + 1 :])[1] != "ok"


def test_garbage_never_raises():
    rng = random.Random(1)
    for data in SOUND.values():
        for _ in range(300):
            spoilt = bytearray(data)
            for _ in range(3):
                spoilt[rng.randrange(len(spoilt))] = rng.randrange(256)
            assert verify.inspected_file(bytes(spoilt))[1] in ("ok", "unknown", "truncated", "damaged")


def test_plan(spark):
    block = tiff(IMAGES[:1], ">")  # orientation 6: on its side
    bomb = PNG[:16] + struct.pack(">II", 60_000, 60_000) + PNG[24:29] + struct.pack(">I", zlib.crc32(PNG[12:16] + struct.pack(">II", 60_000, 60_000) + PNG[24:29])) + PNG[33:]
    rows = {"png": PNG, "side": jpeg(exif=block), "tiff": block, "bomb": bomb, "cut": PNG[:-5], "long": PNG + b"\0" * 5000, "text": b"text", "empty": b"", "null": None}
    got = {r["path"]: r for r in verify.inspected(spark.createDataFrame(list(rows.items()), "path string, content binary"), most_bytes=5000).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"png": "ok", "side": "ok", "tiff": "ok", "bomb": "too_large", "cut": "truncated", "long": "too_large", "text": "unknown", "empty": "empty", "null": "empty"}
    assert (got["side"]["width"], got["side"]["height"], got["side"]["orientation"]) == (9, 14, 6) and (got["png"]["width"], got["png"]["height"]) == (14, 9) and got["long"]["width"] is None
    assert verify.inspected(spark.createDataFrame([], "path string, content binary")).count() == 0
