"""From files to oriented pixels, where a picture that is too large is never decoded."""

import struct
import zlib

import numpy as np
import pytest

from sievewright.sources import decode, images

from .test_frames import IMAGES, tiff
from .test_images_scoring import png

A = np.random.default_rng(0).integers(0, 256, (20, 30, 3), dtype=np.uint8)


def with_orientation(data):
    """A PNG that says it lies on its side (orientation 6)."""
    block = tiff(IMAGES[:1], ">")
    chunk = struct.pack(">I", len(block)) + b"eXIf" + block + struct.pack(">I", zlib.crc32(b"eXIf" + block))
    return data[:33] + chunk + data[33:]


def bomb(side=60_000):
    """A PNG of a few bytes that claims a huge picture."""
    head = struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)
    plain = png(A)
    return plain[:16] + head + struct.pack(">I", zlib.crc32(b"IHDR" + head)) + plain[33:]


def test_folder_to_oriented_pixels(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    files = {"plain.png": png(A), "sub/side.png": with_orientation(png(A)), "sub/bomb.png": bomb(), "cut.png": png(A)[:-9], "text.txt": b"text", "large.png": png(A) + b"\0" * 20_000}
    for name, data in files.items():
        (folder / name).write_bytes(data)
    got = {r["path"].split("/in/")[1]: r for r in decode.decoded(spark, str(folder), f"file://{tmp_path}/staging", most_bytes=15_000).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"plain.png": "ok", "sub/side.png": "ok", "sub/bomb.png": "too_large", "cut.png": "truncated", "text.txt": "unknown", "large.png": "too_large"}
    assert len(list((tmp_path / "staging" / "files").rglob("*"))) - len(list((tmp_path / "staging" / "files").iterdir())) == 2  # the bomb is not among what is decoded
    one, side = got["plain.png"], got["sub/side.png"]
    assert np.allclose(images.to_array(one["pixels"], one["width"], one["height"], one["channels"]) * 255, A)
    assert (side["width"], side["height"], side["orientation"]) == (20, 30, 6)
    assert np.allclose(images.to_array(side["pixels"], 20, 30, 3) * 255, np.rot90(A, -1))
    assert all(got[k]["pixels"] is None for k in ("sub/bomb.png", "cut.png", "text.txt"))


def test_folder_without_an_image(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"text")
    got = decode.decoded(spark, str(tmp_path / "in"), f"{tmp_path}/staging").collect()
    assert [(r["status"], r["pixels"]) for r in got] == [("unknown", None)]


@pytest.mark.parametrize("size", [16, 40])
def test_harmonised_pixels(spark, tmp_path, size):
    """From a folder to a model's input, turned first."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(with_orientation(png(A)))
    rows = images.harmonised(decode.decoded(spark, str(tmp_path / "in"), f"{tmp_path}/staging"), size).collect()
    assert [(r["width"], r["height"], r["channels"], len(r["pixels"])) for r in rows] == [(size, size, 3, 3 * size * size)]
