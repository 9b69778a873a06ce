import struct
import zlib

import numpy as np
import pytest

from sievewright.sources import frames


def tiff(images, order="<", compression=1, cut=0, loop=False):
    """A TIFF file of gray frames."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0))
    link = 4
    for a in images:
        data = a.astype(np.uint8).tobytes()
        data = lzw(data) if compression == 5 else zlib.compress(data) if compression == 8 else b"".join(bytes([0, b]) for b in data) if compression == 32773 else data
        start = len(out)
        out += data[: len(data) - cut] + b"\0" * (len(data) % 2)
        at = len(out)
        struct.pack_into(order + "I", out, link, at)
        tags = [(256, 3, a.shape[1]), (257, 3, a.shape[0]), (258, 3, 8), (259, 3, compression), (273, 4, start), (274, 3, 6), (279, 4, len(data) - cut)]
        out += struct.pack(order + "H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        link = len(out)
        out += struct.pack(order + "I", 0)
    if loop:
        struct.pack_into(order + "I", out, link, struct.unpack_from(order + "I", out, 4)[0])
    return bytes(out)


IMAGES = [np.arange(12).reshape(3, 4), np.arange(20).reshape(5, 4) * 3]


def lzw(data):
    """LZW as TIFF has it: codes of 9 to 12 bits from the highest bit on, one bit more a code early."""
    table, codes, word, width, out, n = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9, 0, 0
    for i in range(len(data)):
        byte = data[i : i + 1]
        if word + byte in table:
            word += byte
            continue
        codes.append((table[word], width))
        table[word + byte] = len(table) + 2
        word = byte
        size = len(table) + 2
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            codes.append((256, width))
            table, width = {bytes([k]): k for k in range(256)}, 9
    codes += ([(table[word], width)] if word else []) + [(257, width)]
    for code, w in codes:
        out, n = out << w | code, n + w
    return (out << -n % 8).to_bytes((n + 7) // 8, "big")


@pytest.mark.parametrize("n", [0, 1, 7, 300, 5000, 40_000])
def test_lzw_lengths(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n).astype(np.uint8).tobytes(), rng.integers(0, 3, n).astype(np.uint8).tobytes(), b"a" * n):
        packed = lzw(data)
        assert frames.lzw_length(packed) == n
        if n > 300:
            assert frames.lzw_length(packed[: len(packed) // 2]) < n


def tiled(a, side, pack=lambda x: x, compression=1, lose=0):
    """A TIFF file of one gray frame in square tiles."""
    h, w = a.shape
    padded = np.pad(a, ((0, -h % side), (0, -w % side))).astype(np.uint8)
    pieces = [pack(padded[y : y + side, x : x + side].tobytes()) for y in range(0, h, side) for x in range(0, w, side)]
    out, places = bytearray(b"II*\0" + b"\0" * 4), []
    for p in pieces:
        places.append(len(out))
        out += p
    lists = len(out)
    out += struct.pack(f"<{len(pieces)}I", *places) + struct.pack(f"<{len(pieces)}I", *[len(p) - lose for p in pieces])
    struct.pack_into("<I", out, 4, len(out))
    tags = [(256, 3, 1, w), (257, 3, 1, h), (258, 3, 1, 8), (259, 3, 1, compression), (277, 3, 1, 1), (322, 3, 1, side), (323, 3, 1, side), *((t, 4, len(pieces), at if len(pieces) > 1 else struct.unpack_from("<I", out, at)[0]) for t, at in ((324, lists), (325, lists + 4 * len(pieces))))]
    return bytes(out + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0" * 4)


def test_tiles():
    a = np.arange(600).reshape(20, 30) % 251
    for pack, code in ((lambda x: x, 1), (lzw, 5), (zlib.compress, 8)):
        assert list(frames.tiff_frames(tiled(a, 8, pack, code))) == [(0, [], [])]
        assert list(frames.tiff_frames(tiled(a, 8, pack, code, lose=5)))[0][2]
    spoilt = tiled(a, 8, lzw, 5)
    at = spoilt.index(lzw(np.pad(a, ((0, 4), (0, 2))).astype(np.uint8)[:8, :8].tobytes())) + 2
    assert list(frames.tiff_frames(spoilt[:at] + b"\xff\xff\xff" + spoilt[at + 3 :]))[0][2]
    whole, cut = b"\xff\xd8scan\xff\xd9", b"\xff\xd8scan"
    assert list(frames.tiff_frames(tiled(a, 32, lambda x: whole, 7))) == [(0, [], [])] and list(frames.tiff_frames(tiled(a, 32, lambda x: cut, 7)))[0][2]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
def test_frames_of_sound_files(order, compression):
    assert list(frames.tiff_frames(tiff(IMAGES, order, compression))) == [(0, [], []), (1, [], [])]


def test_files_with_faults(spark):
    good = tiff(IMAGES)
    rows = {"good": good, "short": tiff(IMAGES, cut=3), "deflate": tiff(IMAGES, compression=8, cut=2), "unknown": tiff(IMAGES, compression=6), "loop": tiff(IMAGES, loop=True), "cut": good[: len(good) - 30], "none": b"no image", "empty": b"", "null": None}
    got = {r["path"]: r for r in frames.validated(spark.createDataFrame(list(rows.items()), "path string, content binary")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"good": "ok", "short": "failed", "deflate": "failed", "unknown": "warning", "loop": "failed", "cut": "failed", "none": "failed", "empty": "failed", "null": "failed"}
    assert got["good"]["frames"] == 2 and got["short"]["failures"] == ["0: 9 bytes for 4 x 3 pixels", "1: 17 bytes for 4 x 5 pixels"] and got["unknown"]["warnings"][1] == "1: compression 6 is not unpacked"
    assert got["loop"]["failures"][-1].endswith("run in a circle") and frames.validated(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_orientation(spark):
    block = tiff(IMAGES[:1], ">")
    exif = b"Exif\0\0" + block
    jpeg = b"\xff\xd8\xff\xe0\0\4xx\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\0\2"
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 1) + b"IHDRx" + b"crc!" + struct.pack(">I", len(block)) + b"eXIf" + block + b"crc!"
    files = [("j", jpeg), ("p", png), ("t", block), ("none", b"\xff\xd8\xff\xda\0\2"), ("cut", jpeg[:30]), ("text", b"text"), ("null", None)]
    got = {r["path"]: r["orientation"] for r in frames.orientations(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"j": 6, "p": 6, "t": 6, "none": 1, "cut": 1, "text": 1, "null": 1}


def test_oriented():
    a = np.array([[1, 2, 3], [4, 5, 6]])
    seen = {1: [[1, 2, 3], [4, 5, 6]], 2: [[3, 2, 1], [6, 5, 4]], 3: [[6, 5, 4], [3, 2, 1]], 4: [[4, 5, 6], [1, 2, 3]], 5: [[1, 4], [2, 5], [3, 6]], 6: [[4, 1], [5, 2], [6, 3]], 7: [[6, 3], [5, 2], [4, 1]], 8: [[3, 6], [2, 5], [1, 4]]}
    assert {k: frames.oriented(a, k).tolist() for k in range(1, 9)} == seen
    assert frames.oriented(np.zeros((2, 3, 3)), 6).shape == (3, 2, 3)
