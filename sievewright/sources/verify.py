"""What an image file is and whether it is whole, from its bytes alone: no pixel is decoded, so a small file that claims a huge picture costs nothing.

A PNG's chunks are walked with their checksums, a JPEG's markers and scans to
its end, a GIF's blocks, the sizes that BMP and WebP files state; a TIFF's
frames are those of `frames`. Files stream through in Arrow batches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import HEIGHT, WIDTH, _entries, _tiff_order, exif_orientation, tiff_frames
from .images import MOST_BYTES, MOST_PIXELS

INSPECTED = "path string, length long, format string, width int, height int, orientation int, status string, reason string"


class Damaged(ValueError):
    """A file that says other than it holds."""


class Truncated(ValueError):
    """A file that ends before it should."""


@dataclass
class Found:
    format: str
    width: int
    height: int


def _need(data: bytes, end: int) -> None:
    if end > len(data):
        raise Truncated(f"{end} bytes are needed, {len(data)} are there")


def _png(data: bytes) -> Found:
    at, size, pixels = 8, None, 0
    while True:
        _need(data, at + 12)
        length, kind = struct.unpack_from(">I4s", data, at)
        _need(data, at + 12 + length)
        body = data[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise Damaged(f"the checksum of {kind.decode('latin-1')} at {at} does not fit")
        if size is None:
            if kind != b"IHDR" or length != 13:
                raise Damaged("the first chunk is no IHDR")
            size = struct.unpack_from(">II", body)
        pixels += kind == b"IDAT"
        at += 12 + length
        if kind == b"IEND":
            break
    if not pixels:
        raise Damaged("no IDAT chunk")
    return Found("PNG", *size)


#: Markers of a frame's size (those of Huffman tables, of extensions and of arithmetic coding lie between them), and markers with no length.
FRAME_MARKERS = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
BARE_MARKERS = {0x01, *range(0xD0, 0xD9)}


def _jpeg(data: bytes) -> Found:
    at, size, scans = 2, None, 0
    while True:
        _need(data, at + 2)
        if data[at] != 0xFF:
            raise Damaged(f"no marker at {at}")
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind == 0xD9:
            break
        at += 2
        if kind in BARE_MARKERS:
            continue
        _need(data, at + 2)
        length = struct.unpack_from(">H", data, at)[0]
        if length < 2:
            raise Damaged(f"a segment of {length} bytes at {at}")
        _need(data, at + length)
        if kind in FRAME_MARKERS:
            if length < 8:
                raise Damaged("a frame without its size")
            height, width = struct.unpack_from(">HH", data, at + 3)
            size = size or (width, height)
        at += length
        if kind == 0xDA:
            if size is None:
                raise Damaged("a scan before its frame")
            scans += 1
            # the scan goes on to the next marker that is neither a stuffed byte nor a restart
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise Truncated("a scan without an end")
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
                    at += 2
                elif data[at + 1] == 0xFF:
                    at += 1
                else:
                    break
    if not scans:
        raise Damaged("no scan")
    return Found("JPEG", *size)


def _blocks(data: bytes, at: int) -> int:
    """The place behind a run of sub-blocks of a GIF."""
    while True:
        _need(data, at + 1)
        n = data[at]
        at += 1 + n
        if not n:
            return at


def _gif(data: bytes) -> Found:
    _need(data, 13)
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    images = 0
    while True:
        _need(data, at + 1)
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            at = _blocks(data, at + 2)
        elif kind == 0x2C:
            _need(data, at + 11)
            own = data[at + 9]
            at = _blocks(data, at + 11 + (3 << (own & 7) + 1 if own & 0x80 else 0))
            images += 1
        else:
            raise Damaged(f"a block of kind {kind} at {at}")
    if not images:
        raise Damaged("no image")
    return Found("GIF", width, height)


def _bmp(data: bytes) -> Found:
    _need(data, 26)
    total, start = struct.unpack_from("<I4xI", data, 2)
    _need(data, total)
    width, height = struct.unpack_from("<ii", data, 18) if struct.unpack_from("<I", data, 14)[0] >= 40 else struct.unpack_from("<HH", data, 18)
    if start > total:
        raise Damaged("the pixels lie behind the end")
    return Found("BMP", width, abs(height))


def _webp(data: bytes) -> Found:
    _need(data, 30)
    _need(data, 8 + struct.unpack_from("<I", data, 4)[0])
    kind = data[12:16]
    if kind == b"VP8X":
        width, height = (1 + int.from_bytes(data[i : i + 3], "little") for i in (24, 27))
    elif kind == b"VP8L":
        packed = struct.unpack_from("<I", data, 21)[0]
        width, height = 1 + (packed & 0x3FFF), 1 + (packed >> 14 & 0x3FFF)
    elif kind == b"VP8 ":
        width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
    else:
        raise Damaged("no picture in the container")
    return Found("WEBP", width, height)


def _tiff(data: bytes) -> Found:
    order = _tiff_order(data)
    _need(data, 8)
    tags, _ = _entries(data, struct.unpack_from(order + "I", data, 4)[0], order)
    failures = [f for _, _, failures in tiff_frames(data) for f in failures]
    if failures:
        raise Damaged(failures[0])
    return Found("TIFF", tags[WIDTH][0], tags[HEIGHT][0])


#: How files of each kind begin, and what reads them.
KINDS: list[tuple[bytes, Callable[[bytes], Found]]] = [(b"\x89PNG\r\n\x1a\n", _png), (b"\xff\xd8", _jpeg), (b"GIF87a", _gif), (b"GIF89a", _gif), (b"BM", _bmp), (b"II*\0", _tiff), (b"MM\0*", _tiff)]


def inspected_file(data: bytes) -> tuple[Found | None, str, str]:
    """What a file is, its status (`ok`, `empty`, `unknown`, `truncated` or `damaged`) and the reason."""
    if not data:
        return None, "empty", "no bytes"
    read = next((f for begin, f in KINDS if data.startswith(begin)), _webp if data[:4] == b"RIFF" and data[8:12] == b"WEBP" else None)
    if read is None:
        return None, "unknown", "no known beginning"
    try:
        found = read(data)
        if found.width <= 0 or found.height <= 0:
            raise Damaged("no width or height")
        return found, "ok", ""
    except Truncated as e:
        return None, "truncated", str(e)
    except (Damaged, ValueError, KeyError, struct.error, zlib.error) as e:
        return None, "damaged", str(e) or type(e).__name__


COLUMNS = ["path", "length", "format", "width", "height", "orientation", "status", "reason"]
WHOLE = {c: "Int32" for c in ("width", "height", "orientation")}


def judged(path: str, length: int, data: bytes | None, most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> tuple:
    """The row of a file. data may be left out where the length is over the limit."""
    if length > most_bytes:
        return path, length, None, None, None, None, "too_large", f"{length} bytes"
    data = bytes(data or b"")
    found, status, reason = inspected_file(data)
    if found is None:
        return path, length, None, None, None, None, status, reason
    turned = exif_orientation(data)
    sides = (found.height, found.width) if turned >= 5 else (found.width, found.height)
    if found.width * found.height > most_pixels:
        status, reason = "too_large", f"{found.width} x {found.height} pixels"
    return path, length, found.format, *sides, turned, status, reason


def readable(files: DataFrame, path: str = "path", content: str = "content", most_bytes: int = MOST_BYTES) -> DataFrame:
    """path, length and content of files, without that of those that are too large."""
    length = F.coalesce(F.octet_length(content).cast("long"), F.lit(0).cast("long"))
    return files.select(F.col(path).alias("path"), length.alias("length"), F.when(length <= most_bytes, F.col(content)).alias("content"))


def inspected(files: DataFrame, path: str = "path", content: str = "content", most_bytes: int = MOST_BYTES, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row for each file: path, length, format, width, height and orientation as they are to be seen (a picture on its side has them swapped), status, reason.

    Status is `too_large` over a limit, which is found before anything is decoded: files over most_bytes are not even sent to Python. A null or empty content is `empty`.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judged(p, n, data, most_bytes, most_pixels) for p, n, data in zip(batch["path"], batch["length"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=COLUMNS).astype(WHOLE)

    return readable(files, path, content, most_bytes).mapInPandas(walk, INSPECTED)
