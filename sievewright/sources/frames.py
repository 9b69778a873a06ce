"""What image files say beside their pixels: orientation, and the frames of a TIFF file, read from their bytes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags of TIFF, bytes of its types, and its codes for data as they are, LZW, JPEG, PackBits and deflate.
WIDTH, HEIGHT, BITS, COMPRESSION, ORIENTATION, STRIPS, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PLANES, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 256, 257, 258, 259, 274, 273, 277, 278, 279, 284, 322, 323, 324, 325
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
PLAIN, LZW, JPEG, PACKBITS, DEFLATE = (1,), (5,), (7,), (32773,), (8, 32946)
FRAMES = "path string, frames int, status string, warnings array<string>, failures array<string>"


def _entries(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """Whole-number tags of the directory at a place, and the place of the next one."""
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        code = {1: "B", 3: "H", 4: "I"}.get(kind)
        if code is None:
            continue
        size = TYPE_BYTES[kind] * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        if where + size > len(data):
            raise ValueError(f"tag {tag} lies behind the end of the file")
        tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, where)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _tiff_order(data: bytes) -> str:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("no TIFF header")
    return order


def exif_orientation(data: bytes) -> int:
    """1 to 8 as an EXIF block of a JPEG, PNG or TIFF file says; 1 where there is none or it cannot be read."""
    try:
        block = b""
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
                size = struct.unpack_from(">H", data, at + 2)[0]
                if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                    block = data[at + 10 : at + 2 + size]
                    break
                at += 2 + size
        elif data[:8] == b"\x89PNG\r\n\x1a\n":
            at = 8
            while at + 8 <= len(data):
                size = struct.unpack_from(">I", data, at)[0]
                if data[at + 4 : at + 8] == b"eXIf":
                    block = data[at + 8 : at + 8 + size]
                    break
                at += 12 + size
        elif data[:4] in (b"II*\0", b"MM\0*"):
            block = data
        if not block:
            return 1
        order = _tiff_order(block)
        tags, _ = _entries(block, struct.unpack_from(order + "I", block, 4)[0], order)
        value = tags.get(ORIENTATION, (1,))[0]
        return value if 1 <= value <= 8 else 1
    except (struct.error, ValueError):
        return 1


def oriented(image: np.ndarray, orientation: int) -> np.ndarray:
    """An image as it is to be seen: of the eight orientations those from five on lie on their side, and 2, 4, 5 and 7 are mirrored."""
    if orientation >= 5:
        image = np.swapaxes(image, 0, 1)
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    return image


@F.pandas_udf(T.IntegerType())
def _orientation(content: pd.Series) -> pd.Series:
    return content.map(lambda c: exif_orientation(bytes(c)) if c is not None else 1)


def orientations(files: DataFrame, content: str = "content", head: int = 1 << 17) -> DataFrame:
    """files with `orientation`, from the first `head` bytes of each, where such blocks stand."""
    return files.withColumn("orientation", _orientation(F.substring(F.col(content), 1, head)))


def lzw_length(data: bytes) -> int:
    """How many bytes LZW data hold. A code's length is all that is kept of it: that of the one before and one more. Fails for a code that the table does not have yet."""
    lengths, before, total, held, bits, width = [1] * 258, 0, 0, 0, 0, 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            lengths, before, width = [1] * 258, 0, 9
            continue
        if code == 257:
            return total
        if not before and code > 255 or code > len(lengths):
            raise ValueError(f"an LZW code {code} that stands for nothing")
        now = before + 1 if code == len(lengths) else lengths[code]
        if before and len(lengths) < 4096:
            lengths.append(before + 1)
        total, before = total + now, now
        width = 9 if len(lengths) < 511 else 10 if len(lengths) < 1023 else 11 if len(lengths) < 2047 else 12
    return total


def _packbits_length(data: bytes) -> int:
    total = at = 0
    while at < len(data):
        n = data[at]
        run = n + 1 if n < 128 else 257 - n if n > 128 else 0
        at += 2 + n if n < 128 else 2 if n > 128 else 1
        if at > len(data):
            raise ValueError("PackBits data end within a run")
        total += run
    return total


def _unpacked_length(data: bytes, compression: int, most: int) -> int | None:
    """Bytes that a strip or tile holds; most is what it should have, so that no more than that is unpacked of deflate. None for a compression that is not known here."""
    if compression in PLAIN:
        return len(data)
    if compression in DEFLATE:
        unpack = zlib.decompressobj()
        n = len(unpack.decompress(data, most + 1))
        if not unpack.eof and n <= most:
            raise ValueError("deflate data end early")
        return n
    if compression in LZW:
        return lzw_length(data)
    if compression in PACKBITS:
        return _packbits_length(data)
    return None


def _segments(tags: dict[int, tuple[int, ...]], width: int, height: int) -> tuple[list[tuple[int, int, int]], int]:
    """Place, length and due bytes of each tile or strip."""
    depth = tags.get(BITS, (1,))
    samples = tags.get(SAMPLES, (1,))[0]
    bits = sum(depth) if len(depth) > 1 else depth[0] * samples
    apart = tags.get(PLANES, (1,))[0] == 2
    if apart:
        bits //= max(1, samples)
    planes = samples if apart else 1
    if TILES in tags:
        across, down = tags.get(TILE_WIDTH, (0,))[0], tags.get(TILE_HEIGHT, (0,))[0]
        if not across or not down:
            raise ValueError("tiles without a size")
        due = [down * -(-across * bits // 8)] * (-(-width // across) * -(-height // down) * planes)
        places, sizes = tags[TILES], tags.get(TILE_BYTES, ())
    else:
        rows = min(height, tags.get(ROWS_A_STRIP, (height,))[0] or height)
        due = [min(rows, height - y) * -(-width * bits // 8) for _ in range(planes) for y in range(0, height, rows)]
        places, sizes = tags[STRIPS], tags.get(STRIP_BYTES, ())
    if not len(places) == len(sizes) == len(due):
        raise ValueError(f"{len(places)} places and {len(sizes)} lengths for {len(due)} {'tiles' if TILES in tags else 'strips'}")
    return list(zip(places, sizes, due, strict=True)), sum(due)


def tiff_frames(data: bytes) -> Iterator[tuple[int, list[str], list[str]]]:
    """Each frame's number with its warnings and failures. A frame fails where its size is missing, its strips or tiles lie behind the file's end, do not unpack (LZW, PackBits, deflate), lack a JPEG's ends, are not as many as the size asks for, or hold too few bytes; another compression is a warning, as only the frame's tags are checked then. A directory that repeats ends the file with a failure."""
    order = _tiff_order(data)
    at, seen, frame = struct.unpack_from(order + "I", data, 4)[0], set(), 0
    while at:
        warnings: list[str] = []
        failures: list[str] = []
        following = 0
        if at in seen:
            yield frame, [], ["the directories run in a circle"]
            return
        seen.add(at)
        try:
            tags, following = _entries(data, at, order)
            width, height = tags.get(WIDTH, (0,))[0], tags.get(HEIGHT, (0,))[0]
            if not width or not height:
                raise ValueError("no width or height")
            if TILES not in tags and STRIPS not in tags:
                warnings.append("no strips and no tiles")
            else:
                compression = tags.get(COMPRESSION, (1,))[0]
                segments, whole = _segments(tags, width, height)
                total = 0
                for start, size, due in segments:
                    if start + size > len(data):
                        raise ValueError("a strip or tile lies behind the end of the file")
                    piece = data[start : start + size]
                    if compression in JPEG:
                        if not (piece.startswith(b"\xff\xd8") and piece.rstrip(b"\0").endswith(b"\xff\xd9")):
                            raise ValueError("a JPEG strip or tile without its beginning or end")
                        total += due
                        continue
                    length = _unpacked_length(piece, compression, due)
                    if length is None:
                        warnings.append(f"compression {compression} is not unpacked")
                        break
                    total += min(length, due)
                else:
                    if total < whole:
                        raise ValueError(f"{total} bytes for {width} x {height} pixels")
        except (struct.error, ValueError, zlib.error) as e:
            failures.append(str(e) or type(e).__name__)
        yield frame, warnings, failures
        frame, at = frame + 1, following


def validated(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row for each file: path, frames, status (`ok`, `warning` or `failed`), warnings and failures, each with the number of its frame. A file without a TIFF header, an empty or a null one fails with no frames. Rows stream through in Arrow batches."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch[path], batch[content], strict=True):
                frames, warnings, failures = 0, [], []
                try:
                    for frame, w, f in tiff_frames(bytes(data or b"")):
                        frames = frame + 1
                        warnings += [f"{frame}: {x}" for x in w]
                        failures += [f"{frame}: {x}" for x in f]
                    if not frames:
                        failures.append("no frames")
                except (struct.error, ValueError) as e:
                    failures.append(str(e))
                rows.append((name, frames, "failed" if failures else "warning" if warnings else "ok", warnings, failures))
            yield pd.DataFrame(rows, columns=["path", "frames", "status", "warnings", "failures"])

    return files.select(F.col(path), F.col(content)).mapInPandas(check, FRAMES)
