"""Image files as rows of features: one decode for each file, in Arrow batches on the executors.

A small decoder reads PNG (8 bits, not interlaced) with the standard library; other formats go
to a plug-in, which also converts HEIF. Undecodable files come out with an error text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import expr
from lumenfold.operators.moves import unused_path
from lumenfold.settings import Settings

#: Tags of the original, the digitized and the plain date, and of the orientation.
DATE_TAGS = (0x9003, 0x9004, 0x0132)
ORIENTATION_TAG, EXIF_FOLDER_TAG = 0x0112, 0x8769

Decoder = Callable[[bytes], np.ndarray]

FEATURES = "source_path STRING, width INT, height INT, orientation STRING, exif_time STRING, exif_orientation INT, blur_score DOUBLE, brightness_mean DOUBLE, overexposed_ratio DOUBLE, perceptual_hash BIGINT, color_histogram ARRAY<DOUBLE>, compare ARRAY<FLOAT>, details STRING"


def decode_png(data: bytes) -> np.ndarray:
    """RGB pixels (height, width, 3) of a PNG of 8 bits a channel."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head, palette = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("truncated PNG")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += size + 12
    if head is None or head[2] != 8 or head[6] != 0:
        raise ValueError("unsupported PNG")
    width, height, _, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros_like(line)
        if kind == 2:
            line = line + up
        elif kind == 1:
            line = np.cumsum(line.reshape(-1, channels), axis=0).ravel()
        elif kind in (3, 4):
            for i in range(len(line)):
                left = line[i - channels] if i >= channels else 0
                corner = up[i - channels] if i >= channels else 0
                guess = (left + up[i]) // 2 if kind == 3 else min((abs(up[i] - corner), 0, left), (abs(left - corner), 1, up[i]), (abs(left + up[i] - 2 * corner), 2, corner))[2]
                line[i] = (line[i] + guess) & 255
        out[y] = line & 255
    pixels = out.reshape(height, width, channels)
    if color == 3:
        return palette[pixels[..., 0]]
    return np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3].copy()


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG of RGB pixels."""
    height, width, _ = pixels.shape
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.astype(np.uint8).reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def exif_block(data: bytes) -> bytes | None:
    """The TIFF block with the metadata of a JPEG or PNG file, or None."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            size = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            at += 2 + size
    elif (i := data.find(b"eXIf")) > 0 and data[:4] == b"\x89PNG":
        return data[i + 4 : i + 4 + struct.unpack(">I", data[i - 4 : i])[0]]
    return None


def read_exif(data: bytes, sub_folder: bool = True) -> dict[int, str | int]:
    """The date tags and the orientation; the base folder comes before the sub-folder."""
    block = exif_block(data)
    found: dict[int, str | int] = {}
    if not block or block[:2] not in (b"II", b"MM"):
        return found
    order = "<" if block[:2] == b"II" else ">"

    def folder(at: int) -> int | None:
        below = None
        for i in range(struct.unpack_from(order + "H", block, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
            spot = at + 10 + 12 * i
            if tag in DATE_TAGS and kind == 2:
                start = spot if count <= 4 else struct.unpack_from(order + "I", block, spot)[0]
                found.setdefault(tag, block[start : start + count].split(b"\0")[0].decode("ascii", "replace"))
            elif tag == ORIENTATION_TAG and kind == 3:
                found.setdefault(tag, struct.unpack_from(order + "H", block, spot)[0])
            elif tag == EXIF_FOLDER_TAG:
                below = struct.unpack_from(order + "I", block, spot)[0]
        return below

    try:
        below = folder(struct.unpack_from(order + "I", block, 4)[0])
        if below and sub_folder:
            folder(below)
    except struct.error:
        pass
    return found


def upright(pixels: np.ndarray, orientation: int | None) -> np.ndarray:
    """The pixels turned as the orientation tag says."""
    turns = {2: lambda p: p[:, ::-1], 3: lambda p: p[::-1, ::-1], 4: lambda p: p[::-1], 5: lambda p: p.transpose(1, 0, 2), 6: lambda p: np.rot90(p, -1), 7: lambda p: np.rot90(p[:, ::-1], 1), 8: lambda p: np.rot90(p, 1)}
    return turns.get(orientation or 1, lambda p: p)(pixels)


def luma(pixels: np.ndarray) -> np.ndarray:
    """Brightness as whole numbers, by the ITU-R 601 weights."""
    return np.floor(pixels.astype(np.float64) @ np.array([0.299, 0.587, 0.114]) + 0.5)


def second_differences(gray: np.ndarray) -> np.ndarray:
    """The sum of the second differences along both axes, for inner pixels: the discrete Laplacian."""
    return np.diff(gray, 2, axis=0)[:, 1:-1] + np.diff(gray, 2, axis=1)[1:-1]


def blur_score(gray: np.ndarray, settings: Settings) -> float:
    """Mean sharpness of the sharpest share of the tiles; that of a tile is the variance of its second differences, 0 below 3 pixels a side.

    The differences are taken once for the whole picture. A tile uses those of its inner
    pixels; tiles differ by at most a pixel in size, larger ones first.
    """
    limits = settings.quality
    edge = second_differences(gray) if min(gray.shape) > 2 else np.zeros((0, 0))
    bounds = [[i * (n // k) + min(i, n % k) for i in range(k + 1)] for n, k in zip(gray.shape, (limits.tile_rows, limits.tile_cols), strict=True)]
    (tops, lefts), score = bounds, []
    for y, below in zip(tops, tops[1:]):
        for x, right in zip(lefts, lefts[1:]):
            if below > y and right > x:
                inner = edge[y : below - 2, x : right - 2] if min(below - y, right - x) > 2 else edge[:0]
                score.append(inner.var() if inner.size else 0.0)
    top = max(1, -int(-len(score) * limits.top_tiles // 1))
    return float(np.mean(sorted(score)[-top:])) if score else 0.0


def resample(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area average of the pixels on another grid."""

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        low, high = edges[:-1, None], edges[1:, None]
        cell = np.arange(old)[None, :]
        w = np.clip(np.minimum(high, cell + 1) - np.maximum(low, cell), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    rows = np.tensordot(weights(pixels.shape[0], height), pixels.astype(np.float64), axes=(1, 0))
    return np.einsum("ec,acd->aed", weights(pixels.shape[1], width), rows, optimize=True)


def image_features(data: bytes, decode: Decoder, settings: Settings) -> dict:
    """All features of one file; ``details`` holds the reason if it can't be decoded."""
    tags = read_exif(data)
    time = next((tags[t] for t in DATE_TAGS if t in tags), None)
    row = {"exif_time": time, "exif_orientation": tags.get(ORIENTATION_TAG), "details": None}
    try:
        pixels = decode(data)
    except Exception as error:  # noqa: BLE001  (whatever a decoder raises makes the file corrupt)
        return row | {"details": str(error) or type(error).__name__}
    gray = luma(pixels)
    small = np.floor(resample(gray[..., None], 8, 9)[..., 0] + 0.5)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    code = int("".join("1" if b else "0" for b in bits), 2)
    counts = np.concatenate([np.bincount(pixels[..., c].ravel() // 32, minlength=8) for c in range(3)]).astype(np.float64)
    size = settings.duplicates.compare_size
    height, width = gray.shape
    return row | {
        "width": width, "height": height, "orientation": "landscape" if width > height else "portrait" if height > width else "square",
        "blur_score": blur_score(gray, settings), "brightness_mean": float(gray.mean()), "overexposed_ratio": float((gray >= settings.quality.bright_pixel).mean()),
        "perceptual_hash": code - (1 << 64) if code >= 1 << 63 else code, "color_histogram": (counts / counts.sum()).tolist(),
        "compare": resample(upright(pixels, tags.get(ORIENTATION_TAG)), size, size).astype(np.float32).ravel().tolist(),
    }


def extract(paths: DataFrame, settings: Settings = Settings(), decode: Decoder = decode_png) -> DataFrame:
    """``paths`` (source_path and more) joined with the features of each file, each read and decoded once.

    Files are read where the batch is processed, so the paths must be visible to all
    executors. An unreadable file is a corrupt one.
    """
    kinds = {"STRING": pa.string(), "INT": pa.int32(), "DOUBLE": pa.float64(), "BIGINT": pa.int64(), "ARRAY<DOUBLE>": pa.list_(pa.float64()), "ARRAY<FLOAT>": pa.list_(pa.float32())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in FEATURES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("source_path").to_pylist():
                try:
                    row = image_features(Path(path.removeprefix("file:")).read_bytes(), decode, settings)
                except OSError as error:
                    row = {"details": str(error)}
                yield pa.RecordBatch.from_pylist([{"source_path": path} | row], schema)  # the compare image is large, so a batch each

    features = paths.select("source_path").distinct().repartition("source_path").mapInArrow(run, FEATURES)
    return paths.join(features, "source_path")


def with_times(photos: DataFrame) -> DataFrame:
    """Photos with exif_time and modified_at, with captured_at, captured_on and timestamp_source."""
    at, source = expr.first_time((expr.exif_datetime(F.col("exif_time")), "exif"), (F.col("modified_at").cast("timestamp_ntz"), "mtime"))
    return photos.withColumns({"captured_at": at, "timestamp_source": source}).withColumn("captured_on", F.to_date("captured_at"))


def convert_heif(root: Path, encode_jpeg: Callable[[bytes], bytes], settings: Settings) -> dict[Path, Path]:
    """Converts top-level HEIF files by a plug-in, by lower-case name; the originals stay.

    A target that exists gets a counter, the time of the file is kept, a failure leaves no
    partial file and ends the run.
    """
    import os

    done = {}
    for source in sorted((p for p in root.iterdir() if p.is_file() and p.suffix.lower() in (".heic", ".heif")), key=lambda p: (p.name.lower(), p.name)):
        target = unused_path(source.with_suffix(".jpg"), settings.conversion_mark)
        part = target.with_name(f".{target.name}.part")
        try:
            part.write_bytes(encode_jpeg(source.read_bytes()))
            stat = source.stat()
            os.utime(part, ns=(stat.st_atime_ns, stat.st_mtime_ns))
            part.replace(target)
        finally:
            part.unlink(missing_ok=True)
        done[source] = target
    return done
