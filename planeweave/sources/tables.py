"""Pixel grids from tables and files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planeweave.plans.values import Frame, Image, Plane

WIDTH = 100


def events_image(spark: SparkSession, sf_dir: str) -> Image:
    """The events table as one picture, 100 wide: value, a number of the properties and the hour as colours."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = events.count()  # from the files' footers
    k = F.regexp_extract("props", r'"k": (\d+)', 1)
    df = events.select(
        F.lit("events").alias("img"), F.floor(F.col("event_id") / WIDTH).cast("int").alias("y"), (F.col("event_id") % WIDTH).cast("int").alias("x"),
        (F.col("value") / 500.0).alias("r0"), (k.cast("double") / 100.0).alias("g0"), (F.hour("ts") / 23.0).alias("b0"),
    )
    frame = Frame(df, WIDTH, -(-n // WIDTH))
    return frame.image(F.col("r0"), F.col("g0"), F.col("b0"), 1.0)


def embeddings_plane(spark: SparkSession, sf_dir: str) -> Plane:
    """The embeddings table as a plane: a row per vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = vectors.select(F.lit("embeddings").alias("img"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v0"))
    frame = Frame(df.select("img", "y", "x", F.col("v0").cast("double").alias("v0")), 64, vectors.count())
    return frame.plane(F.col("v0"))


def pixel_table(df: DataFrame, w: int, h: int, names=("r", "g", "b", "a")) -> Image:
    """Any table keyed (img, y, x) with four colour columns."""
    frame = Frame(df.select("img", "y", "x", *[F.col(n).cast("double").alias(f"p{k}") for k, n in enumerate(names)]), w, h)
    return frame.image(*(F.col(f"p{k}") for k in range(4)))


def decode_png(raw: bytes) -> np.ndarray:
    """(h, w, 4) floats of an 8- or 16-bit grey, RGB, palette-free PNG without interlacing."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        data += body if kind == b"IDAT" else b""
        at += size + 12
    w, h, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in (0, 2, 4, 6) or interlaced:
        raise ValueError("unsupported PNG")
    channels, unit = {0: 1, 2: 3, 4: 2, 6: 4}[colour], depth // 8
    step, stride = channels * unit, w * channels * unit
    flat, rows, above = zlib.decompress(data), [], np.zeros(stride, np.uint8)
    for y in range(h):
        line = flat[y * (stride + 1) : (y + 1) * (stride + 1)]
        way, now = line[0], np.frombuffer(line[1:], np.uint8).copy()
        if way == 2:
            now += above
        elif way:
            for i in range(stride):
                left, up, corner = (int(now[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
                guess = left + up - corner
                paeth = min((left, up, corner), key=lambda v, g=guess: abs(g - v))
                now[i] = (int(now[i]) + (left if way == 1 else (left + up) // 2 if way == 3 else paeth)) & 255
        rows.append(now)
        above = now
    pixels = np.concatenate(rows).view(">u2" if unit == 2 else np.uint8).reshape(h, w, channels) / (65535.0 if unit == 2 else 255.0)
    grey = channels < 3
    rgb = np.repeat(pixels[:, :, :1], 3, axis=2) if grey else pixels[:, :, :3]
    alpha = pixels[:, :, -1:] if channels in (2, 4) else np.ones((h, w, 1))
    return np.concatenate([rgb, alpha], axis=2)


def encode_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGBA PNG of (h, w, 4) floats."""
    h, w = pixels.shape[:2]
    flat = np.floor(np.clip(pixels, 0, 1) * 255 + 0.5).astype(np.uint8)
    lines = b"".join(b"\0" + flat[y].tobytes() for y in range(h))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(img, y, x, r, g, b, a, w, h) of every PNG under a path; files that can't be decoded give no row."""

    def decode(batches):
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    pixels = decode_png(bytes(raw))
                except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
                    continue
                h, w = pixels.shape[:2]
                y, x = np.divmod(np.arange(h * w), w)
                flat = pixels.reshape(-1, 4)
                yield pd.DataFrame({"img": name, "y": y.astype("int32"), "x": x.astype("int32"), **{c: flat[:, k] for k, c in enumerate("rgba")}, "w": np.int32(w), "h": np.int32(h)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")
    return files.mapInPandas(decode, "img string, y int, x int, r double, g double, b double, a double, w int, h int")


def write_pixels(df: DataFrame, path: str) -> None:
    """A rendered frame as Parquet, a folder per image."""
    df.write.mode("overwrite").partitionBy("img").parquet(path)
