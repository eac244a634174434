"""Writes the bound image rows as PNG files, so that the image reader has files to scan."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame

# Leading bytes of every PNG file and its color types for gray and RGBA (fixed values).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
GRAY, RGBA = 0, 6


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png_bytes(data: bytes, width: int, height: int, channels: int) -> bytes:
    """Encodes gray or B, G, R, A pixels."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 4:
        pixels = pixels[:, :, [2, 1, 0, 3]]
    filtered = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)])
    header = struct.pack(">IIBBBBB", width, height, 8, RGBA if channels == 4 else GRAY, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes())) + _chunk(b"IEND", b"")


def write_images(images: DataFrame, key: str, folder: str) -> str:
    """One file per row, named by the key; rows without pixels become unreadable files.

    Tasks write straight to the shared file system; a repeated task rewrites the same files.
    """

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for frame in frames:
            for name, w, h, c, data in frame.itertuples(index=False):
                body = b"not an image" if data is None or w < 0 else png_bytes(data, w, h, c)
                with system.open_output_stream(f"{base}/{name}.png") as out:
                    out.write(body)
            yield pd.DataFrame({"n": [len(frame)]})

    rows = images.select(key, "image.width", "image.height", "image.nChannels", "image.data")
    rows.mapInPandas(save, "n bigint").agg({"n": "sum"}).collect()
    return folder
