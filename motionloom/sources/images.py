"""Frames as PNG files."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def png(pixels: np.ndarray) -> bytes:
    """A PNG of height x width x 3 (blue, green, red) or x 1 pixels."""
    height, width, depth = pixels.shape
    rows = pixels[..., ::-1] if depth == 3 else pixels[..., :1]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(rows).reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if depth == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def write_png(path: str, pixels: np.ndarray) -> None:
    """Write a file whole, wherever pyarrow can write; its folder is made."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    store.create_dir(root.rpartition("/")[0] or ".", recursive=True)
    with store.open_output_stream(root) as f:
        f.write(png(pixels))
