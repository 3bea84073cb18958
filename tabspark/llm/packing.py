"""Arrays as compressed values of a row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; equal bytes of neighbours stand side by side."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        data = pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True) if planes else b""
        out += [struct.pack("<cQQ", a.dtype.char.encode(), len(a), len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, size = struct.unpack_from("<cQQ", data, at)
        dtype = np.dtype(kind.decode())
        at += 17
        planes = pa.Codec("zstd").decompress(data[at : at + size], n * dtype.itemsize, asbytes=True) if n else b""
        out.append(np.frombuffer(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T.tobytes(), dtype))
        at += size
    return out
