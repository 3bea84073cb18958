"""Single files through Spark's file systems, plain or compressed."""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from tabspark.sources.text import codec_of, decompress


class _Stream(io.RawIOBase):
    """A Java output stream as a Python file."""

    def __init__(self, stream: object) -> None:
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self.stream.write(bytearray(data))
        return len(data)

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()


def _place(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def open_output(spark: SparkSession, path: str, compression: str | None = "by name") -> Iterator[io.BufferedIOBase]:
    """A file to write to, compressed by its extension unless told."""
    import zstandard

    fs, p = _place(spark, path)
    kind = codec_of(path) if compression == "by name" else compression
    raw = io.BufferedWriter(_Stream(fs.create(p, True)), 1 << 20)
    try:
        if kind == "gzip":
            with gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
                yield out
        elif kind == "bzip2":
            with bz2.BZ2File(raw, "wb") as out:
                yield out
        elif kind == "zstd":
            with zstandard.ZstdCompressor().stream_writer(raw, closefd=False) as out:
                yield out
        else:
            yield raw
    finally:
        raw.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    with open_output(spark, path, None) as out:
        out.write(data)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole file, decompressed by its extension."""
    fs, p = _place(spark, path)
    stream = fs.open(p)
    try:
        return decompress(bytes(stream.readAllBytes()), codec_of(path))
    finally:
        stream.close()
