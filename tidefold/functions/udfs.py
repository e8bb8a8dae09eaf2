"""Arrow UDFs: compressed sizes and what builds on them."""

from __future__ import annotations

import base64
import gzip
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types are given as objects, so that executors can import this module without a session.
_PAYLOAD = T.StructType([
    T.StructField("compressed", T.BooleanType()), T.StructField("encoding", T.StringType()), T.StructField("original_size", T.LongType()),
    T.StructField("compressed_size", T.LongType()), T.StructField("ratio", T.DoubleType()), T.StructField("data", T.StringType()),
])

#: Codecs by name: bytes to bytes. Add to it to offer another.
CODECS: dict[str, Callable[[bytes], bytes]] = {
    "none": bytes,
    "zlib-6": lambda b: zlib.compress(b, 6),
    "gzip-6": lambda b: gzip.compress(b, 6, mtime=0),
    "gzip-9": lambda b: gzip.compress(b, 9, mtime=0),
}
try:
    import zstandard

    CODECS["zstd-1"] = lambda b: zstandard.ZstdCompressor(level=1).compress(b)
    CODECS["zstd-9"] = lambda b: zstandard.ZstdCompressor(level=9).compress(b)
except ImportError:
    pass


def decompress(codec: str, data: bytes) -> bytes:
    if codec.startswith("zstd"):
        return zstandard.ZstdDecompressor().decompress(data)
    return {"none": bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}[codec.split("-")[0]](data)


def compressed_size(codec: str = "zlib-6"):
    """binary -> long."""
    work = CODECS[codec]

    @F.pandas_udf(T.LongType())
    def size(data: pd.Series) -> pd.Series:
        return data.map(lambda b: None if b is None else len(work(b)))

    return size


@F.pandas_udf(T.DoubleType())
def ncd(a: pd.Series, b: pd.Series) -> pd.Series:
    """Normalised compression distance of two binaries with zlib; 0 where both compress to nothing."""

    def one(x, y):
        if x is None or y is None:
            return None
        cx, cy, both = (len(zlib.compress(z, 6)) for z in (x, y, x + y))
        return (both - min(cx, cy)) / max(cx, cy) if max(cx, cy) else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def compress_payload(codec: str = "zlib-6"):
    """string -> struct of a compressed payload with its sizes and ratio; null stays null."""
    work = CODECS[codec]

    @F.pandas_udf(_PAYLOAD)
    def pack(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            if t is None:
                rows.append((None,) * 6)
                continue
            raw = t.encode()
            data = work(raw)
            rows.append((True, codec, len(raw), len(data), round(len(raw) / max(1, len(data)), 4), base64.b64encode(data).decode()))
        return pd.DataFrame(rows, columns=["compressed", "encoding", "original_size", "compressed_size", "ratio", "data"])

    return pack


def vector_bytes(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float32).tobytes())


as_float_bytes = F.pandas_udf(vector_bytes, T.BinaryType())


def shuffle_bytes(data: bytes, width: int = 4) -> bytes:
    """Byte i of every element, then byte i + 1 of every element; a tail shorter than an element stays at the end."""
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(-1, width).T.tobytes() + data[n:]


def unshuffle_bytes(data: bytes, width: int = 4) -> bytes:
    n = len(data) // width * width
    return np.frombuffer(data[:n], np.uint8).reshape(width, -1).T.tobytes() + data[n:]


def _shuffled(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else shuffle_bytes(b))


def _unshuffled(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else unshuffle_bytes(b))


byte_shuffle = F.pandas_udf(_shuffled, T.BinaryType())
byte_unshuffle = F.pandas_udf(_unshuffled, T.BinaryType())
